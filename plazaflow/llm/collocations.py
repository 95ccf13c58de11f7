"""Phrase collocations from count tries.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Every task reads its texts in shards of
bounded size; of a shard's words it builds a trie of limited depth, level by level as arrays (parent, word, count), and
writes it as rows (lang, phrase, count) in sorted order. The sorted rows of all shards are merged by ranges of phrases:
Spark deals them by sampled ranges, sorts each, and adjacent equal phrases are summed; rare ones go.

Counts fall from a phrase to a longer one, so tries grow along frequent pairs only; all counts of frequent phrases stay
exact. The first pass counts words. The second adds up pairs of frequent words by a number of 40 bits each, written in
sorted slices of a few bytes a pair, and merges those slice by slice. The third builds the tries. What is frequent comes to
the tasks as a bit table of fixed size (``BITS``); a collision of numbers or bits lets a rare phrase be counted and dropped later, and never loses one.

In the sorted order of phrases a phrase's first parts, its ancestors in the trie, stand before it: one walk gives the
counts of all left parts. Suffix links lead from a phrase to the same without its first word; they form the trie of the
reversed phrases, so the same walk in that order gives the counts of all right parts. A range that begins inside a
subtree gets the counts of its first phrase's ancestors (some rows for each range). Phrases are dealt by whole phrases, so
a frequent first or last word is spread over many ranges.

A phrase is dropped if a longer one that holds it occurs ``percent`` % as often. Null texts have no words, a null lang is
``und``; an empty table gives no rows. Repeated rows and ids count each. Other columns are ignored. Scores are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_batches, raw, release

#: Positions of a bit table, a prime: 16 MB. Numbers of pairs, a prime under 2**40.
BITS, PAIRS = 134_217_689, 1_099_511_627_689
#: Pairs that a slice holds of all shards together, about.
SLICE = 8_000_000
#: Words, and different words, of which a shard has about so many at most; bytes that are cut into words at once.
SHARD, VOCABULARY, CHUNK = 2_000_000, 500_000, 1 << 20
#: Stands for the end of a piece, and never in a text; between words of a stored phrase, with what escapes it in a word.
END, SEP, ESCAPE = b"\xff", b"\x00", b"\x01"
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
COUNTS = "lang string, phrase binary, n long"


def escaped(data: bytes) -> bytes:
    return data.replace(ESCAPE, b"\x01\x02").replace(SEP, b"\x01\x01") if SEP in data or ESCAPE in data else data


def shown(phrase: bytes) -> str:
    return phrase.replace(SEP, b" ").replace(b"\x01\x01", SEP).replace(b"\x01\x02", ESCAPE).decode("utf-8", "replace")


class _Numbers(dict):
    """Words numbered as they come; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(stream: bytes, numbers: _Numbers, reach: int) -> Iterator[tuple[np.ndarray, int]]:
    """A stream's words as numbers, in parts: each with how many of them begin phrases here; the rest, looked ahead at, do in the next part."""
    data, at, ahead = escaped(stream.translate(_TABLE)).replace(END, b" \xff "), 0, np.empty(0, np.int32)
    while at < len(data):
        cut = data.find(b" ", at + CHUNK)
        cut = len(data) if cut < 0 else cut
        words = data[at:cut].split()
        new = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        ahead = np.concatenate([ahead, new])
        own = len(ahead) if cut == len(data) else max(0, len(ahead) - reach + 1)
        yield ahead, own
        ahead, at = ahead[own:], cut


class Bits:
    """Which words, or pairs of neighbouring words, may be frequent."""

    def __init__(self, table: np.ndarray, pairs: bool) -> None:
        self.table, self.pairs = table, pairs

    def holds(self, at: np.ndarray) -> np.ndarray:
        return (self.table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def pair_number(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * 1_000_003 + second) % PAIRS


def word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    start = zlib.crc32(lang.encode("utf-8", "surrogatepass") + SEP)
    return np.fromiter((zlib.crc32(w, start) for w in words), np.int64, len(words))


def trie(lang: str, words: list[bytes], ids: np.ndarray, begins: np.ndarray, lowest: int, highest: int, bits: Bits | None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(phrases, counts) of the trie's levels ``lowest`` to ``highest`` over numbered words; 0 ends a piece, ``begins`` marks where phrases begin."""
    ids = np.concatenate([ids, np.zeros(highest, ids.dtype)])
    at = np.flatnonzero(begins & (ids[: len(begins)] != 0))
    pairs = bits is not None and bits.pairs
    follows = None
    if bits is not None:
        hashes = word_hash(lang, words)
        if pairs:
            follows = bits.holds(pair_number(hashes[ids[:-1]], hashes[ids[1:]]) % BITS)
            at = at[follows[at]]
        else:
            frequent = bits.holds(hashes % BITS)
            at = at[frequent[ids[at]]]
    node, parent_of, word_of = ids[at].astype(np.int64), None, None
    names = words
    for level in range(1, highest + 1):
        if level > 1:
            new = ids[at + level - 1]
            keep = new != 0
            if pairs:
                keep &= follows[at + level - 2]
            elif bits is not None:
                keep &= frequent[new]
            at, node, new = at[keep], node[keep], new[keep]
            found, node, counts = np.unique(node * len(words) + new, return_inverse=True, return_counts=True)
            parent_of, word_of = found // len(words), found % len(words)
            names = [names[p] + SEP + words[w] for p, w in zip(parent_of.tolist(), word_of.tolist(), strict=True)]
        else:
            counts = np.bincount(node, minlength=len(words)) if len(node) else np.zeros(len(words), np.int64)
        if level >= lowest:
            some = np.flatnonzero(counts)
            yield [names[k] for k in some.tolist()], counts[some]


Shard = dict[str, tuple[list[bytes], np.ndarray, np.ndarray]]


def read_shards(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[Shard]:
    """A task's texts in shards: by language the words, their numbers in text order, and where phrases of ``reach`` words may begin."""
    numbers: dict[str, _Numbers] = {}
    parts: dict[str, list[tuple[np.ndarray, int]]] = {}
    size = 0

    def shard() -> Shard:
        out = {}
        for lang in sorted(parts):
            ids = np.concatenate([np.append(i, np.int32(0)) for i, _ in parts[lang]])
            out[lang] = list(numbers[lang]), ids, np.concatenate([np.arange(len(i) + 1) < own for i, own in parts[lang]])
        parts.clear()
        return out

    for batch in batches:
        streams: dict[str, list[bytes]] = {}
        for text, lang in zip(raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            if text:
                streams.setdefault("und" if lang is None else lang, []).append(text)
        for lang, texts in streams.items():
            for part in numbered(END.join(texts), numbers.setdefault(lang, _Numbers()), reach):
                parts.setdefault(lang, []).append(part)
                size += len(part[0])
                if size >= SHARD:
                    yield shard()
                    size = 0
        if sum(map(len, numbers.values())) >= VOCABULARY:
            yield shard()
            numbers.clear()
            size = 0
    yield shard()


def tries(docs: DataFrame, lowest: int, highest: int, table: Broadcast | None) -> DataFrame:
    """(lang, phrase, n) rows of every shard's trie along frequent pairs, sorted in the shard; its root, the empty phrase, has the count of all words.

    ``docs`` has text and lang.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(table.value, True) if table is not None else None
        for shard in read_shards(batches, highest):
            for lang, (words, ids, begins) in shard.items():
                rows: list[tuple[bytes, int]] = [(b"", int((begins & (ids != 0)).sum()))] if lowest == 1 else []
                for phrases, counts in trie(lang, words, ids, begins, lowest, highest, bits):
                    rows += zip(phrases, counts.tolist(), strict=True)
                rows.sort()
                for k in range(0, len(rows), 20_000):
                    some = rows[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([p for p, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["lang", "phrase", "n"])

    return in_batches(docs, work, COUNTS)


def packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers and their counts; steps between numbers are stored byte by byte, so that high bytes take no room."""
    steps = np.diff(numbers, prepend=0)
    return zstandard.ZstdCompressor(1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(12, -1)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.int64).ravel()), np.ascontiguousarray(planes[8:].T).view(np.uint32).ravel().astype(np.int64)


def summed(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(numbers, kind="stable")
    numbers, counts = numbers[order], counts[order]
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[first], np.add.reduceat(counts, first) if len(first) else counts


def frequent_pairs(docs: DataFrame, words: Broadcast, slices: int, min_count: int) -> DataFrame:
    """(place): the places in a bit table of the pairs of neighbouring words that occur ``min_count`` times, and of what shares a number with them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(words.value, False)
        for shard in read_shards(batches, 2):
            found = []
            for lang, (known, ids, begins) in shard.items():
                hashes = word_hash(lang, known)
                frequent = bits.holds(hashes % BITS) & (np.arange(len(known)) > 0)
                at = np.flatnonzero((begins & frequent[ids])[:-1] & frequent[ids[1:]])
                found.append(pair_number(hashes[ids[at]], hashes[ids[at + 1]]))
            if not found:
                continue
            numbers, counts = np.unique(np.concatenate(found), return_counts=True)
            order = np.argsort(numbers % slices, kind="stable")
            numbers, counts = numbers[order], counts[order]
            which, first = np.unique(numbers % slices, return_index=True)
            blobs = [packed(numbers[a:b], counts[a:b]) for a, b in pairwise([*first.tolist(), len(numbers)])]
            for k in range(0, len(blobs), 500):
                yield pa.RecordBatch.from_arrays([pa.array(which[k : k + 500], pa.int64()), pa.array(blobs[k : k + 500], pa.binary())], ["slice", "pairs"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, size = None, [], 0

        def places() -> pa.RecordBatch:
            numbers, counts = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(np.unique(numbers[counts >= min_count] % BITS))], ["place"])

        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != here and held:
                    yield places()
                    held, size = [], 0
                here = number
                held.append(unpacked(blob))
                size += len(held[-1][0])
                if size > 2 * SLICE and len(held) > 1:
                    # repeated pairs of a slice are added up before it has all its parts
                    held = [summed(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                    size = len(held[0][0]) // 2
        if held:
            yield places()

    parts = in_batches(docs, work, "slice long, pairs binary")
    return in_batches(parts.repartition("slice").sortWithinPartitions("slice"), merge, "place long")


def merged(runs: DataFrame, min_count: int) -> DataFrame:
    """Sorted runs (lang, phrase, n), dealt by phrases, merged: sums of at least ``min_count``, and those of roots."""

    def kept(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pc.or_(pc.greater_equal(rows.column(2), min_count), pc.equal(pc.binary_length(rows.column(1)), 0)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([held, batch]).combine_chunks() if held is not None else pa.Table.from_batches([batch])
            lang, phrase, n = (both.column(c).combine_chunks() for c in range(3))
            new = np.ones(len(both), bool)
            if len(both) > 1:
                here, before = slice(1, None), slice(0, -1)
                differs = pc.or_(pc.not_equal(lang[here], lang[before]), pc.not_equal(phrase[here], phrase[before]))
                new[1:] = differs.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            sums = np.add.reduceat(n.to_numpy(), first)
            every = pa.RecordBatch.from_arrays([lang.take(pa.array(first)), phrase.take(pa.array(first)), pa.array(sums)], ["lang", "phrase", "n"])
            # the last may go on in the next batch
            held = every.slice(len(first) - 1)
            yield kept(every.slice(0, len(first) - 1))
        if held is not None:
            yield kept(held)

    return in_batches(runs.sortWithinPartitions("lang", "phrase"), work, COUNTS)


def word_places(frequent: DataFrame) -> DataFrame:
    """(place): the places of words in a bit table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [int(word_hash(lang, [w])[0]) % BITS for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], ["place"])

    return in_batches(frequent.select("lang", "phrase"), work, "place long")


def bit_table(places: DataFrame) -> np.ndarray:
    """A table with the bits at these places set; at most ``BITS`` / 64 numbers come to the driver."""
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    rows = places.select(F.shiftright("place", 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(BITS // 64 + 1, np.uint64)
    table[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def counted(docs: DataFrame, longest: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases up to ``longest`` words that occur ``min_count`` times, and (lang, total) of all words."""
    spark = docs.sparkSession
    words = durable(merged(tries(docs, 1, 1, None).repartition("lang", "phrase"), min_count))
    totals = words.where(F.length("phrase") == 0).select("lang", F.col("n").alias("total"))
    words = words.where(F.length("phrase") > 0)
    slices = int((totals.agg(F.sum("total")).first()[0] or 0) // SLICE) + 64
    frequent = spark.sparkContext.broadcast(bit_table(word_places(words)))
    pairs = spark.sparkContext.broadcast(bit_table(frequent_pairs(docs, frequent, slices, min_count)))
    release(spark)
    # the ranges are sampled from a first reading; that costs less than to store all runs between the two
    phrases = durable(merged(tries(docs, 2, longest, pairs).repartitionByRange("lang", "phrase"), min_count))
    for table in (frequent, pairs):
        table.unpersist()
    release(spark)
    return words.unionByName(phrases), totals


def with_parts(phrases: DataFrame, key: str, out: str) -> DataFrame:
    """``phrases`` with ``out``: the counts of all proper beginnings of ``key`` (words joined by ``SEP``), shortest first.

    All beginnings of a key are keys. Every range of keys is walked in order; the ancestors of its first are looked up.
    """
    ordered = durable(phrases.repartitionByRange("lang", key).sortWithinPartitions("lang", key).withColumn("_range", F.spark_partition_id()))
    firsts = ordered.groupBy("_range").agg(F.min(F.struct("lang", key)).alias("f")).select("_range", "f.*").collect()
    asked = [(r["_range"], r.lang, b) for r in firsts for w in [bytes(r[key]).split(SEP)] for b in (SEP.join(w[:k]) for k in range(1, len(w)))]
    known: dict[tuple[int, bytes], int] = {}
    if asked:
        wanted = ordered.sparkSession.createDataFrame([(a, lang, bytearray(b)) for a, lang, b in asked], f"_at int, lang string, {key} binary")
        known = {(r["_at"], bytes(r[key])): r.n for r in ordered.select("lang", key, "n").join(F.broadcast(wanted), ["lang", key]).collect()}
    names = [*phrases.columns, out]
    at_key, at_n, at_range = (ordered.columns.index(c) for c in (key, "n", "_range"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[int] = []
        begun = False
        for batch in batches:
            lists = []
            for phrase, n, place in zip(batch.column(at_key).to_pylist(), batch.column(at_n).to_pylist(), batch.column(at_range).to_pylist(), strict=True):
                words = phrase.split(SEP)
                if not begun:
                    begun, counts = True, [known[place, SEP.join(words[:k])] for k in range(1, len(words))]
                del counts[len(words) - 1 :]
                lists.append(list(counts))
                counts.append(n)
            kept = [batch.column(k) for k in range(batch.num_columns) if k != at_range]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.list_(pa.int64()))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in phrases.schema) + f", `{out}` array<bigint>"
    return in_batches(ordered, work, schema)


def candidates(phrases: DataFrame) -> DataFrame:
    """Scored phrases of two words and more: the cut into two parts with the lowest score, ties to the shorter first part.

    ``phrases`` has lang, phrase, n, total and the counts of its parts, lefts and rights, shortest first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                m = len(r["lefts"]) + 1
                if m > 1:
                    score, k = min((1000 * r["n"] * r["total"] // (r["lefts"][k - 1] * r["rights"][m - k - 1]), k) for k in range(1, m))
                    words = r["phrase"].split(SEP)
                    inner = [SEP.join(words[i : i + size]) for size in range(2, m) for i in range(m - size + 1)]
                    rows.append((r["lang"], r["phrase"], shown(r["phrase"]), r["n"], r["lefts"][k - 1], r["rights"][m - k - 1], r["total"], score, inner))
            kinds = [pa.string(), pa.binary(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.binary())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "key", "phrase", "a", "l", "r", "n", "score", "inner"])

    return in_batches(phrases.select("lang", "phrase", "n", "total", "lefts", "rights"), work, "lang string, key binary, phrase string, a long, l long, r long, n long, score long, inner array<binary>")


def reversed_phrases(df: DataFrame) -> DataFrame:
    """``df`` with ``backwards``: the phrase's words from last to first."""
    at, names = df.columns.index("phrase"), [*df.columns, "backwards"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [SEP.join(p.split(SEP)[::-1]) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", backwards binary"
    return in_batches(df, work, schema)


def collocations(docs: DataFrame, *, longest: int = 5, min_count: int = 100, percent: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to ``longest`` words that occur ``min_count`` times and in no longer one ``percent`` % as often."""
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    every, totals = counted(source, longest, min_count)
    left = with_parts(every.join(totals, "lang"), "phrase", "lefts")
    found = durable(candidates(with_parts(reversed_phrases(left), "backwards", "rights")))
    outer = found.select("lang", "a", F.explode("inner").alias("key")).groupBy("lang", "key").agg(F.max("a").alias("outer"))
    kept = found.join(outer, ["lang", "key"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < percent * F.col("a")))
    return kept.select("lang", "phrase", "a", "l", "r", "n", "score")


def first_of_each(found: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` collocations of each language, with ``rank``, from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
