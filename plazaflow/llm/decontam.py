"""Benchmark decontamination by a positional inverted index of the training text.

The index is partitioned by document: each task turns a run of documents into one shard, a row that holds the shard's
terms, for every term the ascending list of its positions, and a directory of the shard's documents. All training tokens
are in it and nothing of a benchmark, so one stored index serves any number of benchmarks. A search sends test windows to
the shards; in each shard it takes a window's terms from the rarest, shifts their position lists by their offsets and
intersects them. Nothing is shuffled, memory is bounded by a shard, and no two documents meet.

Words: A-Z lower-cased, then maximal runs of 0-9, a-z and non-ASCII characters. Null and empty texts have no words.
Items without an id or without words match nothing; repeated items count once. Each document row gives one row, repeated
or null ids included. Columns other than the id and the text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, durable, in_batches, raw

INDEX = "shard_part int, first long, doc_ids array<long>, n_words array<long>, terms binary, counts binary, positions binary"
FOUND = "part int, ordinal long, doc_id long, n_words long, items array<long>, near array<long>, spans array<struct<start:long,end:long>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class Windows:
    """The test windows of some items: distinct runs of term numbers, and the items of each, as flat arrays."""

    def __init__(self, items: list[tuple[int, bytes | None]], size: int) -> None:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        grids, owners = [], []
        for item_id, text in items:
            found = words(text)
            ids = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
            if len(ids):
                runs = np.lib.stride_tricks.sliding_window_view(ids, min(size, len(ids)))
                grids.append(np.pad(runs, ((0, 0), (0, size - runs.shape[1])), constant_values=-1))
                owners.append(np.full(len(runs), item_id, np.int64))
        self.blob, self.n_terms = b" ".join(number), len(number)
        self.grid, inverse = np.unique(np.concatenate(grids), axis=0, return_inverse=True) if grids else (np.empty((0, size), np.int32), np.empty(0, np.int64))
        # (window, item) without repeats, by window
        pairs = np.unique(np.c_[inverse.reshape(-1), np.concatenate(owners) if owners else np.empty(0, np.int64)], axis=0)
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.grid) + 1))
        self.items = pairs[:, 1].copy()

    def owners(self, window: int) -> list[int]:
        return self.items[self.bounds[window] : self.bounds[window + 1]].tolist()

    def terms(self) -> dict[bytes, int]:
        return dict(zip(self.blob.split(), count()))


def build_index(docs: DataFrame, *, shard_words: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings of all words of ``docs``: one row per shard of about ``shard_words`` words, whole documents each.

    Positions count a shard's words, with one place left free between documents, so that no run crosses two of them.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        part, first = TaskContext.get().partitionId(), 0
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        doc_ids, lengths, ids, places, at = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            order = np.argsort(flat, kind="stable")
            where = np.concatenate(places)[order]
            counts = np.bincount(flat, minlength=len(number)).astype(np.int32)
            steps = np.diff(where, prepend=0).astype(np.int32)
            row = [[part], [first], [doc_ids], [lengths], *([pack.compress(x)] for x in (b" ".join(number), counts.tobytes(), steps.tobytes()))]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["shard_part", "first", "doc_ids", "n_words", "terms", "counts", "positions"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                found = words(text)
                doc_ids.append(doc_id)
                lengths.append(len(found))
                ids.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                places.append(np.arange(at, at + len(found)))
                at += len(found) + 1
                if at >= shard_words:
                    yield shard()
                    first += len(doc_ids)
                    doc_ids, lengths, ids, places, at = [], [], [], [], 0
                    number.clear()
                    number.default_factory = count().__next__
        if doc_ids:
            yield shard()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return durable(in_batches(source, shards, INDEX))


def _intersect(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Starts at which every (offset, positions) list, given from the rarest on, has its position."""
    offset, rarest = lists[0]
    starts = rarest - offset
    for offset, positions in lists[1:]:
        wanted = starts + offset
        at = np.searchsorted(positions, wanted)
        at[at == len(positions)] = 0
        starts = starts[positions[at] == wanted]
        if not len(starts):
            break
    return starts


def _within(lists: list[np.ndarray], span: int) -> np.ndarray:
    """Positions of the rarest list around which every other list has a position, all within ``span`` words."""
    out, likely = [], lists[0]
    for x in lists[1:]:
        # one look-up a list leaves the few places where all lists have something near
        at = np.searchsorted(x, likely - span + 1)
        likely = likely[(at < len(x)) & (x[np.minimum(at, len(x) - 1)] < likely + span)]
    for p in likely.tolist():
        near = sorted((int(q), k) for k, x in enumerate(lists) for q in x[bisect_left(x, p - span + 1) : bisect_left(x, p + span)])
        held: dict[int, int] = {}
        for q, k in near:
            held[k] = q
            if len(held) == len(lists) and q - min(held.values()) < span:
                out.append(p)
                break
    return np.array(out, np.int64)


def search(index: DataFrame, windows: Windows, *, slop: int | None = None, every: bool = True) -> DataFrame:
    """Per indexed document (with ``every`` false, only where something is found): the items with an exact window in it, and the spans of words that windows cover.

    With ``slop``, ``near`` lists the items of which all terms of a window stand, in any order, within the window's
    length plus ``slop`` words (exact matches included); without, it is empty.
    """
    held = index.sparkSession.sparkContext.broadcast(windows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, unpack = held.value, zstandard.ZstdDecompressor()
        get = test.terms().get
        for batch in batches:
            for row in batch.to_pylist():
                lists_of = _postings(row, unpack, get, test.n_terms)
                lengths = np.array(row["n_words"], np.int64)
                starts_of = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
                items: list[set[int]] = [set() for _ in lengths]
                near: list[set[int]] = [set() for _ in lengths]
                cover = np.zeros(int(lengths.sum()) + len(lengths) + 1, np.int32)
                counts, ends, positions = lists_of
                for w in np.flatnonzero(counts[test.grid].min(axis=1) > 0).tolist() if len(test.grid) else ():
                    run = [t for t in test.grid[w].tolist() if t >= 0]
                    order = sorted(range(len(run)), key=lambda k: counts[run[k]])
                    lists = [(k, positions[ends[run[k]] - counts[run[k]] : ends[run[k]]]) for k in order]
                    starts = _intersect(lists)
                    if len(starts):
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + len(run), -1)
                        for d in np.unique(np.searchsorted(starts_of, starts, side="right") - 1).tolist():
                            items[d].update(test.owners(w))
                    if slop is not None:
                        terms = {run[k]: x for k, x in lists}
                        for p in _within(list(terms.values()), len(run) + slop).tolist():
                            d = int(np.searchsorted(starts_of, p, side="right")) - 1
                            lo, hi = starts_of[d], starts_of[d] + lengths[d]
                            inside = [x[(x >= lo) & (x < hi)] for x in terms.values()]
                            if all(map(len, inside)) and len(_within([np.array([p]), *inside[1:]], len(run) + slop)):
                                near[d].update(test.owners(w))
                hit = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
                begin, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
                spans: list[list[dict[str, int]]] = [[] for _ in lengths]
                for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                    d = int(np.searchsorted(starts_of, s, side="right")) - 1
                    spans[d].append({"start": s - int(starts_of[d]), "end": e - int(starts_of[d])})
                told = [d for d in range(len(lengths)) if every or items[d] or near[d]]
                for at in range(0, len(told), 2000):
                    yield _rows(row, told[at : at + 2000], lengths, items, near, spans)

    return index.mapInArrow(find, FOUND)


def _postings(row: dict, unpack: zstandard.ZstdDecompressor, get: Callable, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test term (and, last, for none) its count in a shard and the end of its list in the shard's positions."""
    found = np.fromiter(map(get, unpack.decompress(row["terms"]).split(), repeat(-1)), np.int64)
    stored = np.frombuffer(unpack.decompress(row["counts"]), np.int32).astype(np.int64)
    positions = np.cumsum(np.frombuffer(unpack.decompress(row["positions"]), np.int32), dtype=np.int64)
    known = found >= 0
    counts, ends = np.zeros(n_terms + 1, np.int64), np.zeros(n_terms + 1, np.int64)
    counts[found[known]], ends[found[known]] = stored[known], np.cumsum(stored)[known]
    counts[-1] = 2**31  # fills the windows of shorter items
    return counts, ends, positions


def _rows(row: dict, told: list[int], lengths: np.ndarray, items: list[set[int]], near: list[set[int]], spans: list[list[dict]]) -> pa.RecordBatch:
    columns = [
        pa.array([row["shard_part"]] * len(told), pa.int32()),
        pa.array([row["first"] + d for d in told], pa.int64()),
        pa.array([row["doc_ids"][d] for d in told], pa.int64()),
        pa.array(lengths[told], pa.int64()),
        pa.array([sorted(items[d]) for d in told], pa.list_(pa.int64())),
        pa.array([sorted(near[d]) for d in told], pa.list_(pa.int64())),
        pa.array([spans[d] for d in told], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "ordinal", "doc_id", "n_words", "items", "near", "spans"])


def _pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """The items' texts (item_id, text), long ones in pieces of about ``most`` characters that share ``window`` - 1 words with the next."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                found = words(text)
                step = len(found) if len(text) <= most else max(window, len(found) * most // len(text))
                for at in range(0, max(1, len(found) - window + 1), max(1, step)):
                    ids.append(item_id)
                    texts.append(b" ".join(found[at : at + step + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["item_id", "text"])

    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return durable(in_batches(items, work, "item_id long, text binary").distinct())


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    slop: int | None = None,
    block_chars: int = 2_000_000,
    shard_words: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """Matches of all benchmark items in each document: doc_id, n_words, items, near and covered spans.

    ``index`` is a stored index of ``docs`` (:func:`build_index`), where there is one already. The test side is sent to the
    executors in blocks of about ``block_chars`` bytes, a long item in several, which bounds a block's terms and windows at
    some 60 MB in a worker. Every block is a pass over the same stored index, so rows of passes belong together by shard.
    """
    index = build_index(docs, shard_words=shard_words, id_col=id_col, text_col=text_col) if index is None else index
    items = _pieces(benchmark, window, block_chars // 4)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    passes = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        passes.append(search(index, Windows(sorted((r.item_id, bytes(r.text)) for r in rows), window), slop=slop, every=blocks == 1))
    if blocks == 1:
        return passes[0].drop("part", "ordinal")
    none = [F.expr(f"cast(array() as {t})").alias(c) for c, t in (("items", "array<bigint>"), ("near", "array<bigint>"), ("spans", "array<struct<start:bigint,end:bigint>>"))]
    listed = index.select(F.col("shard_part").alias("part"), "first", F.posexplode(F.arrays_zip("doc_ids", "n_words")))
    every = listed.select("part", (F.col("first") + F.col("pos")).alias("ordinal"), F.col("col.doc_ids").alias("doc_id"), F.col("col.n_words").alias("n_words"), *none)
    for more in passes:
        every = every.unionByName(more)
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    joined = every.groupBy("part", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), both("items"), both("near"), both("spans"))
    # spans of different passes may overlap: fold them, in order, into disjoint ones
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    fold = F.aggregate(
        "spans",
        empty,
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))),
    )
    return joined.withColumn("spans", fold).drop("part", "ordinal")


def digest(found: DataFrame, *, near: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from :func:`contamination`'s rows; with ``near`` also n_near and near_items."""
    listed = lambda c: F.array_join(F.array_sort(F.transform(c, lambda i: i.cast("string"))), ",")
    names = listed("items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        *((F.size("near").cast("long").alias("n_near"), listed("near").alias("near_items")) if near else ()),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs``, all columns whatever their names, less the rows whose ``text`` holds a benchmark window.

    Rows go by their text, known by a 64-bit hash, so ids don't matter. The hashes of contaminated texts are broadcast up to
    ``broadcast_rows`` of them (8 bytes each), beyond that joined by a shuffle; both ways give the same rows.
    """
    key = F.xxhash64("text")
    found = contamination(docs.select(key.alias("key"), "text"), benchmark, window=window, id_col="key")
    leaks = durable(found.where(F.size("items") > 0).select(F.col("doc_id").alias("key")).distinct())
    few = leaks.limit(broadcast_rows + 1).count() <= broadcast_rows
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return carried.join(F.broadcast(leaks) if few else leaks, "key", "left_anti").select("row.*")
