"""Near-duplicate groups by MinHash: many universal minima, banding, verification, alternating star components.

1. Each text becomes its set of word shingles, of which ``bands * rows`` universal hash minima are kept. Texts with the
   same set are one vertex from here on, so exact copies cost nothing more.
2. Banding: vertices that share a band's key are candidates. A bucket is never expanded into pairs. Its smallest member
   serves as hub: each vertex is verified against the hub that its signature puts nearest.
3. What that leaves unconnected within a bucket is compared signature against signature, in blocks of bounded size, the
   members outside the bucket's main component against all. A block gives only a spanning forest of its likely pairs, so
   no pairs are listed. The forests' families are then compared once more in blocks, now with their texts, and each likely
   pair of different components is confirmed or refuted on the full sets. No bucket is capped, and no link that would
   join two components is skipped.
4. Every link is confirmed on the full shingle sets of both texts.
5. Components come from alternating large-star and small-star steps; a hot vertex costs one pre-aggregated minimum.

A signature of 120 minima misses a pair at the threshold 0.85 in all of 24 bands of 5 with a chance of 7e-7; the signature
test allows four standard deviations. At 0.80 the chance is 7e-5. Both fall fast above the threshold, and only matter for
a text without another link into its group.

Words: A-Z lower-cased, split at ASCII white space. A text of fewer words than a shingle is one shingle; null, empty and
blank texts have none and are linked with nothing. Rows with one id are one vertex and all come back; rows without an
id are linked with nothing and kept, with a null component. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, in_batches, raw, release

FEATURES = "doc_id long, n_shingles long, print binary, signature binary, keys array<long>"
#: Words whose hashes a task keeps, and the longest of them.
KNOWN_WORDS, KNOWN_BYTES = 50_000, 40
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def shingles(text: bytes | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles; ``known`` keeps words' hashes while a task runs."""
    words = text.lower().split() if text else []
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    get, codes = known.get, []
    for word in words:
        code = get(word)
        if code is None:
            code = xxhash.xxh3_64_intdigest(word)
            if len(word) <= KNOWN_BYTES:
                known[word] = code
        codes.append(code)
    h = np.array(codes, np.uint64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _M[k % 3]
        out ^= out >> np.uint64(29)
    out *= _M[3]
    return np.unique(out ^ (out >> np.uint64(32)))


def universal(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``count`` multiply-add hash functions modulo 2**64."""
    drawn = np.random.default_rng(seed).integers(0, 2**64, (2, count), np.uint64)
    return (drawn[0] | np.uint64(1))[:, None], drawn[1][:, None]


def minima(hashes: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = functions
    least = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024] * a + b).min(axis=1), out=least)
    return least


def features(docs: DataFrame, *, width: int, bands: int, rows: int, seed: int = 11) -> DataFrame:
    """Each row's shingle count, set fingerprint, one-byte signature and band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions, known = universal(bands * rows, seed), {}
        for batch in batches:
            sizes, prints, signatures, keys = [], [], [], []
            for text in raw(batch.column(1)):
                found = shingles(text, width, known)
                sizes.append(len(found))
                if not len(found):
                    prints.append(None)
                    signatures.append(None)
                    keys.append(None)
                    continue
                least = minima(found, functions)
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                signatures.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
                grid = least.reshape(bands, rows)
                keys.append([xxhash.xxh3_64_intdigest(grid[k].tobytes(), seed=k) - 2**63 for k in range(bands)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "print", "signature", "keys"],
            )

    return in_batches(docs, work, FEATURES)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the share of equal signature bytes, less what chance makes equal."""
    equal = (a == b).mean(axis=-1)
    return (equal - 1 / 256) / (1 - 1 / 256)


def _least(bands: int, rows: int, similarity: float) -> float:
    """The estimate that a pair at the threshold falls short of by chance only beyond four standard deviations."""
    return similarity - 4 * (similarity * (1 - similarity) / (bands * rows)) ** 0.5


def _likely(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures may reach the threshold, with the estimate."""
    both = pairs.join(signatures.withColumnsRenamed({"id": "a", "signature": "sa"}), "a").join(signatures.withColumnsRenamed({"id": "b", "signature": "sb"}), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            near = estimate(sa, sb)
            kept = pa.array(np.flatnonzero(near >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(near).take(kept)], ["a", "b", "near"])

    return both.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long, near double")


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """Rows (key, id, comp) of keys with several components, dealt into cells (key, lc, rc) with ``side`` 0 or 1.

    All rows outside a key's largest component stand on the left, all rows on the right; each side is cut into blocks of
    about ``cell`` rows, and a cell is a block of either side. So every pair of different components meets in a cell, and
    pairs within the largest component do not.
    """
    sizes = rows.groupBy("key", "comp").count()
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most")).where("n > most")
    blocks = lambda n: F.ceil(n / F.lit(cell)).cast("int")
    open_ = rows.join(main, "key").withColumns({"nl": blocks(F.col("n") - F.col("most")), "nr": blocks(F.col("n"))})
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = open_.where("comp <> main").select("key", "id", "comp", F.lit(0).alias("side"), slot("nl").alias("lc"), every("nr").alias("rc"))
    right = open_.select("key", "id", "comp", F.lit(1).alias("side"), every("nl").alias("lc"), slot("nr").alias("rc"))
    return left.unionByName(right)


def _by_cell(cells: DataFrame, columns: list[str], pairs: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """Distinct pairs (a, b), a > b, that ``pairs`` finds in each cell from its rows' ids, components, sides and ``columns``."""
    names = ["key", "lc", "rc", "side", "id", "comp", *columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            _, _, _, side, ids, comps, *rest = zip(*held, strict=True)
            found = sorted({(max(p), min(p)) for p in pairs(np.array(ids), np.array(comps), np.array(side) == 0, *rest)})
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                if held and row[:3] != held[-1][:3]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    spread = cells.repartition("key", "lc", "rc").sortWithinPartitions("key", "lc", "rc")
    return in_batches(spread.select(*names), work, "a long, b long").distinct()


def _spanning(least: float) -> Callable[..., list[tuple[int, int]]]:
    """Edges that connect a cell's rows as its pairs of different components with likely signatures do, without cycles.

    A cell of n rows gives fewer than n edges, however many such pairs it has.
    """

    def pairs(ids: np.ndarray, comps: np.ndarray, left: np.ndarray, signatures: tuple[bytes, ...]) -> list[tuple[int, int]]:
        s = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(ids), -1)
        right = np.flatnonzero(~left)
        _, vertex = np.unique(ids, return_inverse=True)
        tree = np.arange(vertex.max() + 1)
        out = []
        for i in np.flatnonzero(left):
            near = right[(estimate(s[right], s[i]) >= least) & (comps[right] != comps[i])]
            of = tree[vertex[near]]
            for t, at in zip(*np.unique(of, return_index=True), strict=True):
                if t != tree[vertex[i]]:
                    out.append((int(ids[i]), int(ids[near[at]])))
                    tree[tree == t] = tree[vertex[i]]
        return out

    return pairs


def _links(least: float, width: int, percent: int) -> Callable[..., list[tuple[int, int]]]:
    """Confirmed links that join the components of a cell's rows: each left row is held against the others by falling estimate.

    A pair whose components are already joined in the cell is not looked at again; all others with likely signatures are
    confirmed or refuted on their full sets.
    """

    def pairs(ids: np.ndarray, comps: np.ndarray, left: np.ndarray, signatures: tuple[bytes, ...], texts: tuple[str, ...]) -> list[tuple[int, int]]:
        s = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(ids), -1)
        right = np.flatnonzero(~left)
        sets: dict[int, np.ndarray] = {}
        known: dict[bytes, int] = {}
        comp = comps.copy()
        out = []

        def of(k: int) -> np.ndarray:
            if ids[k] not in sets:
                sets[ids[k]] = shingles(texts[k].encode(), width, known)
            return sets[ids[k]]

        for i in np.flatnonzero(left):
            near = estimate(s[right], s[i])
            order = np.argsort(-near, kind="stable")
            for k in right[order[: int((near >= least).sum())]]:
                if comp[k] == comp[i]:
                    continue
                a, b = of(i), of(k)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    out.append((int(ids[i]), int(ids[k])))
                    comp[comp == comp[k]] = comp[i]
        return out

    return pairs


def _once(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) of ``texts`` whose ids are among ``ids``, repeated rows once."""
    needed = texts.join(ids, "id", "left_semi").withColumn("hash", F.xxhash64("text"))
    return needed.groupBy("id", "hash").agg(F.min("text").alias("text")).drop("hash")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold; texts travel only for these pairs."""
    texts = docs.where("doc_id is not null and text is not null").withColumnRenamed("doc_id", "id")
    needed = _once(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    both = pairs.select("a", "b").join(needed.withColumnsRenamed({"id": "b", "text": "tb"}), "b").join(needed.withColumnsRenamed({"id": "a", "text": "ta"}), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, np.ndarray] = {}
        known: dict[bytes, int] = {}

        def of(text: bytes) -> np.ndarray:
            found = recent.get(text)
            if found is None:
                if len(recent) >= 64:
                    recent.clear()
                found = recent[text] = shingles(text, width, known)
            return found

        for batch in batches:
            kept = []
            for k, (ta, tb) in enumerate(zip(raw(batch.column(2)), raw(batch.column(3)), strict=True)):
                sa, sb = shingles(ta, width, known), of(tb)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                if common and 100 * common >= percent * (len(sa) + len(sb) - common):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(kept, pa.int64())) for i in (0, 1)], ["a", "b"])

    return in_batches(both.select("a", "b", "ta", "tb"), work, "a long, b long")


def _settled(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a table of ids, made durable in as few partitions as about ``rows`` rows need, so that it doesn't cost many files.

    What is computed from texts is made durable first, so that the texts are read by as many tasks as there are.
    """
    return durable(df.coalesce(max(8, rows // 50_000 + 1)))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each vertex of ``edges`` (a, b) reaches, by alternating star steps.

    Large-star hangs a vertex's larger neighbours on its smallest one, small-star its smaller ones and itself. Both take
    a minimum by vertex, aggregated before the shuffle, and a join back. They end when a round changes no edge.
    """
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    current = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(current)
    while True:
        rows = before[0]
        few = max(8, rows // 50_000 + 1)
        ways = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(few)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = _settled(small.unionByName(down.withColumnRenamed("m", "b")).coalesce(few).distinct(), rows)
        after = mark(current)
        if after == before:
            break
        before = after
    stars = current.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "id")
    return stars.unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 5,
    cell: int = 1000,
    text_cell: int = 150,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    A link joins texts whose shingle sets' intersection is at least ``percent`` per cent of their union. ``cell`` and
    ``text_cell`` bound the rows of either side that step 3 compares at once, by signature and by text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows_of = durable(features(source, width=width, bands=bands, rows=rows))
    least = _least(bands, rows, percent / 100)
    with_set = rows_of.where("doc_id is not null and print is not null")
    vertices = durable(with_set.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("keys").alias("keys")))
    signatures = vertices.select("id", "signature")

    spread = vertices.select("id", F.explode("keys").alias("key"))
    hubs = spread.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last")
    members = durable(spread.join(hubs.select("key", "hub"), "key"))

    stars = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    likely = _likely(stars, signatures, least)
    first = durable(likely.groupBy("a").agg(F.max_by("b", F.struct("near", -F.col("b"))).alias("b")))
    count = first.count()
    links = _settled(durable(_confirmed(first, source, width, percent)), count)
    release(docs.sparkSession)
    labels = _settled(components(links), count)

    def placed(frame: DataFrame) -> DataFrame:
        """``frame`` (key, id) with each id's component so far."""
        return frame.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))

    apart = _cells(placed(members.select("key", "id")), cell).join(signatures, "id")
    tree = durable(_by_cell(apart, ["signature"], _spanning(least)))
    count += tree.count()
    if not tree.isEmpty():
        # what may be similar across components forms families; their texts travel once for each block they meet
        families = _settled(components(tree), count).select("id", F.col("comp").alias("key"))
        open_ = _cells(placed(families), text_cell).join(signatures, "id")
        texts = source.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
        needed = _once(texts, families.select("id"))
        more = _settled(durable(_by_cell(open_.join(needed, "id"), ["signature", "text"], _links(least, width, percent))), count)
        release(docs.sparkSession)
        if not more.isEmpty():
            stars = labels.select(F.col("id").alias("a"), F.col("comp").alias("b")).where("a <> b")
            labels = _settled(components(stars.unionByName(more)), count)

    final = vertices.select("print", "id").join(labels, "id", "left").select("print", F.coalesce("comp", "id").alias("component"))
    out = rows_of.select("doc_id", "n_shingles", "print").join(final, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def columns_hashed(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` as what can be hashed: a column that has a map or a variant in it as its text."""
    plain = lambda kind: not any(w in kind.lower() for w in ("map<", "variant", "interval"))
    return [F.col(f"`{f.name}`") if plain(f.dataType.simpleString()) else F.col(f"`{f.name}`").cast("string") for f in docs.schema]


def one_of_each_group(docs: DataFrame, *, width: int = 5, percent: int = 80, **options: int) -> DataFrame:
    """``docs``, all columns whatever their names, with one row of each near-duplicate group: that of the smallest id.

    Rows are compared by their texts, so rows that share an id are not taken for copies and rows without an id are compared
    too; they stay only where no row of the group has an id. Of rows with the same id and text one stays. Rows without a word
    are linked with nothing and stay all. Rows are known by a 64-bit hash of id and text; where a second one tells two rows of
    one hash apart, both stay.
    """
    spoken = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # copies with ids of their own have keys of their own, so a group of copies is no hot key
    key, check = F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text").alias("check")
    place = ["key", "check", "none", "id"]
    named = [key, check, F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")]
    groups = near_duplicates(docs.where(spoken).select(key, "text"), width=width, percent=percent, id_col="key", **options)
    of_key = groups.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"))
    slim = docs.where(spoken).select(*named).groupBy(*place).agg(F.count("*"))
    by_key = slim.groupBy("key").agg(F.min(F.struct("none", "id", "check")).alias("least"), (F.min(F.struct("check", "none", "id")) < F.max(F.struct("check", "none", "id"))).alias("two"))
    known = durable(by_key.join(of_key, "key"))
    del groups, of_key, by_key
    release(docs.sparkSession)
    # of a group the row of the smallest id, and all rows of a hash that two texts have
    first = known.groupBy("component").agg(F.min(F.struct("least.none", "least.id", "least.check", "key")).alias("w"))
    stay = first.select(*(f"w.{c}" for c in place)).unionByName(slim.join(known.where("two").select("key"), "key").select(*place)).distinct()
    # repeated rows meet in their tasks before they travel
    one = docs.where(spoken).select(*named, F.xxhash64(*columns_hashed(docs)).alias("tie"), F.struct(*columns).alias("row")).groupBy(*place).agg(F.min_by("row", "tie").alias("row"))
    return docs.where(~spoken).unionByName(one.join(stay, place, "left_semi").select("row.*"))
