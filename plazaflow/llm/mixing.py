"""Mixing sources to target weights by hash thresholds.

A row's size is its number of words, its hash 60 bits of the md5 of its id (of its text, where it has none). Sources share a
budget by weight; none gets more than ``most`` times its size, and what it can't take is shared out again by weight.

A source is taken whole as often as its target holds its size. For the rest sizes are summed by source and hash bucket, and
running sums find the bucket in which the rest ends; only the rows of that bucket are summed again by finer buckets, down to
one hash. Rows up to that hash are taken once more; the row at the end is, if that comes nearer to the target (ties: it is
not). So rows are taken whole, a source misses its target by half of that one row's size at most, and of two budgets the
larger takes all that the smaller takes. Nothing is sorted or drawn at random: reruns agree.

All steps are DataFrame expressions. Texts are read once; what is summed and joined are four short columns, kept as a
durable table. A histogram has ``2**BITS`` rows a source at most, summed in the tasks before it is shuffled, so a source
may hold any share of the rows. The table of sources travels to all tasks only if it has ``SMALL`` rows at most.

Null and empty texts have size 0 and are never taken. A null source is a source, the last. Rows of one id (and rows without
an id, of one text) share a hash and are taken alike. Rows stay as many as they are; an empty table gives no rows. Other
columns may have any name.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Bits of a hash, and of a bucket's number at each level.
HASH, BITS = 60, 15
#: Sources up to which their table is broadcast.
SMALL = 50_000
SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The number of runs of characters other than white space; null has none."""
    rest = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    # each word with the white space after it becomes one character
    return F.length(F.regexp_replace(rest, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def hashed(doc_id: Column, text: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, hash) of each row."""
    i, t, s = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    return docs.select(i.alias("doc_id"), s.cast("string").alias("source"), words(t).alias("size"), hashed(i, t).alias("hash"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, by code point and null last: ranges are numbered apart and then moved up by what is before them."""
    order = [F.col("source").isNull(), F.col("source")]
    parted = durable(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = parted.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parted.join(before.select("_part", "_before"), "_part").withColumn("place", (inner + F.col("_before")).cast("long")).drop("_part", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``sources`` (source, source_size) with their ``target``: ``percent`` of all sizes, shared by ``weights``, repeating.

    Each turn those whose share passes ``most`` times their size get that and leave the sharing. Only sums come to the
    driver; as a share only grows from turn to turn, whoever has left stays out.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    shared = durable(ranked(sources).select("source", "source_size", weight.alias("weight")))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    given, number = 0, -1
    total, left, _ = (int(x or 0) for x in shared.agg(F.sum(exact("source_size")), F.sum(exact("weight")), F.count("*")).first())
    while True:
        share, parts = percent * total - 100 * given, 100 * left
        number_before = number
        full = (exact("source_size") * most * F.lit(Decimal(parts)) < exact("weight") * F.lit(Decimal(share))) & (F.col("source_size") > 0) | (F.col("source_size") == 0)
        sums = shared.agg(F.sum(F.when(full, exact("source_size") * most)), F.sum(F.when(~full, exact("weight"))), F.sum(full.cast("long"))).first()
        given, left, number = (int(x or 0) for x in sums)
        if number == number_before or not left:
            break
    part = (exact("weight") * F.lit(Decimal(share))).cast("double") / F.lit(float(parts or 1))
    return shared.select("source", "source_size", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(part).alias("target"))


def _with(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """``rows`` with their source's columns; null meets null."""
    there = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(there) if small else there, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def thresholds(rows: DataFrame, goals: DataFrame, small: bool) -> DataFrame:
    """(source, limit): the hash up to which rows (source, size, hash) sum up nearest to their source's ``rest``, -1 for none."""
    edge = goals.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"))
    for shift in range(HASH - BITS, -1, -BITS):
        there = _with(rows.where("size > 0"), edge, small).where(F.shiftright("hash", shift + BITS) == F.col("bucket"))
        buckets = there.groupBy("source", "rest", "below", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        upto = F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        ends = buckets.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        first = ends.groupBy("source", "rest").agg(F.min(F.struct("bucket", "upto", "size", "lo", "hi")).alias("e"))
        edge = durable(first.select("source", "rest", "e.bucket", (F.col("e.upto") - F.col("e.size")).alias("below"), "e.upto", "e.lo", "e.hi"))
        if edge.where("lo < hi").isEmpty():
            break
    nearer = F.col("below") + F.col("upto") < 2 * F.col("rest")
    return edge.select("source", (F.col("lo") - F.when(nearer, 0).otherwise(1)).alias("limit"))


def shares(rows: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, limit) of the sources of ``rows``, and whether they are few."""
    sources = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    small = sources.limit(SMALL + 1).count() <= SMALL
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = durable(targets(sources, weights, percent, most).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    limits = thresholds(rows, goals, small).withColumnRenamed("source", "_s")
    joined = goals.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left")
    return durable(joined.select("source", "source_size", "target", "whole", F.coalesce("limit", F.lit(-1)).alias("limit"))), small


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken`` (words, repeats counted) of each row."""
    rows = durable(sized(docs, id_col, text_col, source_col))
    table, small = shares(rows, weights, percent, most)
    taken = F.col("size") * (F.col("whole") + (F.col("hash") <= F.col("limit")).cast("long"))
    return _with(rows, table, small).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all their columns, as often as they are taken. A row without words is not in it."""
    table, small = shares(durable(sized(docs, id_col, text_col, source_col)), weights, percent, most)
    i, t, s = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), s.cast("string").alias("source"), (words(t) > 0).alias("some"), hashed(i, t).alias("hash"))
    times = (F.col("whole") + (F.col("hash") <= F.col("limit")).cast("long")).cast("int")
    rows = _with(carried.where("some"), table.select("source", "whole", "limit"), small)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
