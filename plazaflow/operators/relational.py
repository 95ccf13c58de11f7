"""Joins, aggregates and window operators on plain tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; give an order without ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def mode_first(df: DataFrame, key: list[str], value: str, position: Column) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones, the one that comes first by ``position``."""
    counted = df.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    return counted.groupBy(*key).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("n"), "_first", value)).alias("_m")).select(*key, F.col(f"_m.{value}").alias(value), F.col("_m.n").alias("n"))


def nearest_rank(values: Column, share: float) -> Column:
    """The element of a group's sorted values at rank round-half-up(share * (n - 1))."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, F.floor(share * (F.count(values) - 1) + 0.5).cast("int") + 1)


def gap_segments(df: DataFrame, key: list[str], value: str, gap: float) -> DataFrame:
    """Numbers, from 0, the runs of sorted values that stand no more than ``gap`` apart."""
    order = Window.partitionBy(*key).orderBy(value)
    jump = F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("int"), F.lit(0))
    return df.withColumn("_jump", jump).withColumn("segment", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_jump")


def rank_names(df: DataFrame, kind: str, order: list[Column], name: str) -> DataFrame:
    """Names rows Kind_00001, Kind_00002, ... within each kind by ``order``."""
    n = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return df.withColumn(name, F.format_string("%s_%05d", F.col(kind), n))


def overlay(df: DataFrame, key: str, deltas: list[DataFrame], columns: list[str]) -> DataFrame:
    """Replaces columns by those of the delta tables where they have a row; a later delta wins."""
    for k, delta in enumerate(deltas):
        new = delta.select(key, *(F.col(c).alias(f"_{k}_{c}") for c in columns))
        df = df.join(new, key, "left")
    for c in columns:
        df = df.withColumn(c, F.coalesce(*(F.col(f"_{k}_{c}") for k in reversed(range(len(deltas)))), F.col(c)))
    return df.drop(*(f"_{k}_{c}" for k in range(len(deltas)) for c in columns))


def merge_max(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """All keys of both tables, each with its larger value: history is never lost."""
    both = old.withColumnRenamed(value, "_a").join(new.withColumnRenamed(value, "_b"), key, "full")
    return both.select(*key, F.greatest("_a", "_b").alias(value))


def slope_through_origin(p: Column, target: Column) -> Column:
    """The non-negative k that brings k * p nearest to the target in squares."""
    return F.greatest(F.lit(0.0), F.sum(p * target) / F.sum(p * p))


def circular_smooth(df: DataFrame, key: list[str], bin_: str, value: str, bins: int, sigma: float, reach: int) -> DataFrame:
    """A histogram smoothed by a Gaussian kernel on a circle of ``bins`` bins; each bin is spread, then summed."""
    import math

    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(kernel)
    parts = F.array(*(F.struct(F.lit(k).alias("d"), F.lit(w / total).alias("w")) for k, w in zip(range(-reach, reach + 1), kernel, strict=True)))
    spread = df.withColumn("_k", F.explode(parts))
    return spread.groupBy(*key, F.pmod(F.col(bin_) + F.col("_k.d"), F.lit(bins)).cast("int").alias(bin_)).agg(F.sum(F.col(value) * F.col("_k.w")).alias(value))


def running(partition: list[str], order: list[str]):  # noqa: ANN201
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def unpivot(df: DataFrame, keep: list[str], columns: list[str], label: str, value: str) -> DataFrame:
    return df.unpivot(keep, columns, label, value)


def unique_on(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once, by an aggregate instead of a window."""
    once = df.groupBy(*key).agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_row")).where("_n = 1")
    return once.select("_row.*")


def shared_by_pairs(rows: DataFrame, key: str, member: str, *, least: int = 2, first: int = 3) -> DataFrame:
    """(a, b, n, firsts): pairs a < b of members that share at least ``least`` keys, how many, and the ``first`` least of them, comma-joined.

    ``key`` and ``member`` are longs. A key's members stay one array: each goes with those after it to where its pairs are
    counted, so not pairs but arrays travel. A member's pairs must fit into a task.
    """
    known = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.array_sort(F.collect_set(F.col(member).cast("long"))).alias("_m"))
    sent = known.select("k", "_m", F.posexplode("_m").alias("_at", "a")).where("_at + 1 < size(_m)").select("a", "k", F.slice("_m", F.col("_at") + 2, F.size("_m")).alias("others"))

    def count(group: pa.Table) -> pa.Table:
        lists = group.column("others").combine_chunks()
        b, k = lists.flatten().to_numpy(), np.repeat(group.column("k").to_numpy(), lists.value_lengths().to_numpy())
        order = np.lexsort((k, b))
        b, k = b[order], k[order]
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        n = np.diff(np.r_[starts, len(b)])
        starts, n = starts[n >= least], n[n >= least]
        firsts = [pa.array(k[np.minimum(starts + m, len(k) - 1)], mask=n <= m).cast(pa.string()) for m in range(first)]
        joined = pc.binary_join_element_wise(*firsts, ",", null_handling="skip")
        return pa.table({"a": pa.array(np.full(len(n), group.column("a")[0].as_py()), pa.int64()), "b": b[starts], "n": n, "firsts": joined})

    return sent.groupBy("a").applyInArrow(count, "a long, b long, n long, firsts string")


def exact_percentile(df: DataFrame, column: str, share: float, accuracy: int = 2000) -> float | None:
    """``percentile(column, share)`` of a whole table; null where there is no value.

    An approximate percentile gives two values around the wanted place; those below are counted, and only those between are
    sorted, some 4 to 6 of ``accuracy`` rows. If the place is not between them, they are set further apart.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    apart = 2.0 / accuracy
    while True:
        wide = apart >= 1
        low, high, n = values.agg(*(F.percentile_approx("v", min(1.0, max(0.0, share + d)), accuracy) for d in (-apart, apart)), F.count("*")).first()
        if not n:
            return None
        place = share * (n - 1)
        wanted = {math.floor(place), math.ceil(place)}
        between = values if wide else values.where((F.col("v") >= low) & (F.col("v") <= high))
        below = 0 if wide else values.where(F.col("v") < low).count()
        counts = between.groupBy("v").agg(F.count("*").alias("n"))
        upto = counts.select("v", F.sum("n").over(Window.orderBy("v")).alias("upto"), "n")
        held = upto.where(" or ".join(f"(upto > {w - below} and upto - n <= {w - below})" for w in wanted)).collect() if min(wanted) >= below else []  # two rows at most
        found = {w: r.v for w in wanted for r in held if r.upto - r.n <= w - below < r.upto}
        if len(found) == len(wanted):
            a, b = math.floor(place), math.ceil(place)
            return found[a] if a == b or found[a] == found[b] else (b - place) * found[a] + (place - a) * found[b]
        apart *= 8
