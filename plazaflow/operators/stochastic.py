"""Allocation and keyed random choice: the same draws in every engine and on every run."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as D

_NONE = np.iinfo(np.int64).max


def apportion(df: DataFrame, group: list[str], key: str, weight: str, total: Column) -> DataFrame:
    """Whole shares of each group's ``total`` by largest remainder; ties go to the smaller key, zero shares are dropped.

    A group whose weights sum to zero, or whose total is not positive, gets none. Ranks run within groups of candidates.
    """
    by = Window.partitionBy(*group)
    exact = F.col(weight) * total / F.sum(weight).over(by)
    parts = df.where(F.col(weight) > 0).withColumn("_x", exact).where("_x is not null").withColumn("_f", F.floor("_x"))
    rest = total - F.sum("_f").over(by)
    rank = F.row_number().over(by.orderBy((F.col("_x") - F.col("_f")).desc(), key))
    shares = parts.withColumns({"_rest": rest, "_r": rank}).withColumn("share", (F.col("_f") + (F.col("_r") <= F.col("_rest")).cast("long")).cast("long"))
    return shares.where("share > 0").drop("_x", "_f", "_rest", "_r")


def gumbel(cost_over_scale: Column, u: Column) -> Column:
    """The smallest of these, over candidates, is a draw with odds exp(-cost)."""
    return cost_over_scale + F.log(-F.log(u))


def softmin_choice(pairs: DataFrame, chooser: list[str], candidate: str, cost: Column, scale: float, u: Column) -> DataFrame:
    """One candidate for each chooser with odds exp(-cost / scale): a single aggregate, no cumulative pass."""
    return pairs.groupBy(*chooser).agg(F.min_by(candidate, F.struct(gumbel(cost / scale, u), candidate)).alias(candidate))


def least_options(options: Column, cost: Callable[[Column], Column], candidate: str) -> Column:
    """The struct (k, s) of the least cost and its candidate (ties: smaller id) in an array of structs; null costs don't count."""
    every = F.transform(options, lambda o: F.struct(cost(o).alias("k"), o[candidate].alias("s")))
    return F.array_min(F.filter(every, lambda c: c["k"].isNotNull()))


def with_options(people: DataFrame, options: DataFrame, key: str, match: tuple[str, str], block: int = 512) -> DataFrame:
    """``people`` with the options whose ``match`` column equals theirs, as arrays ``options`` of some ``block`` structs: a row a block, not a pair.

    Choices are made in a row by :func:`least_options`, so that only a block's winner is aggregated and no pair is sorted or
    shuffled. The few values of ``match`` don't limit the tasks: people are dealt by their key too, options go to each deal.
    """
    own, other = match
    tasks = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = options.groupBy(other).count().select(F.col(other).alias("_of"), F.ceil(F.col("count") / block).alias("_n"))
    dealt = options.join(size, F.col(other) == F.col("_of")).withColumn("_block", F.pmod(F.xxhash64(*options.columns), F.col("_n")))
    blocks = dealt.groupBy(F.col(other).alias("_of"), "_block").agg(F.collect_list(F.struct(*options.columns)).alias("options"))
    sent = blocks.select("_of", "options", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_to"))
    asked = people.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int")).repartition(tasks, own, "_deal")
    return asked.join(sent.repartition(tasks, "_of", "_to"), (F.col(own) == F.col("_of")) & (F.col("_deal") == F.col("_to"))).drop("_deal", "_to", "_of")


def least_draws(
    people: DataFrame, options: DataFrame, keys: tuple[str, str], match: tuple[str, str], values: tuple[str, str], seed: int, cost: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], within: float | None = None, pairs: int = 1 << 15
) -> DataFrame:
    """Each person's option (key, ``k``, ``s``, ``near``) of the least :func:`gumbel` cost among those whose ``match`` equals theirs; ties go to the smaller id.

    ``cost(value, other, ids)`` gets a column of people's values, a row of options' and their ids. With ``within`` only
    options whose value differs by no more count where there is one (``near``), else all. Keys are whole numbers; where a
    value is null nothing is drawn, and a person without any draw has a null ``s``. Every pair's draw is made, some ``pairs``
    at once (:mod:`..functions.draws`): people are dealt by their key to groups, options go to each, and no pair leaves its group.
    """
    deals = 2 * int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = lambda d, n: d.select(F.col(match[n]).alias("_of"), F.col(keys[n]).cast("long").alias("_id"), F.col(values[n]).cast("double").alias("_v"))
    asked = named(people, 0).where("_of is not null").withColumns({"_head": F.concat_ws("|", F.lit(str(seed)), F.col("_id").cast("string"), F.lit("")), "_deal": F.pmod(F.xxhash64("_id"), F.lit(deals)).cast("int")})
    sent = named(options, 1).where("_of is not null and _id is not null").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("_id")
        k, s, near = np.full(len(left), np.inf), np.full(len(left), _NONE), np.zeros(len(left), bool)
        real = lambda t: t.filter(pc.is_valid(t.column("_v")))
        right = real(right).sort_by("_v")
        other, names = right.column("_v").to_numpy(), right.column("_id").to_numpy()
        value = pc.fill_null(left.column("_v"), float("nan")).to_numpy()
        texts = names.astype("S")
        long = np.char.str_len(texts)
        size = pc.binary_length(left.column("_head")).to_numpy()
        head = left.column("_head").to_numpy().astype("S") if len(left) else np.empty(0, "S1")
        known = np.flatnonzero(pc.is_valid(left.column("_v")).to_numpy())
        known = known[np.argsort(value[known], kind="stable")]
        groups = [(np.flatnonzero(long == n), n) for n in np.unique(long).tolist()]
        if within is not None and len(other):
            # the two options on either side of a person's place are the nearest
            at = np.searchsorted(other, value)
            near = np.minimum(np.abs(value - other[np.maximum(at - 1, 0)]), np.abs(value - other[np.minimum(at, len(other) - 1)])) <= within

        def choose(own: np.ndarray, limit: float | None) -> None:
            for n in np.unique(size[own]).tolist():
                mine = own[size[own] == n]
                front = D.heads(head[mine].astype(f"S{n}"))
                for of, m in groups:
                    back, y, name = D.tails(texts[of].astype(f"S{m}"), n, b"|0"), other[of], names[of]
                    step = max(1, pairs // max(1, len(of) if limit is None else int(np.searchsorted(y, value[mine[len(mine) // 2]] + limit) - np.searchsorted(y, value[mine[len(mine) // 2]] - limit))))
                    for p in range(0, len(mine), step):
                        rows = mine[p : p + step]
                        slack = 0.0 if limit is None else limit * (1 + 1e-9) + 1e-9 * np.abs(value[rows]).max()
                        low, high = (0, len(of)) if limit is None else (int(np.searchsorted(y, value[rows[0]] - slack)), int(np.searchsorted(y, value[rows[-1]] + slack, side="right")))
                        for q in range(low, high, pairs):
                            part = slice(q, min(high, q + pairs))
                            x, z = value[rows, None], y[None, part]
                            drawn = cost(x, z, name[None, part]) + np.log(-np.log(D.uniforms(front[p : p + step], back[part])))
                            if limit is not None:
                                drawn[np.abs(x - z) > limit] = np.nan
                            drawn[np.isnan(drawn)] = np.inf
                            least = drawn.min(axis=1)
                            best = np.where(drawn == least[:, None], name[None, part], _NONE).min(axis=1)
                            if limit is not None:
                                best[np.isinf(least)] = _NONE
                            less = (least < k[rows]) | ((least == k[rows]) & (best < s[rows]))
                            k[rows[less]], s[rows[less]] = least[less], best[less]

        choose(known[near[known]] if within is not None else known, within)
        if within is not None:
            choose(known[~near[known]], None)
        none = s == _NONE
        return pa.table({keys[0]: ids, "k": pa.array(k, mask=none), "s": pa.array(s, mask=none), "near": near})

    deal = lambda d: d.repartition(deals, "_of", "_deal").groupBy("_of", "_deal")
    schema = f"`{keys[0]}` long, k double, s long, near boolean"

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right if len(left) else right.slice(0, 0)) if len(right) else work(left.slice(0, 0), right)

    return deal(asked).cogroup(deal(sent)).applyInArrow(both, schema)


def inverse_cdf(weights: DataFrame, group: list[str], bin_: str, weight: str) -> DataFrame:
    """Each bin's range [lo, hi) of cumulative shares in its group."""
    total = F.sum(weight).over(Window.partitionBy(*group))
    up = F.sum(weight).over(Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0))
    return weights.select(*group, bin_, ((up - F.col(weight)) / total).alias("lo"), (up / total).alias("hi"))


def box_muller(u1: Column, u2: Column) -> Column:
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)


def poisson(u: Column, mean: float, most: int = 40) -> Column:
    """Inverse of the distribution function, from a table as long as the mean needs."""
    import math

    out, term, up = F.lit(most), math.exp(-mean), 0.0
    steps = []
    for k in range(most):
        up += term
        steps.append((k, up))
        term *= mean / (k + 1)
    for k, level in reversed(steps):
        out = F.when(u < level, F.lit(k)).otherwise(out)
    return out


def keep_ratio(distance: Column, full: float, power: float) -> Column:
    """All within ``full``, then falling with a power of the distance."""
    return F.when(distance <= full, F.lit(1.0)).otherwise(F.pow(F.lit(full) / distance, F.lit(power)))


def taper_ratio(distance: Column, full: float, power: float, cut: float, smooth: bool) -> Column:
    """:func:`keep_ratio`, faded out towards ``cut``, linearly or by a smooth step."""
    from ..functions.scalar import smoothstep

    t = (F.lit(cut) - distance) / F.lit(cut - full)
    fade = smoothstep(t) if smooth else F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return keep_ratio(distance, full, power) * fade


def bernoulli_rounded(x: Column, u: Column) -> Column:
    return F.floor(x + u).cast("int")


def rank_match(left: DataFrame, right: DataFrame, group: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Pairs the k-th of the left with the k-th of the right in each group, nobody twice; the left's rest stays alone."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*right_order)))
    return a.join(b, [*group, "_n"], "left").drop("_n")


def multinomial(totals: DataFrame, weights: DataFrame, group: list[str], key: str, weight: str, total: str, u: Callable[[Column], Column]) -> DataFrame:
    """How many of each group's ``total`` units fall on each key (``n``, zeros left out), each unit drawn on its own.

    ``u`` gives a unit's draw from its number. A unit meets the keys of its group by their ranges of cumulative shares.
    """
    units = totals.where(F.col(total) > 0).select(*group, F.explode(F.sequence(F.lit(1), F.col(total).cast("int"))).alias("_unit"))
    ranges = inverse_cdf(weights.where(F.col(weight) > 0), group, key, weight)
    # a group's few keys are one row, so that units are not multiplied
    rows = ranges.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("hi", key))).alias("_keys"))
    drawn = units.withColumn("_u", u(F.col("_unit"))).join(rows, group)
    last = F.element_at("_keys", -1)[key]
    pick = F.coalesce(F.get(F.filter("_keys", lambda k: F.col("_u") < k["hi"]), F.lit(0))[key], last)
    return drawn.select(*group, pick.alias(key)).groupBy(*group, key).agg(F.count("*").alias("n"))


def raked(parts: DataFrame, whole: DataFrame, group: list[str], bin_: str, period: str, weight: str) -> DataFrame:
    """Each group's weights by period, split within the period as the bins of ``whole`` are, as shares of the group's sum.

    ``whole`` has (bin, period, weight) of all bins; ``parts`` has (group, period, weight). A period without any weight in
    ``whole`` gives its bins nothing.
    """
    same = whole.withColumn("_same", F.sum(weight).over(Window.partitionBy(period))).select(bin_, period, (F.col(weight) / F.greatest(F.col("_same"), F.lit(1.0))).alias("_in"))
    split = parts.join(F.broadcast(same), period).withColumn("_w", F.col(weight) * F.col("_in"))
    return split.select(*group, bin_, (F.col("_w") / F.sum("_w").over(Window.partitionBy(*group))).alias("share"))
