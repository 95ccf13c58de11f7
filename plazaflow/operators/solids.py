"""Objects of points: tiers, outlines, walls, splits and surfaces. Each object is one group that a task can hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import in_ring


def height_tiers(cells: DataFrame, key: str, gap: float, least_area: int) -> DataFrame:
    """Cells of each object cut into tiers at height gaps; tiers of fewer cells join the next lower one, the lowest the next higher."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.sort(pdf.z.to_numpy())
        tiers = [list(t) for t in np.split(z, np.flatnonzero(np.diff(z) > gap) + 1)]
        while len(tiers) > 1 and min(map(len, tiers)) < least_area:
            k = min(range(len(tiers)), key=lambda i: (len(tiers[i]), i))
            into = k - 1 if k else 1
            tiers[into] = sorted(tiers[into] + tiers[k])
            del tiers[k]
        return pd.DataFrame([(pdf[key].iloc[0], n, len(t), float(np.median(t)), float(max(t))) for n, t in enumerate(tiers)], columns=[key, "tier", "cells", "z", "top"])

    return cells.groupBy(key).applyInPandas(work, f"{key} long, tier int, cells long, z double, top double")


def carried_outlines(slices: DataFrame, key: str, same: float) -> DataFrame:
    """Each slice's cells with all of the slices above; neighbours that differ by less than ``same`` of their cells merge."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        above: set = set()
        rows: list[list] = []
        for level, part in sorted(pdf.groupby("level"), key=lambda g: -g[0]):
            now = above | set(zip(part.i, part.j, strict=True))
            if rows and len(now ^ above) < same * len(now):
                rows[-1][1] = level
            else:
                rows.append([level, level, len(now)])
            above = now
        return pd.DataFrame([(pdf[key].iloc[0], int(lo), int(hi), n) for hi, lo, n in rows], columns=[key, "low", "high", "cells"])

    return slices.groupBy(key).applyInPandas(work, f"{key} long, low long, high long, cells long")


def repeat_period(profile: DataFrame, key: str, shortest: int, longest: int) -> DataFrame:
    """The lag at which each profile (pos, v) resembles itself most, by autocorrelation."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("pos").v.to_numpy(float)
        v = v - v.mean()
        power = float((v * v).sum())
        lags = {k: float((v[k:] * v[:-k]).sum()) / power for k in range(shortest, min(longest, len(v) - 1) + 1)} if power else {}
        best = max(lags, key=lambda k: (round(lags[k], 9), -k)) if lags else None
        return pd.DataFrame([(pdf[key].iloc[0], best, lags.get(best))], columns=[key, "period", "strength"])

    return profile.groupBy(key).applyInPandas(work, f"{key} long, period int, strength double")


def lloyd_split(points: DataFrame, key: str, size: float, steps: int = 10) -> DataFrame:
    """Each cluster split into parts of about ``size``: centres start evenly along its longer axis and move ``steps`` times."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy()
        span = p.max(axis=0) - p.min(axis=0)
        axis = int(span[1] > span[0])
        n = max(1, round(float(span[axis]) / size))
        order = np.argsort(p[:, axis], kind="stable")
        centres = np.array([p[part].mean(axis=0) for part in np.array_split(order, min(n, len(p)))])
        for _ in range(steps):
            owner = ((p[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([p[owner == k].mean(axis=0) if (owner == k).any() else centres[k] for k in range(len(centres))])
        count = np.bincount(owner, minlength=len(centres))
        return pd.DataFrame({key: pdf[key].iloc[0], "part": range(len(centres)), "n": count, "x": centres[:, 0], "y": centres[:, 1]})

    return points.groupBy(key).applyInPandas(work, f"{key} long, part int, n long, x double, y double")


def plane(df: DataFrame, key: str) -> DataFrame:
    """(a, b, c) of the least-squares plane z = a + b x + c y of each group, from moments that aggregate before the shuffle.

    Three unknowns are solved in closed form; a group whose points lie on a line has none.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    m = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))
    det = F.nullif(F.round(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), 9), F.lit(0.0))
    b = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    c = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    return m.withColumns({"b": b, "c": c}).withColumn("a", F.col("mz") - F.col("b") * F.col("mx") - F.col("c") * F.col("my")).select(key, "n", "a", "b", "c")


def thickness(df: DataFrame, key: str) -> DataFrame:
    """How far each group's points stand from its plane, between the 5th and the 95th percentile."""
    fitted = df.join(plane(df, key), key).withColumn("r", F.col("z") - F.col("a") - F.col("b") * F.col("x") - F.col("c") * F.col("y"))
    q = F.percentile("r", F.array(F.lit(0.05), F.lit(0.95)))
    return fitted.groupBy(key, "n").agg(q.alias("q")).select(key, "n", (F.col("q")[1] - F.col("q")[0]).alias("thick"))


def grown(seeds: DataFrame, cells: DataFrame, rounds: int, step: Column) -> DataFrame:
    """Cells reached from ``seeds`` in so many rounds of neighbours, where ``step`` (on h, the new cell's height, and from_h) allows.

    The rounds are fixed and few, so the plan stays one job.
    """
    reached = seeds.select("i", "j", "h", F.lit(0).alias("ring"))
    front = reached
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    for ring in range(1, rounds + 1):
        sent = front.select(F.col("h").alias("from_h"), "i", "j", F.explode(around).alias("d")).select((F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"), "from_h")
        new = sent.join(cells.select("i", "j", "h"), ["i", "j"]).where(step).select("i", "j", "h").distinct().join(reached.select("i", "j"), ["i", "j"], "left_anti")
        front = new.select("i", "j", "h", F.lit(ring).alias("ring"))
        reached = reached.unionByName(front)
    return reached


def walls(tiers: DataFrame, key: str, *, least_length: float = 0.5, least_height: float = 1.0, inward: float = 0.3, outward: float = 0.6) -> DataFrame:
    """The walls of objects' tiers (``key``, tier, rings, base, top): (key, tier, wall, ax, ay, bx, by, nx, ny, z0, z1).

    A wall is an edge of a ring, numbered from 0, with the normal (nx, ny) that points away from the tier. It begins at the
    tier's base, or at the top of the highest other tier of the object that stands right outside of it, and is dropped where
    less than ``least_height`` is left. Rings are joined by the even-odd rule; edges shorter than ``least_length`` are no walls.
    """
    def inside(rings: Column, x: Column, y: Column) -> Column:
        return F.aggregate(F.transform(rings, lambda r: in_ring(x, y, r).cast("int")), F.lit(0), lambda a, v: a + v) % 2 == 1

    ends = F.flatten(F.transform("rings", lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda k: F.struct(F.get(r, k).alias("a"), F.get(r, F.pmod(k + 1, F.size(r))).alias("b")))))
    e = tiers.where("rings is not null").select(key, "tier", "rings", "base", "top", F.posexplode(ends).alias("wall", "e")).select(key, "tier", "rings", "base", "top", "wall", *(F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"))
    long = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    e = e.withColumn("_l", long).where(F.col("_l") >= least_length).withColumns({"nx": (F.col("by") - F.col("ay")) / F.col("_l"), "ny": (F.col("ax") - F.col("bx")) / F.col("_l"), "mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2})
    turn = F.when(inside(F.col("rings"), F.col("mx") + inward * F.col("nx"), F.col("my") + inward * F.col("ny")), -1.0).otherwise(1.0)
    e = e.withColumn("_s", turn).withColumns({"nx": F.col("_s") * F.col("nx"), "ny": F.col("_s") * F.col("ny")}).drop("rings", "_s", "_l")
    others = tiers.select(F.col(key).alias("_k"), F.col("tier").alias("_t"), F.col("rings").alias("_r"), F.col("top").alias("_top"))
    beside = (F.col(key) == F.col("_k")) & (F.col("tier") != F.col("_t")) & inside(F.col("_r"), F.col("mx") + outward * F.col("nx"), F.col("my") + outward * F.col("ny"))
    names = [key, "tier", "wall", "ax", "ay", "bx", "by", "nx", "ny"]
    stood = e.join(others, beside, "left").groupBy(*names, "base", "top").agg(F.max("_top").alias("_m"))
    return stood.select(*names, F.coalesce("_m", "base").alias("z0"), F.col("top").alias("z1")).where(F.col("z1") - F.col("z0") > least_height)


def snapped_walls(walls_: DataFrame, points: DataFrame, key: str, *, most: float = 2.5, ends: float = 0.5, under: float = 1.5, least_points: int = 8, size: float = 5.0) -> DataFrame:
    """``walls_`` with ``near``, the measured points (key, x, y, z) beside each, and ``shift``, how far outward it moves onto them.

    A point counts if it stands within ``most`` of the wall's line, no more than ``ends`` past its ends, above its foot and
    ``under`` its top. The shift is the median of the points' distances, 0 for fewer than ``least_points``. Walls are sent to
    the cells that they pass by, points to their own; so an object of many points is many keys.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - most - ends) / size).cast("long"), F.floor((F.greatest(a, b) + most + ends) / size).cast("long")))
    sent = walls_.select("*", span("ax", "bx").alias("_i")).select("*", span("ay", "by").alias("_j"))
    here = points.select(key, F.floor(F.col("x") / size).cast("long").alias("_i"), F.floor(F.col("y") / size).cast("long").alias("_j"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    long = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    dx, dy = F.col("_x") - F.col("ax"), F.col("_y") - F.col("ay")
    along = (dx * (F.col("bx") - F.col("ax")) + dy * (F.col("by") - F.col("ay"))) / long
    off = dx * F.col("nx") + dy * F.col("ny")
    pairs = sent.join(here, [key, "_i", "_j"]).withColumns({"_along": along, "_off": off, "_long": long})
    found = pairs.where((F.col("_along") > -ends) & (F.col("_along") < F.col("_long") + ends) & (F.abs("_off") < most) & (F.col("_z") > F.col("z0")) & (F.col("_z") < F.col("z1") - under))
    counted = found.groupBy(key, "tier", "wall").agg(F.count("*").alias("near"), F.median("_off").alias("_m"))
    joined = walls_.join(counted, [key, "tier", "wall"], "left")
    return joined.select(*walls_.columns, F.coalesce("near", F.lit(0)).alias("near"), F.when(F.col("near") >= least_points, F.col("_m")).otherwise(0.0).alias("shift"))
