"""Grids of cells (i, j): connected groups, hole filling, smoothing, greedy spacing and chunk seams.

Work goes by tiles of bounded size, with a margin where a cell needs its neighbours; what reaches across tiles is settled on
small tables of borders. Results don't depend on the size of tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .graph import components
from .spatial import within

#: Cells are numbered by row, then column; columns lie within 2**31 of 0.
_SPAN = 1 << 32


def cell_number(i: Column, j: Column) -> Column:
    return i * _SPAN + j + (1 << 31)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` things reaches over links a-b: each takes the least label around it, then its label's own."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        np.minimum.at(least, label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def grid_labels(cells: DataFrame, *, reach: int = 1, tile: int = 512) -> DataFrame:
    """(i, j, label): the least cell number of the connected group of each of ``cells``; repeated cells count once.

    Cells up to ``reach`` rows and columns apart are connected: 1 joins eight neighbours, 2 r + 1 what touches once all
    cells have grown by r. Tiles are labelled apart; then only the cells within ``reach`` of a tile's border meet those of other
    tiles, and the labels that they link are joined as a graph.
    """
    steps = [(a, b) for a in range(reach + 1) for b in range(-reach, reach + 1) if (a, b) > (0, 0)]

    def work(group: pd.DataFrame) -> pd.DataFrame:
        number = (group.i.to_numpy() << 32) + group.j.to_numpy() + (1 << 31)
        order = np.argsort(number)
        number = number[order]
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in steps:
            there = np.searchsorted(number, number + a * _SPAN + b)
            here = np.flatnonzero((there < len(number)) & (number[np.minimum(there, len(number) - 1)] == number + a * _SPAN + b))
            ends.append((here, there[here]))
        label = number[joined(len(number), *(np.concatenate(e) for e in zip(*ends, strict=True)))]
        return pd.DataFrame({"i": group.i.to_numpy()[order], "j": group.j.to_numpy()[order], "part": label})

    tiles = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "ij"]
    local = settle(cells.select(F.col("i").cast("long"), F.col("j").cast("long")).distinct().select("*", *tiles).groupBy("ti", "tj").applyInPandas(work, "i long, j long, part long"))
    place = [F.pmod("i", F.lit(tile)), F.pmod("j", F.lit(tile))]
    near = (place[0] < reach) | (place[0] >= tile - reach) | (place[1] < reach) | (place[1] >= tile - reach)
    border = local.where(near)
    sent = border.select(F.col("part").alias("a"), "i", "j", F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in steps))).alias("s"))
    sent = sent.select("a", F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj"), (F.col("i") + F.col("s.x")).alias("i"), (F.col("j") + F.col("s.y")).alias("j"))
    sent = sent.where((F.floor(F.col("i") / tile) != F.col("ti")) | (F.floor(F.col("j") / tile) != F.col("tj"))).select("a", "i", "j")
    links = settle(sent.join(border.withColumnRenamed("part", "b"), ["i", "j"]).select("a", "b").where("a <> b").distinct())
    if links.isEmpty():
        return local.withColumnRenamed("part", "label")
    roots = components(links).select(F.col("node").alias("part"), "comp")
    return local.join(roots, "part", "left").select("i", "j", F.coalesce("comp", "part").alias("label"))


def frame_of(grid: DataFrame) -> tuple[int, int, int, int] | None:
    """(least i, largest i, least j, largest j)."""
    r = grid.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    return None if r[0] is None else tuple(r)


def nearest_filled(grid: DataFrame, value: str, frame: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(i, j, value, measured) of all cells of the frame; one without a value has that of the nearest measured cell.

    Distances are exact, by squares; ties go to the smaller i, then the smaller j. First the nearest of the own row is found
    on either side, then the best row: a column of the frame is one group, gone through from near rows to far ones until no
    farther one can be better. Null values are holes. Without a measured cell there are no rows.
    """
    measured = grid.where(F.col(value).isNotNull()).select("i", "j", F.col(value).cast("double").alias("_v"))
    span = frame or frame_of(measured)
    if span is None:
        return grid.select("i", "j", F.col(value).cast("double").alias(value), F.lit(True).alias("measured")).where("false")
    i0, i1, j0, j1 = span
    # rows beside the frame in which something is measured are gone through too
    ends = frame_of(measured)
    if ends is None:
        return nearest_filled(measured.select("i", "j", F.col("_v").alias(value)), value)
    every = grid.sparkSession.range(min(i0, ends[0]), max(i1, ends[1]) + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(j0).cast("long"), F.lit(j1).cast("long"))).alias("j"))
    # measured cells beside the frame count too
    cells = every.withColumn("_in", F.when(F.col("i").between(i0, i1), True)).join(measured, ["i", "j"], "full")
    row = Window.partitionBy("i").orderBy("j")
    mark = F.when(F.col("_v").isNotNull(), F.struct("j", "_v"))
    before = F.last(mark, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    sides = cells.select("i", "j", "_in", F.col("_v").isNotNull().alias("measured"), before.alias("l"), after.alias("r"))
    left = F.col("l").isNotNull() & (F.col("r").isNull() | (F.col("j") - F.col("l.j") <= F.col("r.j") - F.col("j")))
    best = F.when(left, F.col("l")).otherwise(F.col("r"))
    found = sides.select("i", "j", "_in", "measured", F.abs(F.col("j") - best["j"]).alias("_d"), best["_v"].alias("_v"))

    def work(column: pd.DataFrame) -> pd.DataFrame:
        column = column.sort_values("i", ignore_index=True)
        i, d, v = column.i.to_numpy(), column._d.to_numpy(float) ** 2, column._v.to_numpy(float)
        # rows in which nothing is measured have no distance; rows beside the frame may be missing
        first = int(i[0])
        squares, values = np.full(int(i[-1]) - first + 1, np.inf), np.full(int(i[-1]) - first + 1, np.nan)
        squares[i - first], values[i - first] = np.where(np.isnan(d), np.inf, d), v
        at = i - first
        least, chosen = squares[at].copy(), at.copy()
        k, open_ = 1, np.arange(len(at))
        while len(open_) and k < len(squares):
            open_ = open_[k * k <= least[open_]]
            for sign in (-1, 1):
                there = at[open_] + sign * k
                ok = (there >= 0) & (there < len(squares))
                who, there = open_[ok], there[ok]
                new = squares[there] + k * k
                better = (new < least[who]) | ((new == least[who]) & np.isfinite(new) & (there < chosen[who]))
                least[who[better]], chosen[who[better]] = new[better], there[better]
            k += 1
        column["v"] = values[chosen]
        return column.loc[column._in.notna(), ["i", "j", "v", "measured"]]

    filled = found.groupBy("j").applyInPandas(work, "i long, j long, v double, measured boolean")
    return filled.where("v is not null").select("i", "j", F.col("v").alias(value), "measured")


def smoothed(grid: DataFrame, value: str, frame: tuple[int, int, int, int] | None = None, *, passes: int = 2, sigma: float = 0.8, tile: int = 256) -> DataFrame:
    """(i, j, value) of all cells of the frame: gaps of ``passes`` cells take the largest value around them, other holes the
    smallest of all; then a 3 x 3 median and a Gaussian, mirrored at the frame's edges.

    Tiles carry the margin that all steps together need.
    """
    measured = grid.where(F.col(value).isNotNull()).select(F.col("i").cast("long"), F.col("j").cast("long"), F.col(value).cast("double").alias("v"))
    span = frame or frame_of(measured)
    lowest = measured.agg(F.min("v")).first()[0]
    if span is None or lowest is None:
        return measured.select("i", "j", F.col("v").alias(value)).where("false")
    i0, i1, j0, j1 = span
    radius = int(4 * sigma + 0.5)
    margin = passes + 1 + radius
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()

    def around(a: np.ndarray, reach: int, mode: str) -> np.ndarray:
        p = np.pad(a, reach, mode=mode, **({"constant_values": -np.inf} if mode == "constant" else {}))
        n, m = a.shape
        return np.stack([p[x : x + n, y : y + m] for x in range(2 * reach + 1) for y in range(2 * reach + 1)])

    def work(group: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(group.ti.iloc[0]), int(group.tj.iloc[0])
        # the tile with its margin, as far as the frame goes
        a, b = max(i0, ti * tile - margin), min(i1 + 1, (ti + 1) * tile + margin)
        c, d = max(j0, tj * tile - margin), min(j1 + 1, (tj + 1) * tile + margin)
        z = np.full((b - a, d - c), -np.inf)
        rows = group[group.v.notna()]
        z[rows.i.to_numpy(np.int64) - a, rows.j.to_numpy(np.int64) - c] = rows.v
        for _ in range(passes):
            z = np.where(np.isfinite(z), z, around(z, 1, "constant").max(axis=0))
        z = np.median(around(np.where(np.isfinite(z), z, lowest), 1, "symmetric"), axis=0)
        for axis in (0, 1):
            p = np.pad(z, [(radius, radius) if axis == x else (0, 0) for x in (0, 1)], mode="symmetric")
            z = sum(w * np.take(p, np.arange(k, k + z.shape[axis]), axis=axis) for k, w in enumerate(weights))
        own_i, own_j = np.arange(max(i0, ti * tile), min(i1 + 1, (ti + 1) * tile)), np.arange(max(j0, tj * tile), min(j1 + 1, (tj + 1) * tile))
        part = z[np.ix_(own_i - a, own_j - c)]
        return pd.DataFrame({"i": np.repeat(own_i, len(own_j)), "j": np.tile(own_j, len(own_i)), "v": part.ravel()})

    tiles = lambda c, lo, hi: F.sequence(F.floor(F.greatest(F.col(c) - margin, F.lit(lo)) / tile), F.floor(F.least(F.col(c) + margin, F.lit(hi)) / tile))
    inside = measured.where(F.col("i").between(i0, i1) & F.col("j").between(j0, j1))
    sent = inside.select("i", "j", "v", F.explode(tiles("i", i0, i1)).alias("ti")).select("*", F.explode(tiles("j", j0, j1)).alias("tj"))
    bare = grid.sparkSession.range(i0 // tile, i1 // tile + 1).select(F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("v"), F.col("id").alias("ti"), F.explode(F.sequence(F.lit(j0 // tile).cast("long"), F.lit(j1 // tile).cast("long"))).alias("tj"))
    return sent.unionByName(bare).groupBy("ti", "tj").applyInPandas(work, "i long, j long, v double").withColumnRenamed("v", value)


def spaced(points: DataFrame, key: list[str], order: str, distance: float, tile: float | None = None) -> DataFrame:
    """The rows (``key``, ``order``, x, y) kept in order if further than ``distance`` from all that ``key`` has kept before.

    Tiles of a key decide apart, in order, as far as they can: a row near a kept earlier one goes, a row with an undecided
    earlier one across the border waits, all others stay. Decisions travel over borders in rounds, until no row waits; the
    first undecided row of all can always be decided. ``order`` has no ties within a key; rows without a place are left out.
    """
    side = tile or 64 * distance
    names = [*key, order, "x", "y"]
    state = settle(points.where("x is not null and y is not null").select(*names, F.lit(0).alias("_s")))
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - distance) / side).cast("long"), F.floor((F.col(c) + distance) / side).cast("long")))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, ignore_index=True)
        x, y, s = group.x.to_numpy(), group.y.to_numpy(), group._s.to_numpy().copy()
        own = (np.floor(x / side) == group._ti) & (np.floor(y / side) == group._tj)
        seen: dict[tuple[int, int], list[int]] = {}
        for k, (i, j) in enumerate(zip((x // distance).astype(int).tolist(), (y // distance).astype(int).tolist(), strict=True)):
            if own[k] and s[k] == 0:
                there = [s[n] for a in (-1, 0, 1) for b in (-1, 0, 1) for n in seen.get((i + a, j + b), ()) if (x[n] - x[k]) ** 2 + (y[n] - y[k]) ** 2 <= distance**2]
                s[k] = 2 if 1 in there else 1 if 0 not in there else 0
            if s[k] != 2:
                seen.setdefault((i, j), []).append(k)
        group["_s"] = s
        return group.loc[own, [*names, "_s"]]

    schema = state.schema
    while True:
        # what has gone matters to nobody
        here = state.where("_s <> 2").select("*", near("x").alias("_ti")).select("*", near("y").alias("_tj"))
        open_ = here.join(here.where((F.col("_s") == 0) & (F.floor(F.col("x") / side) == F.col("_ti")) & (F.floor(F.col("y") / side) == F.col("_tj"))).select(*key, "_ti", "_tj").distinct(), [*key, "_ti", "_tj"], "left_semi")
        decided = open_.groupBy(*key, "_ti", "_tj").applyInPandas(work, schema)
        whole = [F.floor(F.col("x") / side).cast("long").alias("_ti"), F.floor(F.col("y") / side).cast("long").alias("_tj")]
        rest = state.where("_s = 1").select("*", *whole).join(open_.select(*key, "_ti", "_tj").distinct(), [*key, "_ti", "_tj"], "left_anti").select(*names, "_s")
        state = settle(decided.where("_s <> 2").unionByName(rest))
        if state.where("_s = 0").isEmpty():
            return state.select(*names)


def seams(points: DataFrame, name: str, *, size: float, strip: float = 1.0, reach: float = 1.5) -> DataFrame:
    """Objects of named points (x, y, z) that touch a chunk's border, with what they are called on its other side.

    Chunks are squares of ``size``; a border lies between a chunk and the next one east or north of it. Every point within
    ``strip`` beyond it takes the nearest point within ``strip`` before it, no further than ``reach`` (ties: the smaller name);
    an object before it is ``same`` if one of the points that took it bears its name, and ``other`` is the name that most
    of them bear (ties: the smaller). One row for each border (ci, cj, axis) and object, with the ``points`` that took it; repeated points count once.
    """
    sides = []
    for axis in ("x", "y"):
        chunk = F.floor(F.col(axis) / size)
        edge = F.when(F.col(axis) - chunk * size < strip, chunk).when((chunk + 1) * size - F.col(axis) <= strip, chunk + 1)
        ci, cj = (edge - 1 if axis == c else F.floor(F.col(c) / size) for c in ("x", "y"))
        sides.append(points.where(F.col(name).isNotNull() & edge.isNotNull()).select(F.lit(axis).alias("axis"), ci.cast("long").alias("ci"), cj.cast("long").alias("cj"), (chunk >= edge).alias("beyond"), F.col(name).alias("name"), "x", "y", "z"))
    near = settle(sides[0].unionByName(sides[1]).distinct())
    border = ["axis", "ci", "cj"]
    pairs = within(near.where("beyond").drop("beyond"), near.where("not beyond").drop("beyond"), reach, ("x", "y", "z")).where(" and ".join(f"{c} = s_{c}" for c in border))
    taken = pairs.groupBy(*border, "name", "x", "y", "z").agg(F.min(F.struct("dist", "s_name")).alias("n")).select(*border, F.col("n.s_name").alias("object"), "name")
    counted = taken.groupBy(*border, "object", "name").agg(F.count("*").alias("n"))
    ranked = counted.groupBy(*border, "object").agg(F.max(F.col("name") == F.col("object")).alias("same"), F.max("n").alias("_n"), F.sum("n").alias("points"))
    other = counted.join(ranked.select(*border, "object", F.col("_n").alias("n")), [*border, "object", "n"]).groupBy(*border, "object").agg(F.min("name").alias("other"))
    return ranked.drop("_n").join(other, [*border, "object"])
