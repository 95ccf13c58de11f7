"""Grid operators against plain definitions; the size of tiles has no influence."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plazaflow.operators import grids as G


def scattered(seed, n, span):
    rng = random.Random(seed)
    return sorted({(rng.randint(-span, span), rng.randint(-span, span)) for _ in range(n)})


def flood(cells, reach):
    left, out = set(cells), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            i, j = todo.pop()
            group.append((i, j))
            near = [(i + a, j + b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (i + a, j + b) in left]
            left -= set(near)
            todo += near
        least = min(group)
        out |= {c: least[0] * 2**32 + least[1] + 2**31 for c in group}
    return out


@pytest.mark.parametrize(("reach", "n"), [(1, 500), (3, 120)])
def test_labels_do_not_depend_on_tiles(spark, reach, n):
    cells = scattered(reach, n, 15)
    df = spark.createDataFrame(cells + cells[:20], "i long, j long").withColumn("part", F.lit("x"))
    want = {(i, j, label) for (i, j), label in flood(cells, reach).items()}
    for tile in (3, 7, 1000):
        assert {tuple(r) for r in G.grid_labels(df, reach=reach, tile=tile).collect()} == want
    assert len({w[2] for w in want}) > 2


def test_a_group_through_many_tiles(spark):
    snake = [(i, j) for i in range(0, 40, 2) for j in range(40)] + [(i, 0 if i % 4 == 1 else 39) for i in range(1, 39, 2)]
    assert G.grid_labels(spark.createDataFrame(snake, "i long, j long"), tile=4).select("label").distinct().count() == 1
    assert G.grid_labels(spark.createDataFrame([], "i long, j long")).count() == 0


def test_nearest_filled(spark):
    rng = random.Random(5)
    cells = {(rng.randint(0, 30), rng.choice([0, 1, 2, 25])): float(k) for k in range(25)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()] + [(3, 12, None)], "i long, j long, z double")
    for frame in (None, (-5, 12, 3, 30)):
        i0, i1, j0, j1 = frame or (min(i for i, _ in cells), max(i for i, _ in cells), min(j for _, j in cells), max(j for _, j in cells))
        want = {}
        for i in range(i0, i1 + 1):
            for j in range(j0, j1 + 1):
                want[i, j] = cells[min(cells, key=lambda c: ((c[0] - i) ** 2 + (c[1] - j) ** 2, c))]  # noqa: B023
        got = {(r.i, r.j): r.z for r in G.nearest_filled(df, "z", frame).collect()}
        assert got == want
    assert G.nearest_filled(df.where("z is null"), "z").count() == 0


def test_smoothed_by_any_tiles(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.randint(-9, 20), rng.randint(4, 30), rng.uniform(0, 9)) for _ in range(150)], "i long, j long, z double").groupBy("i", "j").agg(F.max("z").alias("z"))
    tables = [{(r.i, r.j): r.z for r in G.smoothed(df, "z", tile=t).collect()} for t in (5, 64)]
    assert tables[0].keys() == tables[1].keys() and max(abs(tables[0][k] - tables[1][k]) for k in tables[0]) < 1e-12
    i0, i1, j0, j1 = G.frame_of(df)
    assert len(tables[0]) == (i1 - i0 + 1) * (j1 - j0 + 1) and all(0 <= v <= 9 for v in tables[0].values())
    flat = G.smoothed(spark.createDataFrame([(0, 0, 2.0), (6, 5, 2.0)], "i long, j long, z double"), "z").collect()
    assert len(flat) == 42 and all(r.z == pytest.approx(2.0) for r in flat)
    assert G.smoothed(df.where("false"), "z").count() == 0


@pytest.mark.parametrize("tile", [5.0, 40.0, 5000.0])
def test_greedy_spacing_is_the_sequential_one(spark, tile):
    rng = random.Random(7)
    rows = [(k % 2, k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(400)] + [(0, 1000 + k, float(k), 0.0) for k in range(60)] + [(1, 2000, None, 1.0)]
    kept = []
    for g, k, x, y in sorted(rows, key=lambda r: r[1]):
        if x is not None and all(h != g or (x - a) ** 2 + (y - b) ** 2 > 25 for h, _, a, b in kept):
            kept.append((g, k, x, y))
    got = G.spaced(spark.createDataFrame(rows, "g long, k long, x double, y double"), ["g"], "k", 5.0, tile)
    assert sorted(map(tuple, got.collect())) == sorted(kept)


def test_seams(spark):
    points = [("a", 9.5, 5.0, 0.0), ("a", 10.4, 5.0, 0.0), ("b", 10.6, 5.5, 0.0), ("c", 9.6, 15.0, 0.0), ("d", 10.2, 15.0, 0.0), ("d", 10.3, 15.1, 0.0), ("d", 10.3, 15.1, 0.0), ("e", 5.0, 9.9, 0.0), ("f", 5.0, 10.0, 9.0), (None, 9.9, 5.0, 0.0), ("g", 3.0, 3.0, 0.0)]
    got = {(r.axis, r.ci, r.cj, r.object, r.same, r.points, r.other) for r in G.seams(spark.createDataFrame(points, "name string, x double, y double, z double"), "name", size=10.0).collect()}
    assert got == {("x", 0, 0, "a", True, 2, "a"), ("x", 0, 1, "c", False, 2, "d")}


def test_joined():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    label = G.joined(200, a, b)
    assert (label[a] == label[b]).all() and (label <= np.arange(200)).all() and (label[label] == label).all()
    assert G.joined(3, np.array([], int), np.array([], int)).tolist() == [0, 1, 2] and math.isfinite(label.sum())
