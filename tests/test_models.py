"""Flat forests against the fitted ones, places on the grid and back, and ties of paths."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plazaflow.functions import scalar as S
from plazaflow.operators import graph as G
from plazaflow.operators import learn as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for k in range(400):
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        data.append((k, x if k % 17 else None, y if k % 23 else float("nan"), int(x * y > 20) if k % 3 else int(y > 5), k // 40 % 5))
    return spark.createDataFrame(data, "id long, x double, y double, label int, block int")


def test_flat_arrays_give_the_models_scores(rows):
    model = L.trained_forest(rows, ["x", "y"], "label", trees=25, depth=8)
    arrays = L.forest_arrays(model)
    assert len(arrays["roots"]) == 25 and max(t.depth for t in model.trees) <= 8
    own = {r.id: r.p for r in model.transform(L.complete(rows, ["x", "y"])).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    flat = {r.id: r.score for r in L.flat_forest(L.completed(rows, ["x", "y"]).select("id", "x", "y"), ["x", "y"], arrays, "score").collect()}
    assert own.keys() == flat.keys() and max(abs(own[k] - flat[k]) for k in own) < 1e-12 and len(set(flat.values())) > 20


def test_rows_with_missing_features_stay(rows):
    for forest in (True, False):
        got = L.out_of_fold(rows, ["x", "y"], "label", "block", 5, forest=forest, trees=5, depth=4).collect()
        assert sorted(r.id for r in got) == list(range(400)) and all(0 <= r.p <= 1 for r in got)
        right = sum((r.p >= 0.5) == r.label for r in got)
        assert right > 280
    empty = L.completed(rows.withColumn("z", F.lit(None).cast("double")), ["z"]).select("z").distinct().collect()
    assert [r.z for r in empty] == [0.0]


def test_shapes_of_a_car(spark):
    rng = random.Random(5)
    # four and a half metres long, turned by 30 degrees, the middle a metre higher
    points = []
    for k in range(3000):
        u, v = rng.uniform(-2.25, 2.25), rng.uniform(-0.9, 0.9)
        h = 1.5 if abs(u) < 0.8 else 0.5
        a = math.radians(30)
        points.append((1, 100 + u * math.cos(a) - v * math.sin(a), 50 + u * math.sin(a) + v * math.cos(a), h, float(k % 10)))
    points += [(2, 0.0, 0.0, 1.0, 3.0)]
    got = {r.k: r for r in L.shape_features(spark.createDataFrame(points, "k long, x double, y double, h double, it double"), "k").collect()}
    car = got[1]
    assert car.length == pytest.approx(4.5, abs=0.1) and car.width == pytest.approx(1.8, abs=0.1) and car.bump == pytest.approx(1.0) and car.n == 3000
    assert car.fill > 0.8 and car.h95 == 1.5 and car.roof_std == 0 and got[2].n == 1 and got[2].bump is None


def test_grid_and_back(spark):
    rng = random.Random(2)
    places = spark.createDataFrame([(rng.uniform(-80, 84), -117 + rng.uniform(-3.5, 3.5)) for _ in range(500)] + [(0.0, -117.0), (34.05, -118.25)], "lat double, lon double")
    east, north = S.utm(F.col("lat"), F.col("lon"))
    grid = places.select("*", east.alias("e"), north.alias("n"), S.utm_convergence(F.col("lat"), F.col("lon")).alias("turn"))
    back = S.utm_inverse(F.col("e"), F.col("n"))
    rows = grid.select("*", back[0].alias("la"), back[1].alias("lo")).collect()
    metre = 1 / 111_000
    assert all(abs(r.la - r.lat) < metre / 1000 and abs(r.lo - r.lon) * math.cos(math.radians(r.lat)) < metre / 1000 for r in rows)
    # the turn against a step north on the ground
    step = grid.select("turn", *(c.alias(n) for c, n in zip(S.utm(F.col("lat") + 1e-5, F.col("lon")), ("e2", "n2"), strict=True)), "e", "n").collect()
    assert all(abs(r.turn + math.degrees(math.atan2(r.e2 - r.e, r.n2 - r.n))) < 1e-3 for r in step)


def test_ties_of_paths(spark):
    rng = random.Random(4)
    edges = sorted({(rng.randint(0, 9), rng.randint(0, 9), float(rng.randint(0, 2))) for _ in range(45)})
    edges = [e for e in edges if e[0] != e[1]]
    near = {}
    for a, b, c in edges:
        near[a, b] = min(c, near.get((a, b), c))
    best = {}
    for n in range(1, 6):
        for path in itertools.permutations(range(10), n):
            if all(p in near for p in itertools.pairwise(path)):
                key = (sum(near[p] for p in itertools.pairwise(path)), n, path)
                best[path[0], path[-1]] = min(key, best.get((path[0], path[-1]), key))
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in range(10)], "source long, target long")
    frame = spark.createDataFrame(edges, "a long, b long, cost double")
    for most in (0, 200_000):
        got = {(r.source, r.target): (r.dist, tuple(r.nodes)) for r in G.dijkstra_paths(frame, pairs, max_edges=most).collect()}
        assert all(got[k] <= (d, p) for k, (d, _, p) in best.items())
        assert sum(got[k] == (d, p) for k, (d, _, p) in best.items()) > len(best) * 0.8
        kept = got if most == 0 else kept  # noqa: F821
        assert got == kept


def test_training_rows_are_computed_once_in_bounded_tasks(spark):
    asked = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            asked.add(len(f))
            yield f

    rows = spark.range(0, 900, 1, 1).selectExpr("id", "cast(id % 7 as double) x", "cast(id % 2 as int) label", "id % 3 fold").coalesce(1).mapInPandas(seen, "id long, x double, label int, fold long")
    ready = L.ready_rows(rows, ["x"], "label", most=100)
    sizes = ready.groupBy(F.spark_partition_id()).count().collect()
    assert ready.rdd.getNumPartitions() == 9 and max(r["count"] for r in sizes) < 200 and sum(r["count"] for r in sizes) == 900
    asked_before = asked.value
    assert L.out_of_fold(rows, ["x"], "label", "fold", 3, trees=2, depth=2).count() == 900
    assert asked_before == 900 and asked.value == 1800
    assert L.ready_rows(ready, ["x"], "label") is ready and L.trained_forest(ready, ["x"], "label", trees=2, depth=2).getNumTrees == 2
    assert asked.value == 1800
