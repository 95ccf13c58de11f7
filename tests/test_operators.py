"""Operators against their rules on tiny tables."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plazaflow.functions import scalar as S
from plazaflow.operators import graph as G
from plazaflow.operators import relational as L
from plazaflow.operators import solids as D
from plazaflow.operators import spatial as P
from plazaflow.operators import stochastic as K
from plazaflow.operators import temporal as T
from plazaflow.sources import readers
from plazaflow.streaming import events as E

from .conftest import SMALL


def test_apportion_ties_by_key(spark):
    df = spark.createDataFrame([("g", k, 1) for k in "abc"], "g string, k string, w int")
    got = {r.k: r.share for r in K.apportion(df, ["g"], "k", "w", F.lit(10)).collect()}
    assert got == {"a": 4, "b": 3, "c": 3}


def test_apportion_nothing(spark):
    df = spark.createDataFrame([("g", "a", 0), ("h", "a", 5)], "g string, k string, w int")
    assert K.apportion(df, ["g"], "k", "w", F.lit(0)).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(1, 500))
def test_apportion_sums(spark, weights, total):
    df = spark.createDataFrame([("g", i, w) for i, w in enumerate(weights)], "g string, k int, w int")
    assert sum(r.share for r in K.apportion(df, ["g"], "k", "w", F.lit(total)).collect()) == (total if sum(weights) else 0)


def test_state_wraps_to_the_days_last_trip(spark):
    e = spark.createDataFrame([(1, 30_000, "work"), (1, 70_000, "bar"), (2, 9_000, "park")], "p int, t int, s string")
    got = {r.p: r.state for r in T.state_at(e, ["p"], "t", F.col("s"), F.lit(10_800), F.lit("home")).collect()}
    assert got == {1: "bar", 2: "park"}


def test_trip_is_moved_before_midnight(spark):
    a, b = T.placed_trip(F.lit(86_390.0), F.lit(60.0))
    assert tuple(spark.range(1).select(a, b).first()) == (86_339.0, 86_399.0)


def test_occupancy_wraps(spark):
    i = spark.createDataFrame([("k", 3, 5), ("k", 4, 1), ("k", 2, 2)], "k string, s int, e int")
    assert [r.n for r in T.occupancy(i, ["k"], "s", "e", 6).orderBy("bin").collect()] == [1, 0, 0, 1, 2, 1]


def test_crossing_counts_touch_once_and_parallel_never(spark):
    line = (0.0, 0.0, 0.0, 10.0)
    seg = spark.createDataFrame([(-1.0, 5.0, 1.0, 5.0), (-1.0, 5.0, 0.0, 5.0), (1.0, 1.0, 1.0, 9.0)], "a double, b double, c double, d double")
    got = [r[0] for r in seg.select(P.crossing(F.col("a"), F.col("b"), F.col("c"), F.col("d"), line)).collect()]
    assert got == [True, True, False]


def test_alias_chain_and_cycle(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("x", "y"), ("y", "x")], "n string, t string")
    got = {r["name"]: r.root for r in G.roots(a, "n", "t").collect()}
    assert got["a"] == got["b"] == got["c"] == "c" and got["x"] == got["y"] == "x"


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r.comp for r in G.components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[101] == 100


def test_paths_agree_with_relaxation(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(a, rng.randrange(20), float(rng.randint(1, 9))) for a in range(20) for _ in range(3)], "a long, b long, cost double")
    far = {r["node"]: r.dist for r in G.hop_distances(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    paths = {r.target: r.dist for r in G.dijkstra_paths(edges, spark.createDataFrame([(0, t) for t in range(20)], "source long, target long")).collect()}
    assert paths == far


def test_nearest_matches_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(0, 5000), rng.uniform(0, 5000)) for i in range(60)]
    sites = [(i, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(5)]
    got = P.nearest(spark.createDataFrame(pts, "k int, x double, y double"), spark.createDataFrame(sites, "s int, x double, y double"), "k", "s", 50.0, lambda d: d.cache())
    best = {k: min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, s) for s, a, b in sites)[1] for k, x, y in pts}
    assert {r.k: r.s for r in got.collect()} == best


def test_clip_and_hull():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert P.clip_area([(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)], square) == 4.0
    assert P.clip_area([(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)], square) == 0.0
    assert P.convex_hull([*square, (1.0, 1.0), (2.0, 0.0)]) == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def test_point_hash_equals_wrapped_product(spark):
    rows = [(7, 11, 13), (123_456, 654_321, 42), (999_999_999, 1, 2)]
    df = spark.createDataFrame(rows, "x long, y long, z long").select(S.point_u(F.col("x"), F.col("y"), F.col("z")).alias("u"))
    wrap = lambda v: (v + 2**63) % 2**64 - 2**63
    want = []
    for x, y, z in rows:
        h = (x * 73856093) ^ (y * 19349663) ^ (z * 83492791)
        h = wrap((h ^ (h >> 13)) * 0x5BD1E995)
        want.append(((h ^ (h >> 15)) & 0xFFFFFF) / (1 << 24))
    assert [r.u for r in df.collect()] == want


def test_utm_of_a_known_place(spark):
    east, north = S.utm(F.lit(0.0), F.lit(-117.0))
    e, n = spark.range(1).select(east, north).first()
    assert abs(e - 500_000) < 1e-6 and abs(n) < 1e-6


def test_softmin_odds(spark):
    pairs = spark.range(20_000).select(F.col("id").alias("c"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    cost = F.when(F.col("k") == 1, 0.6931471805599453).otherwise(0.0)
    got = K.softmin_choice(pairs, ["c"], "k", cost, 1.0, S.uniform(1, "c", "k")).groupBy("k").count().collect()
    assert abs({r.k: r["count"] for r in got}[0] / 20_000 - 2 / 3) < 0.015


def test_repeat_period(spark):
    df = spark.createDataFrame([(1, k, float(k % 4 == 0)) for k in range(60)], "k long, pos int, v double")
    assert D.repeat_period(df, "k", 2, 10).first().period in (4, 8)


def test_keep_ratio(spark):
    assert spark.range(1).select(K.keep_ratio(F.lit(250.0), 250.0, 2.7), K.keep_ratio(F.lit(500.0), 250.0, 2.7)).first() == (1.0, 0.5**2.7)


def test_readers(spark, tmp_path):
    (tmp_path / "j.csv").write_text("w_geocode,C000,SA01,x\n1,5,6,a\n2,7,b,c\n")
    assert [tuple(r) for r in readers.jobs_csv(spark, str(tmp_path / "j.csv"), ["w_geocode"]).collect()] == [("1", 5, 6), ("2", 7, None)]
    (tmp_path / "a.txt").write_text("GEO|B1_E1|B1_M1\ng1|5|9\ng2|null|1\n")
    assert [tuple(r) for r in readers.estimates_table(spark, str(tmp_path / "a.txt")).collect()] == [("g1", 5.0), ("g2", None)]
    (tmp_path / "p.tsv").write_text(" a \t b \n 1\t2 \n")
    assert readers.padded_table(spark, str(tmp_path / "p.tsv")).collect() == [("1", "2")]
    (tmp_path / "m.json").write_text('{"x": {"v": 1}, "y": {"v": 2}}')
    assert {(r.key, r.value.v) for r in readers.json_map(spark, str(tmp_path / "m.json"), "struct<v:int>").collect()} == {("x", 1), ("y", 2)}
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"id": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1]]]}}, {"properties": {"id": 2}, "geometry": {"type": "Polygon", "coordinates": [[[0,0]]]}}, {"properties": {"id": 3}, "geometry": null}]}')
    assert [r.props.id for r in readers.features(spark, str(tmp_path / "g.json"), "id:int").collect()] == [1]
    (tmp_path / "l.jsonl").write_text('{"t": 1}\nbad\n{"t": 2}\n')
    assert sorted(r.t for r in readers.log_lines(spark, str(tmp_path / "l.jsonl"), "t int").collect()) == [1, 2]


def test_write_if_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, at string")
    path = str(tmp_path / "t")
    assert readers.write_if_changed(df, path, ["at"])
    assert not readers.write_if_changed(df.withColumn("at", F.lit("b")), path, ["at"])
    assert readers.write_if_changed(df.withColumn("k", F.lit(2)), path, ["at"])


def test_chunk_rewrite_keeps_others(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, chunk string")
    readers.write_chunks(df, path, "v")
    readers.write_chunks(spark.createDataFrame([(3, "b")], "v int, chunk string"), path, "v")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3]


def test_streams_drain_once(spark, tmp_path):
    for k in range(2):
        E.drained(E.windowed_counts(E.read_events(spark, SMALL)), str(tmp_path / "out"), str(tmp_path / "marks"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < out.agg(F.sum("n")).first()[0] <= spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert E.user_sessions(E.read_events(spark, SMALL)).columns == ["user_id", "start", "end", "n"]


def test_regions_equal_a_fine_grid():
    rng = random.Random(3)
    ring = lambda n: [(rng.randint(0, 40) / 2, rng.randint(0, 40) / 2) for _ in range(n)]

    def inside(rings, x, y):
        hits = 0
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
                hits += (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
        return hits % 2 == 1

    for _ in range(6):
        a, b = [ring(5), ring(3)], [ring(4), ring(3)]
        got = P.region_areas(a, b)
        step, sums = 0.1, [0, 0, 0]
        for i in range(200):
            for j in range(200):
                p = inside(a, (i + 0.5013) * step, (j + 0.4987) * step), inside(b, (i + 0.5013) * step, (j + 0.4987) * step)
                sums[0] += p == (True, True)
                sums[1] += p == (True, False)
                sums[2] += p == (False, True)
        assert all(abs(g - s * step * step) < 4 for g, s in zip(got, sums, strict=True))
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    assert P.region_areas([square(0, 0, 10), square(2, 2, 3)], [square(4, 4, 10)]) == (35.0, 56.0, 65.0)
    assert P.region_areas([square(0, 0, 2)], [square(2, 0, 2)]) == (0.0, 4.0, 4.0) and P.region_areas([], []) == (0.0, 0.0, 0.0)


def test_nearest_ends_with_odd_coordinates(spark):
    from plazaflow.operators.common import settle

    nan = float("nan")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, float("inf"), 0.0), (5, 1e7, 0.0)], "k long, x double, y double")
    sites = spark.createDataFrame([(9, 3.0, 4.0), (8, None, None), (7, nan, nan)], "s long, x double, y double")
    got = {r.k: (r.s, r.dist) for r in P.nearest(points, sites, "k", "s", 1.0, settle).collect()}
    assert got[1] == (9, 5.0) and set(got) == {1, 5}
    assert P.nearest(points, sites.where("s = 8"), "k", "s", 1.0, settle).count() == 0 and P.nearest(points.where("false"), sites, "k", "s", 1.0, settle).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12])
def test_roots_of_cycles(spark, n):
    cycle = [(f"c{k:02}", f"c{(k + 1) % n:02}") for k in range(n)]
    tails = [("a0", "a1"), ("a1", "c00"), ("b9", f"c{n - 1:02}"), ("x", "y"), ("y", "z"), ("p", "p"), (None, "x"), ("q", None)]
    got = {r.name: r.root for r in G.roots(spark.createDataFrame(cycle + tails, "f string, t string"), "f", "t").collect()}
    want = {**{a: "c00" for a, _ in cycle}, "a0": "c00", "a1": "c00", "b9": "c00", "x": "z", "y": "z", "p": "p"}
    assert got == want


def brute_crowns(points, cell, depth, flat, reach, flat_reach, tiny, least, passes=8):
    root = {p[0]: p[0] for p in points}
    for _ in range(passes):
        groups: dict = {}
        for n, *p in points:
            groups.setdefault(root[n], []).append(p)
        top = {g: max((z, x, y, h) for x, y, z, h in ps) for g, ps in groups.items()}
        size = {g: len(ps) for g, ps in groups.items()}
        saddle: dict = {}
        for a, pa in groups.items():
            for b, pb in groups.items():
                for xa, ya, za, _ in pa if a < b else ():
                    for xb, yb, zb, _ in pb:
                        if abs(xa // cell - xb // cell) <= 1 and abs(ya // cell - yb // cell) <= 1:
                            saddle[a, b] = max(saddle.get((a, b), -1e9), min(za, zb))
        pairs = []
        for (a, b), s in saddle.items():
            hi, lo = (a, b) if top[a][0] >= top[b][0] else (b, a)
            dip = top[lo][0] - s
            factor = flat_reach if dip < flat else reach
            apart = ((top[lo][1] - top[hi][1]) ** 2 + (top[lo][2] - top[hi][2]) ** 2) ** 0.5
            if (dip < depth and apart <= max(factor * top[hi][3], least)) or size[lo] < tiny:
                pairs.append((-s, lo, hi, factor))
        parent = {g: g for g in groups}

        def find(g):
            while parent[g] != g:
                g = parent[g]
            return g

        joined = 0
        for _, lo, hi, factor in sorted(pairs):
            a, b = find(lo), find(hi)
            if a == b:
                continue
            if top[a][0] > top[b][0]:
                a, b = b, a
            apart = ((top[a][1] - top[b][1]) ** 2 + (top[a][2] - top[b][2]) ** 2) ** 0.5
            if size[a] < tiny or apart <= max(factor * top[b][3], least):
                parent[a] = b
                size[b] += size[a]
                joined += 1
        root = {n: find(r) for n, r in root.items()}
        if not joined:
            break
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_crowns_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    points = []
    for node in range(24):
        cx, cy, top = rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(5, 15)
        for _ in range(rng.choice([1, 2, 12, 30])):
            dx, dy = rng.gauss(0, 1.6), rng.gauss(0, 1.6)
            z = round(top - 0.6 * (dx * dx + dy * dy) ** 0.5 + rng.random() / 100, 6)
            points.append((node, cx + dx, cy + dy, z, z))
    df = spark.createDataFrame(points, "node long, x double, y double, z double, height double").repartition(3)
    got = {r.node: r.root for r in G.merge_crowns(df, tiny=5).collect()}
    want = brute_crowns(points, 1.0, 1.5, 0.5, 0.5, 0.8, 5, 3.0)
    assert got == want and 1 < len(set(want.values())) < 24


def test_paths_of_graphs_too_large_for_a_worker(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 9)) + rng.random()) for _ in range(160)], "a long, b long, cost double")
    pairs = spark.createDataFrame([(a, b) for a in (0, 3, 7) for b in (0, 5, 11, 39, 99)], "source long, target long")
    rows = lambda df: sorted((r.source, r.target, round(r.dist, 9), tuple(r.nodes)) for r in df.collect())
    assert rows(G.dijkstra_paths(edges, pairs, max_edges=10)) == rows(G.dijkstra_paths(edges, pairs))


def test_wishes_are_granted_in_turn(spark):
    taken = spark.createDataFrame([(1, 1000.0, 2000.0)], "k long, t0 double, t1 double")
    wished = spark.createDataFrame([(1, 1, 1900.0, 2100.0), (1, 2, 2200.0, 3000.0), (1, 3, 2900.0, 3500.0), (1, 4, 3200.0, 3300.0), (1, 5, 86_000.0, 86_341.0), (2, 1, 1000.0, 2000.0)], "k long, rank long, t0 double, t1 double")
    got = {(r.k, r["rank"]): r.ok for r in T.when_free(taken, wished, ["k"]).collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 3): False, (1, 4): True, (1, 5): False, (2, 1): True}


def test_pairs_that_share_keys(spark):
    """Repeated rows and nulls, members that share one key, two and many; no pair is a row before it is counted."""
    rng = random.Random(5)
    rows = [(rng.randint(1, 40) if rng.random() < 0.95 else None, rng.randint(-3, 9) if rng.random() < 0.95 else None) for _ in range(220)] + [(100, 50), (101, 50), (100, 51), (101, 51), (102, 52), (102, 53)]
    keys = {}
    for k, m in rows:
        if k is not None and m is not None:
            keys.setdefault(m, set()).add(k)
    want = {(a, b, len(c), ",".join(map(str, sorted(c)[:3]))) for a in keys for b in keys if a < b and len(c := keys[a] & keys[b]) > 1}
    got = L.shared_by_pairs(spark.createDataFrame(rows, "k long, m long"), "k", "m")
    assert {tuple(r) for r in got.collect()} == want and (50, 51, 2, "100,101") in want
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan
    assert L.shared_by_pairs(spark.createDataFrame([], "k long, m long"), "k", "m").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_exact_percentile(spark, share):
    rng = random.Random(6)
    inf = float("inf")
    for values in ([None], [2.5, None], [1.0] * 50 + [2.0] * 3, [rng.choice([rng.gauss(0, 1e4), -inf, inf, 7.0]) for _ in range(20)], [round(rng.gauss(0, 100), 1) for _ in range(9000)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert str(L.exact_percentile(df, "v", share, accuracy=200)) == str(df.agg(F.percentile("v", share)).first()[0])


def test_rounds_of_merges_send_no_table_to_the_driver(spark, monkeypatch):
    """Each round's joins are by shuffles, also of tables small enough to be broadcast."""
    plans, settle = [], G.settle

    def seen(df):
        out = settle(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(G, "settle", seen)
    points = spark.range(40).selectExpr("id % 20 node", "cast(id % 20 as double) x", "0.0D y", "cast(id as double) z", "cast(id + 5 as double) height")
    assert G.merge_crowns(points, cell=1.0, depth=50.0, reach=2.0, flat_reach=2.0, tiny=1, least_reach=5.0).count() == 20
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
