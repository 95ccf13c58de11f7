"""Queries of spatial joins, rasters and planar geometry. Places are made from balances and keys of the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import regions as R
from ..operators import spatial as P
from ..operators.common import settle
from .registry import Tables, query

_CUST = "(SELECT c_custkey, c_nationkey, c_acctbal AS x, CAST(c_custkey * 37 % 9973 AS DOUBLE) AS y FROM customer)"
_SUPP = "(SELECT s_suppkey, s_nationkey, s_acctbal AS x, CAST(s_suppkey * 911 % 9973 AS DOUBLE) AS y FROM supplier)"


def _customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 9973).cast("double").alias("y"))


def _suppliers(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 911 % 9973).cast("double").alias("y"))


@query("J10 J15", f"SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, round(min(d), 6) AS dist FROM (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d FROM {_CUST} c, {_SUPP} s) WHERE d <= 600 GROUP BY 1")
def knn_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return P.nearest(_customers(t), _suppliers(t), "c_custkey", "s_suppkey", None, settle, most=600.0).withColumn("dist", F.round("dist", 6))


@query("J9 O2 J30", f"SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, round(min(d), 6) AS dist FROM (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d FROM {_CUST} c, {_SUPP} s) GROUP BY 1")
def nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest at any distance, by a growing radius instead of a cross join."""
    t = Tables(spark, sf_dir)
    return P.nearest(_customers(t), _suppliers(t), "c_custkey", "s_suppkey", None, settle).withColumn("dist", F.round("dist", 6))


@query("J11", f"SELECT a.c_custkey, count(*) AS near FROM {_CUST} a JOIN {_CUST} b ON a.c_custkey <> b.c_custkey AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 150 GROUP BY 1")
def radius_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many others stand within a radius."""
    c = _customers(Tables(spark, sf_dir)).select(F.col("c_custkey").alias("id"), "x", "y")

    def others(id_, r_id, x, y, squares, starts):  # noqa: ANN001, ANN202
        return {"c_custkey": id_[starts], "near": np.add.reduceat((id_ != r_id).astype(np.int64), starts)}

    counts = P.circle_folds(c, c, 150.0, others, "c_custkey long, near long")
    return counts.groupBy("c_custkey").agg(F.sum("near").alias("near")).where("near > 0")


@query(
    "J12",
    f"""SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey FROM (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d FROM {_CUST} c, {_SUPP} s WHERE abs(c_nationkey - s_nationkey) < 8
      AND NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_suppkey = s_suppkey)) WHERE d <= 700 GROUP BY 1""",
)
def snap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest site at about the same level to which there is no edge yet."""
    t = Tables(spark, sf_dir)
    keys = ["c_custkey", "s_s_suppkey"]
    edges = settle(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_s_suppkey")))

    def allowed(pairs):  # noqa: ANN001, ANN202
        level = settle(pairs.where("abs(c_nationkey - s_s_nationkey) < 8").select(*keys, "dist"))
        # edges of pairs, which are few, not pairs without any of the edges
        return level.join(edges.join(level.select(*keys), keys, "left_semi"), keys, "left_anti")

    return P.nearest(_customers(t), _suppliers(t), "c_custkey", "s_suppkey", None, settle, most=700.0, allowed=allowed).select("c_custkey", "s_suppkey")


_CELLS = f"SELECT CAST(floor(x / 100) AS BIGINT) AS i, CAST(floor(y / 100) AS BIGINT) AS j, max(x) AS hi, min(x) AS lo, count(*) AS n FROM {_CUST} GROUP BY 1, 2"


@query("A4 G9", _CELLS)
def raster_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.raster(_customers(Tables(spark, sf_dir)), 100.0, F.max("x").alias("hi"), F.min("x").alias("lo"), F.count("*").alias("n"))


@query(
    "J13 J14",
    f"""WITH g AS (SELECT c_nationkey AS o, CAST(floor(x / 200) AS BIGINT) AS i, CAST(floor(y / 200) AS BIGINT) AS j, min(x) AS h FROM {_CUST} GROUP BY 1, 2, 3)
    SELECT a.o AS a, b.o AS b, max(least(a.h, b.h)) AS saddle, count(*) AS cells FROM g a JOIN g b ON a.o < b.o AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2""",
)
def touching_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of objects with neighbouring cells, and the highest of their lower heights."""
    g = P.raster(_customers(Tables(spark, sf_dir)).withColumnRenamed("c_nationkey", "o"), 200.0, F.collect_list(F.struct("o", "x")).alias("r"))
    cells = g.select("i", "j", F.explode("r").alias("p")).groupBy("i", "j", "p.o").agg(F.min("p.x").alias("h"))
    sent = P.shifted(cells.withColumn("v", F.struct("o", "h")), "v").select("i", "j", F.col("v.o").alias("b"), F.col("v.h").alias("hb"))
    pairs = cells.withColumnRenamed("o", "a").join(sent, ["i", "j"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.max(F.least("h", "hb")).alias("saddle"), F.count("*").alias("cells"))


@query(
    "W9 G21",
    f"""WITH g AS ({_CELLS}) SELECT a.i, a.j, CAST(sum(CASE WHEN greatest(abs(a.i - b.i), abs(a.j - b.j)) <= 1 THEN b.n ELSE 0 END) AS DOUBLE) AS sum_1, CAST(sum(CASE WHEN greatest(abs(a.i - b.i), abs(a.j - b.j)) <= 3 THEN b.n ELSE 0 END) AS DOUBLE) AS sum_3, CAST(sum(b.n) AS DOUBLE) AS sum_8
    FROM g a JOIN g b ON abs(a.i - b.i) <= 8 AND abs(a.j - b.j) <= 8 GROUP BY 1, 2""",
)
def box_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in boxes of three sizes around each cell."""
    g = P.raster(_customers(Tables(spark, sf_dir)), 100.0, F.count("*").cast("double").alias("n"))
    return P.box_sums(g, "n", [1, 3, 8], tile=32)


@query(
    "G10",
    f"""WITH g AS ({_CELLS}), f AS (SELECT DISTINCT i + a AS i, j + b AS j FROM g, range(-1, 2) x(a), range(-1, 2) y(b))
    SELECT f.i, f.j, max(g.hi) AS z, bool_or(g.i = f.i AND g.j = f.j) AS measured FROM f JOIN g ON abs(f.i - g.i) <= 1 AND abs(f.j - g.j) <= 1 GROUP BY 1, 2""",
)
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured cells and those around them, with the largest value around."""
    g = P.raster(_customers(Tables(spark, sf_dir)), 100.0, F.max("x").alias("z"))
    return P.shifted(g, "z").groupBy("i", "j").agg(F.max("z").alias("z"), F.max((F.col("di") == 0) & (F.col("dj") == 0)).alias("measured"))


_ALONG = "coalesce((coalesce({n}, z) - coalesce({p}, z)) / nullif((CASE WHEN {p} IS NULL THEN 0 ELSE 1 END + CASE WHEN {n} IS NULL THEN 0 ELSE 1 END) * 200.0, 0), 0)"


@query(
    "G11",
    f"""WITH g AS (SELECT CAST(floor(x / 200) AS BIGINT) AS i, CAST(floor(y / 200) AS BIGINT) AS j, avg(x) AS z FROM {_CUST} GROUP BY 1, 2),
    n AS (SELECT g.i, g.j, g.z, w.z AS west, e.z AS east, s.z AS south, n.z AS north FROM g LEFT JOIN g w ON w.i = g.i - 1 AND w.j = g.j LEFT JOIN g e ON e.i = g.i + 1 AND e.j = g.j LEFT JOIN g s ON s.i = g.i AND s.j = g.j - 1 LEFT JOIN g n ON n.i = g.i AND n.j = g.j + 1),
    d AS (SELECT i, j, {_ALONG.format(n="east", p="west")} AS dx, {_ALONG.format(n="north", p="south")} AS dy FROM n)
    SELECT i, j, round(255 * greatest(0, sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(315) - atan2(-dx, dy))), 4) AS shade FROM d""",
)
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.raster(_customers(Tables(spark, sf_dir)), 200.0, F.avg("x").alias("z"))
    return P.slopes(g, "z", 200.0).select("i", "j", F.round(P.shade(F.col("dx"), F.col("dy")), 4).alias("shade"))


@query(
    "J27 G12",
    f"""WITH g AS (SELECT CAST(floor(x / 400) AS BIGINT) AS i, CAST(floor(y / 400) AS BIGINT) AS j, max(x) AS z FROM {_CUST} GROUP BY 1, 2)
    SELECT s_suppkey, round(sum((1 - abs(s.x / 400 - g.i)) * (1 - abs(s.y / 400 - g.j)) * z) + 1e-7, 4) AS z FROM {_SUPP} s JOIN g ON g.i IN (floor(s.x / 400), floor(s.x / 400) + 1) AND g.j IN (floor(s.y / 400), floor(s.y / 400) + 1) GROUP BY 1 HAVING count(*) = 4""",
)
def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster's value at points, interpolated between four cells."""
    t = Tables(spark, sf_dir)
    g = P.raster(_customers(t), 400.0, F.max("x").alias("z"))
    return P.bilinear(_suppliers(t).select("s_suppkey", "x", "y"), g, 400.0, "z").where("z is not null").select("s_suppkey", F.round(F.col("z") + 1e-7, 4).alias("z"))


_RINGS = "(SELECT n_nationkey AS k, CAST(n_nationkey % 5 AS DOUBLE) * 2000 AS x0, CAST(n_nationkey // 5 AS DOUBLE) * 2000 AS y0 FROM nation)"


def _rings(t: Tables) -> DataFrame:
    """A triangle for each nation."""
    x0, y0 = (F.col("n_nationkey") % 5).cast("double") * 2000, F.floor(F.col("n_nationkey") / 5).cast("double") * 2000
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return t.nation.select(F.col("n_nationkey").alias("k"), F.array(corner(x0, y0), corner(x0 + 2600, y0), corner(x0, y0 + 2600)).alias("ring"))


@query("J4 G1 A29", f"SELECT c_custkey, CAST(min(k) AS INTEGER) AS k FROM {_CUST} c JOIN {_RINGS} r ON x >= x0 AND y >= y0 AND (x - x0) + (y - y0) < 2600 GROUP BY 1")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first triangle that contains each point, candidates by cell."""
    t = Tables(spark, sf_dir)
    return P.points_in_rings(_customers(t), _rings(t), "c_custkey", "k", 1000.0)


@query("G2", f"SELECT CAST(k AS INTEGER) AS k, 3380000.0::DOUBLE AS area, round(5200 + 2600 * sqrt(2.0), 6) AS around FROM {_RINGS}")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(Tables(spark, sf_dir)).select("k", P.ring_area(F.col("ring")).alias("area"), F.round(P.ring_length(F.col("ring")), 6).alias("around"))


def _best_overlap(digits: int, floor: float):  # noqa: ANN202
    """Of each run of pairs the largest area, the best partner by rounded area (ties: smaller id), how many reach ``floor``, and their sum."""

    def fold(id_, r_id, area, starts):  # noqa: ANN001, ANN202
        rounded = np.floor(np.round(area * 10.0**digits, 3) + 0.5).astype(np.int64)
        return {"id": id_[starts], "top": np.maximum.reduceat(area, starts), "rounded": np.maximum.reduceat(rounded, starts), "best": _best(rounded, r_id, starts), "parts": np.add.reduceat((area >= floor).astype(np.int64), starts), "total": np.add.reduceat(area, starts)}

    return fold


def _best(rounded: np.ndarray, r_id: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The smallest id among the largest values of each run."""
    top = np.repeat(np.maximum.reduceat(rounded, starts), np.diff(np.r_[starts, len(rounded)]))
    return np.minimum.reduceat(np.where(rounded == top, r_id, np.iinfo(np.int64).max), starts)


@query(
    "J5 J6 J7 J8 J28",
    f"""WITH a AS (SELECT c_custkey AS id, x AS x0, y AS y0, x + 150 AS x1, y + 80 AS y1 FROM {_CUST}), b AS (SELECT s_suppkey AS id, x - 300 AS x0, y - 300 AS y0, x + 300 AS x1, y + 300 AS y1 FROM {_SUPP}),
    o AS (SELECT a.id, b.id AS site, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM a JOIN b ON least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))
    SELECT id, CASE WHEN max(area) >= 3600 THEN arg_max(site, (round(area, 4), -site)) END AS best, CAST(count(CASE WHEN area >= 1200 THEN 1 END) AS BIGINT) AS parts, round(sum(area) / 12000, 6) AS share FROM o GROUP BY 1""",
)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best overlap above a share, all overlaps above a floor, and the covered share of each box."""
    t = Tables(spark, sf_dir)
    box = lambda d, k, l, b, r, u: d.select(F.col(k).alias("id"), (F.col("x") + l).alias("x0"), (F.col("y") + b).alias("y0"), (F.col("x") + r).alias("x1"), (F.col("y") + u).alias("y1"))  # noqa: E731, E741
    o = P.box_folds(box(_customers(t), "c_custkey", 0, 0, 150, 80), box(_suppliers(t), "s_suppkey", -300, -300, 300, 300), 300.0, _best_overlap(4, 1200.0), "id long, top double, rounded long, best long, parts long, total double")
    best = F.when(F.max("top") >= 3600, F.max_by("best", F.struct("rounded", -F.col("best"))))
    return o.groupBy("id").agg(best.alias("best"), F.sum("parts").alias("parts"), F.round(F.sum("total") / 12000, 6).alias("share"))


@query("G3 J5", None)
def convex_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact area of each customer's diamond inside each nation's triangle, candidates by bounding box."""
    t = Tables(spark, sf_dir)
    diamonds = _customers(t).select(F.col("c_custkey").alias("id"), (F.col("x") - 90).alias("x0"), (F.col("y") - 90).alias("y0"), (F.col("x") + 90).alias("x1"), (F.col("y") + 90).alias("y1"))
    boxes = _rings(t).select(F.col("k").alias("id"), F.col("ring")[0]["x"].alias("x0"), F.col("ring")[0]["y"].alias("y0"), F.col("ring")[1]["x"].alias("x1"), F.col("ring")[2]["y"].alias("y1"))
    pairs = P.box_overlaps(diamonds, boxes, 1000.0)

    def work(frames):  # noqa: ANN001, ANN202
        for f in frames:
            out = []
            for r in f.itertuples():
                cx, cy = (r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2
                area = P.clip_area([(r.x0, cy), (cx, r.y0), (r.x1, cy), (cx, r.y1)], [(r.r_x0, r.r_y0), (r.r_x1, r.r_y0), (r.r_x0, r.r_y1)])
                out.append((r.id, r.r_id, round(area, 4)))
            yield pd.DataFrame(out, columns=["id", "k", "area"])

    return pairs.mapInPandas(work, "id long, k int, area double").where("area > 0")


_LINES = [("east", (2500.0, 0.0, 2500.0, 9000.0)), ("north", (0.0, 4000.0, 9000.0, 4000.0)), ("slant", (0.0, 0.0, 9000.0, 9000.0))]


@query(
    "J21 G5 P18",
    f"""WITH s AS (SELECT c_nationkey, x, y, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM {_CUST} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)), l AS (SELECT * FROM (VALUES ('east', 2500.0::DOUBLE, 0.0::DOUBLE, 2500.0::DOUBLE, 9000.0::DOUBLE), ('north', 0, 4000, 9000, 4000), ('slant', 0, 0, 9000, 9000)) v(site, ax, ay, bx, b_y))
    SELECT site, c_nationkey, count(*) AS n FROM (SELECT *, (qx - x) * (b_y - ay) - (qy - y) * (bx - ax) AS den, (ax - x) * (b_y - ay) - (ay - y) * (bx - ax) AS t, (ax - x) * (qy - y) - (ay - y) * (qx - x) AS v FROM s, l WHERE qx IS NOT NULL)
    WHERE den <> 0 AND t / den BETWEEN 0 AND 1 AND v / den BETWEEN 0 AND 1 GROUP BY 1, 2""",
)
def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each path crosses each of a fixed list of counting lines."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    s = _customers(Tables(spark, sf_dir)).withColumns({"qx": F.lead("x").over(w), "qy": F.lead("y").over(w)}).where("qx is not null")
    hit = F.array_compact(F.array(*(F.when(P.crossing(F.col("x"), F.col("y"), F.col("qx"), F.col("qy"), line), F.lit(name)) for name, line in _LINES)))
    return s.select("c_nationkey", F.explode(hit).alias("site")).groupBy("site", "c_nationkey").agg(F.count("*").alias("n"))


def _occluded(x0: int, y0: int, x1: int, y1: int) -> str:
    a, b = "CASE WHEN 5000 - x = 0 THEN 1e-12 ELSE 5000 - x END", "CASE WHEN 5000 - y = 0 THEN 1e-12 ELSE 5000 - y END"
    low = f"greatest(least(({x0} - x) / ({a}), ({x1} - x) / ({a})), least(({y0} - y) / ({b}), ({y1} - y) / ({b})), 0.0)"
    high = f"least(greatest(({x0} - x) / ({a}), ({x1} - x) / ({a})), greatest(({y0} - y) / ({b}), ({y1} - y) / ({b})), 1.0)"
    return f"{low} <= {high}"


@query("J22", f"SELECT c_custkey, {_occluded(1000, 1000, 1800, 2500)} OR {_occluded(4000, 3000, 5200, 3600)} OR {_occluded(6500, 7000, 7200, 9000)} AS hidden FROM {_CUST}")
def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fixed list of boxes stands between each point and a viewpoint."""
    boxes = [(1000.0, 1000.0, 1800.0, 2500.0), (4000.0, 3000.0, 5200.0, 3600.0), (6500.0, 7000.0, 7200.0, 9000.0)]
    c = _customers(Tables(spark, sf_dir))
    hidden = [P.ray_hits(F.col("x"), F.col("y"), 5000 - F.col("x"), 5000 - F.col("y"), b) for b in boxes]
    return c.select("c_custkey", F.array_contains(F.array(*hidden), True).alias("hidden"))


@query("A23 A24", f"SELECT c_nationkey, count(DISTINCT (CAST(floor(x / 250) AS BIGINT), CAST(floor(y / 250) AS BIGINT))) AS cells, round(count(*) / (count(DISTINCT (CAST(floor(x / 250) AS BIGINT), CAST(floor(y / 250) AS BIGINT))) * 0.0625), 6) AS density FROM {_CUST} GROUP BY 1")
def occupied_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(Tables(spark, sf_dir))
    cells = F.countDistinct(F.struct(P.cell("x", 250), P.cell("y", 250)))
    return c.groupBy("c_nationkey").agg(cells.alias("cells"), F.round(F.count("*") / (cells * 0.0625), 6).alias("density"))


@query(
    "A28",
    f"""WITH b AS (SELECT c_nationkey % 3 AS kind, CAST(round_even(x / 120, 0) AS BIGINT) AS i, CAST(round_even(y / 120, 0) AS BIGINT) AS j, CAST(count(*) AS BIGINT) AS w FROM {_CUST} GROUP BY 1, 2, 3)
    SELECT kind, i, j, least(w, 3) AS w FROM b WHERE NOT EXISTS (SELECT 1 FROM {_SUPP} s WHERE CAST(round_even(s.x / 120, 0) AS BIGINT) = b.i AND CAST(round_even(s.y / 120, 0) AS BIGINT) = b.j)""",
)
def spatial_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows merged by kind and rounded place, weights capped, places already taken left out."""
    t = Tables(spark, sf_dir)
    at = lambda c: F.bround(F.col(c) / 120).cast("long")
    b = _customers(t).groupBy((F.col("c_nationkey") % 3).alias("kind"), at("x").alias("i"), at("y").alias("j")).agg(F.count("*").alias("w"))
    taken = _suppliers(t).select(at("x").alias("i"), at("y").alias("j"))
    return b.join(taken, ["i", "j"], "left_anti").select("kind", "i", "j", F.least("w", F.lit(3)).cast("long").alias("w"))


@query(
    "A22",
    f"""WITH c AS (SELECT c_nationkey, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS t, count(*) AS n FROM {_CUST} GROUP BY 1),
    r AS (SELECT c_nationkey, n, (x - mx) * cos(t) + (y - my) * sin(t) AS u, (y - my) * cos(t) - (x - mx) * sin(t) AS v FROM {_CUST} JOIN c USING (c_nationkey)) SELECT c_nationkey, n, round(max(u) - min(u), 4) AS length, round(max(v) - min(v), 4) AS width FROM r GROUP BY 1, 2""",
)
def principal_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.principal_extent(_customers(Tables(spark, sf_dir)), "c_nationkey")
    return e.select("c_nationkey", "n", F.round("length", 4).alias("length"), F.round("width", 4).alias("width"))


_TURN = "(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"
_RING_SQL = "round(abs(list_sum(list_transform(range(1, len({r}) + 1), lambda n: {r}[n].x * {r}[n % len({r}) + 1].y - {r}[n % len({r}) + 1].x * {r}[n].y))) / 2, 3)"


@query(
    "G4",
    f"""WITH RECURSIVE p AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS k, x, y FROM {_CUST}),
    e AS (SELECT a.k, a.x, a.y FROM p a JOIN p b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.k = a.k GROUP BY a.k, a.x, a.y, b.x, b.y
      HAVING bool_and({_TURN.format(p="a", q="b", r="c")} > 0 OR ({_TURN.format(p="a", q="b", r="c")} = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0))),
    ends AS (SELECT k, min({{'x': x, 'y': y}}) AS a, max({{'x': x, 'y': y}}) AS b FROM e GROUP BY k), s AS (SELECT e.k, e.x, e.y, {_TURN.format(p="ends.a", q="ends.b", r="e")} > 0 AS upper FROM e JOIN ends USING (k)),
    ring AS (SELECT k, list({{'x': x, 'y': y}} ORDER BY upper, CASE WHEN upper THEN -x ELSE x END, CASE WHEN upper THEN -y ELSE y END) AS r FROM s GROUP BY k),
    cut(k, r) AS (SELECT k, r FROM ring UNION ALL SELECT k, list_filter(r, lambda p, n: n <> worst) FROM (SELECT k, r, list_sort(list_transform(range(1, len(r) + 1), lambda n: {{'a': abs({_TURN.format(p="r[(n + len(r) - 2) % len(r) + 1]", q="r[n]", r="r[n % len(r) + 1]")}), 'n': n}}))[1].n AS worst FROM cut WHERE len(r) > 12))
    SELECT ring.k, CAST(len(ring.r) AS INTEGER) AS corners, {_RING_SQL.format(r="ring.r")} AS area, CAST(len(last.r) AS INTEGER) AS kept, {_RING_SQL.format(r="last.r")} AS kept_area FROM ring JOIN (SELECT k, arg_min(r, len(r)) AS r FROM cut GROUP BY k) last USING (k)""",
)
def convex_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's hull, and what is left of it with twelve corners at most."""
    found = P.hulls(_customers(Tables(spark, sf_dir)).withColumnRenamed("c_nationkey", "k"), "k")
    return found.withColumns({c: F.round(c, 3) for c in ("area", "kept_area")})


@query("G6 G7", f"SELECT CAST(floor(h / 50) AS BIGINT) AS slice, round(median(z), 6) AS ground, count(*) AS n FROM (SELECT (x - 4500) * 0.6 + (y - 5000) * 0.8 AS h, (y - 5000) * 0.6 - (x - 4500) * 0.8 AS depth, x AS z FROM {_CUST}) WHERE abs(depth) <= 900 GROUP BY 1 HAVING count(*) >= 3")
def cut_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slab along a slanted cut, and the median height of each step with three points at least."""
    dx, dy = F.col("x") - 4500, F.col("y") - 5000
    c = _customers(Tables(spark, sf_dir)).select((dx * 0.6 + dy * 0.8).alias("h"), (dy * 0.6 - dx * 0.8).alias("depth"), F.col("x").alias("z")).where("abs(depth) <= 900")
    return c.groupBy(F.floor(F.col("h") / 50).cast("long").alias("slice")).agg(F.round(F.median("z"), 6).alias("ground"), F.count("*").alias("n")).where("n >= 3")


@query(
    "G19 G24",
    f"""SELECT ci, cj, count(*) AS n, CAST(count(CASE WHEN ci = floor(x / 500) AND cj = floor(y / 500) THEN 1 END) AS BIGINT) AS core FROM {_CUST}, (SELECT unnest(range(-3, 21)) AS ci), (SELECT unnest(range(-1, 21)) AS cj)
    WHERE x >= ci * 500 - 50 AND floor((x - 50) / 500) <= ci AND ci <= floor((x + 50) / 500) AND floor((y - 50) / 500) <= cj AND cj <= floor((y + 50) / 500) GROUP BY 1, 2""",
)
def buffered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points replicated into chunks with a margin."""
    c = P.replicated_chunks(_customers(Tables(spark, sf_dir)), 500.0, 50.0)
    return c.groupBy("ci", "cj").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_core"), 1)).alias("core"))


@query("G14", "SELECT p_partkey, CAST(unnest(range(0, CAST(floor((p_retailprice / 10 - 2.5) / 3.5) + 1 AS BIGINT))) AS BIGINT) AS storey FROM part WHERE p_retailprice / 10 >= 2.5")
def storeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors from the ground while 2.5 m fit under the top."""
    top = F.col("p_retailprice") / 10
    return Tables(spark, sf_dir).part.where(top >= 2.5).select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((top - 2.5) / 3.5))).alias("storey"))


@query(
    "G23 P18",
    f"""WITH n AS (SELECT s_suppkey, c.x, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2 FROM {_SUPP} s JOIN {_CUST} c ON (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 490000),
    g AS (SELECT s_suppkey, quantile_cont(x, 0.2) AS g FROM n GROUP BY 1) SELECT s_suppkey, count(*) AS n, round(min(g), 6) AS ground FROM n JOIN g USING (s_suppkey) WHERE d2 <= 250000 AND x > g + 50 GROUP BY 1""",
)
def tree_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within a circle that rise above the low percentile of a wider one."""
    t = Tables(spark, sf_dir)
    named = lambda d, k: d.select(F.col(k).alias("id"), "x", "y")

    def risen(id_, r_id, x, y, squares, starts):  # noqa: ANN001, ANN202
        found = []
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(id_)], strict=True):
            near = squares[at:end] <= 490000
            heights, close = x[at:end][near], squares[at:end][near] <= 250000
            if len(heights):
                place = (len(heights) - 1) * 0.2
                k = int(place)
                two = np.partition(heights, [k, min(k + 1, len(heights) - 1)])
                g = two[k] + (two[min(k + 1, len(heights) - 1)] - two[k]) * (place - k)
                n = int((close & (heights > g + 50)).sum())
                if n:
                    found.append((id_[at], n, g))
        columns = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], float)
        return dict(zip(("s_suppkey", "n", "ground"), columns, strict=True))

    made = P.circle_folds(named(_suppliers(t), "s_suppkey"), named(_customers(t), "c_custkey"), 700.0, risen, "s_suppkey long, n long, ground double")
    return made.withColumn("ground", F.round("ground", 6))


@query("F11 F12 F14", f"SELECT s_suppkey, round(b, 6) AS bearing, list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], CAST(floor(b / 45 + 0.5) AS INTEGER) % 8 + 1) AS octant, round(((b - 200 + 540) % 360) - 180, 6) AS turn, round(exp(2.0 * (cos(radians(b - 200)) - 1)), 9) AS weight FROM (SELECT s_suppkey, (degrees(atan2(x - 4500, y - 5000)) + 360) % 360 AS b FROM {_SUPP})")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("b")
    s = _suppliers(Tables(spark, sf_dir)).withColumn("b", S.bearing(F.col("x") - 4500, F.col("y") - 5000))
    return s.select("s_suppkey", F.round(b, 6).alias("bearing"), S.octant(b).alias("octant"), F.round(S.turn(b, F.lit(200.0)), 6).alias("turn"), F.round(S.von_mises(F.radians(b - 200), 2.0), 9).alias("weight"))


@query("F13 F19", f"SELECT s_suppkey, round((exp(-3.5 * 0.05) / exp(-3.5 * abs(g + 0.05)) + exp(-3.5 * 0.05) / exp(-3.5 * abs(-g + 0.05))) / 2, 9) AS slope, round(x * 0.3048, 6) AS metres, round(x / 10.764, 6) AS m2 FROM (SELECT *, (x - 4500) / 30000 AS g FROM {_SUPP})")
def slope_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _suppliers(Tables(spark, sf_dir)).select("s_suppkey", F.round(S.tobler((x - 4500) / 30000), 9).alias("slope"), F.round(x * S.FOOT, 6).alias("metres"), F.round(x / S.SQFT_PER_M2, 6).alias("m2"))


def _series(terms: list[float], xi: str, eta: str, f: str, g: str, factor: str = "{k!r}") -> str:
    """A sum of k f(2 j xi) g(2 j eta) over a series' terms k, as SQL."""
    return " + ".join(f"{factor.format(k=k, j=j)} * {f}({2 * j} * {xi}) * {g}({2 * j} * {eta})" for j, k in enumerate(terms, 1))


_UTM_SQL = f"""WITH p AS (SELECT s_suppkey, 34 + x / 100000 AS lat, -118 - y / 100000 AS lon FROM {_SUPP}),
    s AS (SELECT *, radians(lon + 117.0) AS lam, sinh(atanh(sin(radians(lat))) - {S.UTM_C!r} * atanh({S.UTM_C!r} * sin(radians(lat)))) AS t FROM p),
    w AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM s),
    g AS (SELECT *, 500000.0 + {S.UTM_UNIT!r} * (eta + {_series(S.UTM_ALPHA, "xi", "eta", "cos", "sinh")}) AS east, {S.UTM_UNIT!r} * (xi + {_series(S.UTM_ALPHA, "xi", "eta", "sin", "cosh")}) AS north,
      1.0 + {_series(S.UTM_ALPHA, "xi", "eta", "cos", "cosh", "{j} * 2 * {k!r}")} AS sigma, {_series(S.UTM_ALPHA, "xi", "eta", "sin", "sinh", "{j} * 2 * {k!r}")} AS tau FROM w),
    i AS (SELECT *, north / {S.UTM_UNIT!r} AS a, (east - 500000.0) / {S.UTM_UNIT!r} AS b FROM g),
    j AS (SELECT *, a - ({_series(S.UTM_BETA, "a", "b", "sin", "cosh")}) AS a2, b - ({_series(S.UTM_BETA, "a", "b", "cos", "sinh")}) AS b2 FROM i),
    k AS (SELECT *, asin(sin(a2) / cosh(b2)) AS chi FROM j)
    SELECT s_suppkey, round(east, 3) AS east, round(north, 3) AS north, round(degrees(atan2(tau * sqrt(1 + t * t) + sigma * t * tan(lam), sigma * sqrt(1 + t * t) - tau * t * tan(lam))), 7) AS convergence,
      round(degrees(chi + {" + ".join(f"{k!r} * sin({2 * j} * chi)" for j, k in enumerate(S.UTM_DELTA, 1))}), 8) AS lat, round(degrees(atan2(sinh(b2), cos(a2))) - 117.0, 8) AS lon FROM k"""


@query("F18", _UTM_SQL)
def utm_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid coordinates of places around 34 N, 118 W, the grid's turn there, and the degrees found back from the grid."""
    lat, lon = 34 + F.col("x") / 100_000, -118 - F.col("y") / 100_000
    east, north = S.utm(lat, lon)
    placed = _suppliers(Tables(spark, sf_dir)).select("s_suppkey", east.alias("east"), north.alias("north"), S.utm_convergence(lat, lon).alias("turn"))
    back = S.utm_inverse(F.col("east"), F.col("north"))
    return placed.select("s_suppkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round("turn", 7).alias("convergence"), F.round(back[0], 8).alias("lat"), F.round(back[1], 8).alias("lon"))


def _holed_sql(table: str, key: str, w: int, h: int, inset: int) -> str:
    return f"(SELECT {key} AS id, x AS x0, y AS y0, x + {w} AS x1, y + {h} AS y1, x + {inset} AS u0, y + {inset} AS v0, x + {w - inset} AS u1, y + {h - inset} AS v1 FROM {table})"


def _common(a: str, b: str) -> str:
    """Common area of boxes (x0, y0, x1, y1) or their holes (u0, v0, u1, v1)."""
    (ax, ay), (bx, by) = ({"o": "xy", "i": "uv"}[k[-1]] for k in (a, b))
    s, t = a[0], b[0]
    return f"greatest(0, least({s}.{ax}1, {t}.{bx}1) - greatest({s}.{ax}0, {t}.{bx}0)) * greatest(0, least({s}.{ay}1, {t}.{by}1) - greatest({s}.{ay}0, {t}.{by}0))"


def _holed(df: DataFrame, key: str, w: float, h: float, inset: float) -> DataFrame:
    """Polygons with a hole: the outer ring as two halves that touch, and the hole."""
    x, y = F.col("x"), F.col("y")
    ring = lambda *points: F.array(*(F.struct((x + F.lit(float(a))).alias("x"), (y + F.lit(float(b))).alias("y")) for a, b in points))
    halves = ring((0, 0), (w / 2, 0), (w / 2, h), (0, h)), ring((w / 2, 0), (w, 0), (w, h), (w / 2, h))
    hole = ring((inset, inset), (w - inset, inset), (w - inset, h - inset), (inset, h - inset))
    return df.select(F.col(key).alias("id"), F.array(*halves, hole).alias("rings"))


@query(
    "G3 J5 J6 J7 J8 J28",
    f"""WITH a AS {_holed_sql(_CUST, "c_custkey", 160, 120, 30)}, b AS {_holed_sql(_SUPP, "s_suppkey", 700, 500, 90)},
    o AS (SELECT a.id, b.id AS site, {_common("ao", "bo")} - {_common("ai", "bo")} - {_common("ao", "bi")} + {_common("ai", "bi")} AS shared FROM a JOIN b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
    k AS (SELECT *, 160 * 120 - 100 * 60 - shared AS alone, 700 * 500 - 520 * 320 - shared AS r_alone FROM o WHERE shared > 1)
    SELECT id, CASE WHEN max(shared) >= 0.3 * 13200 THEN arg_max(site, (round(shared, 3), -site)) END AS best, CAST(count(CASE WHEN shared >= 50 AND shared >= 0.1 * 13200 THEN 1 END) AS BIGINT) AS matches,
    bool_or(shared >= 0.3 * 13200 AND site % 2 <> id % 2) AS taken, round(sum(shared) / 13200, 6) AS share, round(sum(shared + alone + r_alone), 2) AS unions, round(sum(alone + r_alone), 2) AS differences FROM k GROUP BY 1""",
)
def region_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best overlap above a share, overlaps above two floors, whether one of another kind covers it, and areas of unions and differences."""
    t = Tables(spark, sf_dir)
    whole = 13200

    def fold(id_, r_id, both, only, r_only, starts):  # noqa: ANN001, ANN202
        both, counts = np.where(both > 1, both, 0.0), both > 1
        milli = both * 1000
        rounded = (np.floor(milli) + (milli - np.floor(milli) >= 0.5)).astype(np.int64)  # halves go up, nothing else does
        add = lambda v: np.add.reduceat(np.where(counts, v, 0), starts)
        taken = add((both >= 0.3 * whole) & (r_id % 2 != id_ % 2)) > 0
        return {
            "id": id_[starts], "pairs": add(1), "top": np.maximum.reduceat(both, starts), "rounded": np.maximum.reduceat(rounded, starts), "best": _best(rounded, r_id, starts), "matches": add((both >= 50) & (both >= 0.1 * whole)),
            "taken": taken, "share": add(both), "unions": add(both + only + r_only), "differences": add(only + r_only),
        }

    o = P.region_folds(_holed(_customers(t), "c_custkey", 160, 120, 30), _holed(_suppliers(t), "s_suppkey", 700, 500, 90), 400.0, fold, "id long, pairs long, top double, rounded long, best long, matches long, taken boolean, share double, unions double, differences double")
    best = F.when(F.max("top") >= 0.3 * whole, F.max_by("best", F.struct("rounded", -F.col("best"))))
    return o.where("pairs > 0").groupBy("id").agg(
        best.alias("best"),
        F.sum("matches").alias("matches"),
        F.max("taken").alias("taken"),
        F.round(F.sum("share") / whole, 6).alias("share"),
        F.round(F.sum("unions"), 2).alias("unions"),
        F.round(F.sum("differences"), 2).alias("differences"),
    )


@query(
    "G3 J5",
    f"""WITH a AS {_holed_sql(_CUST, "c_custkey", 160, 120, 30)}, b AS {_holed_sql(_SUPP, "s_suppkey", 700, 500, 90)},
    o AS (SELECT a.id, b.id AS site, {_common("ao", "bo")} - {_common("ai", "bo")} - {_common("ao", "bi")} + {_common("ai", "bi")} AS shared FROM a JOIN b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
    SELECT id, site, round(shared, 2) AS both, round(13200 + 183600 - shared, 2) AS united, round(13200 - shared, 2) AS outside, round(13200 + 183600 - 2 * shared, 2) AS either FROM o WHERE shared > 1""",
)
def united_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of what two overlapping polygons with holes have in common, of their union and of their differences, by their areas."""
    t = Tables(spark, sf_dir)
    rules = {"both": R.all_of(2), "united": R.UNION, "outside": R.FIRST_ONLY, "either": R.EITHER}
    made = P.overlay_areas(_holed(_customers(t), "c_custkey", 160, 120, 30), _holed(_suppliers(t), "s_suppkey", 700, 500, 90), 400.0, rules)
    cents = lambda n: (F.floor(F.col(n) * 100 + 0.5) / 100).alias(n)  # noqa: E731  # far cheaper than a decimal's rounding
    return made.where("both > 1").select("id", F.col("r_id").alias("site"), *map(cents, rules))


@query(
    "G3",
    """SELECT c_custkey AS id, round((w - 3) * (h - 3) - ((w - 60) * (h - 60) + 3 * (w + h - 120) + 32 * 2.25 * sin(2 * pi() / 64)), 2) AS floor_area, round(2 * (w + h - 6) + 2 * (w + h - 120) + 64 * 2 * 1.5 * sin(pi() / 64), 2) AS wall
    FROM (SELECT c_custkey, CAST(100 + 4 * c_nationkey AS DOUBLE) AS w, CAST(90 + c_custkey % 30 AS DOUBLE) AS h FROM customer)""",
)
def inner_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors with a yard, 1.5 m in from all walls: area and length of the resulting rings."""
    c = Tables(spark, sf_dir).customer.select("c_custkey", (100 + 4 * F.col("c_nationkey")).cast("double").alias("w"), (90 + F.col("c_custkey") % 30).cast("double").alias("h"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = lambda d: F.array(at(F.lit(d), F.lit(d)), at(F.col("w") - d, F.lit(d)), at(F.col("w") - d, F.col("h") - d), at(F.lit(d), F.col("h") - d))
    made = R.shape_results(c.select(F.col("c_custkey").alias("id"), F.array(box(0.0), box(30.0)).alias("rings")), ["rings"], {"inner": lambda rings: R.inset(rings, 1.5)})
    return made.select("id", F.round(R.rings_area(F.col("inner")), 2).alias("floor_area"), F.round(R.rings_length(F.col("inner")), 2).alias("wall"))


_SLICES = f"(SELECT DISTINCT c_custkey // 50 AS k, CAST(floor(x / 600) AS BIGINT) AS level, CAST(floor(y / 400) AS BIGINT) % 4 AS i, c_custkey % 5 AS j FROM {_CUST})"


@query(
    "W14 W15 G16",
    f"""WITH RECURSIVE s AS {_SLICES}, top AS (SELECT k, i, j, max(level) AS level FROM s GROUP BY ALL), levels AS (SELECT k, level, row_number() OVER (PARTITION BY k ORDER BY level) AS n FROM (SELECT DISTINCT k, level FROM s)),
    held AS (SELECT l.k, l.n, l.level, i, j FROM levels l JOIN top t ON t.k = l.k AND t.level >= l.level),
    side AS (SELECT h.k, h.n, count(*) AS free FROM held h CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(a, b) LEFT JOIN held o ON o.k = h.k AND o.n = h.n AND o.i = h.i + a AND o.j = h.j + b WHERE o.k IS NULL GROUP BY ALL),
    sized AS (SELECT k, n, level, count(*) AS cells FROM held GROUP BY ALL),
    tier(k, n, base, cells) AS (SELECT k, n, n, cells FROM sized WHERE n = 1 UNION ALL SELECT s.k, s.n, CASE WHEN t.cells - s.cells < 0.05 * t.cells THEN t.base ELSE s.n END, CASE WHEN t.cells - s.cells < 0.05 * t.cells THEN t.cells ELSE s.cells END FROM tier t JOIN sized s ON s.k = t.k AND s.n = t.n + 1)
    SELECT t.k, min(s.level) AS low, max(s.level) AS high, CAST(any_value(t.cells) * 4 AS DOUBLE) AS area, CAST(any_value(free) * 2 AS DOUBLE) AS wall FROM tier t JOIN sized s ON s.k = t.k AND s.n = t.n JOIN side ON side.k = t.k AND side.n = t.base GROUP BY t.k, t.base""",
)
def carried_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the cells of each slice of an object, carried down from the top and merged where they hardly differ, as rings."""
    c = _customers(Tables(spark, sf_dir))
    slices = c.select(F.floor(F.col("c_custkey") / 50).cast("long").alias("k"), F.floor(F.col("x") / 600).cast("long").alias("level"), (P.cell("y", 400) % 4).alias("i"), (F.col("c_custkey") % 5).alias("j"))
    tiers = R.carried_regions(R.cell_outlines(slices, ["k", "level"], 2.0), "k", same=0.05)
    return tiers.select("k", "low", "high", F.round(R.rings_area(F.col("rings")), 6).alias("area"), F.round(R.rings_length(F.col("rings")), 6).alias("wall"))
