"""Queries of grids: connected groups, filled and smoothed rasters, greedy spacing and chunk seams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids as R
from ..operators import spatial as P
from .registry import Tables, query
from .spatial import _CUST, _customers


def _cells_sql(size: int) -> str:
    return f"SELECT CAST(floor(x / {size}) AS BIGINT) AS i, CAST(floor(y / {size}) AS BIGINT) AS j, max(x) AS z FROM {_CUST} GROUP BY 1, 2"


def _labels_sql(size: int, reach: int) -> str:
    return f"""WITH RECURSIVE c AS (SELECT i, j, i * 4294967296 + j + 2147483648 AS n FROM ({_cells_sql(size)})),
    link AS (SELECT a.n AS a, b.n AS b FROM c a JOIN c b ON abs(a.i - b.i) <= {reach} AND abs(a.j - b.j) <= {reach}),
    r(a, b) AS (SELECT n, n FROM c UNION SELECT r.a, link.b FROM r JOIN link ON link.a = r.b)
    SELECT c.i, c.j, min(r.b) AS label FROM c JOIN r ON r.a = c.n GROUP BY 1, 2"""


@query("G13", _labels_sql(150, 1))
def grid_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells that touch, corners included, and the least cell of each group."""
    cells = P.raster(_customers(Tables(spark, sf_dir)), 150.0, F.count("*").alias("n"))
    return R.grid_labels(cells, tile=16)


@query("G13", _labels_sql(60, 3))
def grown_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells that touch once all have grown by one cell."""
    cells = P.raster(_customers(Tables(spark, sf_dir)), 60.0, F.count("*").alias("n"))
    return R.grid_labels(cells, reach=3, tile=32)


@query(
    "G10",
    f"""WITH g AS ({_cells_sql(200)}), e AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM g),
    f AS (SELECT i, unnest(range(j0, j1 + 1)) AS j FROM (SELECT unnest(range(i0, i1 + 1)) AS i, j0, j1 FROM e))
    SELECT f.i, f.j, arg_min(g.z, ((f.i - g.i) * (f.i - g.i) + (f.j - g.j) * (f.j - g.j), g.i, g.j)) AS z, bool_or(g.i = f.i AND g.j = f.j) AS measured FROM f, g GROUP BY 1, 2""",
)
def filled_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells between the outermost ones; a hole has the height of the nearest measured cell, however far."""
    return R.nearest_filled(P.raster(_customers(Tables(spark, sf_dir)), 200.0, F.max("x").alias("z")), "z")


def _mirrored(k: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {k} < {lo} THEN 2 * {lo} - 1 - ({k}) WHEN {k} > {hi} THEN 2 * {hi} + 1 - ({k}) ELSE {k} END"


def _blurred(source: str, axis: str) -> str:
    """A CTE body: a Gaussian of sigma 0.8 along an axis, over three cells on either side."""
    i, j = (_mirrored("a.i + k", "i0", "i1"), "a.j") if axis == "i" else ("a.i", _mirrored("a.j + k", "j0", "j1"))
    return f"SELECT a.i, a.j, sum(b.z * w) AS z FROM {source} a CROSS JOIN e CROSS JOIN w JOIN {source} b ON b.i = {i} AND b.j = {j} GROUP BY 1, 2"


@query(
    "G10",
    f"""WITH g AS ({_cells_sql(200)}), e AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(z) AS low FROM g),
    f AS (SELECT i, unnest(range(j0, j1 + 1)) AS j FROM (SELECT unnest(range(i0, i1 + 1)) AS i, j0, j1 FROM e)),
    g0 AS (SELECT f.i, f.j, g.z FROM f LEFT JOIN g ON g.i = f.i AND g.j = f.j),
    g1 AS (SELECT a.i, a.j, coalesce(a.z, max(b.z)) AS z FROM g0 a JOIN g0 b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j, a.z),
    g2 AS (SELECT a.i, a.j, coalesce(a.z, max(b.z), any_value(low)) AS z FROM g1 a JOIN g1 b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 CROSS JOIN e GROUP BY a.i, a.j, a.z),
    m AS (SELECT a.i, a.j, median(b.z) AS z FROM g2 a CROSS JOIN e CROSS JOIN range(-1, 2) x(k) CROSS JOIN range(-1, 2) y(l) JOIN g2 b ON b.i = {_mirrored("a.i + k", "i0", "i1")} AND b.j = {_mirrored("a.j + l", "j0", "j1")} GROUP BY 1, 2),
    w AS (SELECT k, exp(-0.5 * k * k / 0.64) / sum(exp(-0.5 * k * k / 0.64)) OVER () AS w FROM range(-3, 4) x(k)), b1 AS ({_blurred("m", "i")}), b2 AS ({_blurred("b1", "j")})
    SELECT i, j, round(z + 1e-7, 5) AS z FROM b2""",
)
def smoothed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps closed from around, other holes at the lowest height, a median and a Gaussian, mirrored at the edges."""
    grid = P.raster(_customers(Tables(spark, sf_dir)), 200.0, F.max("x").alias("z"))
    return R.smoothed(grid, "z", tile=16).select("i", "j", F.round(F.col("z") + 1e-7, 5).alias("z"))


@query(
    "W12",
    f"""WITH RECURSIVE c AS (SELECT c_nationkey AS k, c_custkey AS o, x, y, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM {_CUST}),
    r(k, n, kept) AS (SELECT k, 0, CAST([] AS STRUCT(o BIGINT, x DOUBLE, y DOUBLE)[]) FROM (SELECT DISTINCT k FROM c) UNION ALL
      SELECT c.k, c.n, CASE WHEN len(list_filter(kept, lambda p: (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 810000)) > 0 THEN kept ELSE list_append(kept, {{'o': c.o, 'x': c.x, 'y': c.y}}) END FROM r JOIN c ON c.k = r.k AND c.n = r.n + 1)
    SELECT k AS c_nationkey, p.o AS c_custkey FROM (SELECT k, unnest(arg_max(kept, n)) AS p FROM r GROUP BY k)""",
)
def greedy_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points kept in key order if far enough from all kept ones of their nation."""
    c = _customers(Tables(spark, sf_dir)).select("c_nationkey", "c_custkey", "x", "y")
    return R.spaced(c, ["c_nationkey"], "c_custkey", 900.0, tile=4000.0).select("c_nationkey", "c_custkey")


_SIDES = "SELECT '{c}' AS axis, {ci} AS ci, {cj} AS cj, e <= {c} / 500 AS beyond, name, x, y, z FROM (SELECT *, CASE WHEN {c} - floor({c} / 500) * 500 < 100 THEN floor({c} / 500) WHEN (floor({c} / 500) + 1) * 500 - {c} <= 100 THEN floor({c} / 500) + 1 END AS e FROM p) WHERE e IS NOT NULL"


@query(
    "G24",
    f"""WITH p AS (SELECT 'Tree_' || CAST(c_custkey % 7 AS VARCHAR) AS name, x, y, c_custkey * 101 % 4999 / 100.0 AS z FROM {_CUST}),
    s AS (SELECT DISTINCT axis, CAST(ci AS BIGINT) AS ci, CAST(cj AS BIGINT) AS cj, beyond, name, x, y, z FROM ({_SIDES.format(c="x", ci="e - 1", cj="floor(y / 500)")} UNION ALL {_SIDES.format(c="y", ci="floor(x / 500)", cj="e - 1")})),
    d AS (SELECT b.axis, b.ci, b.cj, b.name, b.x, b.y, b.z, a.name AS object, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS dist FROM s a JOIN s b ON NOT a.beyond AND b.beyond AND a.axis = b.axis AND a.ci = b.ci AND a.cj = b.cj),
    t AS (SELECT axis, ci, cj, name, arg_min(object, (dist, object)) AS object FROM d WHERE dist <= 150 GROUP BY axis, ci, cj, name, x, y, z), n AS (SELECT axis, ci, cj, object, name, count(*) AS n FROM t GROUP BY ALL)
    SELECT axis, ci, cj, object, bool_or(name = object) AS same, CAST(sum(n) AS BIGINT) AS points, arg_min(name, (-n, name)) AS other FROM n GROUP BY 1, 2, 3, 4""",
)
def seam_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What touches a chunk's border, and whether it has the same name on the other side."""
    z = (F.col("c_custkey") * 101 % 4999).cast("double") / 100
    c = _customers(Tables(spark, sf_dir)).select(F.concat(F.lit("Tree_"), (F.col("c_custkey") % 7).cast("string")).alias("name"), "x", "y", z.alias("z"))
    return R.seams(c, "name", size=500.0, strip=100.0, reach=150.0)
