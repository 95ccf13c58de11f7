"""Queries over graphs that the tables contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import Tables, query

_STEPS = "(SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders)"
_EDGES = "(SELECT least(a, b) AS a, greatest(a, b) AS b, min(cost) AS cost FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS b, 1.0::DOUBLE * (1 + l_suppkey % 7) AS cost FROM lineitem) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"


def _edges(t: Tables) -> DataFrame:
    moves = G.path_edges(t.lineitem, "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey"], "l_suppkey")
    return G.cheapest(moves.withColumn("cost", 1.0 * (1 + F.col("a") % 7)))


@query("N4 D8 D9", f"SELECT a, b, cost FROM {_EDGES}")
def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive stops, the cheapest of each pair."""
    return _edges(Tables(spark, sf_dir))


@query("N5", f"SELECT n, count(*) AS degree, bool_or(other % 2 = 0) AS even_neighbour FROM (SELECT a AS n, b AS other FROM {_EDGES} UNION ALL SELECT b, a FROM {_EDGES}) GROUP BY 1")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.both_ways(_edges(Tables(spark, sf_dir))).groupBy(F.col("a").alias("n")).agg(F.count("*").alias("degree"), F.max(F.col("b") % 2 == 0).alias("even_neighbour"))


_PARENT = "(SELECT p_partkey AS n, CASE WHEN p_partkey % 10 = 0 THEN p_partkey ELSE p_partkey - 1 - p_partkey % 3 * (CASE WHEN p_partkey % 10 > 3 THEN 1 ELSE 0 END) END AS p FROM part)"


def _parents(t: Tables) -> DataFrame:
    n = F.col("p_partkey")
    back = n - 1 - n % 3 * F.when(n % 10 > 3, 1).otherwise(0)
    return t.part.select(n.alias("n"), F.when(n % 10 == 0, n).otherwise(back).alias("p"))


@query("N7 J17", f"WITH RECURSIVE c(n, p) AS (SELECT n, p FROM {_PARENT} UNION SELECT c.n, a.p FROM c JOIN {_PARENT} a ON a.n = c.p WHERE a.p <> c.p) SELECT n AS name, min(p) AS root FROM c GROUP BY 1")
def alias_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roots(_parents(Tables(spark, sf_dir)), "n", "p")


_LINKS = "(SELECT DISTINCT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS b FROM orders)"


@query(
    "N1 G13",
    f"WITH RECURSIVE e AS (SELECT a, b FROM {_LINKS} WHERE b IS NOT NULL AND a <> b), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM w UNION SELECT r.n, w.b FROM r JOIN w ON w.a = r.m) SELECT n AS node, min(m) AS comp FROM r GROUP BY 1",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked by orders of the same day, priority and state."""
    o = Tables(spark, sf_dir).orders.withColumn("day", F.concat_ws("|", F.col("o_orderdate").cast("string"), "o_orderpriority", "o_orderstatus"))
    return G.components(G.path_edges(o, "day", ["o_orderkey"], "o_custkey"))


_RING = "(SELECT n_nationkey::BIGINT AS a, ((n_nationkey + 1) % 25)::BIGINT AS b, (1 + n_nationkey % 4)::DOUBLE AS cost FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25, (2 + n_nationkey % 5)::DOUBLE FROM nation)"


def _ring(t: Tables) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return t.nation.select(n.alias("a"), ((n + 1) % 25).alias("b"), (1 + n % 4).cast("double").alias("cost")).unionByName(t.nation.select(n.alias("a"), ((n * 7 + 3) % 25).alias("b"), (2 + n % 5).cast("double").alias("cost")))


@query(
    "N2 N3",
    f"WITH RECURSIVE p(n, d, k) AS (SELECT n_nationkey::BIGINT, 0.0::DOUBLE, 0 FROM nation WHERE n_regionkey = 0 UNION SELECT e.b, p.d + e.cost, p.k + 1 FROM p JOIN {_RING} e ON e.a = p.n WHERE p.k < 12 AND p.d < 30) SELECT n AS node, min(d) AS dist FROM p GROUP BY 1",
)
def shortest_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From several sources at once, by relaxation."""
    t = Tables(spark, sf_dir)
    return G.hop_distances(_ring(t), t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("node"))).select("node", "dist")


@query(
    "N2 N3 N8",
    f"""WITH RECURSIVE p(s, n, d, path) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0.0::DOUBLE, [n_nationkey::BIGINT] FROM nation
      UNION ALL SELECT p.s, e.b, p.d + e.cost, list_append(p.path, e.b) FROM p JOIN {_RING} e ON e.a = p.n WHERE len(p.path) < 12 AND NOT list_contains(p.path, e.b)),
    b AS (SELECT s AS source, n AS target, min(d) AS dist, arg_min(path, (d, len(path), path)) AS path FROM p WHERE n = (s * 11 + 5) % 25 GROUP BY 1, 2)
    SELECT source, target, dist, array_to_string(path, '>') AS path, len(list_filter(range(1, len(path)), lambda k: path[k] % 5 = path[k + 1] % 5)) > 0 AS along FROM b""",
)
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole paths of wanted pairs, and whether two consecutive nodes lie in one region."""
    t = Tables(spark, sf_dir)
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("n"), "n_regionkey")
    pairs = n.select(F.col("n").alias("source"), ((F.col("n") * 11 + 5) % 25).alias("target"))
    paths = G.dijkstra_paths(_ring(t), pairs)
    walks = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda k: F.get("nodes", k) % 5 == F.get("nodes", k + 1) % 5)
    inside = F.when(F.size("nodes") > 1, F.exists(walks, lambda x: x)).otherwise(False)
    return paths.select("source", "target", "dist", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), inside.alias("along"))


@query("N6", None)
def ordered_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' places in pieces of 300 by 300, merged where the saddle between two tops is high and the tops are near."""
    c = Tables(spark, sf_dir).customer
    y = (F.col("c_custkey") * 37 % 9973).cast("double")
    places = c.select("c_custkey", F.col("c_acctbal").alias("x"), y.alias("y"), (F.col("c_custkey") * 101 % 4999 / 100.0).alias("z"))
    node = (F.floor(F.col("x") / 300) + 1000) * 100_000 + F.floor(F.col("y") / 300)
    points = places.select(node.cast("long").alias("node"), "x", "y", "z", (F.col("z") + 5).alias("height"))
    return G.merge_crowns(points, cell=150.0, depth=12.0, flat=4.0, reach=8.0, flat_reach=14.0, tiny=2, least_reach=120.0)
