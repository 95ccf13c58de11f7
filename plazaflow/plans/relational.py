"""Filters, joins, aggregates and windows of relational shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from .registry import Tables, query


@query("P1 P13 S4 S13", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS price FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity BETWEEN 10 AND 20")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open and closed bounds, pushed to the scan; only the columns read are kept, rounded."""
    t = Tables(spark, sf_dir).lineitem
    inside = (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("l_quantity").between(10, 20)
    return t.where(inside).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 1).alias("price"))


@query("P2 U2", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def semi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(keys, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("P16 U3", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    denied = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(denied, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("P3 F1", "SELECT split_part(c_name, '#', 1) AS kind, upper(c_mktsegment[1:3]) AS seg, count(*) AS n, max(printf('%05d', c_custkey)) AS last FROM customer WHERE starts_with(c_name, 'C') GROUP BY 1, 2")
def prefix_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).customer.where(F.col("c_name").startswith("C"))
    return t.groupBy(S.prefix(F.col("c_name"), "#").alias("kind"), F.upper(F.substring("c_mktsegment", 1, 3)).alias("seg")).agg(F.count("*").alias("n"), F.max(F.format_string("%05d", "c_custkey")).alias("last"))


_USE_RULES = [("STEEL", "plant"), ("TIN", "shop"), ("COPPER", "office"), ("BRASS", "home")]


@query(
    "P4 P6 J2",
    "SELECT p_partkey, CASE WHEN contains(upper(p_type), 'STEEL') THEN 'plant' WHEN contains(upper(p_type), 'TIN') THEN 'shop' WHEN contains(upper(p_type), 'COPPER') THEN 'office' WHEN contains(upper(p_type), 'BRASS') THEN 'home' ELSE 'other' END AS use_kind FROM part",
)
def ordered_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First match wins."""
    name = F.upper("p_type")
    return Tables(spark, sf_dir).part.select("p_partkey", S.first_rule(name, [(name.contains(w), kind) for w, kind in _USE_RULES], "other").alias("use_kind"))


@query(
    "P5",
    "SELECT o_orderkey, (o_orderstatus <> 'P' AND (o_orderpriority LIKE '1%' OR o_orderstatus = 'F')) AS walk, (o_orderstatus = 'O' AND o_orderpriority LIKE '5%') AS graded FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice < 1000)",
)
def tag_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate tree over a map of tags, with overrides and an exclusion."""
    t = Tables(spark, sf_dir).orders.withColumn("tags", F.create_map(F.lit("access"), "o_orderstatus", F.lit("way"), "o_orderpriority"))
    access, way = F.col("tags")["access"], F.col("tags")["way"]
    kept = t.where(~((access == "O") & (F.col("o_totalprice") < 1000)))
    return kept.select("o_orderkey", ((access != "P") & (way.startswith("1") | (access == "F"))).alias("walk"), ((access == "O") & way.startswith("5")).alias("graded"))


_PREFIXES = [("PROMO BR", 3.0), ("PROMO", 2.0), ("STAND", 1.5), ("S", 0.5)]


@query(
    "P7",
    "SELECT p_type, CASE WHEN starts_with(p_type, 'PROMO BR') THEN 3.0::DOUBLE WHEN starts_with(p_type, 'PROMO') THEN 2.0::DOUBLE WHEN starts_with(p_type, 'STAND') THEN 1.5::DOUBLE WHEN starts_with(p_type, 'S') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, count(*) AS n FROM part GROUP BY 1, 2",
)
def listed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's order decides, not the prefix's length."""
    t = Tables(spark, sf_dir).part
    return t.groupBy("p_type", S.first_listed_prefix(F.col("p_type"), _PREFIXES, 1.0).alias("weight")).agg(F.count("*").alias("n"))


@query("P8", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), 1.0::DOUBLE) AS rate FROM lineitem")
def zero_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", S.first_non_zero(F.col("l_discount"), F.col("l_tax"), F.lit(1.0)).alias("rate"))


@query(
    "P9 P10 F21 S10",
    """SELECT event_id, TRY_CAST(regexp_replace('1,' || k || '+/-', '[,+]|/-', '', 'g') AS DOUBLE) AS parsed, CAST(k AS INTEGER) AS k
    FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) WHERE TRY_CAST(k AS INTEGER) IS NOT NULL""",
)
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that do not parse are dropped; commas and error marks are not an obstacle."""
    k = F.get_json_object("props", "$.k")
    t = Tables(spark, sf_dir).events.select("event_id", k.alias("text")).where(F.col("text").try_cast("int").isNotNull())
    return t.select("event_id", S.number_or_null(F.concat(F.lit("1,"), "text", F.lit("+/-"))).alias("parsed"), F.col("text").cast("int").alias("k"))


@query(
    "P11 T10",
    """SELECT CAST(y AS INTEGER) AS y, count(CASE WHEN year(o_orderdate) <= y AND (y < year(o_orderdate) + 2 OR o_orderstatus = 'P') THEN 1 END) AS standing, count(CASE WHEN year(o_orderdate) <= y THEN 1 END) AS built
    FROM (SELECT unnest(range(1992, 2000)) AS y), orders GROUP BY 1""",
)
def asof_year_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in each year: from its first year to its last, or for good. Yearly starts and ends are summed up."""
    t = Tables(spark, sf_dir).orders.select(F.year("o_orderdate").alias("start"), "o_orderstatus")
    begin = t.select("start", F.lit(1).alias("d"), F.lit(1).alias("b"))
    end = t.where("o_orderstatus <> 'P'").select((F.col("start") + 2).alias("start"), F.lit(-1).alias("d"), F.lit(0).alias("b"))
    frame = spark.range(1992, 2000).select(F.col("id").cast("int").alias("start"), F.lit(0).alias("d"), F.lit(0).alias("b"))
    steps = begin.unionByName(end).unionByName(frame).groupBy("start").agg(F.sum("d").alias("d"), F.sum("b").alias("b"))
    up = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(F.col("start").alias("y"), F.sum("d").over(up).alias("standing"), F.sum("b").over(up).alias("built")).where("y between 1992 and 1999")


@query(
    "P14 J31",
    """SELECT split_part(label, '!!', 1) AS measure, split_part(label, '!!', 2) AS part, round(sum(v), 2) AS total FROM (
      SELECT 'price!!' || l_returnflag AS label, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'quantity!!' || l_returnflag, l_quantity FROM lineitem) GROUP BY 1, 2""",
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide columns to rows, aggregated before the labels are split."""
    t = Tables(spark, sf_dir).lineitem.groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    rows = R.unpivot(t, ["l_returnflag"], ["price", "quantity"], "measure", "v").withColumn("label", F.concat_ws("!!", "measure", "l_returnflag"))
    parts = F.split("label", "!!")
    return rows.select(parts[0].alias("measure"), parts[1].alias("part"), F.round("v", 2).alias("total"))


@query(
    "P15 M3 A31",
    """SELECT l_suppkey, count(*) AS n, max(l_quantity) AS top, round(quantile_cont(l_quantity, 0.95), 6) AS q95, round(stddev_pop(l_quantity), 6) AS spread
    FROM lineitem GROUP BY 1 HAVING count(*) >= 15 AND quantile_cont(l_quantity, 0.95) BETWEEN 30 AND 50 AND stddev_pop(l_quantity) > 5""",
)
def robust_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects accepted by size, height percentile and roughness."""
    q = F.percentile("l_quantity", 0.95)
    t = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"), q.alias("q95"), F.stddev_pop("l_quantity").alias("spread"))
    return t.where("n >= 15 and q95 between 30 and 50 and spread > 5").withColumns({"q95": F.round("q95", 6), "spread": F.round("spread", 6)})


@query("P17", "SELECT c_custkey, c_nationkey, CAST(right(c_name, 4) AS INTEGER) AS digits FROM customer WHERE TRY_CAST(right(c_name, 4) AS INTEGER) IS NOT NULL")
def digit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns chosen by their name, rows by whether a text is a number."""
    t = Tables(spark, sf_dir).customer
    return t.select(*(c for c in t.columns if c[2:3] in "cn" and c.endswith("key")), F.right("c_name", F.lit(4)).try_cast("int").alias("digits")).where("digits is not null")


@query("P19", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN coalesce(nullif(CAST(o_totalprice AS BIGINT) % 2500, 0), 0) > 1000 THEN CAST(o_totalprice AS BIGINT) % 2500 ELSE -1 END AS yr FROM (SELECT o_orderkey, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders)")
def plausible_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year counts if it is plausible; what is no building gets 0, one without a year -1."""
    year = F.floor("o_totalprice").cast("long") % 2500
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", 0).when(year > 1000, year).otherwise(-1).cast("long").alias("yr"))


@query(
    "J1 A1 A2",
    """SELECT r_name, n_name, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""",
)
def lookup_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sums over a chain of key joins. Line items are summed by order before they travel further."""
    t = Tables(spark, sf_dir)
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")).alias("v"))
    orders = lines.join(t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))
    by_nation = orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "y").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    named = by_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name", "y").agg(F.sum("n").alias("n"), F.sum("v").alias("revenue_cents"))


_PLACES = [("first", "^[A-C]"), ("second", "A$"), ("third", "[IO].*N")]


@query("J3 F5", "SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '^[A-C]') THEN 'first' WHEN regexp_matches(n_name, 'A$') THEN 'second' WHEN regexp_matches(n_name, '[IO].*N') THEN 'third' END AS place FROM nation")
def pattern_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a list of patterns that a name matches."""
    name = F.col("n_name")
    return Tables(spark, sf_dir).nation.select("n_nationkey", S.first_rule(name, [(name.rlike(p), place) for place, p in _PLACES]).cast("string").alias("place"))


@query(
    "J16 D3",
    """SELECT p.p_partkey, coalesce(b.brand, a.brand, p.p_brand) AS p_brand, coalesce(b.size, a.size, p.p_size) AS p_size FROM part p
    LEFT JOIN (SELECT l_partkey, max('A' || l_returnflag) AS brand, CAST(max(l_quantity) AS INTEGER) AS size FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) a ON a.l_partkey = p_partkey
    LEFT JOIN (SELECT l_partkey, max('B' || l_returnflag) AS brand, CAST(max(l_quantity) AS INTEGER) AS size FROM lineitem WHERE l_tax > 0.07 GROUP BY 1) b ON b.l_partkey = p_partkey""",
)
def priority_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late deltas over a base table; the later delta wins."""
    t = Tables(spark, sf_dir)

    def delta(mark: str, condition: str) -> DataFrame:
        return t.lineitem.where(condition).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.concat(F.lit(mark), "l_returnflag")).alias("p_brand"), F.max("l_quantity").cast("int").alias("p_size"))

    return R.overlay(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey", [delta("A", "l_discount > 0.08"), delta("B", "l_tax > 0.07")], ["p_brand", "p_size"])


@query(
    "J23 U4",
    """WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n, array_to_string(list_sort(list(a.l_partkey))[1:3], ',') AS first_parts FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs that share keys, with a count and the first shared ones. The side of a key is its distinct members."""
    return R.shared_by_pairs(Tables(spark, sf_dir).lineitem, "l_partkey", "l_suppkey").withColumnRenamed("firsts", "first_parts")


@query(
    "J24",
    """WITH k AS (SELECT (l_partkey << 20) | CAST(l_quantity AS BIGINT) AS k, l_orderkey, l_linenumber FROM lineitem), once AS (SELECT k FROM k GROUP BY k HAVING count(*) = 1)
    SELECT k, l_orderkey, l_linenumber FROM k WHERE k IN (SELECT k FROM once)""",
)
def unique_packed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose packed key occurs once."""
    t = Tables(spark, sf_dir).lineitem.select(F.shiftleft("l_partkey", 20).bitwiseOR(F.col("l_quantity").cast("long")).alias("k"), "l_orderkey", "l_linenumber")
    return R.unique_on(t, ["k"])


@query(
    "J26 J29",
    """SELECT s.s_suppkey, coalesce(o.label, s.s_name) AS label, coalesce(o.why, '') AS why FROM supplier s LEFT JOIN (
      SELECT l_suppkey, arg_min(p_brand, l_partkey) AS label, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS why FROM lineitem JOIN part ON p_partkey = l_partkey
      WHERE p_size >= 45 AND p_type NOT LIKE '%TIN%' GROUP BY 1) o ON o.l_suppkey = s_suppkey""",
)
def listed_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first listing names an object, all reasons are kept; one kind may not merge."""
    t = Tables(spark, sf_dir)
    listed = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.where("p_size >= 45 and p_type not like '%TIN%'"), F.col("l_partkey") == F.col("p_partkey"))
    over = listed.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min_by("p_brand", "l_partkey").alias("label"), F.array_join(F.array_sort(F.collect_set("p_brand")), "; ").alias("why"))
    return t.supplier.join(over, "s_suppkey", "left").select("s_suppkey", F.coalesce("label", "s_name").alias("label"), F.coalesce("why", F.lit("")).alias("why"))


@query(
    "A3",
    "SELECT l_suppkey, l_shipmode AS mode, n FROM (SELECT l_suppkey, l_shipmode, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f, l_shipmode) AS r FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2)) WHERE r = 1",
)
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).lineitem.withColumn("mode", F.concat("l_returnflag", "l_linestatus"))
    return R.mode_first(t, ["l_suppkey"], "mode", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query(
    "A5 A7",
    "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.02), 6) AS p02, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(median(l_extendedprice), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, interpolated percentiles of each group, all from one buffer."""
    q = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(F.percentile("l_extendedprice", F.array(*map(F.lit, (0.02, 0.1, 0.5, 0.9, 0.99)))).alias("q"))
    return q.select("l_suppkey", *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p02", "p10", "p50", "p90", "p99"))))


@query(
    "A6 O5",
    "SELECT l_suppkey, l_quantity AS q FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE r = CAST(floor(0.85 * (n - 1) + 0.5) AS BIGINT) + 1",
)
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(R.nearest_rank(F.col("l_quantity"), 0.85).alias("q"))


@query("A8", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS top_order, max(o_totalprice) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low_order FROM orders GROUP BY 1")
def extreme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at the top and at the bottom of each group, ties by key."""
    t = Tables(spark, sf_dir).orders
    return t.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("top_order"), F.max("o_totalprice").alias("top"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("low_order"))


@query("A11", "SELECT event_type, CAST(round(sum(CASE WHEN value > 50 THEN value END)) AS BIGINT) AS boarding, CAST(round(sum(CASE WHEN value <= 50 THEN value END)) AS BIGINT) AS alighting, count(CASE WHEN value > 90 THEN 1 END) AS n FROM events GROUP BY 1")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.round(F.sum(F.when(v > 50, v))).cast("long").alias("boarding"), F.round(F.sum(F.when(v <= 50, v))).cast("long").alias("alighting"), F.count(F.when(v > 90, 1)).alias("n"))


@query("A13 A14", "SELECT c_mktsegment, count(DISTINCT coalesce(n_name, c_name)) AS things, count(DISTINCT c_nationkey) AS nations FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON n_nationkey = c_nationkey WHERE c_acctbal <> 0 GROUP BY 1")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct things per layer: the entity where there is one, else the object."""
    t = Tables(spark, sf_dir)
    named = t.customer.where("c_acctbal <> 0").join(t.nation.where("n_regionkey <> 2"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return named.groupBy("c_mktsegment").agg(F.countDistinct(F.coalesce("n_name", "c_name")).alias("things"), F.countDistinct("c_nationkey").alias("nations"))


@query(
    "A15",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS model, round(sum(l_quantity * (1 - l_discount)), 2) AS observed, round(sum(l_quantity) / sum(l_quantity * (1 - l_discount)), 6) AS ratio FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())",
)
def grouping_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and ratios over grouping sets, from sums of the finest set."""
    t = Tables(spark, sf_dir).lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("m"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("o"))
    sets = t.groupingSets([[F.col("l_returnflag")], [F.col("l_returnflag"), F.col("l_linestatus")], []], F.col("l_returnflag"), F.col("l_linestatus"))
    return sets.agg(F.round(F.sum("m"), 2).alias("model"), F.round(F.sum("o"), 2).alias("observed"), F.round(F.sum("m") / F.sum("o"), 6).alias("ratio"))


@query(
    "A16",
    "SELECT l_partkey, round(max(n) / sum(n), 6) AS kept, CAST(sum(n) AS BIGINT) AS points FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def group_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per old object, the share of its points that its largest new object holds."""
    n = Tables(spark, sf_dir).lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return n.groupBy("l_partkey").agg(F.round(F.max("n") / F.sum("n"), 6).alias("kept"), F.sum("n").alias("points"))


@query("A17 F20 D2", "SELECT n_regionkey, list_sort(list(n_name))[1:3] AS names, count(*) AS n, list_position(list_sort(list(n_name)), min(n_name)) AS at FROM nation GROUP BY 1")
def collected_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.collect_set("n_name"))
    return Tables(spark, sf_dir).nation.groupBy("n_regionkey").agg(F.slice(names, 1, 3).alias("names"), F.count("*").alias("n"), F.array_position(names, F.min("n_name")).cast("int").alias("at"))


@query(
    "A18",
    "SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS area, arg_max(c_name, (c_acctbal, c_custkey)) AS largest, list_sort(list(c_custkey))[1:12] AS lots, first(c_name ORDER BY c_custkey) FILTER (WHERE c_acctbal > 5000) AS address FROM customer GROUP BY 1, 2",
)
def stacked_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked rows become one: sums, the largest row's name, all keys, the first usable address."""
    usable = F.when(F.col("c_acctbal") > 5000, F.struct("c_custkey", "c_name"))
    return Tables(spark, sf_dir).customer.groupBy("c_nationkey", "c_mktsegment").agg(
        F.round(F.sum("c_acctbal"), 2).alias("area"),
        F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("largest"),
        F.slice(F.array_sort(F.collect_list("c_custkey")), 1, 12).alias("lots"),
        F.min(usable)["c_name"].alias("address"),
    )


@query(
    "A19",
    "SELECT l_suppkey, round(x, 4) AS x, round(sqrt(sum(w * (q - x) * (q - x)) / sum(w)), 4) AS spread FROM (SELECT l_suppkey, l_extendedprice AS w, l_quantity AS q, sum(l_extendedprice * l_quantity) OVER (PARTITION BY l_suppkey) / sum(l_extendedprice) OVER (PARTITION BY l_suppkey) AS x FROM lineitem) GROUP BY l_suppkey, x",
)
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and root mean square distance, from three sums in one pass."""
    w, q = F.col("l_extendedprice"), F.col("l_quantity")
    s = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(F.sum(w).alias("w"), F.sum(w * q).alias("wq"), F.sum(w * q * q).alias("wqq"))
    x = F.col("wq") / F.col("w")
    return s.select("l_suppkey", F.round(x, 4).alias("x"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("wqq") / F.col("w") - x * x)), 4).alias("spread"))


@query("A20", "SELECT l_returnflag, round(greatest(0, sum(l_quantity * (l_extendedprice / 1000 - 3)) / sum(l_quantity * l_quantity)), 6) AS k FROM lineitem GROUP BY 1")
def lsq_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy("l_returnflag").agg(F.round(R.slope_through_origin(F.col("l_quantity"), F.col("l_extendedprice") / 1000 - 3), 6).alias("k"))


@query(
    "A25",
    """WITH a AS (SELECT l_returnflag AS k, l_linestatus AS s, sum(l_quantity) AS w, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
    SELECT s, round(0.5 * sum(abs(w / tw - v / tv)), 6) AS moved FROM (SELECT *, sum(w) OVER (PARTITION BY s) AS tw, sum(v) OVER (PARTITION BY s) AS tv FROM a) GROUP BY 1""",
)
def half_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the absolute difference of two share vectors."""
    a = Tables(spark, sf_dir).lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("w"), F.sum("l_extendedprice").alias("v"))
    by = Window.partitionBy("l_linestatus")
    share = lambda c: F.col(c) / F.sum(c).over(by)
    return a.withColumn("d", F.abs(share("w") - share("v"))).groupBy(F.col("l_linestatus").alias("s")).agg(F.round(0.5 * F.sum("d"), 6).alias("moved"))


@query("A27", "SELECT l_suppkey, count(*) AS kept, round(sum(l_quantity), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS r FROM lineitem) WHERE r <= 100 OR r % 4 = 0 GROUP BY 1")
def sampled_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a group's first hundred rows, then each fourth: a sampling operator."""
    t = Tables(spark, sf_dir).lineitem
    r = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    return t.withColumn("r", r).where("r <= 100 or r % 4 = 0").groupBy("l_suppkey").agg(F.count("*").alias("kept"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("A30 F23", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value * CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 1.25 WHEN 'purchase' THEN 5 END), 4) AS price FROM (SELECT user_id, ts, min(event_type) AS event_type, min(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def dedup_then_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a message, then a tiered price; a kind without a rate has none."""
    one = Tables(spark, sf_dir).events.groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"), F.min("value").alias("value"))
    rate = S.first_rule(F.col("event_type"), [(F.col("event_type") == k, v) for k, v in (("view", 0.5), ("click", 1.25), ("purchase", 5.0))])
    return one.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * rate.cast("double")), 4).alias("price"))


@query("A32", "SELECT s_suppkey, round(least(1.5, greatest(0.5, s_acctbal / avg(s_acctbal) OVER ())), 6) AS factor FROM supplier")
def relative_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value over the mean, clamped. The mean is one number, aggregated before it is joined."""
    s = Tables(spark, sf_dir).supplier
    mean = s.agg(F.avg("s_acctbal")).first()[0]
    return s.select("s_suppkey", F.round(F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.col("s_acctbal") / F.lit(mean))), 6).alias("factor"))


@query("W1", "SELECT s_suppkey, 'S' || s_nationkey || '_' || printf('%05d', row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal), s_name)) AS name FROM supplier")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).supplier.withColumn("kind", F.concat(F.lit("S"), "s_nationkey"))
    return R.rank_names(s, "kind", [F.abs("s_acctbal"), F.col("s_name")], "name").select("s_suppkey", "name")


@query(
    "W2 G8",
    """WITH j AS (SELECT p_size, p_retailprice AS v, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_size ORDER BY p_retailprice) > 20 THEN 1 ELSE 0 END AS j FROM (SELECT DISTINCT p_size, p_retailprice FROM part)),
    g AS (SELECT p_size, v, sum(j) OVER (PARTITION BY p_size ORDER BY v ROWS UNBOUNDED PRECEDING) AS segment FROM j)
    SELECT p_size, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(v) AS low, max(v) AS high FROM g GROUP BY 1, 2""",
)
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Tables(spark, sf_dir).part.select("p_size", F.col("p_retailprice").alias("v")).distinct()
    return R.gap_segments(v, ["p_size"], "v", 20).groupBy("p_size", "segment").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("W4 W5", "SELECT l_orderkey, l_linenumber, round(sum(q) OVER w, 2) AS along, CAST(row_number() OVER w - 1 AS BIGINT) AS offset_ FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)")
def cumulative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length along a path and each place's offset in it."""
    w = R.running(["l_orderkey"], ["l_linenumber"])
    steps = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return steps.select("l_orderkey", "l_linenumber", F.round(F.sum("q").over(w), 2).alias("along"), (F.count("*").over(w) - 1).alias("offset_"))


@query("W7 W8", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_latest(Tables(spark, sf_dir).orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("W10", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def running_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's latest header."""
    t = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role").distinct()
    return t.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(R.running(["conv_id"], ["turn"])).alias("header"))


@query(
    "W11 W16",
    "WITH q AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem GROUP BY 1), g AS (SELECT quantile_cont(l_extendedprice, 0.99) AS top FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, (l_quantity - lo) / nullif(hi - lo, 0))), 6) AS rise, CAST(least(255, floor(l_extendedprice / top * 255)) AS INTEGER) AS inten FROM lineitem JOIN q USING (l_suppkey), g",
)
def percentile_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value's place between its group's low and high percentile; another scaled by the global 99th."""
    t = Tables(spark, sf_dir).lineitem
    q = t.groupBy("l_suppkey").agg(F.percentile("l_quantity", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    top = R.exact_percentile(t, "l_extendedprice", 0.99)
    lo, hi = F.col("q")[0], F.col("q")[1]
    rise = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("l_quantity") - lo) / F.nullif(hi - lo, F.lit(0.0))))
    inten = F.least(F.lit(255), F.floor(F.col("l_extendedprice") / F.lit(top) * 255)).cast("int")
    return t.join(q, "l_suppkey").select("l_orderkey", "l_linenumber", F.round(rise, 6).alias("rise"), inten.alias("inten"))


@query("O1 O2", "SELECT c_nationkey, c_custkey, r FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS r FROM customer) WHERE r <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest of each group: the limit is the feature; groups are cut before the shuffle."""
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return Tables(spark, sf_dir).customer.withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_nationkey", "c_custkey", "r")


@query("O2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(8)


@query(
    "O4",
    "SELECT s AS l_linestatus, count(CASE WHEN q < 20 THEN 1 END) AS below, max(CASE WHEN c <= 5000 THEN q END) AS threshold FROM (SELECT s, q, sum(n) OVER (PARTITION BY s ORDER BY q ROWS UNBOUNDED PRECEDING) AS c, n FROM (SELECT l_linestatus AS s, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1, 2)) GROUP BY 1",
)
def largest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct values lie under a threshold, and the largest threshold whose rows stay within a cap."""
    n = Tables(spark, sf_dir).lineitem.groupBy("l_linestatus", F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))
    c = n.withColumn("c", F.sum("n").over(R.running(["l_linestatus"], ["q"])))
    return c.groupBy("l_linestatus").agg(F.count(F.when(F.col("q") < 20, 1)).alias("below"), F.max(F.when(F.col("c") <= 5000, F.col("q"))).alias("threshold"))


@query("U1 U6", "SELECT l_suppkey AS k, round(avg(l_quantity), 6) AS inten, 'own' AS src FROM lineitem GROUP BY 1 UNION ALL SELECT s_suppkey, coalesce(round(a.q, 6), 128), 'est' FROM supplier LEFT JOIN (SELECT l_suppkey, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_suppkey = s_suppkey")
def union_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated rows beside measured ones, filled from their group's mean, else by a default."""
    t = Tables(spark, sf_dir)
    own = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("inten"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("q"))
    est = t.supplier.select(F.col("s_suppkey").alias("k")).join(own.select("k", "q"), "k", "left").select("k", F.coalesce("q", F.lit(128.0)).alias("inten"), F.lit("est").alias("src"))
    return own.select("k", F.round("inten", 6).alias("inten"), F.lit("own").alias("src")).unionByName(est.withColumn("inten", F.round("inten", 6)))


@query("U5 K7", "SELECT coalesce(a.d, b.d) AS d, coalesce(a.t, b.t) AS t, greatest(a.n, b.n) AS n FROM (SELECT CAST(ts AS DATE) AS d, event_type AS t, count(*) AS n FROM events WHERE value < 60 GROUP BY 1, 2) a FULL JOIN (SELECT CAST(ts AS DATE) AS d, event_type AS t, count(*) AS n FROM events WHERE value >= 40 GROUP BY 1, 2) b ON a.d = b.d AND a.t = b.t")
def mergemax_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events
    count = lambda c: e.where(c).groupBy(F.to_date("ts").alias("d"), F.col("event_type").alias("t")).agg(F.count("*").alias("n"))
    return R.merge_max(count("value < 60"), count("value >= 40"), ["d", "t"], "n")
