"""Queries of allocation and keyed random choice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import stochastic as K
from .registry import Tables, query


def _u(seed: int, *keys: str, draw: int = 0) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)}, '{draw}')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


@query(
    "R1",
    """WITH w AS (SELECT c_nationkey AS g, c_mktsegment AS k, count(*) AS w FROM customer GROUP BY 1, 2), x AS (SELECT *, w * CAST(40 + g AS DOUBLE) / sum(w) OVER (PARTITION BY g) AS x FROM w),
    f AS (SELECT *, floor(x) AS f FROM x), r AS (SELECT *, 40 + g - sum(f) OVER (PARTITION BY g) AS rest, row_number() OVER (PARTITION BY g ORDER BY round(x - f, 9) DESC, k) AS r FROM f)
    SELECT g, k, CAST(f + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM r WHERE f + CASE WHEN r <= rest THEN 1 ELSE 0 END > 0""",
)
def apportion_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole total for each nation, split over its segments."""
    w = Tables(spark, sf_dir).customer.groupBy(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("w"))
    return K.apportion(w, ["g"], "k", "w", (F.lit(40) + F.col("g")).cast("double")).select("g", "k", "share")


@query(
    "R4 R5 R6",
    f"""SELECT c_custkey, arg_min(s_suppkey, (c + ln(-ln(u)), s_suppkey)) AS s_suppkey FROM (
      SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) / 900.0 - ln(1.0 + s_suppkey % 3) AS c, {_u(7, 'c_custkey::VARCHAR', 's_suppkey::VARCHAR')} AS u
      FROM customer JOIN supplier ON s_nationkey = c_nationkey) GROUP BY 1""",
)
def softmin_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier of the own nation for each customer, by cost less a weight's logarithm."""
    t = Tables(spark, sf_dir)
    cost = lambda x, y, site: np.abs(x - y) / 900.0 - np.log(1.0 + np.fmod(site, 3))
    best = K.least_draws(t.customer, t.supplier, ("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal"), 7, cost)
    return best.groupBy("c_custkey").agg(F.min_by("s", F.struct(F.col("s").isNull(), "k", "s")).alias("s_suppkey"))


@query(
    "R7 R3",
    f"""WITH p AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d, {_u(8, 'c_custkey::VARCHAR', 's_suppkey::VARCHAR')} AS u FROM customer JOIN supplier ON s_nationkey = c_nationkey),
    k AS (SELECT *, d / 2500.0 + ln(-ln(u)) AS k FROM p)
    SELECT c_custkey, coalesce(arg_min(s_suppkey, (k, s_suppkey)) FILTER (WHERE d <= 1500), arg_min(s_suppkey, (k, s_suppkey))) AS s_suppkey, bool_or(d <= 1500) AS near FROM k GROUP BY 1""",
)
def gravity_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight falling with distance, within a radius where anything is, else among all."""
    t = Tables(spark, sf_dir)
    cost = lambda x, y, site: np.abs(x - y) / 2500.0
    best = K.least_draws(t.customer, t.supplier, ("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal"), 8, cost, within=1500.0)
    # of rows that share a key those with a near one count first
    return best.groupBy("c_custkey").agg(F.min_by("s", F.struct(~F.col("near"), F.col("s").isNull(), "k", "s")).alias("s_suppkey"), F.max("near").alias("near"))


@query(
    "R8 R9 D12",
    f"""WITH h AS (SELECT event_type AS k, CAST(hour(ts) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY 1, 2),
    c AS (SELECT k, bin, (sum(w) OVER (PARTITION BY k ORDER BY bin) - w) / sum(w) OVER (PARTITION BY k) AS lo, sum(w) OVER (PARTITION BY k ORDER BY bin) / sum(w) OVER (PARTITION BY k) AS hi FROM h),
    p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'purchase' END AS k, {_u(9, 'c_custkey::VARCHAR')} AS u, {_u(9, 'c_custkey::VARCHAR', draw=1)} AS v FROM customer)
    SELECT c_custkey, bin, CAST(floor((bin + v) * 3600) AS INTEGER) AS second FROM p JOIN c ON c.k = p.k AND u >= lo AND u < hi""",
)
def hist_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time for each customer from its kind's histogram: the bin by inverse distribution, then uniform within."""
    t = Tables(spark, sf_dir)
    h = t.events.groupBy(F.col("event_type").alias("k"), F.hour("ts").alias("bin")).agg(F.count("*").cast("double").alias("w"))
    c = K.inverse_cdf(h, ["k"], "bin", "w")
    kind = F.when(F.col("c_custkey") % 3 == 0, "view").when(F.col("c_custkey") % 3 == 1, "click").otherwise("purchase")
    p = t.customer.select("c_custkey", kind.alias("k"), S.uniform(9, "c_custkey").alias("u"), S.uniform(9, "c_custkey", draw=1).alias("v"))
    # 24 bins a kind: the steps travel as one array, searched in the row
    steps = c.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi"))).alias("steps"))
    hit = F.filter("steps", lambda s: (F.col("u") >= s["lo"]) & (F.col("u") < s["hi"]))
    found = p.join(steps, "k").withColumn("bin", F.get(hit, 0)["bin"]).where("bin is not null")
    return found.select("c_custkey", "bin", F.floor((F.col("bin") + F.col("v")) * 3600).cast("int").alias("second"))


@query("R11 P12", f"SELECT event_type, count(*) AS present FROM events WHERE floor({_u(3, 'user_id::VARCHAR')} * 256) < CASE event_type WHEN 'view' THEN 0.8 WHEN 'click' THEN 0.6 ELSE 0.3 END * 256 GROUP BY 1")
def rank_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attendance by a rank that stays with the user."""
    rank = F.floor(S.uniform(3, "user_id") * 256)
    share = F.when(F.col("event_type") == "view", 0.8).when(F.col("event_type") == "click", 0.6).otherwise(0.3)
    return Tables(spark, sf_dir).events.where(rank < share * 256).groupBy("event_type").agg(F.count("*").alias("present"))


@query(
    "R15 R16 A9",
    f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_returnflag AS t, l_quantity AS dist, {_u(5, 'l_orderkey::VARCHAR', 'l_linenumber::VARCHAR', 'l_partkey::VARCHAR')} AS u FROM lineitem),
    r AS (SELECT *, CASE WHEN dist <= 12 THEN 1.0::DOUBLE ELSE pow(12.0 / dist, 2.7) END AS r FROM d), k AS (SELECT *, 1.0 / r AS w FROM r WHERE u < r), n AS (SELECT t, count(*) AS n FROM d GROUP BY 1)
    SELECT t, count(*) AS kept, round(sum(w), 3) AS weight, round(min(n) / sum(w), 6) AS rescale FROM k JOIN n USING (t) GROUP BY 1""",
)
def weighted_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance thinning with inverse weights, rescaled so that each kind weighs its true count."""
    u = S.uniform(5, "l_orderkey", "l_linenumber", "l_partkey")
    d = Tables(spark, sf_dir).lineitem.select(F.col("l_returnflag").alias("t"), K.keep_ratio(F.col("l_quantity"), 12.0, 2.7).alias("r"), u.alias("u"))
    kept = F.col("u") < F.col("r")
    s = d.groupBy("t").agg(F.count(F.when(kept, 1)).alias("kept"), F.sum(F.when(kept, 1 / F.col("r"))).alias("w"), F.count("*").alias("n"))
    return s.select("t", "kept", F.round("w", 3).alias("weight"), F.round(F.col("n") / F.col("w"), 6).alias("rescale"))


@query(
    "R15 F15",
    "SELECT l_orderkey, l_linenumber, l_quantity, round(CASE WHEN l_quantity <= 12 THEN 1.0::DOUBLE ELSE pow(12.0 / l_quantity, 2.7) END * t, 9) AS linear, round(CASE WHEN l_quantity <= 12 THEN 1.0::DOUBLE ELSE pow(12.0 / l_quantity, 2.7) END * t * t * (3 - 2 * t), 9) AS smooth FROM (SELECT *, greatest(0.0, least(1.0, (45.0 - l_quantity) / 33.0)) AS t FROM lineitem)",
)
def thinning_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear and the smooth taper side by side."""
    q = F.col("l_quantity")
    ratios = {name: F.round(K.taper_ratio(q, 12.0, 2.7, 45.0, name == "smooth"), 9).alias(name) for name in ("linear", "smooth")}
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", q, *ratios.values())


@query("R17", f"SELECT p_partkey, CAST(unnest(range(1, CAST(floor(p_size / 7.0 + {_u(4, 'p_partkey::VARCHAR')}) AS BIGINT) + 1)) AS INTEGER) AS copy_no FROM part")
def bernoulli_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many copies as a share and one draw give."""
    n = K.bernoulli_rounded(F.col("p_size") / 7.0, S.uniform(4, "p_partkey"))
    return Tables(spark, sf_dir).part.where(n > 0).select("p_partkey", F.explode(F.sequence(F.lit(1), n)).alias("copy_no"))


@query(
    "R10 R2",
    f"""SELECT c_custkey, round(greatest(-2, least(2, sqrt(-2 * ln(u)) * cos(2 * pi() * v))), 6) AS normal, CASE WHEN u < exp(-1.5) THEN 0 WHEN u < exp(-1.5) * 2.5 THEN 1 WHEN u < exp(-1.5) * 3.625 THEN 2 ELSE 3 END AS events,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY v, c_custkey) AS place FROM (SELECT *, {_u(6, 'c_custkey::VARCHAR')} AS u, {_u(6, 'c_custkey::VARCHAR', draw=1)} AS v FROM customer)""",
)
def keyed_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped normal, Poisson up to three, and a shuffled order, all from keyed draws."""
    u, v = S.uniform(6, "c_custkey"), S.uniform(6, "c_custkey", draw=1)
    t = Tables(spark, sf_dir).customer.withColumns({"u": u, "v": v})
    normal = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), K.box_muller(F.col("u"), F.col("v"))))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("v", "c_custkey"))
    return t.select("c_custkey", F.round(normal, 6).alias("normal"), K.poisson(F.col("u"), 1.5, 3).alias("events"), place.cast("long").alias("place"))


@query(
    "R12",
    f"""WITH j AS (SELECT o_orderkey, o_custkey % 25 AS g, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderdate, o_orderkey) AS n FROM orders), w AS (SELECT c_custkey, c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_u(2, 'c_custkey::VARCHAR')}, c_custkey) AS n FROM customer)
    SELECT o_orderkey, c_custkey FROM j LEFT JOIN w ON w.g = j.g AND w.n = j.n""",
)
def match_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in their order and shuffled residents of the same block, one each; the rest go unmatched."""
    t = Tables(spark, sf_dir)
    jobs = t.orders.select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 25).cast("int").alias("g"))
    people = t.customer.select("c_custkey", F.col("c_nationkey").alias("g"))
    found = K.rank_match(jobs, people, ["g"], [F.col("o_orderdate"), F.col("o_orderkey")], [S.uniform(2, "c_custkey"), F.col("c_custkey")])
    return found.select("o_orderkey", "c_custkey")


@query(
    "R13",
    f"""WITH s AS (SELECT avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END) AS near FROM lineitem)
    SELECT mode, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 10 AND {_u(1, 'l_orderkey::VARCHAR', 'l_partkey::VARCHAR')} < least(1.0, 0.1 / near) THEN 'walk' WHEN l_quantity <= 30 THEN 'rail' ELSE 'drive' END AS mode FROM lineitem, s) GROUP BY 1""",
)
def calibrated_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the near walk so that walkers are a tenth of all: one pass for the share, one to assign."""
    t = Tables(spark, sf_dir).lineitem
    near = t.agg(F.avg((F.col("l_quantity") <= 10).cast("double"))).first()[0]
    walk = (F.col("l_quantity") <= 10) & (S.uniform(1, "l_orderkey", "l_partkey") < min(1.0, 0.1 / near if near else 1.0))
    return t.select(F.when(walk, "walk").when(F.col("l_quantity") <= 30, "rail").otherwise("drive").alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query(
    "R18 R19",
    f"""WITH g AS (SELECT l_suppkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS own, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) / 2.0 AS ground FROM lineitem GROUP BY 1)
    SELECT l_suppkey, count(CASE WHEN u <= ground / own THEN 1 END) AS kept, round(min(u * pow(CAST(own AS DOUBLE), 0.4) * pow(20.0, 0.6)), 6) AS first_priority FROM (SELECT l.l_suppkey, own, ground, {_u(11, 'l_orderkey::VARCHAR', 'l_linenumber::VARCHAR', 'l_partkey::VARCHAR')} AS u FROM lineitem l JOIN g USING (l_suppkey) WHERE l_returnflag = 'R') GROUP BY 1""",
)
def density_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dropped to match a lower density, and drawing priorities from their own density."""
    t = Tables(spark, sf_dir).lineitem
    own_row = F.col("l_returnflag") == "R"
    g = t.groupBy("l_suppkey").agg(F.count(F.when(own_row, 1)).alias("own"), (F.count(F.when(~own_row, 1)) / 2.0).alias("ground"))
    u = S.uniform(11, "l_orderkey", "l_linenumber", "l_partkey")
    rows = t.where(own_row).join(g, "l_suppkey").withColumn("u", u)
    priority = F.col("u") * F.pow(F.col("own").cast("double"), F.lit(0.4)) * F.pow(F.lit(20.0), F.lit(0.6))
    return rows.groupBy("l_suppkey").agg(F.count(F.when(F.col("u") <= F.col("ground") / F.col("own"), 1)).alias("kept"), F.round(F.min(priority), 6).alias("first_priority"))


@query(
    "R20 R21 J28",
    "SELECT p_partkey, CASE WHEN p_size >= 40 THEN round_even(p_size * 0.95 * 2.1, 0) WHEN p_type LIKE 'STANDARD%' THEN 50 WHEN p_size < 3 THEN 0 ELSE round_even(p_retailprice / 37.16, 0) END AS residents, CAST(round_even(CAST((p_size + p_size * 1.3) * 0.37 AS DOUBLE), 0) AS DOUBLE) AS unsheltered FROM part",
)
def residents_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, group quarters, noise or area: the first rule that holds; rounded half to even."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    people = F.when(size >= 40, F.bround(size * 0.95 * 2.1, 0)).when(F.col("p_type").startswith("STANDARD"), F.lit(50.0)).when(size < 3, F.lit(0.0)).otherwise(F.bround(price / 37.16, 0))
    return Tables(spark, sf_dir).part.select("p_partkey", people.alias("residents"), F.bround((size + size * 1.3) * 0.37, 0).alias("unsheltered"))


@query("F17", "SELECT l_orderkey, l_linenumber, l_partkey, ((p # (p >> 15)) & 16777215) / 16777216.0::DOUBLE AS u FROM (SELECT *, (((a & 1048575) * 1540483477) + ((((a >> 20) * 1540483477) & 524287) << 20)) & 549755813887 AS p FROM (SELECT *, xor(m, m >> 13) & 549755813887 AS a FROM (SELECT l_orderkey, l_linenumber, l_partkey, xor(xor(l_orderkey * 73856093, l_partkey * 19349663), CAST(l_linenumber AS BIGINT) * 83492791) AS m FROM lineitem)))".replace("(p # (p >> 15))", "xor(p, p >> 15)"))
def integer_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of integer coordinates that cannot overflow."""
    t = Tables(spark, sf_dir).lineitem
    return t.select("l_orderkey", "l_linenumber", "l_partkey", S.point_u(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("long")).alias("u"))


@query(
    "R14 G1",
    f"""WITH c AS (SELECT s_suppkey, i, {_u(12, 's_suppkey::VARCHAR', 'i::VARCHAR')} AS x, {_u(12, 's_suppkey::VARCHAR', 'i::VARCHAR', draw=1)} AS y FROM supplier, (SELECT unnest(range(1, 41)) AS i))
    SELECT s_suppkey, coalesce(round(arg_min(x, i) FILTER (WHERE x + y < 0.6), 9), 0.2) AS x, coalesce(round(arg_min(y, i) FILTER (WHERE x + y < 0.6), 9), 0.2) AS y FROM c GROUP BY 1""",
)
def rejection_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of forty keyed candidates inside a triangle, else its centre."""
    spots = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.struct(S.uniform(12, F.col("s_suppkey"), i).alias("x"), S.uniform(12, F.col("s_suppkey"), i, draw=1).alias("y")))
    hit = F.get(F.filter(spots, lambda s: s["x"] + s["y"] < 0.6), 0)
    return Tables(spark, sf_dir).supplier.select("s_suppkey", hit.alias("h")).select("s_suppkey", F.coalesce(F.round("h.x", 9), F.lit(0.2)).alias("x"), F.coalesce(F.round("h.y", 9), F.lit(0.2)).alias("y"))


@query(
    "R2 R8",
    f"""WITH w AS (SELECT c_nationkey AS g, c_mktsegment AS k, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY 1, 2), r AS (SELECT g, k, sum(w) OVER (PARTITION BY g ORDER BY k) / sum(w) OVER (PARTITION BY g) AS hi FROM w),
    n AS (SELECT DISTINCT g, unnest(range(1, 61 + g)) AS unit FROM (SELECT DISTINCT c_nationkey AS g FROM customer)), d AS (SELECT g, unit, {_u(31, 'g::VARCHAR', 'unit::VARCHAR')} AS u FROM n)
    SELECT g, k, count(*) AS n FROM (SELECT d.g, unit, arg_min(k, hi) AS k FROM d JOIN r ON r.g = d.g AND u < hi GROUP BY 1, 2) GROUP BY 1, 2""",
)
def multinomial_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each nation drawn over its segments."""
    c = Tables(spark, sf_dir).customer
    w = c.groupBy(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("k")).agg(F.count("*").cast("double").alias("w"))
    totals = c.select(F.col("c_nationkey").alias("g")).distinct().withColumn("total", F.lit(60) + F.col("g"))
    return K.multinomial(totals, w, ["g"], "k", "w", "total", lambda unit: S.uniform(31, "g", unit))


_MODE = "CASE WHEN c_custkey % 4 = 0 THEN 'rail' WHEN c_custkey % 4 = 1 THEN 'bus' WHEN c_custkey % 4 = 2 THEN 'drive' ELSE 'walk' END"


@query(
    "R6 R4",
    f"""WITH c AS (SELECT c_custkey, {_MODE} AS mode, c_acctbal, c_custkey * 7 % 360 AS bearing FROM customer),
    p AS (SELECT c_custkey, mode, n_nationkey AS portal, CASE mode WHEN 'walk' THEN abs((n_nationkey * 15 - bearing + 540) % 360 - 180) / 25.0 WHEN 'bus' THEN abs(c_acctbal / 10 - n_nationkey * 40) / 90.0 WHEN 'drive' THEN abs(c_acctbal / 10 - n_nationkey * 40) / 120.0
      ELSE abs(c_acctbal / 10 - n_nationkey * 40) / 60.0 END AS k, {_u(32, 'c_custkey::VARCHAR', 'n_nationkey::VARCHAR')} AS u FROM c JOIN nation ON n_nationkey % 4 = CASE mode WHEN 'rail' THEN 0 WHEN 'bus' THEN 1 WHEN 'drive' THEN 2 ELSE 3 END WHERE NOT (mode = 'drive' AND c_acctbal >= 6000))
    SELECT c.c_custkey, c.mode, best.portal FROM c LEFT JOIN (SELECT c_custkey, arg_min(portal, (k + ln(-ln(u)), portal)) AS portal FROM p GROUP BY 1) best USING (c_custkey)""",
)
def portal_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portal of the mode's kind, by distance or by the bearing's miss, each mode with its own scale; own garages need none."""
    t = Tables(spark, sf_dir)
    key = F.col("c_custkey")
    mode = F.when(key % 4 == 0, "rail").when(key % 4 == 1, "bus").when(key % 4 == 2, "drive").otherwise("walk")
    people = t.customer.select("c_custkey", mode.alias("mode"), "c_acctbal", (key * 7 % 360).alias("bearing"))
    kinds = F.when(F.col("n_nationkey") % 4 == 0, "rail").when(F.col("n_nationkey") % 4 == 1, "bus").when(F.col("n_nationkey") % 4 == 2, "drive").otherwise("walk")
    # a fixed list of 25, an array for each mode: a person's choice is made in its own row
    portals = F.broadcast(t.nation.groupBy(kinds.alias("mode")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("portal"))).alias("options")))

    def drawn(o):  # noqa: ANN001, ANN202
        far = F.abs(F.col("c_acctbal") / 10 - o["portal"] * 40)
        miss = F.abs((o["portal"] * 15 - F.col("bearing") + 540) % 360 - 180)
        cost = F.when(F.col("mode") == "walk", miss / 25.0).when(F.col("mode") == "bus", far / 90.0).when(F.col("mode") == "drive", far / 120.0).otherwise(far / 60.0)
        return K.gumbel(cost, S.uniform(32, "c_custkey", o["portal"]))

    garage = (F.col("mode") == "drive") & (F.col("c_acctbal") >= 6000)
    own = people.join(portals, "mode", "left").withColumn("b", F.when(~F.coalesce(garage, F.col("mode") == "drive"), K.least_options(F.col("options"), drawn, "portal")))
    return own.select("c_custkey", "mode", F.col("b.s").alias("portal"))


@query(
    "R9",
    """WITH whole AS (SELECT CAST(hour(ts) AS INTEGER) AS bin, CAST(hour(ts) AS INTEGER) // 6 AS period, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY 1, 2), site AS (SELECT event_type AS g, CAST(hour(ts) AS INTEGER) // 6 AS period, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY 1, 2),
    s AS (SELECT g, bin, site.w * whole.w / greatest(sum(whole.w) OVER (PARTITION BY g, site.period), 1.0) AS w FROM site JOIN whole USING (period))
    SELECT g, bin, round(w / sum(w) OVER (PARTITION BY g), 9) AS share FROM s""",
)
def raked_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of each kind by period, split into hours as those of all kinds are."""
    e = Tables(spark, sf_dir).events.select("event_type", F.hour("ts").alias("bin"), F.floor(F.hour("ts") / 6).cast("int").alias("period"))
    whole = e.groupBy("bin", "period").agg(F.count("*").cast("double").alias("w"))
    parts = e.groupBy(F.col("event_type").alias("g"), "period").agg(F.count("*").cast("double").alias("w"))
    return K.raked(parts, whole, ["g"], "bin", "period", "w").withColumn("share", F.round("share", 9))
