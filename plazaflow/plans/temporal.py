"""Queries over intervals, snapshots, schedules and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import temporal as T
from .registry import Tables, query
from .stochastic import _u

_SEC = "(extract(epoch FROM ts) - extract(epoch FROM date_trunc('day', ts)))"


def _second_of_day(c: str = "ts"):  # noqa: ANN202
    at = F.col(c)
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


@query(
    "A10 T2",
    """WITH i AS (SELECT o_orderstatus AS status, CAST(floor(extract(epoch FROM o_orderdate) / 86400) AS BIGINT) - 8035 AS s, max(CAST(floor(extract(epoch FROM l_shipdate) / 86400) AS BIGINT)) - 8035 AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, 1, 2),
    b AS (SELECT status, CAST(pmod_s AS INTEGER) AS s, CAST(pmod_e AS INTEGER) AS e FROM (SELECT status, CAST(floor(s / 30.0) AS BIGINT) % 96 AS pmod_s, CAST(floor(e / 30.0) AS BIGINT) % 96 AS pmod_e FROM (SELECT status, s + 96 * 30 * 100 AS s, e + 96 * 30 * 100 AS e FROM i))),
    g AS (SELECT DISTINCT status, CAST(bin AS INTEGER) AS bin FROM b, (SELECT unnest(range(0, 96)) AS bin) WHERE s <> e)
    SELECT g.status, g.bin, CAST(count(CASE WHEN (s < e AND s <= bin AND bin < e) OR (e < s AND (bin >= s OR bin < e)) THEN 1 END) AS BIGINT) AS n FROM g JOIN b ON b.status = g.status GROUP BY 1, 2""",
)
def occupancy_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders by status over a circle of 96 bins of 30 days, from order date to last shipment."""
    t = Tables(spark, sf_dir)
    day = lambda c: F.unix_date(F.to_date(c)).cast("long") - 8035
    last = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    joined = t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    bin_ = lambda c: F.pmod(F.floor(day(c) / 30), F.lit(96)).cast("int")
    intervals = joined.select(F.col("o_orderstatus").alias("status"), bin_("o_orderdate").alias("s"), bin_("last").alias("e"))
    return T.occupancy(intervals, ["status"], "s", "e", 96)


@query(
    "J18 W6 T1 T14",
    f"""WITH e AS (SELECT user_id, ts, event_type, CAST(floor({_SEC}) AS BIGINT) AS s FROM events)
    SELECT user_id, coalesce(max((s, event_type)) FILTER (WHERE s <= 10800), max((s, event_type)))[2] AS state FROM e GROUP BY 1""".replace("[2]", "").replace("coalesce(max((s, event_type)) FILTER (WHERE s <= 10800), max((s, event_type)))", "coalesce(arg_max(event_type, (s, event_type)) FILTER (WHERE s <= 10800), arg_max(event_type, (s, event_type)))"),
)
def state_asof_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's state at 03:00 of a circular day."""
    e = Tables(spark, sf_dir).events.select("user_id", "event_type", _second_of_day().alias("s"))
    return T.state_at(e, ["user_id"], "s", F.col("event_type"), F.lit(10_800), F.lit("home"))


@query(
    "T1 T12",
    f"""WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, CAST(floor({_SEC}) AS BIGINT) AS s FROM events),
    st AS (SELECT user_id, CAST(m AS INTEGER) AS m, arg_max(event_type, (s, event_type)) FILTER (WHERE s <= m) AS a, arg_max(event_type, (s, event_type)) AS z FROM e, (SELECT unnest([10800, 43200, 75600]) AS m) GROUP BY 1, 2)
    SELECT m, coalesce(a, z) AS state, count(*) AS n FROM st GROUP BY 1, 2""",
)
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by state at three moments, from one aggregate of each user's events."""
    e = Tables(spark, sf_dir).events.select("user_id", "event_type", _second_of_day().alias("s"))
    row = F.struct("s", "event_type")
    moments = [10_800, 43_200, 75_600]
    by_user = e.groupBy("user_id").agg(F.max(row).alias("z"), *(F.max(F.when(F.col("s") <= m, row)).alias(f"a{m}") for m in moments))
    states = F.array(*(F.struct(F.lit(m).alias("m"), F.coalesce(f"a{m}", "z")["event_type"].alias("state")) for m in moments))
    return by_user.select(F.explode(states).alias("x")).groupBy("x.m", "x.state").agg(F.count("*").alias("n"))


@query(
    "W3 S17 D18 F22",
    """WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM events)
    SELECT day, CAST(round(sum(CASE WHEN gap <= 86400 THEN gap ELSE 0 END) / 60) AS BIGINT) AS minutes, count(*) AS n FROM g GROUP BY 1""",
)
def sessions_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes between consecutive events no more than a day apart, by the earlier event's day."""
    e = Tables(spark, sf_dir).events
    return T.active_minutes(e, ["user_id"], "ts", 86_400).groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("seconds") / 60).cast("long").alias("minutes"), F.count("*").alias("n"))


@query(
    "J19 T7",
    """WITH b AS (SELECT o_custkey AS k, epoch(o_orderdate) AS s, epoch(o_orderdate) + 20 * 86400 AS e, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
    w AS (SELECT o_custkey AS k, o_orderkey, epoch(o_orderdate) AS s, epoch(o_orderdate) + 5 * 86400 AS e FROM orders WHERE o_orderstatus = 'P')
    SELECT o_orderkey FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = w.k AND b.s < w.e + 120 AND b.e > w.s - 120)""",
)
def free_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that meet no busy one of the same customer."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s"))
    wanted = o.where("o_orderstatus = 'P'").withColumn("e", F.col("s") + 5 * 86_400)
    busy = o.where("o_orderstatus = 'F'").withColumn("e", F.col("s") + 20 * 86_400)
    return T.free(wanted, busy, ["k"], "s", "e", 120).select("o_orderkey")


@query(
    "A12",
    f"""WITH e AS (SELECT event_type, value, CAST(hour(ts) * 4 + floor(minute(ts) / 15) AS INTEGER) AS bin, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    k AS (SELECT 'to=' || event_type AS k, bin, value FROM e UNION ALL SELECT p || '>' || event_type, bin, value FROM e WHERE p IS NOT NULL)
    SELECT k, bin, round(sum(value), 2) AS w, count(*) AS n FROM k GROUP BY 1, 2""",
)
def time_histogram_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted quarter-hour histograms under two keys a row."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = Tables(spark, sf_dir).events.select("event_type", "value", (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int").alias("bin"), before.alias("p"))
    keys = F.array_compact(F.array(F.concat(F.lit("to="), "event_type"), F.concat("p", F.lit(">"), "event_type")))
    return e.select(F.explode(keys).alias("k"), "bin", "value").groupBy("k", "bin").agg(F.round(F.sum("value"), 2).alias("w"), F.count("*").alias("n"))


@query(
    "A26",
    """WITH h AS (SELECT event_type, CAST(hour(ts) * 4 + floor(minute(ts) / 15) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2),
    k AS (SELECT d, exp(-0.5 * (d / 2.0) * (d / 2.0)) AS w FROM (SELECT unnest(range(-6, 7)) AS d)), t AS (SELECT sum(w) AS t FROM k)
    SELECT event_type, CAST((bin + d + 96) % 96 AS INTEGER) AS bin, round(sum(n * w / t), 6) AS n FROM h, k, t GROUP BY 1, 2""",
)
def circular_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Tables(spark, sf_dir).events.groupBy("event_type", (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    return R.circular_smooth(h, ["event_type"], "bin", "n", 96, 2.0, 6).withColumn("n", F.round("n", 6))


@query(
    "T4 T5 F1",
    f"""WITH e AS (SELECT event_id, CAST(floor({_SEC}) AS BIGINT) AS t, round(value * 20, 3) / 1.25 + 4 / 1.25 + CASE WHEN value > 80 THEN value / 2.5 + 30 ELSE 0 END AS dur, event_type = 'click' AS back FROM events),
    b AS (SELECT event_id, dur, CASE WHEN back THEN t - dur ELSE t END AS s0 FROM e), m AS (SELECT event_id, dur, CASE WHEN s0 < 0 THEN s0 + 86400 ELSE s0 END AS s FROM b),
    x AS (SELECT event_id, dur, CASE WHEN s + dur >= 86400 THEN 86399 - dur ELSE s END AS s FROM m)
    SELECT event_id, round(s, 4) AS t0, round(s + dur, 4) AS t1, printf('%02d:%02d', CAST(floor(s / 3600) AS INTEGER) % 24, CAST(floor(s / 60) AS INTEGER) % 60) AS clock FROM x""",
)
def placed_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with their durations, some taken backwards from arrival, none across midnight."""
    e = Tables(spark, sf_dir).events
    value = F.col("value")
    duration = T.leg_seconds(F.round(value * 20, 3), F.lit(1.25), F.lit(4.0), F.when(value > 80, value).otherwise(0.0), 30)
    start, end = T.placed_trip(_second_of_day().cast("double"), duration, backwards=F.col("event_type") == "click")
    return e.select("event_id", F.round(start, 4).alias("t0"), F.round(end, 4).alias("t1"), S.hhmm(start).alias("clock"))


@query(
    "T6 T8",
    f"""WITH w AS (SELECT user_id, min(CAST(floor({_SEC}) AS BIGINT)) AS s, max(CAST(floor({_SEC}) AS BIGINT)) AS e, avg(value) AS v FROM events GROUP BY 1)
    SELECT user_id, 1 AS leg, 'work' AS purpose, CAST(s AS BIGINT) AS t FROM w UNION ALL SELECT user_id, 2, 'lunch', 43200 FROM w WHERE s < 39600 AND e > 50400 AND v > 40
    UNION ALL SELECT user_id, 3, 'shop', e FROM w WHERE v > 55 UNION ALL SELECT user_id, 4, 'home', CASE WHEN v > 55 THEN e + 1800 ELSE e END FROM w""",
)
def day_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional legs of a working day."""
    w = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.min(_second_of_day()).cast("long").alias("s"), F.max(_second_of_day()).cast("long").alias("e"), F.avg("value").alias("v"))
    leg = lambda n, purpose, t, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(n).alias("leg"), F.lit(purpose).alias("purpose"), t.cast("long").alias("t")))
    e, v = F.col("e"), F.col("v")
    legs = F.array_compact(F.array(
        leg(1, "work", F.col("s")),
        leg(2, "lunch", F.lit(43_200), (F.col("s") < 39_600) & (e > 50_400) & (v > 40)),
        leg(3, "shop", e, v > 55),
        leg(4, "home", F.when(v > 55, e + 1800).otherwise(e)),
    ))
    return w.select("user_id", F.explode(legs).alias("x")).select("user_id", "x.*")


@query("T9", "SELECT p_partkey, round(p_retailprice * 365 / (261 + 104 * 1.4), 6) AS weekday, round(p_retailprice * 365 / (261 + 104 * 1.4) * 1.4, 6) AS weekend FROM part")
def typical_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = F.col("p_retailprice") * 365
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(T.typical_day(annual, 1.4, False), 6).alias("weekday"), F.round(T.typical_day(annual, 1.4, True), 6).alias("weekend"))


@query(
    "T11",
    """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS era, o_custkey AS at_, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1, 2),
    n AS (SELECT era, at_, sum(v) OVER (PARTITION BY era ORDER BY at_ RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS total FROM y)
    SELECT era, arg_max(at_, (total, -at_)) AS at_, CAST(max(total) AS BIGINT) AS total FROM n GROUP BY 1""",
)
def densest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where most was added in each year, within a reach."""
    y = Tables(spark, sf_dir).orders.groupBy(F.year("o_orderdate").alias("era"), F.col("o_custkey").alias("at_")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    return T.densest(y, ["era"], "at_", "v", 25)


@query(
    "T12 T13",
    """WITH h AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS bin, count(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 END) AS we, count(CASE WHEN dayofweek(ts) NOT IN (0, 6) THEN 1 END) AS wd FROM events GROUP BY 1, 2)
    SELECT event_type, bin, round(100.0 * we / nullif(wd, 0), 4) AS pct FROM h""",
)
def day_against_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekend = F.dayofweek("ts").isin(1, 7)
    h = Tables(spark, sf_dir).events.groupBy("event_type", F.hour("ts").alias("bin")).agg(F.count(F.when(weekend, 1)).alias("we"), F.count(F.when(~weekend, 1)).alias("wd"))
    return h.select("event_type", "bin", F.round(100.0 * F.col("we") / F.nullif(F.col("wd"), F.lit(0)), 4).alias("pct"))


@query("T13", "SELECT user_id, count(*) AS n, string_agg(event_type, '>' ORDER BY ts, event_id) AS story FROM events GROUP BY 1")
def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order, as one line."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["event_type"]), ">").alias("story"))


@query(
    "T3 G5",
    """WITH s AS (SELECT l_orderkey, l_linenumber AS k, sum(l_quantity) AS len FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(len) OVER (PARTITION BY l_orderkey ORDER BY k) AS up, sum(len) OVER (PARTITION BY l_orderkey) AS total FROM s)
    SELECT l_orderkey, arg_min(k, k) AS k, round(min_by((0.37 * total - (up - len)) / len, k) + 1e-9, 5) AS part FROM c WHERE up >= 0.37 * total GROUP BY 1""",
)
def along_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that holds 37 % of a path's length, and how far into it."""
    s = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("len"))
    c = s.withColumns({"up": F.sum("len").over(R.running(["l_orderkey"], ["k"])), "total": F.sum("len").over(Window.partitionBy("l_orderkey"))})
    part = (0.37 * F.col("total") - (F.col("up") - F.col("len"))) / F.col("len")
    return c.where("up >= 0.37 * total").groupBy("l_orderkey").agg(F.min("k").alias("k"), F.round(F.min_by(part, "k") + 1e-9, 5).alias("part"))


@query(
    "W13",
    """WITH y AS (SELECT event_type AS k, CAST(month(ts) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), c AS (SELECT k, x, sum(n) OVER (PARTITION BY k ORDER BY x) AS y FROM y),
    s AS (SELECT k, x, y, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS r, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS l FROM c WINDOW w AS (PARTITION BY k ORDER BY x))
    SELECT k, x, y, round(coalesce(CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN l * r <= 0 THEN 0 ELSE 2 * l * r / (l + r) END, 0), 6) AS slope FROM s""",
)
def monotone_tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("k"), F.month("ts").cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"))
    c = y.withColumn("y", F.sum("n").over(R.running(["k"], ["x"]))).select("k", "x", "y")
    return T.monotone_slopes(c, ["k"], "x", "y").withColumn("slope", F.round("slope", 6))


@query(
    "T7 T6",
    f"""WITH RECURSIVE e AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_id, event_type, CAST(floor({_SEC}) AS DOUBLE) AS t, CAST(event_id * 37 % 7200 AS DOUBLE) AS dwell FROM events),
    busy AS (SELECT user_id, day, list({{'t0': t, 't1': t + 900}}) AS busy FROM e WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2),
    wish AS (SELECT user_id, day, event_id, t AS t0, t + 600 + dwell AS t1, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS k FROM e WHERE event_type NOT IN ('purchase', 'signup')),
    w AS (SELECT wish.*, coalesce(busy.busy, []) AS busy FROM wish LEFT JOIN busy USING (user_id, day)),
    r AS (SELECT user_id, day, event_id, k, t0, t1, len(list_filter(busy, lambda b: t1 + 120 >= b.t0 AND t0 - 120 <= b.t1)) = 0 AND t1 <= 86340 AS ok, busy FROM w WHERE k = 1
      UNION ALL SELECT w.user_id, w.day, w.event_id, w.k, w.t0, w.t1, len(list_filter(CASE WHEN r.ok THEN list_append(r.busy, {{'t0': r.t0, 't1': r.t1}}) ELSE r.busy END, lambda b: w.t1 + 120 >= b.t0 AND w.t0 - 120 <= b.t1)) = 0 AND w.t1 <= 86340,
        CASE WHEN r.ok THEN list_append(r.busy, {{'t0': r.t0, 't1': r.t1}}) ELSE r.busy END FROM r JOIN w ON w.user_id = r.user_id AND w.day = r.day AND w.k = r.k + 1)
    SELECT user_id, event_id, t0, t1, ok FROM r""",
)
def outings_when_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outings of each user's day, granted in turn where they fit between what is taken and granted already."""
    at = _second_of_day().cast("double")
    e = Tables(spark, sf_dir).events.select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type", at.alias("t"), (F.col("event_id") * 37 % 7200).cast("double").alias("dwell"))
    fixed = F.col("event_type").isin("purchase", "signup")
    taken = e.where(fixed).select("user_id", "day", F.col("t").alias("t0"), (F.col("t") + 900).alias("t1"))
    wished = e.where(~fixed).select("user_id", "day", F.col("event_id").alias("rank"), F.col("t").alias("t0"), (F.col("t") + 600 + F.col("dwell")).alias("t1"))
    return T.when_free(taken, wished, ["user_id", "day"]).select("user_id", F.col("rank").alias("event_id"), "t0", "t1", "ok")


def _stop(purpose: str, x: str, y: str, dwell: str = "0", arrive: str = "NULL", until: str = "NULL") -> str:
    return f"{{'purpose': '{purpose}', 'x': CAST({x} AS DOUBLE), 'y': CAST({y} AS DOUBLE), 'dwell': CAST({dwell} AS DOUBLE), 'arrive': CAST({arrive} AS DOUBLE), 'until': CAST({until} AS DOUBLE)}}"


_DRAWS = [f"u{k}" for k in range(4)]


@query(
    "T8",
    f"""WITH RECURSIVE c AS (SELECT c_custkey AS id, c_nationkey AS n, c_acctbal AS x, CAST(c_custkey * 37 % 9973 AS DOUBLE) AS y, {", ".join(f"{_u(81, 'c_custkey', draw=k)} AS {u}" for k, u in enumerate(_DRAWS))} FROM customer),
    p AS (SELECT id, CAST(CASE id % 4 WHEN 1 THEN x WHEN 3 THEN x ELSE n * 400 END AS DOUBLE) AS x, CAST(CASE id % 4 WHEN 1 THEN y WHEN 3 THEN y ELSE 0 END AS DOUBLE) AS y,
      CASE id % 4 WHEN 0 THEN 25200 + u0 * 36000 WHEN 1 THEN 43200 WHEN 2 THEN 21600 + u0 * 57600 ELSE 27000 + u0 * 12600 END AS t,
      CASE id % 4 WHEN 0 THEN CASE WHEN u1 < 0.4 THEN [{_stop("visit", "x", "y", "1800 + u2 * 3600")}, {_stop("visit", "y", "x", "600 + u3 * 1800")}] ELSE [{_stop("visit", "x", "y", "1800 + u2 * 3600")}] END
        WHEN 1 THEN [{_stop("event", "n * 350", "n * 270", "0", "64800 + n % 3 * 3600 - u1 * 1800", "72000 + n % 3 * 3600")}] WHEN 2 THEN [{_stop("pass", "n * 100", "9000")}]
        ELSE [{_stop("outing", "y", "x", "2400 + u1 * 3000")}, {_stop("leave the site", "n * 400", "0", "0", "NULL", "59400 + u2 * 21600")}] END AS stops,
      CASE id % 4 WHEN 0 THEN 'leave the site' WHEN 2 THEN NULL ELSE 'come home' END AS purpose FROM c),
    r(id, k, free, x, y, purpose, t0, t1, fx, fy) AS (SELECT id, 0, CAST(t AS DOUBLE), x, y, '', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), x, y FROM p UNION ALL
      SELECT id, k + 1, greatest(leave + takes + s.dwell, coalesce(s.until, leave + takes)), s.x, s.y, s.purpose, leave, leave + takes, fx, fy
      FROM (SELECT *, greatest(free, coalesce(s.arrive - takes, free)) AS leave FROM (SELECT r.id, r.k, r.free, r.x AS fx, r.y AS fy, stops[k + 1] AS s, sqrt((stops[k + 1].x - r.x) * (stops[k + 1].x - r.x) + (stops[k + 1].y - r.y) * (stops[k + 1].y - r.y)) / 1.3 AS takes FROM r JOIN p ON p.id = r.id WHERE k < len(stops)))),
    h AS (SELECT r.id, k + 1 AS leg, p.purpose, free AS t0, free + sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y)) / 1.3 AS t1, r.x AS fx, r.y AS fy, p.x AS tx, p.y AS ty FROM r JOIN p ON p.id = r.id AND r.k = len(stops) WHERE p.purpose IS NOT NULL AND free < 84600)
    SELECT id, leg, purpose, round(t0, 4) AS t0, round(t1, 4) AS t1, round(fx, 4) AS fx, round(fy, 4) AS fy, round(tx, 4) AS tx, round(ty, 4) AS ty FROM (SELECT id, k AS leg, purpose, t0, t1, fx, fy, x AS tx, y AS ty FROM r WHERE k > 0 UNION ALL SELECT * FROM h)""",
)
def visit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of visitors (one stop or two), an event's audience, passers-by and hotel guests, each trip from where the one before ended."""
    c = Tables(spark, sf_dir).customer
    n, x, y, kind = F.col("c_nationkey"), F.col("c_acctbal"), (F.col("c_custkey") * 37 % 9973).cast("double"), F.col("c_custkey") % 4
    u = [S.uniform(81, "c_custkey", draw=k) for k in range(4)]
    d = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    stop = lambda purpose, x, y, dwell=0.0, arrive=None, until=None: F.struct(F.lit(purpose).alias("purpose"), d(x).alias("x"), d(y).alias("y"), d(dwell).alias("dwell"), d(arrive).alias("arrive"), d(until).alias("until"))
    visit = stop("visit", x, y, 1800 + u[2] * 3600)
    event = 64_800 + n % 3 * 3600
    stops = (
        F.when(kind == 0, F.when(u[1] < 0.4, F.array(visit, stop("visit", y, x, 600 + u[3] * 1800))).otherwise(F.array(visit)))
        .when(kind == 1, F.array(stop("event", n * 350, n * 270, 0.0, event - u[1] * 1800, event + 7200)))
        .when(kind == 2, F.array(stop("pass", n * 100, 9000.0)))
        .otherwise(F.array(stop("outing", y, x, 2400 + u[1] * 3000), stop("leave the site", n * 400, 0.0, 0.0, None, 59_400 + u[2] * 21_600)))
    )
    own = (kind == 1) | (kind == 3)
    at = F.when(own, x).otherwise(n * 400).cast("double"), F.when(own, y).otherwise(0.0)
    start = F.when(kind == 0, 25_200 + u[0] * 36_000).when(kind == 1, 43_200.0).when(kind == 2, 21_600 + u[0] * 57_600).otherwise(27_000 + u[0] * 12_600)
    back = F.when(kind != 2, F.struct(F.when(kind == 0, "leave the site").otherwise("come home").alias("purpose"), at[0].alias("x"), at[1].alias("y")))
    people = c.select(F.col("c_custkey").alias("id"), at[0].alias("x"), at[1].alias("y"), start.alias("start"), stops.alias("stops"), back.alias("back"))
    trips = T.chained_trips(people, "id", speed=1.3)
    return trips.select("id", "leg", "purpose", *(F.round(v, 4).alias(v) for v in ("t0", "t1", "fx", "fy", "tx", "ty")))
