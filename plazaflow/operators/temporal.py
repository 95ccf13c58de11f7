"""Intervals, snapshots, schedules and sessions on a circular day or on timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def occupancy(intervals: DataFrame, key: list[str], start: str, end: str, bins: int, weight: Column | None = None) -> DataFrame:
    """How many intervals cover each bin 0..bins-1, by key: +1 at the first covered bin, -1 after the last, summed up.

    ``start`` and ``end`` are bin numbers, ``end`` excluded; one that lies before its start wraps around. The cost is two
    rows an interval, however many bins it covers.
    """
    weight = F.lit(1) if weight is None else weight
    wraps = F.col(end) < F.col(start)
    step = lambda at, w: F.struct(at.cast("int").alias("bin"), w.alias("d"))
    edges = F.when(wraps, F.array(step(F.lit(0), weight), step(F.col(end), -weight), step(F.col(start), weight), step(F.lit(bins), -weight))).otherwise(F.array(step(F.col(start), weight), step(F.col(end), -weight)))
    deltas = intervals.where(F.col(start) != F.col(end)).select(*key, F.explode(edges).alias("e")).groupBy(*key, F.col("e.bin").alias("bin")).agg(F.sum("e.d").alias("d"))
    frame = deltas.select(*key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("d", F.lit(0))
    all_ = deltas.unionByName(frame).groupBy(*key, "bin").agg(F.sum("d").alias("d"))
    up = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return all_.withColumn("n", F.sum("d").over(up)).where(F.col("bin") < bins).select(*key, "bin", "n")


def state_at(events: DataFrame, key: list[str], at: str, state: Column, moment: Column, default: Column) -> DataFrame:
    """Each key's state at a moment: of its last event up to then, else, the day being a circle, of its last event at all.

    One aggregate: no join and no sort. ``at`` orders the events; ties go to the larger state.
    """
    past = F.when(F.col(at) <= moment, F.struct(F.col(at), state.alias("_state")))
    return events.groupBy(*key).agg(F.coalesce(F.max(past)["_state"], F.max(F.struct(F.col(at), state.alias("_state")))["_state"], default).alias("state"))


def active_minutes(events: DataFrame, key: list[str], at: str, gap_seconds: float) -> DataFrame:
    """Seconds between consecutive events no further apart than the gap, credited to the earlier one."""
    after = F.lead(at).over(Window.partitionBy(*key).orderBy(at))
    gap = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(1e6)
    return events.withColumn("seconds", F.when(gap <= gap_seconds, gap).otherwise(F.lit(0.0)))


def free(wanted: DataFrame, busy: DataFrame, key: list[str], start: str, end: str, pad: float) -> DataFrame:
    """Rows of ``wanted`` whose padded interval meets no busy one of the same key."""
    taken = busy.select(*key, F.col(start).alias("_s"), F.col(end).alias("_e"))
    meets = [F.col(f"w.{k}") == F.col(f"b.{k}") for k in key] + [F.col("_s") < F.col(f"w.{end}") + pad, F.col("_e") > F.col(f"w.{start}") - pad]
    return wanted.alias("w").join(taken.alias("b"), meets, "left_anti")


def placed_trip(start: Column, duration: Column, *, backwards: Column | None = None) -> tuple[Column, Column]:
    """A trip's start and end on the day: taken backwards from its arrival where asked, and moved to end before midnight."""
    begin = F.pmod(start if backwards is None else F.when(backwards, start - duration).otherwise(start), F.lit(float(DAY)))
    late = begin + duration >= DAY
    begin = F.when(late, F.lit(DAY - 1.0) - duration).otherwise(begin)
    return begin, begin + duration


def leg_seconds(path_m: Column, speed: Column, off_path_m: Column, dz: Column, lift_wait: float) -> Column:
    """Walking time with the way to the path and, for more than 3 m of height, a lift."""
    return path_m / speed + off_path_m / speed + F.when(F.abs(dz) > 3, F.abs(dz) / 2.5 + lift_wait).otherwise(F.lit(0.0))


def typical_day(annual: Column, weekend_factor: float, weekend: bool) -> Column:
    """A year's visits as those of a typical day: 261 weekdays and 104 weekend days that weigh ``weekend_factor``."""
    day = annual / (261 + 104 * weekend_factor)
    return day * weekend_factor if weekend else day


def densest(df: DataFrame, key: list[str], at: str, value: str, reach: float) -> DataFrame:
    """The place of each key around which most value stands within ``reach``; a range frame, no join."""
    near = Window.partitionBy(*key).orderBy(at).rangeBetween(-reach, reach)
    best = df.withColumn("total", F.sum(value).over(near))
    return best.groupBy(*key).agg(F.max_by(F.struct(at, "total"), F.struct(F.round("total", 6), -F.col(at))).alias("_b")).select(*key, F.col(f"_b.{at}").alias(at), F.col("_b.total").alias("total"))


def monotone_slopes(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Fritsch-Carlson tangents of a monotone cubic through each key's points."""
    w = Window.partitionBy(*key).orderBy(x)
    right = (F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x))
    left = (F.col(y) - F.lag(y).over(w)) / (F.col(x) - F.lag(x).over(w))
    mean = F.when(left * right <= 0, 0.0).otherwise(2 * left * right / (left + right))
    return df.withColumn("slope", F.coalesce(F.when(left.isNull(), right).when(right.isNull(), left).otherwise(mean), F.lit(0.0)))


def when_free(taken: DataFrame, wished: DataFrame, key: list[str], *, margin: float = 120.0, day_end: float = 86_340.0) -> DataFrame:
    """Every wish (key, rank, t0, t1) with ``ok``: whether nothing taken (key, t0, t1) or granted before it, by rank, is within ``margin`` of it.

    Wishes are decided in turn, as each depends on those before it, in one fold over a key's sorted wishes; a wish that
    ends after ``day_end`` is refused. A key's rows are a person's day, so they are few.
    """
    span = lambda a, b: F.struct(a.cast("double").alias("t0"), b.cast("double").alias("t1"))
    busy = taken.groupBy(*key).agg(F.collect_list(span(F.col("t0"), F.col("t1"))).alias("_busy"))
    asked = wished.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1")))).alias("_asked"))
    none = F.expr("cast(array() as array<struct<t0:double,t1:double>>)")
    start = F.struct(F.coalesce("_busy", none).alias("busy"), F.expr("cast(array() as array<boolean>)").alias("ok"))

    def decide(state: Column, wish: Column) -> Column:
        clash = F.exists(state["busy"], lambda b: (wish["t1"] + margin >= b["t0"]) & (wish["t0"] - margin <= b["t1"]))
        free = ~clash & (wish["t1"] <= day_end)
        return F.struct(F.when(free, F.concat(state["busy"], F.array(span(wish["t0"], wish["t1"])))).otherwise(state["busy"]).alias("busy"), F.concat(state["ok"], F.array(free)).alias("ok"))

    told = asked.join(busy, key, "left").withColumn("_ok", F.aggregate("_asked", start, decide)["ok"])
    rows = told.select(*key, F.explode(F.arrays_zip(F.col("_asked").alias("w"), F.col("_ok").alias("ok"))).alias("r"))
    return rows.select(*key, "r.w.rank", "r.w.t0", "r.w.t1", "r.ok")


STOPS = "array<struct<purpose:string,x:double,y:double,dwell:double,arrive:double,until:double>>"


def chained_trips(people: DataFrame, key: str, *, speed: float, last_start: float = 84_600.0) -> DataFrame:
    """The trips of people who go from stop to stop: (key, leg, purpose, t0, t1, fx, fy, tx, ty), legs from 1.

    ``people`` have a place (x, y), a ``start`` in seconds, ``stops`` (:data:`STOPS`) and ``back``, a struct of purpose, x and y
    or null. Each trip starts where and when the stop before has ended. A stop with ``arrive`` is reached then, if the one
    before ends in time; a stop ends after ``dwell``, and not before ``until``, which a whole audience may share. The way back
    is only begun before ``last_start``. One fold over a person's stops; null stops, dwells and people without a start give no trip.
    """
    trip = "struct<leg:int,purpose:string,t0:double,t1:double,fx:double,fy:double,tx:double,ty:double>"
    empty = F.struct(F.col("start").cast("double").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0).alias("n"), F.expr(f"cast(array() as array<{trip}>)").alias("trips"))

    def going(a: Column, x: Column, y: Column, purpose: Column, leave: Column, end: Column) -> Column:
        return F.concat(a["trips"], F.array(F.struct((a["n"] + 1).alias("leg"), purpose.alias("purpose"), leave.alias("t0"), end.alias("t1"), a["x"].alias("fx"), a["y"].alias("fy"), x.alias("tx"), y.alias("ty"))))

    def step(a: Column, s: Column) -> Column:
        takes = F.hypot(s["x"] - a["x"], s["y"] - a["y"]) / speed
        leave = F.greatest(a["t"], F.coalesce(s["arrive"] - takes, a["t"]))
        end = leave + takes
        free = F.greatest(end + F.coalesce(s["dwell"], F.lit(0.0)), F.coalesce(s["until"], end))
        return F.struct(free.alias("t"), s["x"].alias("x"), s["y"].alias("y"), (a["n"] + 1).alias("n"), going(a, s["x"], s["y"], s["purpose"], leave, end).alias("trips"))

    def home(a: Column) -> Column:
        x, y = F.col("back.x").cast("double"), F.col("back.y").cast("double")
        end = a["t"] + F.hypot(x - a["x"], y - a["y"]) / speed
        return F.when(F.col("back").isNotNull() & (a["t"] < last_start), going(a, x, y, F.col("back.purpose"), a["t"], end)).otherwise(a["trips"])

    known = F.filter(F.coalesce(F.col("stops").cast(STOPS), F.expr(f"cast(array() as {STOPS})")), lambda s: s.isNotNull() & s["x"].isNotNull() & s["y"].isNotNull())
    walked = people.where("start is not null and x is not null and y is not null").select(key, F.aggregate(known, empty, step, home).alias("trips"))
    return walked.select(key, F.explode("trips").alias("t")).select(key, "t.*")
