"""Baselines, trends and multi-day patterns over daily rows.

A user has one row per day (per slot, per goal), so windows over a user's days are bounded by
the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from daytrace.catalog import TAXONOMY, WORK
from daytrace.config import US, USER_DAY, Thresholds
from daytrace.functions import timecols as tc

PPB = 1_000_000_000


def day_no(col: str = "local_date") -> Column:
    return F.unix_date(col).cast("long")


def trailing_baseline(metrics: DataFrame, th: Thresholds, days: int = 30) -> DataFrame:
    """Means over the days before each day, well-covered days only."""
    w = Window.partitionBy("user_id").orderBy("day_no").rangeBetween(-days, -1)
    valid = F.col("coverage_ratio") >= th.coverage_gate
    us = lambda c: F.rint(F.col(c) * US).cast("long")
    ppb = F.rint(F.col("fragmentation_index") * PPB).cast("long")
    n = F.coalesce(F.sum(F.when(valid, 1).otherwise(0)).over(w), F.lit(0))
    frag_n = F.sum(F.when(valid & ppb.isNotNull(), 1).otherwise(0)).over(w)

    def mean(col: Column, count: Column, unit: float) -> Column:
        total = F.sum(F.when(valid, col)).over(w)
        return F.when(count > 0, total / count / unit).otherwise(F.lit(0.0))

    return metrics.withColumn("day_no", day_no()).select(
        *USER_DAY,
        n.alias("valid_days"),
        mean(us("screen_time_s"), n, 60.0 * US).alias("screen_minutes_mean"),
        mean(us("deep_work_s"), n, 60.0 * US).alias("deep_work_minutes_mean"),
        mean(ppb, frag_n, float(PPB)).alias("fragmentation_mean"),
    )


def median_of(values: Column) -> Column:
    """Exact interpolated median of a sorted array; null when empty."""
    n = F.size(values)
    low = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(values, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def _frame(df: DataFrame, value: Column, valid: Column, window) -> Column:
    """Sorted values of the valid days in a calendar frame (at most one per day)."""
    return F.array_sort(F.collect_list(F.when(valid, value)).over(window))


def robust_baseline(
    metrics: DataFrame, value: Column, th: Thresholds, partition: list[str] | None = None
) -> DataFrame:
    """Median, MAD and mean of the 7, 30 and 90 days before each day."""
    df = metrics.withColumns(
        {"day_no": day_no(), "x": value, "ok": F.col("coverage_ratio") >= th.baseline_gate}
    )
    keys = partition or ["user_id"]
    for k in keys:
        if k == "weekday":
            df = df.withColumn("weekday", F.weekday("local_date"))
    w = Window.partitionBy(*keys).orderBy("day_no")
    frames = F.array(
        *[
            F.struct(
                F.lit(n).alias("days"),
                _frame(df, F.col("x"), F.col("ok"), w.rangeBetween(-n, -1)).alias("xs"),
            )
            for n in (7, 30, 90)
        ]
    )
    df = df.select(*USER_DAY, frames.alias("fs")).select(*USER_DAY, F.explode("fs").alias("f"))
    med = median_of(F.col("f.xs"))
    df = df.select(*USER_DAY, "f.days", "f.xs", med.alias("median"))
    gaps = F.array_sort(F.transform("xs", lambda x: F.abs(x - F.col("median"))))
    total = F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        *USER_DAY,
        F.col("days").alias("window_days"),
        F.size("xs").alias("valid_days"),
        "median",
        median_of(gaps).alias("mad"),
        F.when(F.size("xs") > 0, total / F.size("xs")).alias("mean"),
    )


def trend_change(metrics: DataFrame, value: Column, th: Thresholds) -> DataFrame:
    """Days on which the last week's median left the band of the three weeks before."""
    df = metrics.withColumns(
        {"day_no": day_no(), "x": value, "ok": F.col("coverage_ratio") >= th.baseline_gate}
    )
    w = Window.partitionBy("user_id").orderBy("day_no")
    df = df.withColumns(
        {
            "recent": _frame(df, F.col("x"), F.col("ok"), w.rangeBetween(-6, 0)),
            "past": _frame(df, F.col("x"), F.col("ok"), w.rangeBetween(-27, -7)),
        }
    )
    df = df.withColumns({"recent_median": median_of(F.col("recent")), "past_median": median_of(F.col("past"))})
    gaps = F.array_sort(F.transform("past", lambda x: F.abs(x - F.col("past_median"))))
    df = df.withColumn("past_mad", median_of(gaps))
    # Valid days needed and width of the band.
    enough = (F.size("recent") >= 5) & (F.size("recent") + F.size("past") >= 14)
    changed = enough & (
        F.abs(F.col("recent_median") - F.col("past_median")) > 1.5 * F.col("past_mad")
    )
    return df.select(
        *USER_DAY,
        "recent_median",
        "past_median",
        "past_mad",
        F.size("recent").alias("recent_days"),
        (F.size("recent") + F.size("past")).alias("valid_days"),
        F.coalesce(changed, F.lit(False)).alias("changed"),
    )


def weekly(metrics: DataFrame) -> DataFrame:
    """ISO-week totals with the change against the user's previous week."""
    us = lambda c: F.rint(F.col(c) * US).cast("long")
    df = metrics.groupBy(
        "user_id",
        F.extract(F.lit("YEAROFWEEK"), F.col("local_date")).cast("int").alias("iso_year"),
        F.weekofyear("local_date").alias("iso_week"),
    ).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(us("screen_time_s")).alias("screen_us"),
        F.sum(us("deep_work_s")).alias("deep_us"),
        F.sum("context_switches").alias("context_switches"),
        F.sum("focus_session_count").alias("focus_sessions"),
    )
    w = Window.partitionBy("user_id").orderBy("iso_year", "iso_week")
    return df.withColumns(
        {
            "screen_delta_us": F.col("screen_us") - F.lag("screen_us").over(w),
            "deep_delta_us": F.col("deep_us") - F.lag("deep_us").over(w),
        }
    )


def slot_time(intervals: DataFrame, th: Thresholds, tz: str, day_start_hour: int, extra: list[str]) -> DataFrame:
    """Spread intervals over the local-time slots of their day (each covers few slots)."""
    start = tc.day_start_us(F.col("local_date"), F.lit(tz), F.lit(day_start_hour))
    width = th.slot_s * US
    df = intervals.withColumn("day_us", start)
    first = F.floor((F.col("start_us") - F.col("day_us")) / width).cast("long")
    last = F.floor((F.col("end_us") - 1 - F.col("day_us")) / width).cast("long")
    df = df.filter("end_us > start_us").withColumn("slot", F.explode(F.sequence(first, last)))
    lo = F.greatest("start_us", F.col("day_us") + F.col("slot") * width)
    hi = F.least("end_us", F.col("day_us") + (F.col("slot") + 1) * width)
    return df.select(*USER_DAY, *extra, "slot", (hi - lo).alias("in_slot_us"))


def best_slots(focus: DataFrame, bursts: DataFrame, th: Thresholds, tz: str, day_start_hour: int) -> DataFrame:
    """Per user the slot with most focus time and the one with most distraction time."""
    def top(df: DataFrame, kind: str) -> DataFrame:
        per_slot = slot_time(df, th, tz, day_start_hour, []).groupBy("user_id", "slot").agg(
            F.sum("in_slot_us").alias("total_us")
        )
        best = F.max_by(F.struct("slot", "total_us"), F.struct("total_us", -F.col("slot")))
        return per_slot.groupBy("user_id").agg(best.alias("b")).select(
            "user_id", F.lit(kind).alias("kind"), "b.slot", "b.total_us"
        )

    return top(focus, "focus").unionByName(top(bursts, "distraction"))


def time_of_day_sink(classified: DataFrame, th: Thresholds, tz: str, day_start_hour: int) -> DataFrame:
    """Slots whose non-work share lies two deviations above its mean of the 30 days before.

    Shares are whole parts per million, so sums and squares are exact.
    """
    slots = slot_time(classified, th, tz, day_start_hour, ["category"])
    other = F.sum(F.when(~F.col("category").isin(WORK), F.col("in_slot_us")).otherwise(0))
    df = slots.groupBy(*USER_DAY, "slot").agg(
        other.alias("other_us"), F.sum("in_slot_us").alias("all_us")
    )
    df = df.withColumns(
        {
            "share_ppm": F.expr("other_us * 1000000L div all_us"),
            "day_no": day_no(),
        }
    )
    w = Window.partitionBy("user_id", "slot").orderBy("day_no").rangeBetween(-30, -1)
    x = F.col("share_ppm")
    df = df.withColumns(
        {
            "n": F.count(x).over(w),
            "s": F.sum(x).over(w),
            "ss": F.sum(x * x).over(w),
        }
    )
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    spread = F.sqrt(n * (n * ss - s * s) / (n - 1))
    return df.filter((n >= 2) & (x * n - s >= 2 * spread)).select(
        *USER_DAY, "slot", "share_ppm", n.alias("history_days")
    )


def task_start_avoidance(classified: DataFrame, hours: DataFrame, th: Thresholds, tz: str, needed: int) -> DataFrame:
    """Days whose working hours begin with much non-work before the first work, on enough of
    the last seven days.

    ``hours``: user_id, weekday, start_sod, end_sod.  Work counts from the start of working
    hours; non-work counts from there to the first work, or to the end of the hours.
    """
    midnight = tc.day_start_us(F.col("local_date"), F.lit(tz), F.lit(0))
    df = classified.withColumn("weekday", F.weekday("local_date")).join(hours, ["user_id", "weekday"])
    df = df.withColumns(
        {
            "from_us": midnight + F.col("start_sod").cast("long") * US,
            "to_us": midnight + F.col("end_sod").cast("long") * US,
        }
    )
    work = F.col("category").isin(WORK)
    firsts = df.groupBy(*USER_DAY).agg(
        F.min(
            F.when(work & (F.col("end_us") > F.col("from_us")), F.greatest("start_us", "from_us"))
        ).alias("first_work_us")
    )
    df = df.join(firsts, USER_DAY)
    until = F.least(F.coalesce("first_work_us", "to_us"), F.col("to_us"))
    lost = F.greatest(F.least("end_us", until) - F.greatest("start_us", "from_us"), F.lit(0))
    days = df.groupBy(*USER_DAY).agg(
        F.sum(F.when(~work, lost).otherwise(0)).alias("avoid_us")
    ).withColumn("hit", F.col("avoid_us") >= th.start_avoid_min_s * US)
    w = Window.partitionBy("user_id").orderBy("day_no").rangeBetween(-6, 0)
    days = days.withColumn("day_no", day_no()).withColumn(
        "hits", F.sum(F.col("hit").cast("long")).over(w)
    )
    return days.filter(F.col("hit") & (F.col("hits") >= needed)).select(*USER_DAY, "avoid_us", "hits")


def late_night_drift(classified: DataFrame, th: Thresholds, tz: str, wind_down_hour: int, min_us: int) -> DataFrame:
    """ISO weeks with enough nights of long consumption after the wind-down hour."""
    consumption = list(TAXONOMY["consumption"][2])
    from_us = tc.day_start_us(F.col("local_date"), F.lit(tz), F.lit(wind_down_hour))
    late = F.greatest(F.col("end_us") - F.greatest(F.col("start_us"), from_us), F.lit(0))
    nights = (
        classified.filter(F.col("category").isin(consumption))
        .groupBy(*USER_DAY)
        .agg(F.sum(late).alias("late_us"))
        .filter(F.col("late_us") >= min_us)
    )
    return (
        nights.groupBy(
            "user_id",
            F.extract(F.lit("YEAROFWEEK"), F.col("local_date")).cast("int").alias("iso_year"),
            F.weekofyear("local_date").alias("iso_week"),
        )
        .agg(F.count(F.lit(1)).alias("nights"), F.sum("late_us").alias("late_us"))
        .filter(F.col("nights") >= th.drift_nights)
    )
