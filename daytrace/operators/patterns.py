"""Distraction patterns: shapes in the sequence of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from daytrace.catalog import WORK
from daytrace.config import US, USER_DAY, Thresholds
from daytrace.operators.focus import TIMELINE, switch_flags


def _windows(df: DataFrame, keys: list[str], span_us: int) -> tuple[DataFrame, Window, Window]:
    """Number rows per key and find the last row starting within ``span_us``."""
    w = Window.partitionBy(*keys).orderBy(*TIMELINE)
    near = Window.partitionBy(*keys).orderBy("start_us").rangeBetween(0, span_us)
    df = df.withColumn("idx", F.row_number().over(w))
    return df.withColumn("right", F.max("idx").over(near)), w, near


def _pick(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Left-to-right choice of windows that do not overlap.

    Windows that overlap nothing before them start a new island, and the choice restarts
    there, so the ordered fold runs per island and not per user-day.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("head", F.when(F.col("idx") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    df = df.withColumn("island", F.sum("head").over(w))
    row = F.struct("idx", "right", *fields)
    picked = F.aggregate(
        F.col("rows"),
        F.struct(F.lit(-1).alias("upto"), F.slice("rows", 1, 0).alias("kept")),
        lambda acc, x: F.when(
            x["idx"] > acc["upto"],
            F.struct(
                x["right"].alias("upto"), F.concat(acc["kept"], F.array(x)).alias("kept")
            ),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return (
        df.groupBy(*keys, "island")
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .select(*keys, F.explode(picked).alias("r"))
        .select(*keys, *[f"r.{f}" for f in fields])
    )


def _ends(df: DataFrame, near: Window) -> DataFrame:
    """End of the window's last session."""
    return df.withColumn(
        "last_end", F.max(F.struct("idx", "end_us")).over(near)["end_us"]
    )


def distraction_bursts(classified: DataFrame, th: Thresholds) -> DataFrame:
    df = classified.filter(~F.col("category").isin(WORK))
    df, w, near = _windows(df, USER_DAY, th.burst_window_s * US)
    length = F.col("end_us") - F.col("start_us")
    df = df.withColumn("total", F.sum(length).over(w))
    df = df.withColumn("total_us", F.max("total").over(near) - F.col("total") + length)
    df = _ends(df, near).withColumn("n", F.col("right") - F.col("idx") + 1)
    df = df.filter(
        (F.col("n") >= th.burst_min_sessions) & (F.col("total_us") >= th.burst_min_total_s * US)
    )
    return _pick(df, USER_DAY, ["start_us", "last_end", "n", "total_us"]).select(
        *USER_DAY,
        F.lit("DISTRACTION_BURST").alias("pattern"),
        "start_us",
        F.col("last_end").alias("end_us"),
        F.least(F.col("total_us") / (2.0 * th.burst_min_total_s * US), F.lit(1.0)).alias("strength"),
        F.lit(None).cast("string").alias("app_key"),
        F.col("n").cast("long").alias("n"),
        (F.col("total_us") / float(US)).alias("measure"),
    )


def _median(values: Column) -> Column:
    n = F.size(values)
    low = F.element_at(values, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(values, F.floor(n / 2).cast("int") + 1)
    return (low + high) / 2.0


def habitual_checking(classified: DataFrame, th: Thresholds) -> DataFrame:
    """Many short openings of one app.  The collected frame is one time window of one app and
    holds at most window / min_session sessions per device."""
    keys = [*USER_DAY, "app_key"]
    df, w, near = _windows(classified, keys, th.habit_window_s * US)
    length = (F.col("end_us") - F.col("start_us")).alias("len")
    df = _ends(df, near).withColumn("frame", F.collect_list(F.struct("idx", length)).over(near))
    df = df.withColumn("n", F.col("right") - F.col("idx") + 1).filter(
        F.col("n") >= th.habit_min_opens
    )
    inside = F.filter("frame", lambda x: x["idx"] >= F.col("idx"))
    df = df.withColumn("lens", F.array_sort(F.transform(inside, lambda x: x["len"])))
    df = df.withColumn("median_us", _median(F.col("lens"))).filter(
        F.col("median_us") <= th.habit_max_median_s * US
    )
    return _pick(df, keys, ["start_us", "last_end", "n", "median_us"]).select(
        *USER_DAY,
        F.lit("HABITUAL_CHECKING").alias("pattern"),
        "start_us",
        F.col("last_end").alias("end_us"),
        F.least(F.col("n") / (2.0 * th.habit_min_opens), F.lit(1.0)).alias("strength"),
        "app_key",
        F.col("n").cast("long").alias("n"),
        (F.col("median_us") / float(US)).alias("measure"),
    )


def switch_storms(classified: DataFrame, th: Thresholds) -> DataFrame:
    df = switch_flags(classified)
    df, w, near = _windows(df, USER_DAY, th.storm_window_s * US)
    df = df.withColumn("upto", F.sum(F.col("context_switch").cast("long")).over(w))
    df = _ends(df, near).withColumn("n", F.max("upto").over(near) - F.col("upto"))
    df = df.filter(F.col("n") >= th.storm_min_switches)
    return _pick(df, USER_DAY, ["start_us", "last_end", "n"]).select(
        *USER_DAY,
        F.lit("SWITCH_STORM").alias("pattern"),
        "start_us",
        F.col("last_end").alias("end_us"),
        F.least(F.col("n") / (2.0 * th.storm_min_switches), F.lit(1.0)).alias("strength"),
        F.lit(None).cast("string").alias("app_key"),
        "n",
        F.col("n").cast("double").alias("measure"),
    )


def post_task_avoidance(classified: DataFrame, th: Thresholds) -> DataFrame:
    w = Window.partitionBy(*USER_DAY).orderBy(*TIMELINE)
    back = Window.partitionBy(*USER_DAY).orderBy(
        *[F.col(c).desc() for c in TIMELINE]
    ).rowsBetween(Window.unboundedPreceding, -1)
    work = F.col("category").isin(WORK)
    length = F.col("end_us") - F.col("start_us")
    df = classified.withColumns(
        {
            "nxt": F.lead(F.struct("category", "start_us", "end_us")).over(w),
            "next_work": F.last(F.when(work, F.col("start_us")), True).over(back),
        }
    )
    nxt_len = F.col("nxt.end_us") - F.col("nxt.start_us")
    return df.filter(
        work
        & (length >= th.avoid_work_min_s * US)
        & ~F.col("nxt.category").isin(WORK)
        & (F.col("nxt.start_us") - F.col("end_us") <= th.avoid_gap_s * US)
        & (nxt_len >= th.avoid_min_s * US)
        & ~F.coalesce(
            F.col("next_work") <= F.col("end_us") + th.avoid_resume_s * US, F.lit(False)
        )
    ).select(
        *USER_DAY,
        F.lit("POST_TASK_AVOIDANCE").alias("pattern"),
        F.col("end_us").alias("start_us"),
        F.col("nxt.end_us").alias("end_us"),
        F.lit(0.7).alias("strength"),
        F.lit(None).cast("string").alias("app_key"),
        (length).alias("n"),
        (nxt_len / float(US)).alias("measure"),
    )


def promote(occurrences: DataFrame, th: Thresholds) -> DataFrame:
    """Patterns per user, confirmed once seen often enough on enough days."""
    n, days = F.count(F.lit(1)), F.count_distinct("local_date")
    return occurrences.groupBy("user_id", "pattern", "app_key").agg(
        n.alias("occurrences"),
        days.alias("days"),
        F.min("start_us").alias("first_us"),
        F.max("end_us").alias("last_us"),
        F.max("strength").alias("strength"),
        F.when((n >= th.confirm_occurrences) & (days >= th.confirm_days), "confirmed")
        .otherwise("candidate")
        .alias("status"),
    )
