"""Goal alignment: how much activity time counts towards each goal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from daytrace.catalog import WORK
from daytrace.config import US

OUTSIDE_HOURS = 0.85  # fixed value: weight of time outside working hours for work goals
WINDOWS = (1, 7, 30, 90)  # fixed values: trailing windows in days
PPB = 1_000_000_000


def matched_weights(activities: DataFrame, mappings: DataFrame) -> DataFrame:
    """Weight of every activity for every goal it matches by category or by app.

    ``mappings``: user_id, goal_id, category or app_key, weight.  The two kinds of target are
    two equality joins, not one OR join; several matches add up to at most 1.
    """
    cols = ["user_id", "goal_id", "activity_id"]
    keep = activities.select("user_id", "activity_id", "category", "app_key")
    by_category = keep.join(
        mappings.filter("category is not null").drop("app_key"), ["user_id", "category"]
    )
    by_app = keep.join(mappings.filter("app_key is not null").drop("category"), ["user_id", "app_key"])
    return (
        by_category.select(*cols, "weight")
        .unionByName(by_app.select(*cols, "weight"))
        .groupBy(*cols)
        .agg(F.least(F.sum("weight"), F.lit(1.0)).alias("weight"))
    )


def contributions(activities: DataFrame, goals: DataFrame, mappings: DataFrame) -> DataFrame:
    """Aligned time and its uncertainty per user, goal and day, in whole microseconds.

    ``activities`` needs ``in_hours``.  Goals with a work category weigh time outside working
    hours less.  ``mappings`` are per user if they have a user_id, else for all users.
    """
    on = [c for c in ("user_id", "goal_id") if c in mappings.columns]
    targets = goals.select("user_id", "goal_id").join(mappings, on)
    work_goal = targets.groupBy("user_id", "goal_id").agg(
        F.max(F.coalesce(F.col("category").isin(["work", *WORK]), F.lit(False))).alias("is_work")
    )
    facts = activities.select(
        "user_id", "activity_id", "local_date", "duration_us", "confidence", "in_hours"
    )
    df = matched_weights(activities, targets).join(facts, ["user_id", "activity_id"]).join(
        work_goal, ["user_id", "goal_id"]
    )
    factor = F.when(F.col("is_work") & ~F.col("in_hours"), OUTSIDE_HOURS).otherwise(F.lit(1.0))
    part = F.col("duration_us") * F.col("weight") * F.col("confidence") * factor
    return (
        df.filter("weight > 0")
        .withColumn("aligned_us", F.rint(part).cast("long"))
        .withColumn("unsure_us", F.rint(part * (1 - F.col("confidence"))).cast("long"))
        .groupBy("user_id", "goal_id", "local_date")
        .agg(F.sum("aligned_us").alias("aligned_us"), F.sum("unsure_us").alias("unsure_us"))
    )


def windowed(daily: DataFrame, days: DataFrame, goals: DataFrame) -> DataFrame:
    """Alignment over trailing windows for every user-day and goal.

    ``days`` holds coverage_ratio per user-day.  A user and goal have one row per day, so the
    range windows are bounded by the calendar.  Days without data count with coverage 0.
    """
    base = days.select("user_id", "local_date", "coverage_ratio").join(
        goals.select("user_id", "goal_id", "target_weekly_min"), "user_id"
    )
    df = base.join(daily, ["user_id", "goal_id", "local_date"], "left").fillna(
        0, ["aligned_us", "unsure_us"]
    )
    df = df.withColumns(
        {
            "day_no": F.unix_date("local_date").cast("long"),
            "ppb": F.rint(F.col("coverage_ratio") * PPB).cast("long"),
        }
    )
    w = Window.partitionBy("user_id", "goal_id").orderBy("day_no")
    per_window = F.array(
        *[
            F.struct(
                F.lit(n).alias("window_days"),
                *[
                    F.sum(c).over(w.rangeBetween(-(n - 1), 0)).alias(c)
                    for c in ("aligned_us", "unsure_us", "ppb")
                ],
            )
            for n in WINDOWS
        ]
    )
    df = df.select("user_id", "goal_id", "local_date", "target_weekly_min", per_window.alias("ws"))
    df = df.select("user_id", "goal_id", "local_date", "target_weekly_min", F.explode("ws").alias("w"))
    coverage = F.col("w.ppb") / (F.col("w.window_days") * float(PPB))
    aligned = F.col("w.aligned_us") / (60.0 * US)
    half = (F.col("w.unsure_us") + F.col("w.aligned_us") * (1 - coverage) * 0.5) / (60.0 * US)
    target = F.col("target_weekly_min") * F.col("w.window_days") / 7
    return df.select(
        "user_id",
        "goal_id",
        "local_date",
        F.col("w.window_days").alias("window_days"),
        coverage.alias("coverage_ratio"),
        aligned.alias("aligned_min"),
        F.greatest(aligned - half, F.lit(0.0)).alias("low_min"),
        (aligned + half).alias("high_min"),
        F.when(target > 0, aligned / target).otherwise(F.lit(0.0)).alias("attainment"),
    )


def active_goals(days: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals in force on each user-day."""
    return days.join(goals, "user_id").filter(
        ~F.col("archived")
        & (F.col("active_from") <= F.col("local_date"))
        & (F.col("active_to").isNull() | (F.col("active_to") >= F.col("local_date")))
    )


def unallocated(activities: DataFrame, weights: DataFrame) -> DataFrame:
    """Time per user-day that matches no goal; it is reported, never spread over goals."""
    return (
        activities.join(weights.select("activity_id").distinct(), "activity_id", "left_anti")
        .groupBy("user_id", "local_date")
        .agg(F.sum("duration_us").alias("unallocated_us"), F.count(F.lit(1)).alias("activities"))
    )
