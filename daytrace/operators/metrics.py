"""Daily metrics and simple totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrace.catalog import WORK
from daytrace.config import US, USER_DAY
from daytrace.functions import timecols as tc
from daytrace.operators import coverage as cov
from daytrace.operators import focus as fo
from daytrace.operators import intervals as iv
from daytrace.sources.tables import stage



def length():
    return F.col("end_us") - F.col("start_us")


def category_totals(classified: DataFrame) -> DataFrame:
    return classified.groupBy(*USER_DAY, "category").agg(
        F.sum(length()).alias("total_us"), F.count(F.lit(1)).alias("sessions")
    )


def work_median(classified: DataFrame) -> DataFrame:
    """Exact median length of work sessions per user-day.  Equal lengths are counted first, so
    the final step sees distinct lengths only."""
    work = classified.filter(F.col("category").isin(WORK))
    counts = work.groupBy(*USER_DAY, length().alias("len_us")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*USER_DAY).agg(
        F.percentile("len_us", F.lit(0.5), F.col("n")).alias("median_us")
    )


def burst_span(bursts: DataFrame, th) -> DataFrame:
    return iv.union_length(bursts, USER_DAY, th).withColumnRenamed("union_us", "distraction_us")


def work_partition(classified: DataFrame, focus: DataFrame) -> DataFrame:
    """Deep, focused and shallow work per user-day."""
    work = classified.groupBy(*USER_DAY).agg(
        F.sum(F.when(F.col("category").isin(WORK), length()).otherwise(0)).alias("work_us")
    )
    split = focus.groupBy(*USER_DAY).agg(
        F.sum(F.when(F.col("is_deep"), length()).otherwise(0)).alias("deep_us"),
        F.sum(F.when(~F.col("is_deep"), length()).otherwise(0)).alias("focused_us"),
    )
    df = work.join(split, USER_DAY, "left").fillna(0, ["deep_us", "focused_us"])
    return df.withColumn(
        "shallow_us",
        F.greatest(F.col("work_us") - F.col("deep_us") - F.col("focused_us"), F.lit(0)),
    )


def daily_metrics(plan) -> DataFrame:
    """The wide user-day row: all parts are aggregated per user-day first, then joined."""
    th = plan.th
    rows = plan.events.select(*USER_DAY, "tz", "day_start_hour", "type")
    if plan.silent is not None:
        quiet = plan.silent.select(*USER_DAY, "tz", "day_start_hour", F.lit(None).cast("string").alias("type"))
        rows = rows.unionByName(quiet)
    days = rows.groupBy(*USER_DAY).agg(
        F.min("tz").alias("tz"),
        F.min("day_start_hour").alias("day_start_hour"),
        F.count_if(F.col("type") == "DEVICE_UNLOCK").alias("unlock_count"),
        (F.count_distinct("tz") > 1).alias("tz_transition"),
    )
    start, end = tc.day_window(F.col("local_date"), F.col("tz"), F.col("day_start_hour"))
    days = days.withColumns({"day_start_us": start, "day_end_us": end}).drop(
        "tz", "day_start_hour"
    )

    def in_state(state: str):
        return F.sum(F.when(F.col("state") == state, length()).otherwise(0))

    coverage = plan.coverage.groupBy(*USER_DAY).agg(
        in_state(cov.TRACKED).alias("tracked_us"),
        in_state(cov.IDLE).alias("idle_us"),
        in_state(cov.UNOBSERVED).alias("unobserved_us"),
        in_state(cov.OFFLINE).alias("offline_us"),
    )
    screen = cov.screen_on(plan.states, th).groupBy(*USER_DAY).agg(
        F.sum("screen_on_us").alias("screen_us")
    )

    flags = fo.switch_flags(plan.classified)

    def in_category(*names: str):
        return F.sum(F.when(F.col("category").isin(*names), length()).otherwise(0))

    sessions = flags.groupBy(*USER_DAY).agg(
        F.sum(length()).alias("session_us"),
        in_category(*WORK).alias("work_us"),
        in_category("communication").alias("communication_us"),
        in_category("learning").alias("learning_us"),
        in_category("entertainment").alias("entertainment_us"),
        in_category("social").alias("social_us"),
        in_category("unknown").alias("unknown_us"),
        F.count_if("context_switch").alias("context_switches"),
    )
    focus = plan.focus.groupBy(*USER_DAY).agg(
        F.sum(F.when(F.col("is_deep"), length()).otherwise(0)).alias("deep_us"),
        F.sum(F.when(~F.col("is_deep"), length()).otherwise(0)).alias("focused_us"),
        F.sum("interruptions").alias("interruptions"),
        F.max(length()).alias("longest_us"),
        F.count(F.lit(1)).alias("focus_session_count"),
    )
    parts = [
        coverage, screen, plan.unified, sessions, focus,
        work_median(plan.classified), burst_span(plan.bursts, th),
    ]
    df = days
    for part in parts:
        df = df.join(part, USER_DAY, "left")
    df = df.fillna(0)

    day_us = F.col("day_end_us") - F.col("day_start_us")
    ratio = F.when(day_us > 0, F.col("observed_us") / day_us).otherwise(F.lit(0.0))
    active_us = F.greatest(F.col("screen_us") - F.col("idle_us"), F.lit(0))
    hours = active_us / (3600.0 * US)
    per_hour = F.when(
        active_us > 0, F.col("context_switches") / F.greatest(hours, F.lit(1 / 3600))
    ).otherwise(F.lit(0.0))
    focus_us = F.col("deep_us") + F.col("focused_us")
    frag = F.when(
        F.col("coverage_ratio") >= th.coverage_gate,
        fo.fragmentation(
            F.col("switches_per_hour"),
            focus_us,
            F.greatest("work_us", focus_us),
            F.col("median_us") / (60.0 * US),
        ),
    )
    sec = lambda c: tc.seconds(F.col(c) if isinstance(c, str) else c)
    df = df.withColumns({"coverage_ratio": ratio, "switches_per_hour": per_hour})
    return df.select(
        *USER_DAY,
        "day_start_us",
        "day_end_us",
        sec(day_us).alias("duration_s"),
        sec("observed_us").alias("observed_s"),
        sec("tracked_us").alias("tracked_s"),
        sec("idle_us").alias("idle_s"),
        sec("unobserved_us").alias("unobserved_s"),
        sec("offline_us").alias("offline_s"),
        "coverage_ratio",
        sec("dual_us").alias("dual_device_s"),
        sec("screen_us").alias("screen_time_s"),
        sec(active_us).alias("active_time_s"),
        sec("deep_us").alias("deep_work_s"),
        sec("focused_us").alias("focused_work_s"),
        sec(F.greatest(F.col("work_us") - focus_us, F.lit(0))).alias("shallow_work_s"),
        sec("communication_us").alias("communication_s"),
        sec("learning_us").alias("learning_s"),
        sec("entertainment_us").alias("entertainment_s"),
        sec("social_us").alias("social_s"),
        sec("distraction_us").alias("distraction_s"),
        sec("unknown_us").alias("unknown_s"),
        F.when(F.col("session_us") > 0, F.col("unknown_us") / F.col("session_us"))
        .otherwise(F.lit(0.0))
        .alias("unknown_ratio"),
        "context_switches",
        "switches_per_hour",
        "interruptions",
        frag.alias("fragmentation_index"),
        sec("longest_us").alias("longest_focus_s"),
        F.when(F.col("focus_session_count") > 0, sec(focus_us) / F.col("focus_session_count"))
        .otherwise(F.lit(0.0))
        .alias("avg_focus_s"),
        "focus_session_count",
        "unlock_count",
        "tz_transition",
    )


def collector_health(
    events: DataFrame, rejected: DataFrame, devices: DataFrame, as_of_us: int, stale_s: int
) -> DataFrame:
    """Per device: last event, last sequence, rejected batches, and whether it went silent.  A device is
    revoked if ``devices`` (user_id, device_id, revoked_us) has a time for it."""
    key = ["user_id", "device_id"]
    seen = events.groupBy(*key).agg(F.max("us").alias("last_seen_us"), F.max("seq").alias("last_seq"))
    silent = as_of_us - F.col("last_seen_us")
    return (
        seen.join(rejected, key, "left")
        .fillna(0, ["rejected_batches"])
        .join(devices.select(*key, "revoked_us"), key, "left")
        .withColumns({"revoked": F.col("revoked_us").isNotNull(), "stale": silent > stale_s * US})
        .drop("revoked_us")
    )


#: Buckets of a refinement, and distinct values of a bucket that are sorted in one task.
QUANTILE_BUCKETS, QUANTILE_VALUES = 4096, 4096


def exact_quantiles(
    per_value: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
    buckets: int = QUANTILE_BUCKETS, most: int = QUANTILE_VALUES,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key, each row standing for ``n`` of them.

    Every wanted rank has a range of values it must lie in, at first all of its key's.  A round counts
    the range's values in equal-width buckets between its least and largest and keeps the bucket that
    holds the rank, with the least and largest value really in it.  Both ends of a range fall into
    different buckets, so ranges shrink whatever the values are; an outlier costs a round.  Rounds go on
    until no range has more than ``most`` distinct values, and only those are sorted.
    """
    v = F.col(value).cast("double")
    rows = per_value.groupBy(*keys, v.alias("_v")).agg(F.sum("n").alias("n"))
    at = lambda p: F.lit(p) * (F.col("_all") - 1)
    ranks = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in quantiles.values() for f in (F.floor, F.ceil)]))
    spans = rows.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("n").alias("_all"), F.count("*").alias("_m")
    )
    # one small row per key and rank
    spans = stage(spans.withColumn("_r", F.explode(ranks)).withColumn("_before", F.lit(0).cast("long")))
    rows = stage(rows)

    def inside(frame: DataFrame) -> DataFrame:
        return rows.join(frame, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    while (spans.agg(F.max("_m")).first()[0] or 0) > most:
        place = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        bucket = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(place * buckets), F.lit(buckets - 1))).otherwise(0)
        own = [*keys, "_r", "_all", "_before"]
        counts = inside(spans).groupBy(*own, bucket.alias("_b")).agg(
            F.sum("n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_m")
        )
        # at most as many rows per rank as there are buckets
        earlier = Window.partitionBy(*keys, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        hit = (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_n"))
        spans = stage(counts.where(hit).drop("_b", "_n"))
    order = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = inside(spans).withColumn("_end", F.col("_before") + F.sum("n").over(order))
    found = found.where((F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("n")))

    def quantile(p: float):
        low, high = (F.max(F.when(F.col("_r") == f(at(p)).cast("long"), F.col("_v"))) for f in (F.floor, F.ceil))
        return F.round(low + (high - low) * F.max(at(p) - F.floor(at(p))), 6)

    return found.groupBy(*keys).agg(*[quantile(p).alias(name) for name, p in quantiles.items()])


def latency_quantiles(events: DataFrame) -> DataFrame:
    """Event totals and exact sync-latency quantiles; equal latencies are counted first."""
    per_value = events.groupBy("latency_s").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("synced").alias("synced")
    )
    per_value = per_value.withColumn("_one", F.lit(1))
    totals = per_value.groupBy("_one").agg(F.sum("n").alias("collected"), F.sum("synced").alias("synced"))
    found = exact_quantiles(
        per_value.where("latency_s is not null"), ["_one"], "latency_s", {"latency_p50": 0.5, "latency_p95": 0.95}
    )
    return totals.join(found, "_one", "left").drop("_one")


def classification_health(classified: DataFrame) -> DataFrame:
    """Unknown share and confidence quantiles per day; equal confidences are counted first."""
    per_value = classified.groupBy("local_date", "confidence").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(length()).alias("all_us"),
        F.sum(F.when(F.col("category") == "unknown", length()).otherwise(0)).alias("unknown_us"),
    )
    share = per_value.groupBy("local_date").agg((F.sum("unknown_us") / F.sum("all_us")).alias("unknown_ratio"))
    found = exact_quantiles(
        per_value.where("confidence is not null"),
        ["local_date"],
        "confidence",
        {"confidence_p50": 0.5, "confidence_p10": 0.1},
    )
    return share.join(found, "local_date", "left")


def domain_totals(arbitrated: DataFrame, families: list[str]) -> DataFrame:
    """Time per domain over all browsers, with the share of each family."""
    return arbitrated.groupBy(*USER_DAY, "app_key").agg(
        F.sum(length()).alias("total_us"),
        F.count_distinct("browser_family").alias("families"),
        *[
            F.sum(F.when(F.col("browser_family") == f, length()).otherwise(0)).alias(f"{f}_us")
            for f in families
        ],
    )
