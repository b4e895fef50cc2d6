"""The daily summary document and what is computed from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from daytrace.config import US, USER_DAY
from daytrace.functions import timecols as tc
from daytrace.operators import focus as fo

# List sizes of the document.
MAX_CATEGORIES, MAX_ATTENTION, MAX_GOALS, MAX_PATTERNS = 15, 15, 10, 10
PPB = 1_000_000_000


def minutes(us: Column) -> Column:
    return F.rint(us / (60.0 * US)).cast("long")


def _best(ranked: DataFrame, limit: int | None) -> DataFrame:
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def category_summary(
    activities: DataFrame, taxonomy: DataFrame, metrics: DataFrame, limit: int | None = None
) -> DataFrame:
    """Categories per user-day by rank, the first ``limit`` if given: minutes, sessions, mean
    confidence, share of screen time."""
    sure = F.sum(F.rint(F.col("confidence") * PPB).cast("long"))
    n = F.count(F.lit(1))
    rows = (
        activities.join(taxonomy, "category")
        .filter(~F.col("is_system"))
        .groupBy(*USER_DAY, F.col("label").alias("category"))
        .agg(
            minutes(F.sum("duration_us")).alias("minutes"),
            n.alias("sessions"),
            tc.round_even(sure / n / float(PPB), 2).alias("avg_confidence"),
        )
    )
    rank = F.row_number().over(
        Window.partitionBy(*USER_DAY).orderBy(F.col("minutes").desc(), "category")
    )
    top = _best(rows.withColumn("rank", rank), limit)
    screen = metrics.select(*USER_DAY, minutes(F.col("screen_time_s") * US).alias("screen_minutes"))
    share = F.when(
        F.col("screen_minutes") > 0, tc.round_even(F.col("minutes") / F.col("screen_minutes"), 2)
    ).otherwise(F.lit(0.0))
    return top.join(screen, USER_DAY).select(
        *USER_DAY, "rank", "category", "minutes", share.alias("share"), "sessions", "avg_confidence"
    )


def top_attention(classified: DataFrame, taxonomy: DataFrame, limit: int | None = None) -> DataFrame:
    """Apps and domains by time per user-day, the first ``limit`` if given, as category and time
    bucket; names stay out."""
    length = F.col("end_us") - F.col("start_us")
    apps = (
        classified.join(taxonomy, "category")
        .filter(~F.col("is_system"))
        .groupBy(*USER_DAY, "app_key")
        .agg(
            F.sum(length).alias("total_us"),
            F.count(F.lit(1)).alias("sessions"),
            F.max_by("label", F.struct("start_us", "device_id")).alias("category"),
        )
    )
    rank = F.row_number().over(
        Window.partitionBy(*USER_DAY).orderBy(F.col("total_us").desc(), "app_key")
    )
    return _best(apps.withColumn("rank", rank), limit).select(
        *USER_DAY,
        "rank",
        "category",
        tc.duration_bucket(F.col("total_us") / (60.0 * US)).alias("bucket"),
        "sessions",
    )


def focus_summary(focus: DataFrame) -> DataFrame:
    length = F.col("end_us") - F.col("start_us")
    n = F.count(F.lit(1))
    good = F.sum(F.rint(fo.quality() * PPB).cast("long"))
    return focus.groupBy(*USER_DAY).agg(
        n.alias("sessions"),
        F.count_if("is_deep").alias("deep_sessions"),
        minutes(F.max(length)).alias("longest_minutes"),
        minutes(F.sum(length) / n).alias("average_minutes"),
        minutes(F.sum(length)).alias("total_focus_minutes"),
        tc.round_even(good / n / float(PPB), 2).alias("avg_quality"),
    )


def confirmed_patterns(patterns: DataFrame, limit: int | None = None) -> DataFrame:
    """A user's confirmed patterns by strength, the first ``limit`` if given."""
    rank = F.row_number().over(
        Window.partitionBy("user_id").orderBy(
            F.col("strength").desc(), "pattern", F.col("app_key").asc_nulls_first()
        )
    )
    return (
        _best(patterns.filter("status = 'confirmed'").withColumn("rank", rank), limit)
        .select(
            "user_id",
            "rank",
            F.col("pattern").alias("type"),
            "occurrences",
            tc.round_even(F.col("strength"), 2).alias("strength"),
            "status",
        )
    )


def goal_summary(active: DataFrame, windowed: DataFrame) -> DataFrame:
    """Goals in force per user-day with today's alignment and the week's attainment."""
    key = ["user_id", "goal_id", "local_date"]
    today = windowed.filter("window_days = 1").select(
        *key, "aligned_min", (F.col("high_min") - F.col("aligned_min")).alias("unsure_min")
    )
    week = windowed.filter("window_days = 7").select(*key, F.col("attainment").alias("week"))
    rank = F.row_number().over(Window.partitionBy(*USER_DAY).orderBy("priority", "goal_id"))
    return (
        active.join(today, key)
        .join(week, key)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= MAX_GOALS)
        .select(
            *USER_DAY,
            "rank",
            "name",
            "priority",
            F.rint("target_weekly_min").cast("long").alias("target_weekly_minutes"),
            F.rint("aligned_min").cast("long").alias("aligned_minutes_today"),
            F.rint("unsure_min").cast("long").alias("uncertainty"),
            tc.round_even(F.col("week"), 2).alias("week_attainment"),
        )
    )


def _listed(df: DataFrame, keys: list[str], name: str, fields: list[str]) -> DataFrame:
    """Ranked rows as one array per key; ``rank`` limits keep the arrays short."""
    row = F.struct("rank", *[F.col(f).alias(f) for f in sorted(fields) if f != "rank"])
    items = F.array_sort(F.collect_list(row))
    shape = lambda x: F.struct(*[x[f].alias(f) for f in sorted(fields)])
    return df.groupBy(*keys).agg(F.transform(items, shape).alias(name))


def document(
    metrics: DataFrame,
    categories: DataFrame,
    attention: DataFrame,
    focus: DataFrame,
    goals: DataFrame,
    patterns: DataFrame,
    baseline: DataFrame,
    platforms: DataFrame,
) -> DataFrame:
    """One nested document per user-day.  Fields are declared in sorted order, so its JSON text
    is canonical."""
    reporting = platforms.groupBy(*USER_DAY).agg(
        F.array_sort(F.collect_set("platform")).alias("devices_reporting")
    )
    df = (
        metrics.join(_listed(categories, USER_DAY, "categories",
                             ["category", "minutes", "share", "sessions", "avg_confidence"]), USER_DAY, "left")
        .join(_listed(attention, USER_DAY, "top_attention",
                      ["rank", "category", "bucket", "sessions"]), USER_DAY, "left")
        .join(focus, USER_DAY, "left")
        .join(_listed(goals, USER_DAY, "goals",
                      ["name", "priority", "target_weekly_minutes", "aligned_minutes_today",
                       "uncertainty", "week_attainment"]), USER_DAY, "left")
        .join(_listed(patterns, ["user_id"], "patterns",
                      ["type", "occurrences", "strength", "status"]), "user_id", "left")
        .join(baseline, USER_DAY, "left")
        .join(reporting, USER_DAY, "left")
    )

    def whole(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("long")

    def mins(c: str) -> Column:
        return minutes(F.col(c) * US)

    frag = tc.round_even(F.col("fragmentation_index"), 2)
    fields = lambda **kw: F.struct(*[kw[k].alias(k) for k in sorted(kw)])
    versus = fields(
        deep_work_minutes=tc.signed_delta(F.col("deep_work_s") / 60.0 - F.col("deep_work_minutes_mean"), 0),
        fragmentation=F.when(
            frag.isNotNull(), tc.signed_delta(frag - F.col("fragmentation_mean"), 2)
        ),
        screen_minutes=tc.signed_delta(mins("screen_time_s") - F.col("screen_minutes_mean"), 0),
    )
    # the score's inputs are the document's own rounded values
    doc = fields(
        baselines=fields(
            deep_work_minutes_mean=F.rint("deep_work_minutes_mean").cast("long"),
            fragmentation_mean=tc.round_even(F.col("fragmentation_mean"), 2),
            screen_minutes_mean=F.rint("screen_minutes_mean").cast("long"),
            today_vs_mean=versus,
            valid_days=F.col("valid_days"),
            window_days=F.lit(30),
        ),
        categories=_or_empty("categories"),
        context_version=F.lit("v1"),
        data_quality=fields(
            caveats=F.array().cast("array<string>"),
            coverage_ratio=tc.round_even(F.col("coverage_ratio"), 2),
            devices_reporting=_or_empty("devices_reporting"),
            offline_minutes=mins("offline_s"),
            unknown_ratio=tc.round_even(F.col("unknown_ratio"), 2),
            unobserved_minutes=mins("unobserved_s"),
        ),
        date=F.col("local_date").cast("string"),
        focus=fields(
            average_minutes=whole("average_minutes"),
            avg_quality=F.coalesce("avg_quality", F.lit(0.0)),
            context_switches=F.col("context_switches"),
            deep_sessions=whole("deep_sessions"),
            fragmentation_index=frag,
            interruptions=F.col("interruptions"),
            longest_minutes=whole("longest_minutes"),
            sessions=whole("sessions"),
            switches_per_hour=tc.round_even(F.col("switches_per_hour"), 1),
            total_focus_minutes=whole("total_focus_minutes"),
        ),
        goals=_or_empty("goals"),
        patterns=_or_empty("patterns"),
        scope=F.lit("day"),
        time_of_day=F.array().cast("array<string>"),
        top_attention=_or_empty("top_attention"),
        totals=fields(
            active_minutes=mins("active_time_s"),
            day_minutes=mins("duration_s"),
            observed_minutes=mins("observed_s"),
            screen_minutes=mins("screen_time_s"),
        ),
        weekday=F.date_format("local_date", "EEEE"),
    )
    return df.select(*USER_DAY, doc.alias("doc"))


def _or_empty(name: str) -> Column:
    """The array, or an empty one of the same type where a day has none."""
    return F.coalesce(F.col(name), F.expr(f"filter(array(element_at({name}, 1)), x -> false)"))


def canonical_json(doc: Column) -> Column:
    """The document's JSON text.  A day without a fragmentation index has no key for its difference
    from the mean; no text inside a value can look like that key, as its quotes would be escaped."""
    return F.replace(
        F.to_json(doc, {"ignoreNullFields": "false"}), F.lit('"fragmentation":null,'), F.lit("")
    )


def summary_hash(doc: Column) -> Column:
    """SHA-256 of the canonical JSON: equal summaries have equal hashes."""
    return F.sha2(canonical_json(doc), 256)


def day_score() -> Column:
    """Reference score of a day, 0 to 100, from the document's own values."""
    # Points and penalties.
    d = lambda p: F.col(f"doc.{p}")
    hundredths = F.transform(F.col("doc.goals"), lambda g: F.rint(g["week_attainment"] * 100).cast("long"))
    total = F.aggregate(hundredths, F.lit(0).cast("long"), lambda a, x: a + x)
    attained = total / F.size("doc.goals") / 100.0
    raw = (
        50.0
        + F.least(d("focus.deep_sessions") * 8.0, F.lit(24.0))
        + F.least(d("focus.total_focus_minutes") / 10.0, F.lit(15.0))
        - F.coalesce(d("focus.fragmentation_index") * 20.0, F.lit(0.0))
        - F.least(d("focus.interruptions") * 1.5, F.lit(15.0))
        - d("data_quality.unknown_ratio") * 15.0
        + F.when(
            F.size("doc.goals") > 0, (F.least(attained, F.lit(1.5)) - 0.5) * 10.0
        ).otherwise(F.lit(0.0))
    )
    pulled = F.when(d("data_quality.coverage_ratio") < 0.6, (raw + 50.0) / 2).otherwise(raw)
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), pulled))).cast("long")
