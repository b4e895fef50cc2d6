"""Telemetry view over the sample ``events`` table, and its dimensions.

The sample stream is sparse per user, so fifteen of its users form one person with two
phones and three browsers, and every duration constant is ten times longer.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace import catalog
from daytrace.config import Thresholds
from daytrace.functions import timecols as tc
from daytrace.sources.tables import read

# Thresholds for the sample: the clock runs ten times slower, and the two count-based
# patterns need fewer events.  Slots are two hours wide.
SAMPLE = replace(
    Thresholds().scaled(10),
    habit_min_opens=2,
    habit_max_median_s=3600,
    storm_min_switches=4,
    slot_s=7200,
    wake_bound_s=12 * 3600,
    chunk_s=6 * 3600,
)
TZ, DAY_START = "UTC", 4


def _type() -> F.Column:
    e, k = F.col("event_type"), F.col("k")
    android = (
        F.when(e == "view", "APP_FOREGROUND")
        .when(e == "purchase", F.when(k < 50, "APP_FOREGROUND").otherwise("APP_BACKGROUND"))
        .when(e == "click", "USER_INTERACTION")
        .when(e == "signup", F.when(k < 80, "SCREEN_ON").otherwise("DEVICE_UNLOCK"))
        .otherwise(
            F.when(k < 60, "SCREEN_OFF")
            .when(k < 80, "DEVICE_LOCK")
            .when(k < 86, "DEVICE_SHUTDOWN")
            .when(k < 93, "DEVICE_STARTUP")
            .when(k < 95, "COLLECTOR_STOP")
            .otherwise("COLLECTOR_START")
        )
    )
    browser = (
        F.when(e == "view", "DOMAIN_FOCUS_START")
        .when(e == "purchase", "DOMAIN_FOCUS_END")
        .otherwise("HEALTH")
    )
    return F.when(F.col("platform") == "browser", browser).otherwise(android)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(read(spark, sf_dir, "events"))


def view(events: DataFrame) -> DataFrame:
    """One row per event: user, device, platform, seq, us (UTC micros), local_date, type, key."""
    u = F.col("user_id")
    family = F.floor((u % 15) / 5).cast("int")
    src = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    is_browser = (u % 3) == 2
    return (
        src.select(
            F.floor(u / 15).cast("long").alias("user_id"),
            F.when(is_browser, 2 + family).otherwise((u % 3).cast("int")).alias("device_id"),
            F.when(is_browser, "browser").otherwise("android").alias("platform"),
            F.when(
                is_browser,
                F.element_at(
                    F.array(F.lit("brave"), F.lit("chromium"), F.lit("firefox")), family + 1
                ),
            ).alias("browser_family"),
            F.col("event_id").alias("seq"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            tc.local_date(F.col("ts").cast("timestamp"), F.lit(TZ), F.lit(DAY_START)).alias(
                "local_date"
            ),
            "event_type",
            "value",
            "k",
        )
        .withColumn("type", _type())
        .withColumn(
            "key",
            F.when(
                F.col("event_type").isin("view", "purchase"),
                F.concat(F.lit("app_"), (F.col("k") % 8).cast("string")),
            ),
        )
    )


def priors(spark: SparkSession, entries: dict[str, tuple[str, float]]) -> DataFrame:
    """A seed catalogue as a DataFrame; it is a fixed list, so it is safe to broadcast."""
    rows = [(k, c, float(p)) for k, (c, p) in entries.items()]
    return spark.createDataFrame(rows, "app_key string, seed_category string, seed_conf double")


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = []
    for parent, (label, system, leaves) in catalog.TAXONOMY.items():
        rows.append((parent, None, label, system))
        rows += [(leaf, parent, leaf_label, system) for leaf, leaf_label in leaves.items()]
    return spark.createDataFrame(
        rows, "category string, parent string, label string, is_system boolean"
    )


def users(ev: DataFrame) -> DataFrame:
    return ev.select("user_id").distinct()


def user_rules(ev: DataFrame) -> DataFrame:
    """(user, app) rules of the sample: every seventh user files app_4 under reading."""
    return (
        users(ev)
        .filter(F.col("user_id") % 7 == 0)
        .select("user_id", F.lit("app_4").alias("app_key"), F.lit("reading").alias("rule_category"))
    )


def learned_priors(ev: DataFrame) -> DataFrame:
    """Learned priors of the sample, with sample counts on both sides of the gate."""
    u = F.col("user_id")
    return (
        users(ev)
        .filter(u % 5 == 1)
        .select(
            "user_id",
            F.lit("app_6").alias("app_key"),
            F.lit("research").alias("learned_category"),
            F.lit(0.83).alias("learned_conf"),
            F.when(u % 2 == 0, 4).otherwise(5).alias("samples"),
        )
    )


def enrolled_phones(ev: DataFrame) -> DataFrame:
    """Phones of the sample, enrolled from the user's first day to the one after the last, which is silent."""
    span = ev.groupBy("user_id").agg(
        F.min("local_date").alias("first_date"), F.date_add(F.max("local_date"), 1).alias("last_date")
    )
    phones = ev.filter("platform = 'android'").select("user_id", "device_id", "tz", "day_start_hour").distinct()
    return phones.join(span, "user_id")


def devices(ev: DataFrame) -> DataFrame:
    """Enrolled devices of the sample; some were revoked at their last event."""
    gone = (F.col("user_id") + F.col("device_id")) % 7 == 0
    return ev.groupBy("user_id", "device_id").agg(F.max("us").alias("us")).select(
        "user_id", "device_id", F.when(gone, F.col("us")).alias("revoked_us")
    )


def corrections(ev: DataFrame) -> DataFrame:
    """Category corrections derived from every app event."""
    v = F.col("value")
    return ev.filter(F.col("key").isNotNull()).select(
        "user_id",
        F.col("key").alias("app_key"),
        F.when(v < 12, "development").when(v < 25, "writing").otherwise("learning").alias(
            "category"
        ),
        "us",
        "seq",
        "local_date",
    )


def activity_corrections(acts: DataFrame) -> DataFrame:
    """Corrections of activities: every lone unknown one was first filed under admin, then under reading."""
    lone = acts.filter("category = 'unknown' and members = 1")
    again = F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("admin").alias("to")), F.struct(F.lit(2).alias("seq"), F.lit("reading").alias("to"))))
    return lone.select("activity_id", (F.col("end_us") + 1).alias("us"), again.alias("c")).select(
        "activity_id", F.col("c.to").alias("corrected_category"), "us", "c.seq"
    )


def goals(ev: DataFrame) -> DataFrame:
    """Three goals per user: by category, by app, and by both at once."""
    g = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("goal_id"),
                    F.lit(name).alias("name"),
                    F.lit(prio).alias("priority"),
                    F.lit(target).cast("double").alias("target_weekly_min"),
                    F.lit(frm).cast("date").alias("active_from"),
                    F.lit(to).cast("date").alias("active_to"),
                    F.lit(archived).alias("archived"),
                )
                for i, name, prio, target, frm, to, archived in SAMPLE_GOALS
            ]
        )
    ).alias("g")
    return users(ev).select("user_id", g).select("user_id", "g.*")


# goal_id, name, priority, weekly minutes, active from, active to, archived
SAMPLE_GOALS = [
    (1, "Ship it", 1, 6000.0, "2024-01-01", None, False),
    (2, "Less social", 3, 0.0, "2024-01-05", "2024-01-20", False),
    (3, "Learn", 2, 1200.0, "2024-01-01", None, False),
    (4, "Old", 4, 600.0, "2024-01-01", None, True),
]
# goal_id, category, app, weight; each row has exactly one target
SAMPLE_MAPPINGS = [
    (1, "development", None, 0.9),
    (2, None, "app_3", 1.0),
    (3, "learning", None, 0.8),
    (3, None, "app_7", 0.7),
    (4, "writing", None, 1.0),
]


def goal_mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SAMPLE_MAPPINGS, "goal_id int, category string, app_key string, weight double"
    )


def working_hours(ev: DataFrame) -> DataFrame:
    """Monday to Friday 09:00-17:00 for every user; weekday 0 is Monday."""
    return users(ev).select(
        "user_id",
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("weekday"),
        F.lit(9 * 3600).alias("start_sod"),
        F.lit(17 * 3600).alias("end_sod"),
    )


def sample_plan(spark: SparkSession, sf_dir: str):
    """The day pipeline over the sample telemetry."""
    from daytrace.plans.day import WHOLE_ROWS, DayPlan

    ev = telemetry(spark, sf_dir).withColumns(
        {"tz": F.lit(TZ), "day_start_hour": F.lit(DAY_START)}
    )
    return DayPlan(
        ev,
        priors(spark, catalog.APP_PRIORS | catalog.SAMPLE_PRIORS),
        SAMPLE,
        domain_seeds=priors(spark, catalog.DOMAIN_PRIORS | catalog.SAMPLE_PRIORS),
        rules=user_rules(ev),
        learned=learned_priors(ev),
        enrolled=enrolled_phones(ev),
        corrections=lambda plan: activity_corrections(plan.activities),
        whole_rows=WHOLE_ROWS,
    )
