"""App, browser and dwell sessions from raw events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from daytrace.config import DEVICE_DAY, US, Thresholds
from daytrace.operators.scan import CHUNK, chunked, scan


@dataclass(frozen=True)
class SessionRule:
    """Which event types open and close a session."""

    opens: str
    closes_same: str  # closes only the session with the same key
    closes_any: tuple[str, ...] = ()
    interaction: str | None = None

    @property
    def types(self) -> list[str]:
        extra = [self.interaction] if self.interaction else []
        return [self.opens, self.closes_same, *self.closes_any, *extra]


# Event types per session kind.
APP = SessionRule(
    "APP_FOREGROUND",
    "APP_BACKGROUND",
    ("SCREEN_OFF", "DEVICE_LOCK", "DEVICE_SHUTDOWN", "COLLECTOR_STOP"),
    "USER_INTERACTION",
)
BROWSER = SessionRule("DOMAIN_FOCUS_START", "DOMAIN_FOCUS_END")
DWELL = SessionRule(
    "APP_FOREGROUND", "APP_BACKGROUND", ("SCREEN_OFF", "DEVICE_LOCK", "DEVICE_SHUTDOWN")
)


def _opens(
    events: DataFrame, rule: SessionRule, th: Thresholds, hard: Column, constant: tuple[str, ...] = ()
) -> DataFrame:
    """One row per opening event with what happened before the next opening:
    ``closer_us`` (first hard closer), ``interactions`` and ``last_soft_us`` (newest
    same-key closing event), both counted only before that closer.

    Events of one opening are summed per time chunk first, so a session with very many
    interactions is never gathered in one task.
    """
    opening = (F.col("type") == rule.opens) & F.col("key").isNotNull()
    ev = chunked(
        events.select(*DEVICE_DAY, *constant, "us", "seq", "type", "key"), DEVICE_DAY, "us", th.chunk_s * US
    )
    ev = scan(
        ev,
        DEVICE_DAY,
        ["us", "seq"],
        last_us=("all_max", F.col("us")),
        o=(
            "last",
            F.when(
                opening,
                F.struct(
                    F.col("us").alias("o_us"),
                    F.col("seq").alias("o_seq"),
                    F.col("key").alias("app_key"),
                ),
            ),
        ),
    ).filter(F.col("o").isNotNull() & F.col("type").isin(rule.types)).select("*", "o.*").drop("o")

    in_chunk = Window.partitionBy(*DEVICE_DAY, CHUNK, "o_us", "o_seq").orderBy("us", "seq")
    ev = ev.withColumn("soft", (F.col("type") == rule.closes_same) & F.col("key").eqNullSafe(F.col("app_key")))
    ev = ev.withColumn("hard", hard)
    ev = ev.withColumn(
        "live",
        ~F.coalesce(
            F.max("hard").over(in_chunk.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(False),
        ),
    )
    counted = F.col("live") & (F.col("type") == F.lit(rule.interaction))
    opening = [*DEVICE_DAY, *constant, "app_key", "o_us", "o_seq", "last_us"]
    per_chunk = ev.groupBy(*opening, CHUNK).agg(
        F.min(F.when(F.col("hard"), F.col("us"))).alias("closer_us"),
        F.count_if(F.coalesce(counted, F.lit(False))).alias("interactions"),
        F.max(F.when(F.col("live") & F.col("soft"), F.col("us"))).alias("last_soft_us"),
    )
    # the chunk of the opening places its rows for all that follows
    per_chunk = chunked(per_chunk.withColumnRenamed(CHUNK, "_of"), DEVICE_DAY, "o_us", th.chunk_s * US)
    group = [*opening, CHUNK]
    earlier = Window.partitionBy(*group).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    open_chunk = F.count("closer_us").over(earlier) == 0
    return (
        per_chunk.withColumn("open_chunk", open_chunk)
        .groupBy(*group)
        .agg(
            F.min("closer_us").alias("closer_us"),
            F.sum(F.when(F.col("open_chunk"), F.col("interactions")).otherwise(0)).alias("interactions"),
            F.max(F.when(F.col("open_chunk"), F.col("last_soft_us"))).alias("last_soft_us"),
        )
    )


def _chained(opens: DataFrame, continues: Callable[[Column, Column], Column]) -> DataFrame:
    """Join openings into raw sessions ``s``.  ``continues`` says, given the previous opening and one,
    that this goes on with its session; ``next_us`` is the next session's start."""
    out = scan(
        opens,
        DEVICE_DAY,
        ["o_us", "o_seq"],
        joins=continues,
        uses=("app_key", "closer_us", "last_soft_us"),
        next_island=True,
    )
    return out.withColumn("next_us", F.col("next_island.o_us")).withColumnRenamed("island", "s")


def _sessions(
    events: DataFrame, rule: SessionRule, th: Thresholds, constant: tuple[str, ...] = ()
) -> DataFrame:
    """Sessions of a rule; columns ``constant`` are the same for all events of a device."""
    any_closer = F.col("type").isin(list(rule.closes_any)) if rule.closes_any else F.lit(False)
    opens = _opens(events, rule, th, hard=any_closer | F.col("soft"), constant=constant)
    raw = (
        _chained(opens, lambda p, o: (p["app_key"] == o["app_key"]) & p["closer_us"].isNull())
        .groupBy(*DEVICE_DAY, *constant, "s", "app_key")
        .agg(
            F.max("closer_us").alias("closer_us"),
            F.max("next_us").alias("next_us"),
            F.sum("interactions").alias("interactions"),
            F.max("last_us").alias("last_us"),
        )
    )
    raw = raw.select(
        *DEVICE_DAY,
        *constant,
        "app_key",
        F.col("s.o_us").alias("start_us"),
        F.coalesce("closer_us", "next_us", "last_us").alias("found_end"),
        (F.col("closer_us").isNull() & F.col("next_us").isNull()).alias("open_end"),
        "interactions",
    )
    cap = F.col("start_us") + th.max_session_s * US
    raw = raw.select(
        *DEVICE_DAY,
        *constant,
        "app_key",
        "start_us",
        F.least("found_end", cap).alias("end_us"),
        ((F.col("found_end") > cap) | F.col("open_end")).alias("truncated"),
        "interactions",
    ).filter(F.col("end_us") - F.col("start_us") >= th.min_session_s * US)
    return _merge_bounces(raw, th, constant)


def _merge_bounces(raw: DataFrame, th: Thresholds, constant: tuple[str, ...]) -> DataFrame:
    """Join same-key neighbours with a short gap.  Sessions of a device do not overlap and
    last at least ``min_session_s``, so a device-day holds at most day / min_session rows and
    a plain window is bounded."""
    w = Window.partitionBy(*DEVICE_DAY).orderBy("start_us")
    joins = (F.lag("app_key").over(w) == F.col("app_key")) & (
        F.col("start_us") - F.lag("end_us").over(w) < th.merge_gap_s * US
    )
    return (
        raw.withColumn("new", F.when(joins, 0).otherwise(1))
        .withColumn("grp", F.sum("new").over(w))
        .groupBy(*DEVICE_DAY, *constant, "grp", "app_key")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("interactions").alias("interactions"),
            F.max_by("truncated", "start_us").alias("truncated"),
            F.count(F.lit(1)).alias("merged_from"),
        )
        .drop("grp")
    )


def app_sessions(events: DataFrame, th: Thresholds) -> DataFrame:
    """Sessions of phone apps per device-day."""
    return _sessions(events, APP, th)


def browser_sessions(events: DataFrame, th: Thresholds) -> DataFrame:
    """Sessions of browser domains per device-day; ``app_key`` holds the domain."""
    return _sessions(events, BROWSER, th, ("browser_family",)).drop("interactions")


def app_dwells(events: DataFrame, th: Thresholds, now_us: Column) -> DataFrame:
    """Dwells with no minimum length: leaving an app and coming back within the merge gap
    keeps the dwell open.  ``now_us`` ends a dwell that is still open."""
    opens = _opens(events, DWELL, th, hard=F.col("type").isin(list(DWELL.closes_any)))

    def continues(p, o):
        soon = o["o_us"] - p["last_soft_us"] <= th.merge_gap_s * US
        return (p["app_key"] == o["app_key"]) & p["closer_us"].isNull() & soon

    chained = _chained(opens, continues)
    # the last opening of a dwell decides how it ends
    tail = F.max_by(
        F.struct("last_soft_us", "closer_us", "next_us"), F.struct("o_us", "o_seq")
    )
    dwells = (
        chained.groupBy(*DEVICE_DAY, "s", "app_key")
        .agg(tail.alias("t"))
        .select(
            *DEVICE_DAY,
            "app_key",
            F.col("s.o_us").alias("start_us"),
            F.coalesce("t.last_soft_us", "t.closer_us", "t.next_us", now_us).alias("found_end"),
        )
    )
    cap = F.col("start_us") + th.max_session_s * US
    return dwells.select(
        *DEVICE_DAY,
        "app_key",
        "start_us",
        F.least("found_end", cap).alias("end_us"),
        (F.col("found_end") > cap).alias("truncated"),
    )


def dwell_summary(dwells: DataFrame) -> DataFrame:
    return dwells.groupBy("user_id", "device_id", "app_key").agg(
        F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"),
        F.count(F.lit(1)).alias("opens"),
    )
