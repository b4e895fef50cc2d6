"""Coverage of a device-day: which time was observed, and in which state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace.config import DEVICE_DAY, US, Thresholds
from daytrace.functions import timecols as tc
from daytrace.operators.scan import CHUNK, chunked, scan

TRACKED, IDLE, OFFLINE, UNOBSERVED = "TRACKED", "IDLE", "DEVICE_OFFLINE", "UNOBSERVED"


def signal_states(
    events: DataFrame, th: Thresholds, media_apps: list[str] | None = None
) -> DataFrame:
    """Every event with the device state right after it and the next event's time.

    With ``media_apps`` a column ``media`` says whether the newest foreground app plays media.
    """
    t, us = F.col("type"), F.col("us")
    on = t == "SCREEN_ON"
    dark = t.isin("SCREEN_OFF", "DEVICE_LOCK")
    down = t == "DEVICE_SHUTDOWN"
    none = F.lit(-1).cast("long")
    cols, extra = [*DEVICE_DAY, "tz", "day_start_hour", "us", "seq", "type"], {}
    if media_apps is not None:
        cols.append("key")
        opened = (t == "APP_FOREGROUND") & F.col("key").isNotNull()
        playing = F.when(opened, F.col("key").isin(media_apps)).when(t == "APP_BACKGROUND", False)
        extra["media"] = ("last", playing)
    ev = chunked(events.select(*cols), DEVICE_DAY, "us", th.chunk_s * US)
    out = scan(
        ev,
        DEVICE_DAY,
        ["us", "seq"],
        screen=("last", F.when(on, True).when(dark | down, False)),
        down=("last", F.when(down, True).when(t == "DEVICE_STARTUP", False)),
        alive=("last", F.when(t == "COLLECTOR_STOP", False).when(t == "COLLECTOR_START", True)),
        touched=("last", F.when(t == "USER_INTERACTION", us).when(on | dark, none)),
        on_since=("last", F.when(on, us).when(dark, none)),
        lit=("last", F.when(on, True).when(dark, False)),
        next_us=("lead", us),
        prev_us=("before", us),
        **extra,
    ).drop(CHUNK)
    if media_apps is not None:
        out = out.withColumn("media", F.coalesce("media", F.lit(False)))
    return out


def _window(df: DataFrame) -> DataFrame:
    start, end = tc.day_window(F.col("local_date"), F.col("tz"), F.col("day_start_hour"))
    return df.withColumns({"win_start": start, "win_end": end})


def coverage_intervals(states: DataFrame, th: Thresholds, exempt: Column | None = None) -> DataFrame:
    """Gapless cover of each device's day window by state.

    ``exempt`` marks rows during which media plays: such time is never idle.
    """
    df = _window(states)
    start, end = F.col("us"), F.coalesce("next_us", "win_end")
    touched = F.when(F.col("touched") >= 0, F.col("touched"))
    on_since = F.when(F.col("on_since") >= 0, F.col("on_since"))
    idle_at = F.coalesce(touched, on_since, start) + th.idle_s * US
    if exempt is not None:
        idle_at = F.when(exempt, end).otherwise(idle_at)
    split = F.least(F.greatest(idle_at, start), end)

    def piece(a: Column, b: Column, state: Column | str) -> Column:
        return F.struct(a.alias("start_us"), b.alias("end_us"), (F.lit(state) if isinstance(state, str) else state).alias("state"))

    fixed = (
        F.when(~F.coalesce(F.col("alive"), F.lit(True)), UNOBSERVED)
        .when(F.coalesce(F.col("down"), F.lit(False)), OFFLINE)
        .when(~F.coalesce(F.col("screen"), F.lit(False)), TRACKED)
        .when(end - start >= 2 * th.poll_s * US, UNOBSERVED)
    )
    # the first event of a day also stands for the silence before it
    silence = F.when(F.col("prev_us").isNull(), F.col("win_start")).otherwise(start)
    pieces = F.array(
        piece(silence, start, UNOBSERVED),
        piece(start, F.when(fixed.isNull(), split).otherwise(end), F.coalesce(fixed, F.lit(TRACKED))),
        piece(F.when(fixed.isNull(), split).otherwise(end), end, IDLE),
    )
    segments = (
        df.select(*DEVICE_DAY, F.explode(pieces).alias("s"))
        .select(*DEVICE_DAY, "s.*")
        .filter("end_us > start_us")
    )
    return coalesce_intervals(segments, DEVICE_DAY, th)


def silent_days(enrolled: DataFrame, events: DataFrame) -> DataFrame:
    """Device-days without any event.  ``enrolled``: user_id, device_id, tz, day_start_hour, first_date,
    last_date (both included)."""
    days = enrolled.filter("first_date <= last_date").select(
        "user_id", "device_id", "tz", "day_start_hour",
        F.explode(F.sequence("first_date", "last_date")).alias("local_date"),
    )
    return days.join(events.select(*DEVICE_DAY).distinct(), DEVICE_DAY, "left_anti")


def silent_intervals(silent: DataFrame) -> DataFrame:
    """One unobserved interval over the whole window of each silent device-day."""
    return _window(silent).select(
        *DEVICE_DAY,
        F.col("win_start").alias("start_us"),
        F.col("win_end").alias("end_us"),
        F.lit(UNOBSERVED).alias("state"),
    )


def coalesce_intervals(df: DataFrame, keys: list[str], th: Thresholds) -> DataFrame:
    """Join touching neighbours of the same state (start_us, end_us, state per key)."""
    df = chunked(df.select(*keys, "start_us", "end_us", "state"), keys, "start_us", th.chunk_s * US)
    df = scan(
        df, keys, ["start_us"], uses=("end_us", "state"),
        joins=lambda p, r: (p["state"] == r["state"]) & (p["end_us"] == r["start_us"]),
    )
    return df.groupBy(*keys, F.col("island.start_us").alias("start_us"), "state").agg(
        F.max("end_us").alias("end_us")
    ).select(*keys, "start_us", "end_us", "state")


def coverage_ratio(cov: DataFrame, keys: list[str]) -> DataFrame:
    """Observed share of the covered window per key."""
    length = F.col("end_us") - F.col("start_us")
    seen = F.sum(F.when(F.col("state").isin(TRACKED, IDLE), length).otherwise(0))
    total = F.sum(length)
    return cov.groupBy(*keys).agg(
        seen.alias("observed_us"),
        total.alias("window_us"),
        F.when(total > 0, seen / total).otherwise(F.lit(0.0)).alias("coverage_ratio"),
    )


def screen_on(states: DataFrame, th: Thresholds) -> DataFrame:
    """Screen-on time per device-day; an unfinished stretch ends two polls after the last event."""
    df = _window(states)
    cap = F.least(F.col("win_end"), F.col("us") + 2 * th.poll_s * US)
    span = F.when(F.coalesce("lit", F.lit(False)), F.coalesce("next_us", cap) - F.col("us"))
    return df.groupBy(*DEVICE_DAY).agg(F.sum(F.coalesce(span, F.lit(0))).alias("screen_on_us"))


def overlaps(
    cov: DataFrame, th: Thresholds, keys: list[str] = DEVICE_DAY, order: list[str] | None = None
) -> DataFrame:
    """Data-quality check: intervals that run into the next one of their key."""
    df = chunked(cov.select(*DEVICE_DAY, "start_us", "end_us"), keys, "start_us", th.chunk_s * US)
    df = scan(df, keys, order or ["start_us", "end_us"], next_start=("lead", F.col("start_us")))
    return df.filter("next_start < end_us").drop(CHUNK)


def poll_cadence(events: DataFrame) -> DataFrame:
    """Mean gap between consecutive events: the gaps add up to last - first."""
    n = F.count(F.lit(1))
    return events.groupBy("user_id", "device_id").agg(
        n.alias("polls"),
        F.when(n > 1, (F.max("us") - F.min("us")) / (n - 1)).alias("mean_gap_us"),
    )
