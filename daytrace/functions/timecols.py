"""Time and scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daytrace.config import US


def local_date(ts: Column, tz: Column, day_start_hour: Column) -> Column:
    """The user's day an instant belongs to: days start at ``day_start_hour`` local time."""
    return F.to_date(
        F.from_utc_timestamp(ts, tz) - F.make_dt_interval(hours=day_start_hour)
    )


def day_start_us(date: Column, tz: Column, day_start_hour: Column) -> Column:
    """UTC micros at which the local day begins (23, 24 or 25 h before the next one)."""
    wall = F.make_timestamp(
        F.year(date), F.month(date), F.dayofmonth(date), day_start_hour, F.lit(0), F.lit(0)
    )
    return F.unix_micros(F.to_utc_timestamp(wall, tz))


def day_window(date: Column, tz: Column, day_start_hour: Column) -> tuple[Column, Column]:
    return (
        day_start_us(date, tz, day_start_hour),
        day_start_us(F.date_add(date, 1), tz, day_start_hour),
    )


def local_ts(us: Column, tz: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_micros(us), tz)


def weekday0(ts: Column) -> Column:
    """0 = Monday."""
    return F.weekday(ts)


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds(us: Column) -> Column:
    return us / F.lit(float(US))


def round_even(x: Column, digits: int = 0) -> Column:
    """Half-even rounding."""
    if digits == 0:
        return F.rint(x)
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


# Bucket labels and their upper bounds in minutes.
BUCKETS = [
    (15, "<15m"), (30, "15-30m"), (60, "30-60m"), (120, "1-2h"), (180, "2-3h"), (240, "3-4h"),
]
BUCKET_REST = "4h+"


def duration_bucket(minutes: Column) -> Column:
    out = F.lit(BUCKET_REST)
    for bound, label in reversed(BUCKETS):
        out = F.when(minutes < bound, label).otherwise(out)
    return out


def coverage_tier(ratio: Column) -> Column:
    return F.when(ratio < 0.6, "low").when(ratio >= 0.9, "good").otherwise("partial")


def signed_delta(delta: Column, digits: int) -> Column:
    """``+0.10`` / ``-21``: half-even rounding, sign always shown."""
    return F.format_string(f"%+.{digits}f", round_even(delta, digits))
