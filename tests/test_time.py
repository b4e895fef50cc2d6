import datetime as dt

import pytest
from pyspark.sql import functions as F

from daytrace.functions import timecols as tc


@pytest.mark.parametrize("date, hours", [("2024-03-09", 23), ("2024-11-02", 25), ("2024-06-01", 24)])
def test_day_length_across_clock_changes(spark, date, hours):
    df = spark.createDataFrame([(dt.date.fromisoformat(date),)], "d date")
    a, b = tc.day_window(F.col("d"), F.lit("America/New_York"), F.lit(4))
    assert df.select(((b - a) / 3.6e9).alias("h")).first().h == hours


def test_local_date_before_day_start(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 08:59:59' AS t")
    d = tc.local_date(F.col("t"), F.lit("America/New_York"), F.lit(4))
    assert df.select(d.alias("d")).first().d == dt.date(2024, 1, 1)


@pytest.mark.parametrize("m, want", [(14.9, "<15m"), (15, "15-30m"), (60, "1-2h"), (240, "4h+")])
def test_buckets(spark, m, want):
    assert spark.range(1).select(tc.duration_bucket(F.lit(m)).alias("b")).first().b == want


def test_signed_delta(spark):
    r = spark.range(1).select(
        tc.signed_delta(F.lit(0.1), 2).alias("a"), tc.signed_delta(F.lit(-20.5), 0).alias("b")
    ).first()
    assert (r.a, r.b) == ("+0.10", "-20")
