import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE = 1_704_088_800  # 2024-01-01 06:00 UTC, inside the day that starts at 04:00


def _events(spark, rows, device=0, user=1):
    """Events of one device-day: (second, type, key) in order."""
    import datetime as dt

    data = [
        (user, device, dt.date(2024, 1, 1), "android", None, i, int((BASE + s) * 1_000_000), t, k, "UTC", 4)
        for i, (s, t, k) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "user_id long, device_id int, local_date date, platform string, browser_family string, seq long, "
        "us long, type string, key string, tz string, day_start_hour int",
    )


@pytest.fixture
def events(spark):
    return lambda rows, **kw: _events(spark, rows, **kw)


def rel(us):
    """Seconds after the base instant."""
    return us / 1_000_000 - BASE
