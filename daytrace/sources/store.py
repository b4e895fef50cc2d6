"""Event tables partitioned by day and user bucket, marks of changed days, and derived tables that
follow them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.config import USER_DAY
from daytrace.sources.tables import create_table, stage

#: Parts of a day's users.  A recompute reads and rewrites only the parts its users are in.
BUCKETS = 8
#: Local days reach from 14 hours ahead of UTC to 12 hours behind, and begin some hours after midnight:
#: their events have a UTC date at most one day off.
SLACK = dt.timedelta(days=1)


def bucket_of(user: str = "user_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The finished data files of an unpartitioned table."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    names = [s.getPath() for s in fs.listStatus(target) if s.isFile()]
    return sorted(str(p.toString()) for p in names if not p.getName().startswith(("_", ".")))


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def partition_values(spark: SparkSession, path: str) -> dict[str, str]:
    """Folders of a table's first partition column, by value.  A listing, no data is read."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return {}
    found = [s.getPath() for s in fs.listStatus(target) if s.isDirectory() and "=" in s.getPath().getName()]
    return {str(p.getName()).split("=", 1)[1]: str(p.toString()) for p in found}


def _overwrite(df: DataFrame, path: str, *partition: str) -> None:
    (
        df.hint("rebalance", *partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )


def retire(spark: SparkSession, path: str, partition: str, oldest: dt.date, needed: Column | None = None) -> list[str]:
    """Drop the day partitions before ``oldest``; younger ones are not touched.  Rows that are ``needed``
    (such as those not synced yet) outlive their day: a partition with such rows is rewritten to
    hold them only.  Returns the days that are gone."""
    old = {d: p for d, p in partition_values(spark, path).items() if d < oldest.isoformat()}
    held: set[tuple[str, ...]] = set()
    inner: list[str] = []
    if needed is not None and old:
        frame = spark.read.parquet(path)
        inner = [c for c in ("bucket",) if c in frame.columns]
        rest = stage(frame.where((F.col(partition) < F.lit(oldest)) & F.coalesce(needed, F.lit(True))))
        # the rows kept take their partitions' place in one commit; only then are others dropped
        _overwrite(rest, path, partition, *inner)
        held = {tuple(str(v) for v in r) for r in rest.select(partition, *inner).distinct().collect()}
    days = {h[0] for h in held}
    for day, folder in old.items():
        if day not in days:
            delete(spark, folder)
        elif inner:
            for value, sub in partition_values(spark, folder).items():
                if (day, value) not in held:
                    delete(spark, sub)
    return sorted(set(old) - days)


class EventStore:
    """Raw events in Parquet, partitioned by the UTC day of the event and a bucket of its user.

    ``schema`` needs user_id, local_date and us.  Reads of local days list and open only the partitions
    these days can lie in.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = f"{schema}, day date, bucket int"
        create_table(spark, path, self.schema, "day", "bucket")

    def placed(self, events: DataFrame) -> DataFrame:
        return events.withColumns(
            {"day": F.to_date(F.timestamp_micros("us")), "bucket": bucket_of("user_id", self.buckets)}
        )

    def append(self, events: DataFrame) -> None:
        rows = self.placed(events).hint("rebalance", "day", "bucket")
        rows.write.mode("append").partitionBy("day", "bucket").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self, days: tuple[dt.date, dt.date]) -> DataFrame:
        """Events of the local days from the first to the last, both included."""
        first, last = days
        stored = F.col("day").between(F.lit(first - SLACK), F.lit(last + SLACK))
        return self.all().where(stored & F.col("local_date").between(F.lit(first), F.lit(last))).drop("day", "bucket")

    def of(self, marks: DataFrame) -> DataFrame:
        """Events of the marked user-days, from the partitions of those days and users alone."""
        places = marks.select("local_date", bucket_of("user_id", self.buckets).alias("b")).distinct().collect()
        days = sorted({r.local_date + k * SLACK for r in places for k in (-1, 0, 1)})  # days and buckets, not rows
        stored = F.col("day").isin(days) & F.col("bucket").isin(sorted({r.b for r in places}))
        return self.all().where(stored).join(marks.select(*USER_DAY), USER_DAY, "left_semi").drop("day", "bucket")


@dataclass(frozen=True)
class Marks:
    """Marks taken from a queue: the user-days, and the files that held them."""

    frame: DataFrame
    files: tuple[str, ...]


class MarkQueue:
    """User-days to recompute.  ``clear`` takes away exactly the files that ``take`` has seen, so a
    mark that comes during a recompute stays, even one for the same day."""

    SCHEMA = "user_id bigint, local_date date"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def mark(self, days: DataFrame) -> None:
        days.select(*USER_DAY).where("local_date is not null").distinct().write.mode("append").parquet(self.path)

    def take(self) -> Marks:
        files = tuple(data_files(self.spark, self.path))
        if not files:
            return Marks(self.spark.createDataFrame([], self.SCHEMA), ())
        frame = self.spark.read.schema(self.SCHEMA).parquet(*files).distinct()
        # empty files (a write without rows leaves one) are taken along and cleared
        return Marks(stage(frame), files)

    def clear(self, marks: Marks) -> None:
        for file in marks.files:
            delete(self.spark, file)


class DerivedTable:
    """A table of user-days in Parquet, partitioned by local_date and user bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = f"{schema}, bucket int"
        create_table(spark, path, self.schema, "local_date", "bucket")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("bucket")

    def replace(self, days: DataFrame, rows: DataFrame) -> None:
        """Put ``rows`` in the place of all rows of the user-days ``days``.  Only partitions of these days
        and their users' buckets are read and rewritten; one that ends up empty is dropped."""
        bucket = bucket_of("user_id", self.buckets)
        marked = days.select(*USER_DAY, bucket.alias("bucket")).distinct()
        touched = {(r.local_date, r.bucket) for r in marked.select("local_date", "bucket").distinct().collect()}
        stored = self.spark.read.schema(self.schema).parquet(self.path).where(
            F.col("local_date").isin(sorted({d for d, _ in touched})) & F.col("bucket").isin(sorted({b for _, b in touched}))
        )
        places = marked.select("local_date", "bucket").distinct()
        kept = stored.join(places, ["local_date", "bucket"], "left_semi").join(marked.select(*USER_DAY), USER_DAY, "left_anti")
        new = stage(kept.unionByName(rows.withColumn("bucket", bucket)))
        _overwrite(new, self.path, "local_date", "bucket")
        written = {(r.local_date, r.bucket) for r in new.select("local_date", "bucket").distinct().collect()}
        for day, b in touched - written:
            delete(self.spark, f"{self.path}/local_date={day.isoformat()}/bucket={b}")


def recompute(
    events: Callable[[DataFrame], DataFrame], queue: MarkQueue, build: Callable[[DataFrame], DataFrame], table: DerivedTable
) -> bool:
    """Rebuild the marked user-days of a derived table from their events (``events`` gives those of a
    frame of user-days), then clear the marks taken.  Without marks nothing is read and False comes back.
    A run that dies midway leaves its marks, and the next one repeats its days."""
    marks = queue.take()
    if not marks.files:
        return False
    if not marks.frame.isEmpty():
        table.replace(marks.frame, build(events(marks.frame)))
    queue.clear(marks)
    return True
