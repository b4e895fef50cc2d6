"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrace.sources.tables import checkpoint_dir, read

__all__ = ["Scratch", "grouped", "ranked", "read", "utf8_size"]

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run in the shared folder that ``spark.checkpoint.dir`` names.

    A table is written once and read again, so it outlives lost executors and cuts lineage.  The
    shuffle files of a write are freed as soon as it is complete.  ``drop`` deletes a table that no
    later step reads; what a returned DataFrame reads stays until its owner clears the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def free_shuffles(self, write: Callable[[], None]) -> None:
        """Runs a write whose shuffle files go once it is complete."""
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            write()
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        self.free_shuffles(lambda: df.write.parquet(path))
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            for out, path in self.paths.values():
                if out is df:
                    target = jvm.org.apache.hadoop.fs.Path(path)
                    target.getFileSystem(conf).delete(target, True)


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: Sequence[Column], scratch: Scratch, to: str) -> DataFrame:
    """Adds the row's place (from 0) in a total order without one task that sees all rows: range
    partitions, places inside each, and the number of rows in the partitions before it."""
    part, place = "_part", "_place"
    sorted_parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = scratch.put(
        sorted_parts.withColumn(part, F.spark_partition_id()).withColumn(
            place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    # one row per partition
    before = local.groupBy(part).agg(F.count("*").alias("_n"))
    before = before.select(
        F.col(part).alias("_p"),
        (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"),
    )
    return (
        local.join(before, F.col(part) == F.col("_p"))
        .withColumn(to, F.col(place) + F.col("_before"))
        .drop(part, place, "_p", "_before")
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows with equal integer keys of a stream that is sorted by them, one table per key."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table[k].to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        starts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            if a and held:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)
