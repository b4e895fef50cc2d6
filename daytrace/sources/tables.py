"""Reading and writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.  The cluster names it in ``spark.checkpoint.dir``; where that is
    unset (tests), it lies beside the warehouse, which a cluster shares too."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    sc.setCheckpointDir(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read to the shared folder and read it back: it
    is computed once, survives the loss of executors, and is read column by column."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def create_table(spark: SparkSession, path: str, schema: str, *partition: str) -> None:
    """Make sure an (empty) partitioned table exists."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partition).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace whole partitions of a table; the others stay as they are.  Repeating the write
    gives the same table.  Rows are rebalanced by partition, which splits a partition that
    holds much of the data over several writers."""
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def overwrite_days(df: DataFrame, path: str) -> None:
    """Replace whole days of a derived table."""
    overwrite_partitions(df, path, "local_date")
