"""Device batches and wire events derived from the sample telemetry, faults included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.config import US

BATCH = 100  # sequence numbers per batch


def batches(ev: DataFrame) -> DataFrame:
    """One row per (device, sequence block) with its declared range and arrival time."""
    return (
        ev.withColumn("batch_no", F.floor(F.col("seq") / BATCH).cast("long"))
        .groupBy("user_id", "device_id", "batch_no")
        .agg(F.count(F.lit(1)).alias("events"), (F.max("us") + 60 * US).alias("arrival"))
        .select(
            "*",
            F.concat_ws(":", "user_id", "device_id", "batch_no").alias("batch_id"),
            (F.col("batch_no") * BATCH).alias("seq_from"),
            (F.col("batch_no") * BATCH + BATCH - 1).alias("seq_to"),
        )
    )


def wire_events(ev: DataFrame) -> DataFrame:
    """JSON envelope per event.  Some values of ``k`` break one rule each; some batches have a
    reversed range or name another device."""
    k, n = F.col("k"), F.floor(F.col("seq") / BATCH).cast("long")
    device = F.concat_ws(":", "user_id", "device_id")
    many = F.map_from_entries(
        F.transform(
            F.sequence(F.lit(1), F.lit(21)),
            lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")), F.lit("v")),
        )
    )
    payload = (
        F.when(k == 77, many)
        .when(k == 88, F.create_map(F.lit("package"), F.repeat(F.lit("x"), F.lit(1001))))
        .when(k == 5, F.create_map(F.repeat(F.lit("y"), F.lit(101)), F.lit("v")))
        .when(F.col("key").isNotNull(), F.create_map(F.lit("package"), F.col("key")))
    )
    envelope = F.struct(
        F.when(k != 22, F.col("seq").cast("string")).alias("event_id"),
        F.when(k == 31, "other").otherwise(device).alias("device_id"),
        F.when(k == 91, -1).otherwise(F.col("seq")).alias("seq"),
        F.floor(F.col("us") / 1000).alias("ts_utc"),
        F.when(k == 27, 900).otherwise(0).alias("tz_offset_min"),
        F.when(k == 55, "").otherwise("UTC").alias("tz_id"),
        F.when(k == 93, F.array_repeat(F.lit("drift"), 11)).alias("clock_flags"),
        F.when(k == 64, -5).otherwise(F.floor(F.col("us") / 1000)).alias("uptime_ms"),
        F.when(k == 41, "BOGUS").otherwise(F.col("type")).alias("type"),
        F.when(k == 95, "").otherwise(F.col("platform")).alias("source"),
        payload.alias("payload"),
        F.when(k == 66, 0).otherwise(1).alias("schema_v"),
        F.when(k == 13, "surprise").alias("extra"),
    )
    return ev.select(
        "seq",
        "k",
        F.concat_ws(":", device, n).alias("batch_id"),
        F.when(n % 19 == 5, F.lit("elsewhere")).otherwise(device).alias("batch_device"),
        (n * BATCH).alias("seq_from"),
        F.when(n % 17 == 3, n * BATCH - 1).otherwise(n * BATCH + BATCH - 1).alias("seq_to"),
        F.to_json(envelope).alias("line"),
    )


def wire_batches(ev: DataFrame) -> DataFrame:
    """The wire events as devices send them: one row per batch, at most ``BATCH`` lines each."""
    return wire_events(ev).groupBy("batch_id", "batch_device", "seq_from", "seq_to").agg(
        F.max("seq").alias("arrival"), F.sort_array(F.collect_list("line")).alias("lines")
    )


def device_owners(ev: DataFrame) -> DataFrame:
    """Whose a device is, by the id it sends under."""
    return ev.select(F.concat_ws(":", "user_id", "device_id").alias("device_id"), "user_id").distinct()


def deliveries(ev: DataFrame) -> DataFrame:
    """Batches as delivered: every fourth arrives twice, an hour apart."""
    times = F.when(F.col("batch_no") % 4 == 1, 2).otherwise(1)
    return (
        batches(ev)
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), times)))
        .withColumn("arrival", F.col("arrival") + (F.col("attempt") - 1).cast("long") * (3600 * US))
    )


def ledger(ev: DataFrame) -> DataFrame:
    """Batches already processed before these deliveries."""
    return batches(ev).filter(F.col("batch_no") % 10 == 0).select("batch_id")


def resent_events(ev: DataFrame) -> DataFrame:
    """Events with their batch; every ninth is sent again in the device's next batch."""
    n = F.floor(F.col("seq") / BATCH).cast("long")
    sends = F.when(F.col("k") % 9 == 0, F.array(n, n + 1)).otherwise(F.array(n))
    return ev.select(
        "user_id", "device_id", "local_date", F.col("seq").alias("event_id"), "us",
        F.explode(sends).alias("no"),
    ).select(
        "event_id", "us", "user_id", "local_date",
        F.struct("user_id", "device_id", "no").alias("batch_no"),
        (F.col("no") * BATCH + BATCH - 1).alias("seq_to"),
        (F.col("us") + 60 * US).alias("arrival"),
    )
