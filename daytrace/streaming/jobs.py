"""Streaming jobs: idempotent ingest, and events that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from daytrace.config import US, Thresholds
from daytrace.operators import ingest as ing
from daytrace.sources.store import EventStore, MarkQueue
from daytrace.sources.tables import create_table
from daytrace.streaming.state import STORE

EVENT_TABLE = (
    "event_id string, device_id string, user_id bigint, batch_id string, us bigint, seq bigint, type string, "
    "key string, platform string, tz string, local_date date"
)
BATCH_TABLE = (
    "batch_id string, accepted boolean, events bigint, seq_to bigint, delivery string, batch_device string, "
    "user_id bigint, arrival bigint, seq_from bigint, new_events bigint, duplicates bigint, lb int"
)
ANSWER_TABLE = (
    "batch_id string, delivery string, is_replay boolean, accepted boolean, new_events bigint, duplicates bigint, "
    "next_expected_seq bigint, epoch bigint"
)
#: Parts of the ledger, by a hash of the batch's id.
LEDGER_BUCKETS = 64


def run(df: DataFrame, name: str, path: str) -> StreamingQuery:
    """Run a stream over everything available into the Parquet table ``path``/``name``, until it is done."""
    spark, key = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        query = (
            df.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/{name}")
            .option("checkpointLocation", f"{path}/{name}-checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return query


def drain(df: DataFrame, name: str, path: str) -> DataFrame:
    """What ``run`` has written."""
    run(df, name, path)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def ingest_stream(
    batches: DataFrame, base: str, devices: DataFrame, name: str = "ingest", day_start: int = 4
) -> StreamingQuery:
    """Take wire batches from a stream into ``base``/events and ``base``/batches.

    A row is a whole batch (batch_id, batch_device, seq_from, seq_to, arrival, lines), so a batch is
    judged as a whole wherever a micro-batch ends.  ``devices`` (device_id, user_id) says whose a device
    is; batches of unknown devices are rejected.  Batches accepted in the ledger ``base``/batches are
    replays and change nothing.  A rejected delivery leaves its batch_id free: the first valid delivery
    counts.  The ledger row is the receipt (new_events, duplicates, seq_to); every delivery is answered
    in ``base``/answers, a replay with the receipt stored for its batch.  The ledger is partitioned by
    a hash of the batch's id, and only the parts of a micro-batch's ids are read.

    User-days of new events are marked in the queue ``base``/dirty, by the event's own offset from UTC,
    days beginning at ``day_start``.  An event that several batches carry belongs to the one that arrived
    first.  Events are stored by day and user bucket (``store.EventStore``), and only the days that a
    micro-batch touches are read to drop those known.  Marks are written before events and events before
    the ledger, each only where not there yet, so a repeated micro-batch neither loses nor doubles rows.
    ``name`` identifies the stream's checkpoint.
    """
    spark = batches.sparkSession
    create_table(spark, f"{base}/batches", BATCH_TABLE, "lb")
    create_table(spark, f"{base}/answers", ANSWER_TABLE, "epoch")
    owners = devices.select(F.col("device_id").alias("batch_device"), "user_id")
    EventStore(spark, f"{base}/events", EVENT_TABLE)

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # else each frame kept below has as many partitions as a shuffle is dealt to, however small it is
        spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
        store = EventStore(spark, f"{base}/events", EVENT_TABLE)
        sent = batch.withColumns(
            {"delivery": F.sha2(F.to_json(F.struct("*")), 256), "lb": F.pmod(F.xxhash64("batch_id"), F.lit(LEDGER_BUCKETS)).cast("int")}
        ).dropDuplicates(["delivery"]).persist()
        parts = [r.lb for r in sent.select("lb").distinct().collect()]  # parts of the ledger, not batches
        ledger = spark.read.schema(BATCH_TABLE).parquet(f"{base}/batches").filter(F.col("lb").isin(parts))
        done = ledger.filter("accepted").select("batch_id")
        fresh = sent.join(done, "batch_id", "left_anti").join(owners, "batch_device", "left")
        fresh = fresh.withColumnRenamed("batch_id", "_batch").withColumn("line", F.explode("lines")).drop("lines")
        parsed = ing.parse_envelope(fresh.withColumn("batch_id", F.col("delivery"))).persist()
        heads = parsed.groupBy("delivery").agg(
            *[F.first(c).alias(c) for c in ("_batch", "batch_device", "arrival", "user_id", "lb")]
        )
        verdicts = ing.batch_verdicts(parsed).withColumnRenamed("batch_id", "delivery").join(heads, "delivery")
        verdicts = verdicts.withColumn("accepted", F.col("accepted") & F.col("user_id").isNotNull()).persist()
        valid = verdicts.filter("accepted").groupBy("_batch").agg(F.min(F.struct("arrival", "delivery")).alias("f"))
        first = verdicts.join(valid.select("f.delivery"), "delivery", "left_semi")
        good = parsed.join(first.select("delivery"), "delivery", "left_semi")
        e = F.col("e")
        event = F.struct(
            "arrival", F.col("_batch").alias("batch_id"), "user_id", e["device_id"], e["seq"], e["type"],
            F.coalesce(e["payload"]["package"], e["payload"]["domain"]).alias("key"), e["source"].alias("platform"),
            e["tz_id"].alias("tz"), e["tz_offset_min"],
        )
        rows = good.groupBy(e["event_id"].alias("event_id"), (e["ts_utc"] * 1000).alias("us")).agg(F.min(event).alias("v"))
        local_us = F.col("us") + F.col("v.tz_offset_min") * (60 * US) - day_start * 3600 * US
        rows = rows.select(
            "event_id", "us", *[F.col(f"v.{c}").alias(c) for c in ("device_id", "user_id", "batch_id", "seq", "type", "key", "platform", "tz")],
            F.to_date(F.timestamp_micros(local_us)).alias("local_date"),
        ).persist()
        day = F.to_date(F.timestamp_micros("us"))
        days = [r.day for r in rows.select(day.alias("day")).distinct().collect()]  # days, not events
        stored = store.all().filter(F.col("day").isin(days))
        new = rows.join(stored.select("event_id", "us"), ["event_id", "us"], "left_anti")
        # marks come before events, so none is missing where a micro-batch stops between the two
        MarkQueue(spark, f"{base}/dirty").mark(new)
        store.append(new)
        stored = store.all().filter(F.col("day").isin(days))
        own = rows.select("event_id", "us", "batch_id").join(stored, ["event_id", "us", "batch_id"], "left_semi")
        own = own.groupBy(F.col("batch_id").alias("_batch")).agg(F.count("*").alias("new_events"))
        told = ledger.filter(~F.col("accepted")).select("delivery")
        refused = verdicts.filter(~F.col("accepted")).join(told, "delivery", "left_anti")
        receipts = first.unionByName(refused).join(own, "_batch", "left").withColumn(
            "new_events", F.when(F.col("accepted"), F.coalesce("new_events", F.lit(0)))
        )
        receipts.select(
            F.col("_batch").alias("batch_id"), "accepted", "events", "seq_to", "delivery", "batch_device", "user_id", "arrival",
            "seq_from", "new_events", (F.col("events") - F.col("new_events")).alias("duplicates"), "lb",
        ).hint("rebalance", "lb").write.mode("append").partitionBy("lb").parquet(f"{base}/batches")
        ledger = spark.read.schema(BATCH_TABLE).parquet(f"{base}/batches").filter(F.col("lb").isin(parts))
        ing.delivery_answers(sent, ledger).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("epoch").parquet(f"{base}/answers")
        for frame in (verdicts, rows, parsed, sent):
            frame.unpersist()

    return (
        batches.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{base}/checkpoint-{name}")
        .trigger(availableNow=True)
        .start()
    )


def accepted_batches(spark: SparkSession, base: str) -> DataFrame:
    """The accepted batches of the ledger, for ``ingest.device_cursor`` and ``ingest.seq_gaps``."""
    ledger = spark.read.schema(BATCH_TABLE).parquet(f"{base}/batches").filter("accepted")
    return ledger.select(
        "user_id", F.col("batch_device").alias("device_id"), F.col("batch_id").alias("batch_no"),
        "arrival", "seq_from", "seq_to",
    )


def cursors(spark: SparkSession, base: str) -> DataFrame:
    return ing.device_cursor(accepted_batches(spark, base))


def gaps(spark: SparkSession, base: str, th: Thresholds) -> DataFrame:
    return ing.seq_gaps(accepted_batches(spark, base), th)


def ingested(spark: SparkSession, base: str) -> tuple[EventStore, MarkQueue]:
    """The events and the marks of a folder that ``ingest_stream`` fills, for ``store.recompute``."""
    return EventStore(spark, f"{base}/events", EVENT_TABLE), MarkQueue(spark, f"{base}/dirty")


def split_late(events: DataFrame, base: str, delay_s: int) -> StreamingQuery:
    """Take events (with us, user_id, local_date) from a stream into ``base``/on_time or ``base``/late.

    An event is late if it is no newer than the newest one of earlier micro-batches less ``delay_s``:
    then a watermark of that delay, at the pace of these micro-batches or slower, would drop it.  The
    days of late events are marked in the queue ``base``/dirty.  Each micro-batch owns a part of every table and
    replaces it when it is repeated, so no event is lost or doubled.
    """
    spark = events.sparkSession
    tables = {"on_time": events.schema.simpleString()[7:-1], "newest": "us bigint"}
    tables["late"] = tables["on_time"]
    for name, schema in tables.items():
        create_table(spark, f"{base}/{name}", f"{schema.replace(':', ' ')}, epoch bigint", "epoch")

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = spark.read.schema("us bigint, epoch bigint").parquet(f"{base}/newest").filter(F.col("epoch") < epoch)
        line = newest.agg(F.max("us")).first()[0]
        is_late = F.lit(False) if line is None else F.col("us") <= line - delay_s * US
        batch = batch.withColumn("epoch", F.lit(epoch).cast("long")).persist()
        late = batch.filter(is_late)
        MarkQueue(spark, f"{base}/dirty").mark(late)
        for name, rows in (
            ("late", late),
            ("on_time", batch.filter(~is_late)),
            ("newest", batch.groupBy("epoch").agg(F.max("us").alias("us"))),
        ):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{base}/{name}")
        batch.unpersist()

    return (
        events.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{base}/checkpoint-split")
        .trigger(availableNow=True)
        .start()
    )
