"""Ingest of device batches: checks, replays, duplicates, gaps, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace import catalog
from daytrace.config import US, Thresholds
from daytrace.operators.scan import CHUNK, chunked, scan

ENVELOPE = """
 event_id string, device_id string, seq bigint, ts_utc bigint, tz_offset_min int, tz_id string,
 clock_flags array<string>, uptime_ms bigint, type string, source string,
 payload map<string,string>, schema_v int
"""


def parse_envelope(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``e`` (the parsed envelope) and ``reasons`` (broken rules; empty when valid)."""
    df = df.withColumns(
        {"e": F.from_json(line, ENVELOPE), "_keys": F.json_object_keys(line)}
    )
    lo, hi = catalog.TZ_OFFSET_RANGE
    entries = F.map_entries("e.payload")

    def text(col: str, longest: int) -> Column:
        return ~F.length(col).between(1, longest)

    # Bounds of the envelope.
    checks: list[tuple[str, Column]] = [
        ("bad_json", F.col("_keys").isNull()),
        (
            "unknown_field",
            F.size(F.array_except("_keys", F.lit(catalog.ENVELOPE_FIELDS))) > 0,
        ),
        *[(f"required:{f}", F.col(f"e.{f}").isNull()) for f in catalog.ENVELOPE_REQUIRED],
        ("type", ~F.col("e.type").isin(catalog.EVENT_TYPES)),
        ("tz_offset", ~F.col("e.tz_offset_min").between(lo, hi)),
        ("seq", F.col("e.seq") < 0),
        ("uptime", F.col("e.uptime_ms") < 0),
        ("tz_id", text("e.tz_id", 64)),
        ("source", text("e.source", 20)),
        ("schema_v", ~F.col("e.schema_v").between(1, 100)),
        ("clock_flags", F.size("e.clock_flags") > 10),
        ("payload_size", F.size(entries) > 20),
        ("payload_key", F.exists(entries, lambda x: F.length(x["key"]) > 100)),
        ("payload_value", F.exists(entries, lambda x: F.length(x["value"]) > 1000)),
    ]
    reasons = F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks])
    )
    return df.withColumn("reasons", reasons).drop("_keys")


def batch_verdicts(parsed: DataFrame) -> DataFrame:
    """One row per batch: accepted only if every event and the header are valid.

    Needs batch_id, batch_device, seq_from, seq_to besides ``parse_envelope`` columns; counts
    are summed map-side, so an oversized batch never meets in one task.
    """
    wrong_device = ~F.col("e.device_id").eqNullSafe(F.col("batch_device"))
    df = parsed.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.size("reasons") > 0).alias("invalid"),
        F.count_if(wrong_device).alias("mismatched"),
        F.min("seq_from").alias("seq_from"),
        F.max("seq_to").alias("seq_to"),
    )
    ok = (
        (F.col("invalid") == 0)
        & (F.col("mismatched") == 0)
        & (F.col("seq_from") >= 0)
        & (F.col("seq_to") >= F.col("seq_from"))
        & F.col("events").between(1, catalog.MAX_BATCH)
    )
    return df.withColumn("accepted", ok)


def first_deliveries(deliveries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mark each delivery as replay or first; batches in the ledger only ever replay.  Of deliveries
    that arrive together, the one of the lowest attempt is the first."""
    first = deliveries.groupBy("batch_id").agg(F.min(F.struct("arrival", "attempt")).alias("first"))
    known = ledger.select("batch_id", F.lit(True).alias("known"))
    return (
        deliveries.join(first, "batch_id")
        .join(known, "batch_id", "left")
        .withColumn(
            "is_replay",
            F.coalesce("known", F.lit(False)) | (F.struct("arrival", "attempt") > F.col("first")),
        )
        .drop("known", "first")
    )


def dedupe_events(events: DataFrame) -> DataFrame:
    """First delivery of every (event_id, us); needs ``batch_no`` as delivery order."""
    return events.groupBy("event_id", "us").agg(
        F.min("batch_no").alias("batch_no"), F.count(F.lit(1)).alias("copies")
    )


def receipts(events: DataFrame) -> DataFrame:
    """Per batch: accepted and duplicate events, and the next sequence the device may send."""
    new = dedupe_events(events).groupBy("batch_no").agg(F.count(F.lit(1)).alias("accepted"))
    sent = events.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("sent"), F.max("seq_to").alias("server_seq")
    )
    return (
        sent.join(new, "batch_no", "left")
        .fillna(0, ["accepted"])
        .select(
            "batch_no",
            "accepted",
            (F.col("sent") - F.col("accepted")).alias("duplicates"),
            "server_seq",
            (F.col("server_seq") + 1).alias("next_expected_seq"),
        )
    )


def delivery_answers(deliveries: DataFrame, ledger: DataFrame) -> DataFrame:
    """What each delivery (batch_id, delivery) is told.  The ledger has one accepted row per stored batch, its
    receipt, with the ``delivery`` that counted: that delivery and every replay of the batch get this
    receipt.  Other deliveries are told their own rejection."""
    stored = ledger.filter("accepted").select(
        "batch_id", F.col("delivery").alias("_first"), F.lit(True).alias("accepted"), "new_events", "duplicates",
        (F.col("seq_to") + 1).alias("next_expected_seq"),
    )
    return (
        deliveries.select("batch_id", "delivery")
        .join(stored, "batch_id", "left")
        .select(
            "batch_id", "delivery", F.coalesce(F.col("delivery") != F.col("_first"), F.lit(False)).alias("is_replay"),
            F.coalesce("accepted", F.lit(False)).alias("accepted"), "new_events", "duplicates", "next_expected_seq",
        )
    )


def replay_receipts(deliveries: DataFrame, ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """Deliveries marked as by ``first_deliveries``, each with the receipt ``stored`` (batch_id, accepted,
    duplicates, next_expected_seq) for its batch: a replay is told what the first delivery was told."""
    return first_deliveries(deliveries, ledger).join(
        stored.select("batch_id", "accepted", "duplicates", "next_expected_seq"), "batch_id", "left"
    )


def event_uuid(device: Column, package: Column, ms: Column, type_: Column) -> Column:
    """Name-based (MD5) UUID of ``device|package|ms|type``."""
    h = F.md5(F.concat_ws("|", device.cast("string"), package, ms.cast("string"), type_).cast("binary"))
    # version nibble 3; the variant nibble keeps its two low bits under binary 10
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("3"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def seq_gaps(batches: DataFrame, th: Thresholds) -> DataFrame:
    """Gaps in a device's batch sequence; batches are taken in order of ``arrival``."""
    keys = ["user_id", "device_id"]
    df = chunked(batches, keys, "arrival", th.chunk_s * US)
    df = scan(df, keys, ["arrival", "batch_no"], seen=("max_before", F.col("seq_to")))
    df = df.drop(CHUNK).withColumn("last_seq", F.greatest(F.coalesce("seen", F.lit(0)), F.lit(0)))
    return df.filter(F.col("seq_from") > F.col("last_seq") + 1).select(
        *keys,
        "batch_no",
        (F.col("last_seq") + 1).alias("expected_seq"),
        F.col("seq_from").alias("received_seq_from"),
    )


def device_cursor(batches: DataFrame) -> DataFrame:
    return batches.groupBy("user_id", "device_id").agg(
        F.max("seq_to").alias("last_seq"),
        (F.max("seq_to") + 1).alias("next_expected_seq"),
        F.max("arrival").alias("last_seen_us"),
    )


def dirty_days(events: DataFrame) -> DataFrame:
    """User-days touched by ingest with the newest mark."""
    return events.groupBy("user_id", "local_date").agg(F.max("arrival").alias("marked_us"))


def map_types(raw: DataFrame, codes: DataFrame) -> DataFrame:
    """Source codes to registry types; codes without a type are dropped."""
    return raw.join(codes, "code")


def shape_payload(type_: Column, package: Column) -> Column:
    """Only app and interaction events carry their package."""
    empty = F.create_map().cast("map<string,string>")
    keep = type_.isin("APP_FOREGROUND", "APP_BACKGROUND", "USER_INTERACTION")
    return F.when(keep & package.isNotNull(), F.create_map(F.lit("package"), package)).otherwise(empty)


def local_prunable(synced: Column, synced_us: Column, as_of_us: int, keep_days: int = 7) -> Column:
    """Synced rows past local retention; unsynced rows never qualify."""
    return synced & (synced_us < as_of_us - keep_days * 86400 * US)


def queue_counts(queue: DataFrame) -> DataFrame:
    """Sync backlog per device: events, unsynced, eligible, and batches by status."""
    return queue.groupBy("user_id", "device_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~F.col("synced")).alias("unsynced"),
        F.count_if(~F.col("synced") & F.col("batch_no").isNull()).alias("eligible"),
        F.count_distinct(F.when(F.col("batch_status") == "pending", F.col("batch_no"))).alias(
            "batches_pending"
        ),
        F.count_distinct(F.when(F.col("batch_status") == "quarantined", F.col("batch_no"))).alias(
            "batches_quarantined"
        ),
    )


def clock_suspect(events: DataFrame, th: Thresholds, width: int = 1_000_000) -> DataFrame:
    """Events whose wall clock moved differently from uptime since the device's last event."""
    keys = ["user_id", "device_id"]
    df = chunked(events, keys, "seq", width)
    df = scan(df, keys, ["seq"], p=("before", F.struct("us", "uptime_ms")))
    wall = (F.col("us") - F.col("p.us")) / 1e6
    up = (F.col("uptime_ms") - F.col("p.uptime_ms")) / 1e3
    return df.drop(CHUNK).withColumn(
        "clock_suspect", F.coalesce(F.abs(wall - up) > th.clock_drift_s, F.lit(False))
    ).drop("p")
