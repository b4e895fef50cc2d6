"""Streams whose events come in several files, out of order and late."""

import datetime as dt
import json
import uuid
from collections import Counter

from daytrace.config import US, Thresholds
from daytrace.operators import attribution as at
from daytrace.operators import sessions as se
from daytrace.plans.stream_queries import WAKE, sessions_of_stream
from daytrace.sources import telemetry as tm
from daytrace.sources import store as store_mod
from daytrace.sources.tables import checkpoint_dir
from daytrace.streaming import jobs, state
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_sessions_of_late_and_disordered_events(spark):
    ev = tm.view(spark.read.parquet(f"{SF}/events.parquet")).filter("platform = 'android'")
    base = f"{checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    # files by time, a third of the rows in a later one, some in the last
    day = F.datediff("local_date", F.lit("2024-01-01").cast("date"))
    place = F.when(F.col("seq") % 29 == 0, 3).otherwise(F.floor(day / 10) + (F.col("seq") % 3 == 0).cast("int"))
    rows = ev.withColumn("place", F.greatest(F.lit(0), F.least(place, F.lit(3)))).persist()
    for k in range(4):
        rows.filter(F.col("place") == k).drop("place").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    got = sessions_of_stream(stream, f"{base}/run")
    want = se.app_sessions(ev, tm.SAMPLE).select(*got.columns)
    assert spark.read.parquet(f"{base}/run/late").count() > 0
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))
    on_time = spark.read.parquet(f"{base}/run/on_time").count()
    assert on_time + spark.read.parquet(f"{base}/run/late").count() == ev.count()


def test_attribution_of_disordered_files_and_its_state(spark):
    """Files by time with rows of one file in the next give the batch operator's rows; what is left of the
    state are devices with a domain in focus and the row far ahead."""
    ev = tm.view(spark.read.parquet(f"{SF}/events.parquet")).filter("platform = 'browser'")
    sig = at.signals(ev)
    base = f"{checkpoint_dir(spark)}/signals-{uuid.uuid4().hex}"
    day = F.floor(F.col("us") / (5 * 86_400 * US))
    first = sig.agg(F.min(day)).first()[0]
    place = F.least(F.lit(5), day - first + (F.col("seq") % 3 == 0).cast("int"))
    rows = sig.withColumn("place", place).persist()
    for k in sorted(r.place for r in rows.select("place").distinct().collect()):
        rows.filter(F.col("place") == k).drop("place").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(sig.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    last = rows.drop("place").limit(1).withColumns(
        {"user_id": F.lit(-1).cast("long"), "us": F.lit(4102488000 * US).cast("long"), "kind": F.lit("heartbeat")}
    )
    last.coalesce(1).write.mode("append").parquet(f"{base}/in")
    late = stream.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "7 days")
    query = jobs.run(state.stream_attribution(late, WAKE), "out", base)
    got = spark.read.parquet(f"{base}/out")
    want = at.attribute(sig, tm.SAMPLE, WAKE).select(*got.columns)
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))
    on = got.groupBy("user_id", "device_id").agg(
        F.sum(F.when(F.col("type") == "DOMAIN_FOCUS_START", 1).otherwise(-1)).alias("open")
    ).filter("open > 0").count()
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= on + 2


def _line(seq, ms=1_704_088_800_000, **more):
    return json.dumps({
        "event_id": str(seq), "device_id": "1:0", "seq": seq, "ts_utc": ms + seq * 1000, "tz_offset_min": 0, "tz_id": "UTC",
        "clock_flags": None, "uptime_ms": 1, "type": "SCREEN_ON", "source": "android", "payload": {}, "schema_v": 1, **more,
    })


def test_a_rejected_batch_sent_again_is_taken_and_leaves_its_receipt(spark):
    base = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = "batch_id string, batch_device string, seq_from long, seq_to long, arrival long, lines array<string>"
    files = [
        [("a", "1:0", 1, 2, 10, [_line(1), "{broken"]), ("b", "1:0", 5, 6, 11, [_line(5), _line(6)])],
        [("a", "1:0", 1, 2, 12, [_line(1), _line(2)]), ("c", "1:0", 7, 7, 13, ["no"]), ("c", "1:0", 7, 8, 14, [_line(6), _line(8)])],
        [("a", "1:0", 1, 2, 15, [_line(1), _line(3)])],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    devices = spark.createDataFrame([("1:0", 1)], "device_id string, user_id long")
    jobs.ingest_stream(stream, base, devices).awaitTermination()
    store, queue = jobs.ingested(spark, base)
    events = store.all().collect()
    assert sorted((r.event_id, r.batch_id) for r in events) == [("1", "a"), ("2", "a"), ("5", "b"), ("6", "b"), ("8", "c")]
    ledger = spark.read.schema(jobs.BATCH_TABLE).parquet(f"{base}/batches").filter("accepted").collect()
    assert sorted((r.batch_id, r.new_events, r.duplicates, r.seq_to) for r in ledger) == [("a", 2, 0, 2), ("b", 2, 0, 6), ("c", 1, 1, 8)]
    assert {(r.user_id, r.local_date, r.platform, r.tz) for r in events} == {(1, dt.date(2024, 1, 1), "android", "UTC")}
    assert [tuple(r) for r in queue.take().frame.collect()] == [(1, dt.date(2024, 1, 1))]
    # a replay is told what the batch's first valid delivery was told
    told = spark.read.parquet(f"{base}/answers").collect()
    assert sorted((r.epoch, r.batch_id, r.is_replay, r.accepted, r.new_events, r.duplicates, r.next_expected_seq) for r in told if r.accepted) == [
        (0, "b", False, True, 2, 0, 7), (1, "a", False, True, 2, 0, 3), (1, "c", False, True, 1, 1, 9), (1, "c", True, True, 1, 1, 9),
        (2, "a", True, True, 2, 0, 3),
    ]
    assert [(r.batch_id, r.new_events) for r in told if not r.accepted] == [("a", None)]
    assert [(r.last_seq, r.next_expected_seq) for r in jobs.cursors(spark, base).collect()] == [(8, 9)]
    assert [(r.batch_no, r.expected_seq) for r in jobs.gaps(spark, base, Thresholds()).collect()] == [("b", 1)]


def test_unknown_devices_are_rejected_and_marks_drive_the_recompute(spark):
    base = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = "batch_id string, batch_device string, seq_from long, seq_to long, arrival long, lines array<string>"
    devices = spark.createDataFrame([("1:0", 7)], "device_id string, user_id long")
    fields = "user_id bigint, n bigint, local_date date"
    counts = store_mod.DerivedTable(spark, f"{base}/counts", fields)
    built = []

    def build(ev):
        out = ev.groupBy("user_id", "local_date").agg(F.count("*").alias("n")).select("user_id", "n", "local_date")
        built.append(out.count())
        return out

    def send(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.ingest_stream(stream, base, devices).awaitTermination()
        events, queue = jobs.ingested(spark, base)
        changed = store_mod.recompute(events.of, queue, build, counts)
        again = store_mod.recompute(events.of, queue, build, counts)
        assert not again and len(built) == k
        return changed, sorted((r.user_id, r.local_date.day, r.n) for r in counts.read().collect())

    next_day = 1_704_088_800_000 + 86_400_000
    assert send(1, [("a", "1:0", 1, 2, 10, [_line(1), _line(2)]), ("x", "9:9", 1, 1, 10, [_line(1, device_id="9:9")])]) == (True, [(7, 1, 2)])
    assert send(2, [("b", "1:0", 3, 4, 11, [_line(2), _line(3, next_day)])]) == (True, [(7, 1, 2), (7, 2, 1)])
    # a replay brings no new event: the marks are empty, nothing is built
    assert send(2, [("b", "1:0", 3, 4, 12, [_line(2), _line(3, next_day)])])[1] == [(7, 1, 2), (7, 2, 1)]


def test_a_micro_batch_writes_one_ledger_file_per_part(spark):
    base = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = "batch_id string, batch_device string, seq_from long, seq_to long, arrival long, lines array<string>"
    sent = [(f"b{i}", "1:0", i, i, i, [_line(i)]) for i in range(1, 301)]
    spark.createDataFrame(sent, schema).write.parquet(f"{base}/in")
    devices = spark.createDataFrame([("1:0", 7)], "device_id string, user_id long")
    jobs.ingest_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), base, devices).awaitTermination()
    ledger = spark.read.parquet(f"{base}/batches").filter("accepted")
    files = ledger.select("lb", F.input_file_name().alias("file")).distinct().groupBy("lb").count()
    assert ledger.count() == 300
    assert {r["count"] for r in files.collect()} == {1}


def test_rows_of_a_frame_have_no_missing_markers():
    import pandas as pd

    frame = pd.DataFrame({"us": [1, 2], "key": ["a", None], "seq": [3.0, float("nan")], "focused": [True, None]})
    assert state._tuples(frame, ["us", "key", "seq", "focused"]) == [(1, "a", 3.0, True), (2, None, None, None)]
