"""Attribution, and streaming jobs run to the end of the available data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from daytrace.config import US, USER_DAY
from daytrace.functions import timecols as tc
from daytrace.operators import attribution as at
from daytrace.operators import metrics as me
from daytrace.operators import sessions as se
from daytrace.plans.day import DayPlan
from daytrace.plans.oracle import part
from daytrace.plans.registry import query
from daytrace.sources import telemetry as tm
from daytrace.sources import wire
from daytrace.sources.store import DerivedTable, EventStore, MarkQueue, recompute
from daytrace.sources.tables import checkpoint_dir
from daytrace.streaming import jobs, state

DAY = "CAST(local_date AS VARCHAR) AS local_date"
WAKE = tm.SAMPLE.wake_bound_s * US


def _attribution_parts(prefix: str, bound: str) -> None:
    part(f"{prefix}_g", f"""
SELECT *, sum(CASE WHEN us - prev > {bound} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, device_id ORDER BY us, seq) AS g FROM (
 SELECT *, lag(us) OVER (PARTITION BY user_id, device_id ORDER BY us, seq) AS prev FROM ev WHERE platform = 'browser')""")
    part(f"{prefix}_s", f"""
SELECT *, last_value(CASE WHEN event_type = 'view' THEN key END IGNORE NULLS) OVER w AS d,
 coalesce(last_value(CASE WHEN event_type = 'click' THEN k < 70 END IGNORE NULLS) OVER w, false) AS f,
 coalesce(last_value(CASE WHEN event_type = 'signup' THEN k < 80 END IGNORE NULLS) OVER w, true) AS a
FROM {prefix}_g WINDOW w AS (PARTITION BY user_id, device_id, g ORDER BY us, seq ROWS UNBOUNDED PRECEDING)""")
    part(f"{prefix}_t", f"""
SELECT *, d IS NOT NULL AND f AND a AS att, lag(d) OVER w AS pd, coalesce(lag(d IS NOT NULL AND f AND a) OVER w, false) AS patt,
 lead(us) OVER w IS NULL AND lead(us) OVER (PARTITION BY user_id, device_id ORDER BY us, seq) IS NOT NULL AS cut
FROM {prefix}_s WINDOW w AS (PARTITION BY user_id, device_id, g ORDER BY us, seq)""")
    part(prefix, f"""
SELECT user_id, device_id, us, 'DOMAIN_FOCUS_END' AS type, pd AS domain FROM {prefix}_t WHERE patt AND (NOT att OR pd <> d)
UNION ALL SELECT user_id, device_id, us, 'DOMAIN_FOCUS_START', d FROM {prefix}_t WHERE att AND (NOT patt OR pd <> d)
UNION ALL SELECT user_id, device_id, us, 'DOMAIN_FOCUS_END', d FROM {prefix}_t WHERE att AND cut""")


_attribution_parts("attr_all", "9000000000000000")
_attribution_parts("attr_wake", str(WAKE))
query("s1_domain_attribution", "SELECT user_id, device_id, us, type, domain FROM attr_all")(
    lambda c: at.attribute(at.signals(c.plan.browser_events), c.plan.th)
)
query("s2_wake_reconcile", "SELECT user_id, device_id, us, type, domain FROM attr_wake")(
    lambda c: at.attribute(at.signals(c.plan.browser_events), c.plan.th, WAKE)
)


def fresh(c) -> str:
    """A new folder on the shared storage for one streaming run."""
    return f"{checkpoint_dir(c.spark)}/stream-{uuid.uuid4().hex}"


def event_stream(c):
    """The events table as a file stream, in the telemetry view."""
    schema = c.table("events").schema
    raw = c.spark.readStream.schema(schema).parquet(f"{c.sf_dir}/events.parque[t]")
    return tm.view(raw)


@query("s1_stream_attribution", "SELECT user_id, device_id, us, type, domain FROM attr_wake")
def _(c):
    """The attribution state machine over the file stream, with wake reconciliation."""
    sig = at.signals(event_stream(c).filter("platform = 'browser'"))
    path = fresh(c)
    return jobs.drain(attribution_of_stream(sig, path), "attribution", path)


def attribution_of_stream(sig, path, delay_days=7):
    """Focus events of a stream of signals; one signal far ahead moves the watermark past all others."""
    ahead = sig.sparkSession.createDataFrame(
        [(-1, 0, 4102488000 * US, 0, "heartbeat", None, None, None)],
        "user_id long, device_id int, us long, seq long, kind string, domain string, focused boolean, active boolean",
    ).select(*[F.col(f.name).cast(f.dataType) for f in sig.schema.fields])
    ahead.write.parquet(f"{path}/closing")
    closing = sig.sparkSession.readStream.schema(ahead.schema).parquet(f"{path}/closing")
    rows = sig.unionByName(closing).withColumn("ts", F.timestamp_micros("us"))
    return state.stream_attribution(rows.withWatermark("ts", f"{delay_days} days"), WAKE)


@query("s3_stream_ingest", """
SELECT w.seq::VARCHAR AS event_id, batch_id FROM wire_r w JOIN (
 SELECT batch_id FROM wire_r GROUP BY batch_id HAVING bool_and(reasons = '' AND n % 19 <> 5 AND k <> 31) AND any_value(n) % 17 <> 3) USING (batch_id)""")
def _(c):
    """Wire batches from a file stream into the event table, in several micro-batches; a second run
    over the same files with a new checkpoint changes nothing."""
    base = fresh(c)
    files = max(4, c.spark.sparkContext.defaultParallelism)  # every core writes and reads some
    wire.wire_batches(c.events).repartition(files).write.parquet(f"{base}/lines")
    schema = c.spark.read.parquet(f"{base}/lines").schema
    for run in ("first", "again"):
        lines = c.spark.readStream.schema(schema).option("maxFilesPerTrigger", (files + 1) // 2).parquet(f"{base}/lines")
        jobs.ingest_stream(lines, base, wire.device_owners(c.events), run).awaitTermination()
    return jobs.ingested(c.spark, base)[0].all().select("event_id", "batch_id")


@query("s4_late_recompute", f"""SELECT user_id, {DAY}, category, sum(end_us - start_us)::BIGINT AS total_us, count(*) AS sessions
 FROM classified_apps GROUP BY user_id, local_date, category""")
def _(c):
    """Build the days without their late events, then rebuild only the days those touch, from the events
    stored by day and user bucket."""
    path = fresh(c)

    def build(ev):
        plan = DayPlan(ev, c.plan.seeds, tm.SAMPLE, rules=c.plan.rules, learned=c.plan.learned)
        return me.category_totals(plan.classified_apps).select(
            "user_id", "category", "total_us", "sessions", "local_date"
        )

    late = F.col("k") == 50
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.events.schema.fields)
    events, queue = EventStore(c.spark, f"{path}/events", fields), MarkQueue(c.spark, f"{path}/dirty")
    totals = DerivedTable(
        c.spark, f"{path}/totals", "user_id bigint, category string, total_us bigint, sessions bigint, local_date date"
    )
    for part_of in (~late, late):
        arrived = c.events.filter(part_of)
        queue.mark(arrived)
        events.append(arrived)
        recompute(events.of, queue, build, totals)
    return totals.read()


@query("s5_stream_sessions", f"""SELECT user_id, device_id, {DAY}, app_key, start_us, end_us, interactions,
  truncated, merged_from FROM app_sessions""")
def _(c):
    """App sessions from the event stream, late rows included."""
    return sessions_of_stream(event_stream(c).filter("platform = 'android'"), fresh(c))


def sessions_of_stream(ev, path, delay_days=7):
    """App sessions of a stream of phone events, in the table ``path``/days.

    Late rows are split off first.  The others go through the state machine, where one closing row
    far ahead moves the watermark past the last day, so that every state is flushed.  Then the days
    that the late rows marked dirty are rebuilt from all their events.
    """
    spark = ev.sparkSession
    cols = ["user_id", "device_id", "local_date", "us", "seq", "type", "key"]
    ev = ev.select(*cols)
    jobs.split_late(ev, path, delay_days * 86400).awaitTermination()
    end = tc.day_window(F.col("local_date"), F.lit(tm.TZ), F.lit(tm.DAY_START))[1]
    ahead = spark.createDataFrame([(1,)], "one int").select(
        F.lit(-1).cast("long").alias("user_id"), F.lit(0).alias("device_id"),
        F.lit("2100-01-01").cast("date").alias("local_date"), F.lit(4102488000 * US).alias("us"),
        F.lit(0).cast("long").alias("seq"), F.lit("HEALTH").alias("type"), F.lit(None).cast("string").alias("key"),
    )
    ahead.write.parquet(f"{path}/closing")
    closing = spark.readStream.schema(ahead.schema).parquet(f"{path}/closing")
    rows = (
        spark.readStream.schema(ev.schema).parquet(f"{path}/on_time")
        .select(*cols)
        .unionByName(closing.select(*cols))
        .withColumns({"day_end_us": end, "ts": F.timestamp_micros("us")})
        .withWatermark("ts", f"{delay_days} days")
    )
    made = jobs.drain(state.stream_sessions(rows, tm.SAMPLE), "sessions", path)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)
    days = DerivedTable(spark, f"{path}/days", fields)
    days.replace(made, made)

    both = [spark.read.schema(ev.schema).parquet(f"{path}/{name}").select(*cols) for name in ("on_time", "late")]
    taken = both[0].unionByName(both[1]).withColumns(
        {"platform": F.lit("android"), "tz": F.lit(tm.TZ), "day_start_hour": F.lit(tm.DAY_START)}
    )

    def build(ev):
        return se.app_sessions(ev, tm.SAMPLE).select(*made.columns)

    queue = MarkQueue(spark, f"{path}/dirty")
    recompute(lambda marks: taken.join(marks, USER_DAY, "left_semi"), queue, build, days)
    return days.read().select(*made.columns)
