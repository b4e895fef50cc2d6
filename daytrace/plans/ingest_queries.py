"""Ingest, time columns, joins."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from daytrace import catalog
from daytrace.config import DEVICE_DAY, US, USER_DAY
from daytrace.functions import timecols as tc
from daytrace.operators import classify as cl
from daytrace.operators import coverage as cov
from daytrace.operators import ingest as ing
from daytrace.plans.oracle import part
from daytrace.plans.registry import query
from daytrace.sources import tables
from daytrace.sources import telemetry as tm
from daytrace.sources import wire
from daytrace.sources.store import EventStore, retire

DAY = "CAST(local_date AS VARCHAR) AS local_date"
AS_OF = 1706659200 * US  # 2024-01-31 00:00 UTC, the sample's end

part("bat", """
SELECT user_id, device_id, seq // 100 AS batch_no, count(*) AS events, max(us) + 60000000 AS arrival,
  user_id || ':' || device_id || ':' || (seq // 100) AS batch_id, (seq // 100) * 100 AS seq_from,
  (seq // 100) * 100 + 99 AS seq_to FROM ev GROUP BY user_id, device_id, seq // 100""")
part("wire_r", """
SELECT seq, k, user_id || ':' || device_id || ':' || (seq // 100) AS batch_id, seq // 100 AS n,
 CASE k WHEN 13 THEN 'unknown_field' WHEN 22 THEN 'required:event_id' WHEN 27 THEN 'tz_offset' WHEN 41 THEN 'type'
  WHEN 55 THEN 'tz_id' WHEN 64 THEN 'uptime' WHEN 66 THEN 'schema_v' WHEN 77 THEN 'payload_size'
  WHEN 88 THEN 'payload_value' WHEN 5 THEN 'payload_key' WHEN 91 THEN 'seq' WHEN 93 THEN 'clock_flags'
  WHEN 95 THEN 'source' ELSE '' END AS reasons FROM ev""")
part("sends", """
SELECT user_id, device_id, local_date, seq AS event_id, us, seq // 100 AS no FROM ev
UNION ALL SELECT user_id, device_id, local_date, seq, us, seq // 100 + 1 FROM ev WHERE k % 9 = 0""")
part("firsts", "SELECT user_id, device_id, event_id, us, min(no) AS no, count(*) AS copies FROM sends GROUP BY ALL")

# --- A ---------------------------------------------------------------------------------------


@query("a1_raw_scan", """SELECT event_id AS seq, user_id, epoch_us(ts) AS us FROM events
 WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def _(c):
    """Half-open time range, filtered on the stored column so that it reaches the file scan."""
    ts = F.col("ts")
    rows = c.table("events").filter(
        (ts >= F.lit("2024-01-10").cast("timestamp_ntz")) & (ts < F.lit("2024-01-20").cast("timestamp_ntz"))
    )
    return rows.select(
        F.col("event_id").alias("seq"), "user_id", F.unix_micros(ts.cast("timestamp")).alias("us")
    )


@query("a1_day_range", f"""SELECT user_id, device_id, {DAY}, seq, us FROM ev
 WHERE local_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'""")
def _(c):
    """Ten local days from the events stored by day and user bucket; other partitions are not opened."""
    store = event_store(c, c.events)
    return store.read((dt.date(2024, 1, 10), dt.date(2024, 1, 19))).select(*DEVICE_DAY, "seq", "us")


def event_store(c, events):
    """A new store with these events."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    store = EventStore(c.spark, f"{tables.checkpoint_dir(c.spark)}/events-{uuid.uuid4().hex}", fields)
    store.append(events)
    return store


query("a2_envelope_validate", "SELECT seq, reasons FROM wire_r")(
    lambda c: ing.parse_envelope(wire.wire_events(c.events)).select("seq", "reasons")
)
query("a3_batch_atomic_reject", """
SELECT batch_id, count(*) AS events, count(CASE WHEN reasons <> '' THEN 1 END) AS invalid,
  count(CASE WHEN n % 19 = 5 OR k = 31 THEN 1 END) AS mismatched,
  bool_and(reasons = '' AND n % 19 <> 5 AND k <> 31) AND any_value(n) % 17 <> 3 AND count(*) BETWEEN 1 AND 1000 AS accepted
FROM wire_r GROUP BY batch_id""")(
    lambda c: ing.batch_verdicts(ing.parse_envelope(wire.wire_events(c.events))).drop("seq_from", "seq_to")
)
query("a4_batch_replay", """
SELECT batch_id, attempt, arrival + (attempt - 1) * 3600000000 AS arrival, attempt = 2 OR batch_no % 10 = 0 AS is_replay
FROM bat, (VALUES (1::BIGINT), (2)) t(attempt) WHERE attempt = 1 OR batch_no % 4 = 1""")(
    lambda c: ing.first_deliveries(wire.deliveries(c.events), wire.ledger(c.events)).select(
        "batch_id", "attempt", "arrival", "is_replay"
    )
)
query("a4_replay_receipt", """
SELECT d.batch_id, attempt, attempt = 2 OR batch_no % 10 = 0 AS is_replay, coalesce(a, 0) AS accepted, sent - coalesce(a, 0) AS duplicates,
  batch_no * 100 + 100 AS next_expected_seq
FROM (SELECT * FROM bat, (VALUES (1), (2)) t(attempt) WHERE attempt = 1 OR batch_no % 4 = 1) d
LEFT JOIN (SELECT user_id, device_id, no, count(*) AS sent FROM sends GROUP BY ALL) s ON s.user_id = d.user_id AND s.device_id = d.device_id AND s.no = d.batch_no
LEFT JOIN (SELECT user_id, device_id, no, count(*) AS a FROM firsts GROUP BY ALL) f ON f.user_id = d.user_id AND f.device_id = d.device_id AND f.no = d.batch_no""")(
    lambda c: ing.replay_receipts(
        wire.deliveries(c.events), wire.ledger(c.events),
        ing.receipts(wire.resent_events(c.events)).withColumn(
            "batch_id", F.concat_ws(":", "batch_no.user_id", "batch_no.device_id", "batch_no.no")
        ),
    ).select("batch_id", "attempt", "is_replay", "accepted", "duplicates", "next_expected_seq")
)
query("a5_event_dedupe", "SELECT event_id, us, no AS batch_no, copies FROM firsts")(
    lambda c: ing.dedupe_events(wire.resent_events(c.events)).withColumn("batch_no", F.col("batch_no.no"))
)


@query("a6_deterministic_event_id", """
SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-3' || substr(h,14,3) || '-' ||
  translate(substr(h,17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h,18,3) || '-' || substr(h,21,12) AS event_uuid,
  CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS polls
FROM (SELECT k, md5(user_id || ':' || device_id || '|' || coalesce(key, 'android') || '|' || (us // 1000) || '|' || type) AS h FROM ev)""")
def _(c):
    """Every fifth event is read by two overlapping polls; equal ids leave one row."""
    times = F.when(F.col("k") % 5 == 0, 2).otherwise(1)
    uid = ing.event_uuid(
        F.concat_ws(":", "user_id", "device_id"), F.coalesce("key", F.lit("android")),
        F.floor(F.col("us") / 1000), F.col("type"),
    )
    polled = c.events.withColumn("poll", F.explode(F.sequence(F.lit(1), times)))
    return polled.select(uid.alias("event_uuid")).groupBy("event_uuid").agg(
        F.count(F.lit(1)).alias("polls")
    )


query("a7_seq_gap", """
SELECT user_id, device_id, batch_no, last_seq + 1 AS expected_seq, seq_from AS received_seq_from FROM (
 SELECT *, greatest(coalesce(max(seq_to) OVER (PARTITION BY user_id, device_id ORDER BY arrival, batch_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS last_seq FROM bat) WHERE seq_from > last_seq + 1""")(
    lambda c: ing.seq_gaps(wire.batches(c.events), c.plan.th)
)
query("a8_device_cursor", """SELECT user_id, device_id, max(seq_to) AS last_seq, max(seq_to) + 1 AS next_expected_seq,
 max(arrival) AS last_seen_us FROM bat GROUP BY ALL""")(lambda c: ing.device_cursor(wire.batches(c.events)))
query("a9_dirty_days", f"""SELECT user_id, {DAY}, max(us) + 60000000 AS marked_us FROM ev GROUP BY user_id, local_date""")(
    lambda c: ing.dirty_days(wire.resent_events(c.events))
)
query("a10_ingest_receipt", """
SELECT user_id || ':' || device_id || ':' || no AS batch_id, coalesce(a, 0) AS accepted, sent - coalesce(a, 0) AS duplicates,
  no * 100 + 99 AS server_seq, no * 100 + 100 AS next_expected_seq
FROM (SELECT user_id, device_id, no, count(*) AS sent FROM sends GROUP BY ALL)
LEFT JOIN (SELECT user_id, device_id, no, count(*) AS a FROM firsts GROUP BY ALL) USING (user_id, device_id, no)""")(
    lambda c: ing.receipts(wire.resent_events(c.events)).select(
        F.concat_ws(":", "batch_no.user_id", "batch_no.device_id", "batch_no.no").alias("batch_id"),
        "accepted", "duplicates", "server_seq", "next_expected_seq",
    )
)


@query("a11_event_type_map", """
SELECT event_id AS seq, CASE event_type || (k % 2) WHEN 'view0' THEN 'APP_FOREGROUND' WHEN 'view1' THEN 'APP_FOREGROUND'
 WHEN 'purchase0' THEN 'APP_BACKGROUND' WHEN 'purchase1' THEN 'APP_BACKGROUND' WHEN 'click0' THEN 'USER_INTERACTION'
 WHEN 'signup0' THEN 'SCREEN_ON' WHEN 'signup1' THEN 'DEVICE_UNLOCK' WHEN 'error0' THEN 'SCREEN_OFF' WHEN 'error1' THEN 'DEVICE_SHUTDOWN' END AS type
FROM raw_k WHERE NOT (event_type = 'click' AND k % 2 = 1)""")
def _(c):
    even, e = F.col("k") % 2 == 0, F.col("event_type")
    code = (
        F.when(e == "view", "ACTIVITY_RESUMED")
        .when(e == "purchase", F.when(even, "ACTIVITY_PAUSED").otherwise("ACTIVITY_STOPPED"))
        .when(e == "click", F.when(even, "USER_INTERACTION").otherwise("CONFIGURATION_CHANGE"))
        .when(e == "signup", F.when(even, "SCREEN_INTERACTIVE").otherwise("KEYGUARD_HIDDEN"))
        .otherwise(F.when(even, "SCREEN_NON_INTERACTIVE").otherwise("DEVICE_SHUTDOWN"))
    )
    codes = c.spark.createDataFrame(list(catalog.USAGE_CODES.items()), "code string, type string")
    raw = c.events.select("seq", code.alias("code"))
    return ing.map_types(raw, codes).select("seq", "type")


query("a12_payload_shape", """SELECT seq, CASE WHEN type IN ('APP_FOREGROUND','APP_BACKGROUND','USER_INTERACTION') AND key IS NOT NULL
 THEN '{"package":"' || key || '"}' ELSE '{}' END AS payload FROM ev""")(
    lambda c: c.events.select("seq", F.to_json(ing.shape_payload(F.col("type"), F.col("key"))).alias("payload"))
)


@query("a13_window_rewrite_sink", f"SELECT user_id, {DAY}, count(*) AS events, 2 AS run FROM ev GROUP BY user_id, local_date")
def _(c):
    """Write all user-days, then rewrite them by a second run; the table holds each day once."""
    path = f"{tables.checkpoint_dir(c.spark)}/user_days-{uuid.uuid4().hex}"
    days = c.events.groupBy(*USER_DAY).agg(F.count(F.lit(1)).alias("events"))
    for run in (1, 2):
        tables.overwrite_days(days.withColumn("run", F.lit(run)), path)
    schema = "user_id bigint, events bigint, run int, local_date date"
    return c.spark.read.schema(schema).parquet(path)


@query("a14_seed_dims", """
SELECT e.app_key, coalesce(seed_category, 'unknown') AS category, d.label, g.label AS group_label, d.is_system, e.events
FROM (SELECT key AS app_key, count(*) AS events FROM ev WHERE key IS NOT NULL GROUP BY ALL) e
LEFT JOIN seeds USING (app_key) JOIN dim_cat d ON d.category = coalesce(seed_category, 'unknown')
JOIN dim_cat g ON g.category = d.parent""")
def _(c):
    """Seed catalogue and taxonomy attached to the apps seen in the events."""
    apps = c.events.filter("key is not null").groupBy(F.col("key").alias("app_key")).agg(
        F.count(F.lit(1)).alias("events")
    )
    tax = tm.taxonomy(c.spark)
    groups = tax.select(F.col("category").alias("parent"), F.col("label").alias("group_label"))
    df = apps.join(c.plan.seeds, "app_key", "left")
    df = df.withColumn("category", F.coalesce("seed_category", F.lit("unknown")))
    return (
        df.join(tax, "category")
        .join(groups, "parent")
        .select("app_key", "category", "label", "group_label", "is_system", "events")
    )


def _listed(entries) -> str:
    """A seed catalogue as SQL values."""
    rows = ", ".join(f"('{k}', '{c}', {p}::DOUBLE)" for k, (c, p) in entries.items())
    return f"(VALUES {rows}) s(name, seed_category, seed_conf)"


APPS = [*catalog.APP_PRIORS, "com.unlisted.app"]


@query("a14_app_catalogue", f"""
SELECT d.category, d.label, g.label AS group_label, count(DISTINCT u.app_key) AS apps, count(*) AS events, min(s.seed_conf) AS least_conf
FROM (SELECT [{", ".join(f"'{a}'" for a in APPS)}][event_id % {len(APPS)} + 1] AS app_key FROM events) u
LEFT JOIN {_listed(catalog.APP_PRIORS)} ON s.name = u.app_key
JOIN dim_cat d ON d.category = coalesce(s.seed_category, 'unknown') JOIN dim_cat g ON g.category = d.parent GROUP BY ALL""")
def _(c):
    """The whole app catalogue and the taxonomy over events, each filed under a package by its id."""
    app = F.element_at(F.lit(APPS), (F.col("event_id") % len(APPS) + 1).cast("int"))
    counts = c.table("events").groupBy(app.alias("app_key")).agg(F.count(F.lit(1)).alias("n"))
    df = counts.join(c.plan.seeds, "app_key", "left").withColumn("category", F.coalesce("seed_category", F.lit("unknown")))
    tax = tm.taxonomy(c.spark)
    groups = tax.select(F.col("category").alias("parent"), F.col("label").alias("group_label"))
    return df.join(tax, "category").join(groups, "parent").groupBy("category", "label", "group_label").agg(
        F.count(F.lit(1)).alias("apps"), F.sum("n").alias("events"), F.min("seed_conf").alias("least_conf")
    )


SITES = [*catalog.DOMAIN_PRIORS, "notgithub.com", "unlisted.test", "google.com.test"]
FRONTS = ["", "www.", "a.b.", "docs.", "WWW."]


@query("d7_domain_catalogue", f"""
WITH h AS (SELECT page_id, [{", ".join(f"'{f}'" for f in FRONTS)}][page_id % {len(FRONTS)} + 1] ||
  [{", ".join(f"'{s}'" for s in SITES)}][page_id % {len(SITES)} + 1] AS host FROM pages),
m AS (SELECT page_id, host, s.*, row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC NULLS LAST) AS r
  FROM h LEFT JOIN {_listed(catalog.DOMAIN_PRIORS)} ON '.' || lower(host) LIKE '%.' || name)
SELECT page_id, host, CASE WHEN seed_conf >= 0.55 THEN seed_category ELSE 'unknown' END AS category,
  coalesce(seed_conf, 0.0) AS confidence, CASE WHEN seed_conf >= 0.55 THEN 'seed' ELSE 'unknown' END AS source
FROM m WHERE r = 1""")
def _(c):
    """The whole domain catalogue over hosts made from the pages' ids, sub-domains and look-alikes included."""
    front = F.element_at(F.lit(FRONTS), (F.col("page_id") % len(FRONTS) + 1).cast("int"))
    site = F.element_at(F.lit(SITES), (F.col("page_id") % len(SITES) + 1).cast("int"))
    seen = c.table("pages").select("page_id", F.concat(front, site).alias("app_key"))
    found = cl.classify(cl.with_domain_priors(seen, c.plan.domain_seeds), c.plan.th)
    return found.select("page_id", F.col("app_key").alias("host"), "category", "confidence", "source")


@query("a15_retention_filter", f"""SELECT user_id, device_id, count(*) AS events,
 count(CASE WHEN us >= {AS_OF} - 20 * 86400000000 THEN 1 END) AS kept_server,
 count(CASE WHEN NOT (k < 80 AND us + 60000000 < {AS_OF} - 7 * 86400000000) THEN 1 END) AS kept_local
 FROM ev GROUP BY ALL""")
def _(c):
    fresh = F.col("us") >= AS_OF - 20 * 86400 * US
    prunable = ing.local_prunable(F.col("k") < 80, F.col("us") + 60 * US, AS_OF)
    return c.events.groupBy("user_id", "device_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(fresh).alias("kept_server"),
        F.count_if(~prunable).alias("kept_local"),
    )


@query("a15_partition_drop", f"""SELECT user_id, device_id, seq FROM ev
 WHERE CAST(make_timestamp(us) AS DATE) >= CAST(make_timestamp({AS_OF}) AS DATE) - 20 OR k >= 80""")
def _(c):
    """Days older than 20 dropped from a stored event table; rows not synced yet (k from 80 on) outlive them."""
    store = event_store(c, c.events.select(*DEVICE_DAY, "us", "seq", "k"))
    oldest = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=AS_OF)).date() - dt.timedelta(days=20)
    retire(c.spark, store.path, "day", oldest, needed=F.col("k") >= 80)
    return store.all().select("user_id", "device_id", "seq")


@query("a16_pending_queue_counts", """SELECT user_id, device_id, count(*) AS events, count(CASE WHEN k >= 60 THEN 1 END) AS unsynced,
 count(CASE WHEN k >= 85 THEN 1 END) AS eligible,
 count(DISTINCT CASE WHEN k < 85 AND (seq // 100) % 5 <> 0 THEN seq // 100 END) AS batches_pending,
 count(DISTINCT CASE WHEN k < 85 AND (seq // 100) % 5 = 0 THEN seq // 100 END) AS batches_quarantined FROM ev GROUP BY ALL""")
def _(c):
    n = F.when(F.col("k") < 85, F.floor(F.col("seq") / 100).cast("long"))
    queue = c.events.select(
        "user_id", "device_id", (F.col("k") < 60).alias("synced"), n.alias("batch_no"),
        F.when(n.isNotNull(), F.when(n % 5 == 0, "quarantined").otherwise("pending")).alias("batch_status"),
    )
    return ing.queue_counts(queue)


# --- B ---------------------------------------------------------------------------------------
_ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]


@query("b1_local_date", " UNION ALL ".join(f"""SELECT event_id AS seq, '{z}' AS tz,
 CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE '{z}' - INTERVAL 4 HOUR AS DATE) AS VARCHAR) AS local_date FROM events""" for z in _ZONES))
def _(c):
    ev = c.events.select("seq", "us", F.explode(F.lit(_ZONES)).alias("tz"))
    return ev.select(
        "seq", "tz", tc.local_date(F.timestamp_micros("us"), F.col("tz"), F.lit(4)).alias("local_date")
    )


_BOUND = "epoch_us((CAST(d + {n} AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE '{z}')"


@query("b2_day_window_utc", " UNION ALL ".join(f"""
SELECT '{z}' AS tz, CAST(d AS VARCHAR) AS local_date, {_BOUND.format(n=0, z=z)} AS start_us, {_BOUND.format(n=1, z=z)} AS end_us,
 ({_BOUND.format(n=1, z=z)} - {_BOUND.format(n=0, z=z)}) // 3600000000 AS hours
FROM (SELECT DISTINCT local_date + o AS d FROM ev, (VALUES (0), (45), (290)) t(o))""" for z in _ZONES))
def _(c):
    """Day windows of all dates in the data and of the same dates moved to both clock changes."""
    days = c.events.select("local_date").distinct()
    d = days.select(F.explode(F.lit([0, 45, 290])).alias("o"), "local_date").select(
        F.expr("date_add(local_date, o)").alias("local_date")
    ).distinct()
    d = d.select(F.explode(F.lit(_ZONES)).alias("tz"), "local_date")
    a, b = tc.day_window(F.col("local_date"), F.col("tz"), F.lit(4))
    return d.select("tz", "local_date", a.alias("start_us"), b.alias("end_us")).withColumn(
        "hours", F.floor((F.col("end_us") - F.col("start_us")) / (3600 * US))
    )


@query("b3_working_hours_flag", """SELECT seq, isodow(make_timestamp(us)) <= 5 AND hour(make_timestamp(us)) >= 9
 AND hour(make_timestamp(us)) < 17 AS in_hours FROM ev""")
def _(c):
    return with_hours(c, c.events, "us").select("seq", "in_hours")


def with_hours(c, df, us):
    """Add ``in_hours``: whether the instant lies in the user's working hours."""
    ts = tc.local_ts(F.col(us), F.lit(tm.TZ))
    df = df.withColumns({"weekday": tc.weekday0(ts), "sod": tc.second_of_day(ts)})
    hours = tm.working_hours(c.events)
    df = df.join(hours, ["user_id", "weekday"], "left")
    inside = (F.col("start_sod") <= F.col("sod")) & (F.col("sod") < F.col("end_sod"))
    return df.withColumn("in_hours", F.coalesce(inside, F.lit(False))).drop(
        "weekday", "sod", "start_sod", "end_sod"
    )


query("b4_duration_bucket", """SELECT seq, CASE WHEN value * 5 < 15 THEN '<15m' WHEN value * 5 < 30 THEN '15-30m'
 WHEN value * 5 < 60 THEN '30-60m' WHEN value * 5 < 120 THEN '1-2h' WHEN value * 5 < 180 THEN '2-3h'
 WHEN value * 5 < 240 THEN '3-4h' ELSE '4h+' END AS bucket FROM ev""")(
    lambda c: c.events.select("seq", tc.duration_bucket(F.col("value") * 5).alias("bucket"))
)
query("b5_coverage_tier", f"""SELECT user_id, {DAY}, CASE WHEN r < 0.6 THEN 'low' WHEN r >= 0.9 THEN 'good' ELSE 'partial' END AS tier,
 r < 0.6 AS uncertain FROM (SELECT user_id, local_date, device_id,
  sum(CASE WHEN state IN ('TRACKED','IDLE') THEN end_us - start_us ELSE 0 END)::BIGINT / sum(end_us - start_us)::BIGINT AS r
  FROM coverage GROUP BY ALL)""")(
    lambda c: cov.coverage_ratio(c.plan.coverage, DEVICE_DAY).select(
        *USER_DAY, tc.coverage_tier(F.col("coverage_ratio")).alias("tier"),
        (F.col("coverage_ratio") < 0.6).alias("uncertain"),
    )
)
query("b6_signed_delta", """SELECT seq, format('{:+.2f}', round_even((value - 25) * 100.0::DOUBLE, 0) / 100.0::DOUBLE) AS d2,
 format('{:+.0f}', round_even(value - 25, 0)) AS d0 FROM ev""")(
    lambda c: c.events.select(
        "seq", tc.signed_delta(F.col("value") - 25, 2).alias("d2"), tc.signed_delta(F.col("value") - 25, 0).alias("d0")
    )
)


@query("b7_clock_suspect", """SELECT seq, coalesce(abs((us - lag(us) OVER d) / 1e6 - (up - lag(up) OVER d) / 1e3) > 120, false) AS clock_suspect
FROM (SELECT *, us // 1000 - 1704067200000 + CASE WHEN k % 25 = 0 THEN 200000 ELSE 0 END AS up FROM ev)
WINDOW d AS (PARTITION BY user_id, device_id ORDER BY seq)""")
def _(c):
    up = F.floor(F.col("us") / 1000) - 1704067200000 + F.when(F.col("k") % 25 == 0, 200000).otherwise(0)
    ev = c.events.select("user_id", "device_id", "seq", "us", up.alias("uptime_ms"))
    return ing.clock_suspect(ev, c.plan.th).select("seq", "clock_suspect")


query("b8_tz_transition", f"""SELECT user_id, {DAY}, count(DISTINCT CASE WHEN k < 97 THEN 'UTC' ELSE 'Europe/Paris' END) > 1 AS tz_transition
 FROM ev GROUP BY user_id, local_date""")(
    lambda c: c.events.withColumn("tz_id", F.when(F.col("k") < 97, "UTC").otherwise("Europe/Paris"))
    .groupBy(*USER_DAY)
    .agg((F.min("tz_id") != F.max("tz_id")).alias("tz_transition"))
)
query("b9_late_beyond_window", """SELECT seq, us, us + k * 13000000000 AS ingested_us FROM ev WHERE k * 13000000000 > 7 * 86400000000""")(
    lambda c: c.events.select(
        "seq", "us", (F.col("us") + F.col("k").cast("long") * (13000 * US)).alias("ingested_us")
    ).filter(F.col("ingested_us") - F.col("us") > c.plan.th.late_s * US)
)

# --- J ---------------------------------------------------------------------------------------
query("j1_category_label", "SELECT activity_id, a.category, label, parent FROM acts a JOIN dim_cat d USING (category)")(
    lambda c: c.plan.activities.join(tm.taxonomy(c.spark), "category").select(
        "activity_id", "category", "label", "parent"
    )
)


@query("j2_interval_overlap_platforms", f"""
SELECT DISTINCT w.user_id, CAST(w.d AS VARCHAR) AS local_date, s.platform
FROM (SELECT DISTINCT user_id, local_date AS d, win_start, win_end FROM ev) w
JOIN (SELECT user_id, 'android' AS platform, start_us, end_us + 43200000000 AS end_us FROM coverage WHERE state = 'TRACKED'
      UNION ALL SELECT user_id, 'browser', start_us, end_us + 43200000000 FROM arbitrated) s
ON s.user_id = w.user_id AND s.start_us < w.win_end AND s.end_us > w.win_start""")
def _(c):
    """Platforms whose observed time meets a day.  Each interval is mapped to the few days it
    touches, so the join is on equality; here observed time is kept for another half day."""
    spans = c.plan.coverage.filter("state = 'TRACKED'").select(
        "user_id", F.lit("android").alias("platform"), "start_us", "end_us"
    ).unionByName(
        c.plan.arbitrated.select("user_id", F.lit("browser").alias("platform"), "start_us", "end_us")
    )
    day = lambda us: tc.local_date(F.timestamp_micros(us), F.lit(tm.TZ), F.lit(tm.DAY_START))
    last = F.col("end_us") + 43200 * US - 1
    touched = spans.select(
        "user_id", "platform", F.explode(F.sequence(day(F.col("start_us")), day(last))).alias("local_date")
    ).distinct()
    return touched.join(c.events.select(*USER_DAY).distinct(), USER_DAY, "left_semi").select(
        *USER_DAY, "platform"
    )


query("j3_array_key_join", """
SELECT activity_id, array_to_string(list_sort(list(DISTINCT c.app_key)), ',') AS app_keys
FROM (SELECT activity_id, unnest(session_ids) AS session_id FROM acts) a JOIN classified c USING (session_id) GROUP BY activity_id""")(
    lambda c: activity_apps(c.plan, c.plan.activities)
)


def activity_apps(plan, activities):
    """Sorted set of app keys behind every activity."""
    members = activities.select("activity_id", F.explode("session_ids").alias("session_id"))
    return (
        members.join(plan.classified.select("session_id", "app_key"), "session_id")
        .groupBy("activity_id")
        .agg(F.array_sort(F.collect_set("app_key")).alias("app_keys"))
    )


query("j4_prior_joins", """SELECT user_id, device_id, CAST(local_date AS VARCHAR) AS local_date, app_key, start_us, rule_category,
 learned_category, samples, seed_category, seed_conf FROM app_priors""")(
    lambda c: cl.with_priors(c.plan.app_sessions, c.plan.seeds, c.plan.rules, c.plan.learned).select(
        *DEVICE_DAY, "app_key", "start_us", "rule_category", "learned_category", "samples", "seed_category", "seed_conf"
    )
)
query("j7_anti_new_batches", "SELECT batch_id, events FROM bat WHERE batch_no % 10 <> 0")(
    lambda c: wire.batches(c.events).join(wire.ledger(c.events), "batch_id", "left_anti").select("batch_id", "events")
)
query("j8_category_self_join", """
SELECT p.category AS parent, c.category AS child, c.label, coalesce(n, 0) AS sessions FROM dim_cat c JOIN dim_cat p ON c.parent = p.category
LEFT JOIN (SELECT category, count(*) AS n FROM classified GROUP BY ALL) s ON s.category = c.category""")(
    lambda c: category_children(c)
)


def category_children(c):
    """Leaf categories under their group with the sessions each one holds."""
    tax = tm.taxonomy(c.spark)
    parents = tax.select(F.col("category").alias("parent"))
    used = c.plan.classified.groupBy("category").agg(F.count(F.lit(1)).alias("sessions"))
    return (
        tax.join(parents, "parent")
        .join(used, "category", "left")
        .fillna(0, ["sessions"])
        .select("parent", F.col("category").alias("child"), "label", "sessions")
    )
