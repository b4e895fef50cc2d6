"""Corrections, goals, daily summary, baselines and trends, read views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from daytrace.config import DEVICE_DAY, US, USER_DAY
from daytrace.functions import timecols as tc
from daytrace.operators import classify as cl
from daytrace.operators import goals as go
from daytrace.operators import metrics as me
from daytrace.operators import summary as su
from daytrace.operators import trends as tr
from daytrace.plans.ingest_queries import AS_OF, activity_apps, with_hours
from daytrace.plans.day import together
from daytrace.plans.oracle import part
from daytrace.plans.registry import query
from daytrace.sources import telemetry as tm
from daytrace.sources import wire
from daytrace.sources.tables import stage

DAY = "CAST(local_date AS VARCHAR) AS local_date"

# --- D: corrections ----------------------------------------------------------------------------
part("corr", """
SELECT user_id, key AS app_key, CASE WHEN value < 12 THEN 'development' WHEN value < 25 THEN 'writing' ELSE 'learning' END AS category,
 us, seq, local_date FROM ev WHERE key IS NOT NULL""")
part("corr_n", "SELECT *, row_number() OVER (PARTITION BY user_id, app_key ORDER BY us, seq) AS n FROM corr")
part("prior_rec", """
SELECT user_id, app_key, n, category, 0.75::DOUBLE AS confidence, 1::BIGINT AS samples, us FROM corr_n WHERE n = 1
UNION ALL
SELECT r.user_id, r.app_key, c.n, c.category,
 CASE WHEN c.category <> r.category THEN 0.75 ELSE least(0.95::DOUBLE, 0.75::DOUBLE + 0.04::DOUBLE *
   (r.samples * pow(0.5::DOUBLE, greatest(c.us - r.us, 0) / (60.0::DOUBLE * 86400 * 1000000)) + 1 - 1)) END,
 CASE WHEN c.category <> r.category THEN 1 ELSE greatest(1, CAST(round_even(
   r.samples * pow(0.5::DOUBLE, greatest(c.us - r.us, 0) / (60.0::DOUBLE * 86400 * 1000000)) + 1, 0) AS BIGINT)) END, c.us
FROM prior_rec r JOIN corr_n c ON c.user_id = r.user_id AND c.app_key = r.app_key AND c.n = r.n + 1""")

query("d3_learned_prior_fold", """SELECT user_id, app_key, category, round(confidence, 9) AS confidence, samples, us AS updated_us FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, app_key ORDER BY n DESC) AS z FROM prior_rec) WHERE z = 1""")(
    lambda c: cl.learned_prior_fold(tm.corrections(c.events), c.plan.th).withColumn(
        "confidence", F.round("confidence", 9)
    )
)
query("d4_taxonomy_rollup", f"""
SELECT user_id, {DAY}, parent, CASE WHEN user_id % 4 = 3 AND parent = 'growth' THEN 'Study'
  WHEN parent = 'growth' THEN 'Growth' WHEN parent = 'work' THEN 'Work' WHEN parent = 'connection' THEN 'Connection'
  WHEN parent = 'life' THEN 'Life' WHEN parent = 'consumption' THEN 'Consumption' ELSE 'System' END AS label,
 bool_or(is_work) AS is_work_set, bool_or(is_system) AS is_system, sum(len)::BIGINT AS total_us
FROM classified JOIN dim_cat USING (category) GROUP BY user_id, local_date, parent""")(lambda c: rollup(c))


def rollup(c):
    """Leaf categories to groups.  Users may rename groups (here growth), never system ones."""
    from daytrace.catalog import WORK

    tax = tm.taxonomy(c.spark)
    groups = tax.filter("parent is null").select(
        F.col("category").alias("parent"), F.col("label").alias("given"), "is_system"
    )
    renames = tm.users(c.events).filter("user_id % 4 = 3").select(
        "user_id", F.lit("growth").alias("parent"), F.lit("Study").alias("renamed")
    )
    leaves = tax.select("category", "parent")
    totals = (
        c.plan.classified.join(leaves, "category")
        .groupBy(*USER_DAY, "parent")
        .agg(
            F.max(F.col("category").isin(WORK)).alias("is_work_set"),
            F.sum(me.length()).alias("total_us"),
        )
    )
    return (
        totals.join(groups, "parent")
        .join(renames, ["user_id", "parent"], "left")
        .select(
            *USER_DAY,
            "parent",
            F.when(F.col("is_system"), F.col("given")).otherwise(F.coalesce("renamed", "given")).alias("label"),
            "is_work_set",
            "is_system",
            "total_us",
        )
    )


@query("d5_supersede", """
SELECT activity_id, category, confidence, source, CASE WHEN hit THEN activity_id || '+' END AS superseded_by
FROM (SELECT *, category = 'unknown' AND members = 1 AS hit FROM acts)
UNION ALL SELECT activity_id || '+', 'reading', 1.0, 'user', NULL FROM acts WHERE category = 'unknown' AND members = 1""")
def _(c):
    """Correct every lone unknown activity to reading; the old row stays, marked."""
    acts = c.plan.activities
    fixes = acts.filter("category = 'unknown' and members = 1").select(
        "activity_id", F.lit("reading").alias("corrected_category")
    )
    return cl.supersede(acts, fixes).select(
        "activity_id", "category", "confidence", "source", "superseded_by"
    )


query("d6_retroactive_days", f"""
SELECT DISTINCT s.user_id, s.app_key, CAST(s.local_date AS VARCHAR) AS local_date FROM app_sessions s
JOIN corr c ON c.user_id = s.user_id AND c.app_key = s.app_key AND c.local_date <> s.local_date""")(
    lambda c: cl.retroactive_days(c.plan.app_sessions, tm.corrections(c.events))
)

# --- G: goals ----------------------------------------------------------------------------------
part("goal_dim", """
SELECT u.user_id, g.* FROM (SELECT DISTINCT user_id FROM ev) u, (VALUES
 (1, 'Ship it', 1, 6000.0::DOUBLE, DATE '2024-01-01', NULL::DATE, false), (2, 'Less social', 3, 0.0, DATE '2024-01-05', DATE '2024-01-20', false),
 (3, 'Learn', 2, 1200.0, DATE '2024-01-01', NULL, false), (4, 'Old', 4, 600.0, DATE '2024-01-01', NULL, true))
 g(goal_id, name, priority, target_weekly_min, active_from, active_to, archived)""")
part("goal_map", """
SELECT * FROM (VALUES (1, 'development', NULL, 0.9::DOUBLE), (2, NULL, 'app_3', 1.0), (3, 'learning', NULL, 0.8),
 (3, NULL, 'app_7', 0.7), (4, 'writing', NULL, 1.0)) t(goal_id, category, app_key, weight)""")
part("acts_h", """SELECT *, isodow(make_timestamp(start_us)) <= 5 AND hour(make_timestamp(start_us)) >= 9
 AND hour(make_timestamp(start_us)) < 17 AS in_hours FROM acts""")
part("goal_w", """
SELECT user_id, goal_id, activity_id, least(sum(weight), 1.0) AS weight FROM (
 SELECT a.user_id, g.goal_id, activity_id, weight FROM acts a JOIN goal_dim g USING (user_id) JOIN goal_map m ON m.goal_id = g.goal_id AND m.category = a.category
 UNION ALL SELECT a.user_id, g.goal_id, activity_id, weight FROM acts a JOIN goal_dim g USING (user_id) JOIN goal_map m ON m.goal_id = g.goal_id AND m.app_key = a.app_key)
GROUP BY ALL""")
part("goal_c", """
SELECT user_id, goal_id, local_date, weight, confidence, duration_us * weight * confidence * (CASE WHEN goal_id IN (1, 4) AND NOT in_hours THEN 0.85::DOUBLE ELSE 1.0 END) AS p
FROM goal_w JOIN acts_h USING (user_id, activity_id)""")
part("goal_day", """
SELECT user_id, goal_id, local_date, sum(CAST(round_even(p, 0) AS BIGINT))::BIGINT AS aligned_us,
 sum(CAST(round_even(p * (1 - confidence), 0) AS BIGINT))::BIGINT AS unsure_us FROM goal_c GROUP BY ALL""")
part("goal_base", """
SELECT m.user_id, goal_id, m.local_date, target_weekly_min, m.local_date - DATE '1970-01-01' AS day_no, coalesce(aligned_us, 0) AS aligned_us,
 coalesce(unsure_us, 0) AS unsure_us, CAST(round_even(coverage_ratio * 1000000000, 0) AS BIGINT) AS ppb
FROM m_sw m JOIN goal_dim USING (user_id) LEFT JOIN goal_day USING (user_id, goal_id, local_date)""")
part("goal_roll", " UNION ALL ".join(f"""
SELECT user_id, goal_id, local_date, target_weekly_min, {n} AS window_days, sum(aligned_us) OVER w AS aligned_us, sum(unsure_us) OVER w AS unsure_us,
 sum(ppb) OVER w / ({n} * 1000000000.0::DOUBLE) AS coverage_ratio FROM goal_base
WINDOW w AS (PARTITION BY user_id, goal_id ORDER BY day_no RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for n in (1, 7, 30, 90)))
part("goal_win", """
SELECT user_id, goal_id, local_date, window_days, coverage_ratio, aligned_us / 60000000.0::DOUBLE AS aligned_min,
 greatest(aligned_us / 60000000.0::DOUBLE - (unsure_us + aligned_us * (1 - coverage_ratio) * 0.5::DOUBLE) / 60000000.0::DOUBLE, 0.0) AS low_min,
 aligned_us / 60000000.0::DOUBLE + (unsure_us + aligned_us * (1 - coverage_ratio) * 0.5::DOUBLE) / 60000000.0::DOUBLE AS high_min,
 CASE WHEN target_weekly_min > 0 THEN aligned_us / 60000000.0::DOUBLE / (target_weekly_min * window_days / 7) ELSE 0.0 END AS attainment
FROM goal_roll""")


def goal_parts(c):
    """Activities with working hours, goals, mappings, and the windowed alignment."""
    acts = stage(with_hours(c, c.plan.activities, "start_us"))
    goals, maps = tm.goals(c.events), tm.goal_mappings(c.spark)
    daily = go.contributions(acts, goals, maps)
    return acts, goals, maps, daily


def rounded(df, *cols, digits=6):
    return df.withColumns({x: F.round(x, digits) for x in cols})


query("g1_goal_alignment", f"SELECT user_id, goal_id, {DAY}, aligned_us, unsure_us FROM goal_day")(lambda c: goal_parts(c)[3])
_WIN = "round(coverage_ratio, 6) AS coverage_ratio, round(aligned_min, 6) AS aligned_min, round(low_min, 6) AS low_min, round(high_min, 6) AS high_min"


def goal_windows(c):
    c.plan.at_once("classified", "coverage")
    wide, (_, goals, _, daily) = together(c.spark, lambda: c.plan.metrics, lambda: goal_parts(c))
    return go.windowed(daily, wide, goals)


query("g2_goal_window", f"SELECT user_id, goal_id, {DAY}, window_days, {_WIN} FROM goal_win")(
    lambda c: rounded(goal_windows(c), "coverage_ratio", "aligned_min", "low_min", "high_min").drop("attainment")
)
query("g3_attainment", f"SELECT user_id, goal_id, {DAY}, window_days, round(attainment, 6) AS attainment FROM goal_win")(
    lambda c: rounded(goal_windows(c), "attainment").select("user_id", "goal_id", "local_date", "window_days", "attainment")
)
query("g4_activity_app_key", "SELECT activity_id, app_key FROM acts")(
    lambda c: c.plan.activities.select("activity_id", "app_key")
)


@query("g5_unallocated_time", f"""SELECT user_id, {DAY}, sum(duration_us)::BIGINT AS unallocated_us, count(*) AS activities
 FROM acts WHERE activity_id NOT IN (SELECT activity_id FROM goal_w) GROUP BY user_id, local_date""")
def _(c):
    acts, goals, maps, _ = goal_parts(c)
    targets = goals.select("user_id", "goal_id").join(maps, "goal_id")
    return go.unallocated(acts, go.matched_weights(acts, targets))


@query("j5_or_join_goal_mapping", "SELECT user_id, goal_id, activity_id, weight FROM goal_w")
def _(c):
    acts, goals, maps, _ = goal_parts(c)
    return go.matched_weights(acts, goals.select("user_id", "goal_id").join(maps, "goal_id"))


query("j6_goals_as_of", f"""SELECT d.user_id, CAST(d.local_date AS VARCHAR) AS local_date, goal_id, priority FROM (SELECT DISTINCT user_id, local_date FROM ev) d
 JOIN goal_dim g ON g.user_id = d.user_id AND NOT archived AND active_from <= d.local_date AND (active_to IS NULL OR active_to >= d.local_date)""")(
    lambda c: go.active_goals(c.events.select(*USER_DAY).distinct(), tm.goals(c.events)).select(
        *USER_DAY, "goal_id", "priority"
    )
)

# --- M7..M14, P6..P8 ---------------------------------------------------------------------------
part("mx", """SELECT *, local_date - DATE '1970-01-01' AS day_no, CAST(round_even(screen_time_s * 1000000, 0) AS BIGINT) AS screen_us,
 CAST(round_even(deep_work_s * 1000000, 0) AS BIGINT) AS deep_us, CAST(round_even(fragmentation_index * 1000000000, 0) AS BIGINT) AS frag_ppb FROM metrics""")
part("base30_s", """
SELECT user_id, local_date, coalesce(count(CASE WHEN coverage_ratio >= 0.6 THEN 1 END) OVER w, 0) AS n,
 count(CASE WHEN coverage_ratio >= 0.6 THEN frag_ppb END) OVER w AS fn, sum(CASE WHEN coverage_ratio >= 0.6 THEN screen_us END) OVER w AS s,
 sum(CASE WHEN coverage_ratio >= 0.6 THEN deep_us END) OVER w AS d, sum(CASE WHEN coverage_ratio >= 0.6 THEN frag_ppb END) OVER w AS f
FROM mx WINDOW w AS (PARTITION BY user_id ORDER BY day_no RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
part("base30", """
SELECT user_id, local_date, n AS valid_days, CASE WHEN n > 0 THEN s::BIGINT / n / 60000000.0::DOUBLE ELSE 0.0 END AS screen_minutes_mean,
 CASE WHEN n > 0 THEN d::BIGINT / n / 60000000.0::DOUBLE ELSE 0.0 END AS deep_work_minutes_mean,
 CASE WHEN fn > 0 THEN f::BIGINT / fn / 1000000000.0::DOUBLE ELSE 0.0 END AS fragmentation_mean FROM base30_s""")
query("m7_trailing_baseline", f"""SELECT user_id, {DAY}, valid_days, round(screen_minutes_mean, 6) AS screen_minutes_mean,
 round(deep_work_minutes_mean, 6) AS deep_work_minutes_mean, round(fragmentation_mean, 6) AS fragmentation_mean FROM base30""")(
    lambda c: rounded(
        tr.trailing_baseline(c.plan.metrics, c.plan.th),
        "screen_minutes_mean", "deep_work_minutes_mean", "fragmentation_mean",
    )
)
def _screen():
    return F.rint(F.col("screen_time_s") * US).cast("long")



def _robust(name: str, extra: str, partition):
    part(f"{name}_l", f"""
SELECT a.user_id, a.local_date, n AS window_days, list(b.screen_us) FILTER (b.screen_us IS NOT NULL) AS xs
FROM mx a CROSS JOIN (VALUES (7), (30), (90)) t(n) LEFT JOIN mx b ON b.user_id = a.user_id AND b.coverage_ratio >= 0.7
 AND b.day_no BETWEEN a.day_no - n AND a.day_no - 1 {extra} GROUP BY ALL""")
    part(f"{name}_m", f"SELECT *, list_aggregate(xs, 'median') AS median FROM {name}_l")
    query(name, f"""SELECT user_id, {DAY}, window_days, coalesce(len(xs), 0) AS valid_days, median,
 list_aggregate(list_transform(xs, lambda x: abs(x - median)), 'median') AS mad, CAST(list_sum(xs) AS BIGINT) / len(xs) AS mean FROM {name}_m""")(
        lambda c: tr.robust_baseline(c.plan.metrics, _screen(), c.plan.th, partition)
    )


_robust("m8_robust_baseline", "", ["user_id"])
_robust("m10_dow_baseline", "AND isodow(a.local_date) = isodow(b.local_date)", ["user_id", "weekday"])
part("tc_l", """
SELECT a.user_id, a.local_date, list(b.screen_us) FILTER (b.day_no > a.day_no - 7) AS recent, list(b.screen_us) FILTER (b.day_no <= a.day_no - 7) AS past
FROM mx a LEFT JOIN mx b ON b.user_id = a.user_id AND b.coverage_ratio >= 0.7 AND b.day_no BETWEEN a.day_no - 27 AND a.day_no GROUP BY ALL""")
part("tc_m", "SELECT *, list_aggregate(recent, 'median') AS recent_median, list_aggregate(past, 'median') AS past_median FROM tc_l")
part("tc_x", """SELECT *, list_aggregate(list_transform(past, lambda x: abs(x - past_median)), 'median') AS past_mad,
 coalesce(len(recent), 0) AS recent_days, coalesce(len(recent), 0) + coalesce(len(past), 0) AS valid_days FROM tc_m""")
query("m9_trend_change", f"""SELECT user_id, {DAY}, recent_median, past_median, past_mad, recent_days, valid_days,
 coalesce(recent_days >= 5 AND valid_days >= 14 AND abs(recent_median - past_median) > 1.5 * past_mad, false) AS changed FROM tc_x""")(
    lambda c: tr.trend_change(c.plan.metrics, _screen(), c.plan.th)
)
query("m11_weekly_metrics", """SELECT *, screen_us - lag(screen_us) OVER w AS screen_delta_us, deep_us - lag(deep_us) OVER w AS deep_delta_us FROM (
 SELECT user_id, isoyear(local_date) AS iso_year, weekofyear(local_date) AS iso_week, count(*) AS days, sum(screen_us)::BIGINT AS screen_us,
  sum(deep_us)::BIGINT AS deep_us, sum(context_switches)::BIGINT AS context_switches, sum(focus_session_count)::BIGINT AS focus_sessions FROM mx GROUP BY ALL)
 WINDOW w AS (PARTITION BY user_id ORDER BY iso_year, iso_week)""")(lambda c: tr.weekly(c.plan.metrics))


def _slot_part(name: str, source: str, cols: str) -> None:
    part(name, f"""
SELECT user_id, local_date, {cols} slot, least(end_us, d0 + (slot + 1) * 7200000000) - greatest(start_us, d0 + slot * 7200000000) AS in_slot_us
FROM (SELECT *, unnest(range((start_us - d0) // 7200000000, (end_us - 1 - d0) // 7200000000 + 1)) AS slot FROM (
 SELECT *, epoch_us(local_date::TIMESTAMP) + 14400000000 AS d0 FROM {source} WHERE end_us > start_us))""")


_slot_part("slot_f", "focus", "")
_slot_part("slot_b", "bursts", "")
_slot_part("slot_c", "classified", "is_work,")
query("m12_best_slots", " UNION ALL ".join(f"""
SELECT user_id, '{kind}' AS kind, slot, total_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_us DESC, slot) AS z FROM (
 SELECT user_id, slot, sum(in_slot_us)::BIGINT AS total_us FROM {src} GROUP BY ALL)) WHERE z = 1"""
    for kind, src in (("focus", "slot_f"), ("distraction", "slot_b"))))(
    lambda c: tr.best_slots(c.plan.focus, c.plan.bursts, c.plan.th, tm.TZ, tm.DAY_START)
)
query("p7_time_of_day_sink", f"""
SELECT user_id, {DAY}, slot, share_ppm, n AS history_days FROM (SELECT *, count(*) OVER w AS n, sum(share_ppm) OVER w AS s, sum(share_ppm * share_ppm) OVER w AS ss FROM (
  SELECT user_id, local_date, local_date - DATE '1970-01-01' AS day_no, slot,
   sum(CASE WHEN is_work THEN 0 ELSE in_slot_us END)::BIGINT * 1000000 // sum(in_slot_us)::BIGINT AS share_ppm FROM slot_c GROUP BY ALL)
 WINDOW w AS (PARTITION BY user_id, slot ORDER BY day_no RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
WHERE n >= 2 AND share_ppm * n - s >= 2 * sqrt((n * (n * ss - s * s)) / (n - 1))""")(
    lambda c: tr.time_of_day_sink(c.plan.classified, c.plan.th, tm.TZ, tm.DAY_START)
)
part("tsa_r", """
SELECT *, epoch_us(local_date::TIMESTAMP) + 32400000000 AS f, epoch_us(local_date::TIMESTAMP) + 61200000000 AS t FROM classified WHERE isodow(local_date) <= 5""")
part("tsa_f", """SELECT *, min(CASE WHEN is_work AND end_us > f THEN greatest(start_us, f) END) OVER (PARTITION BY user_id, local_date) AS fw FROM tsa_r""")
part("tsa_d", """SELECT user_id, local_date, sum(CASE WHEN is_work THEN 0 ELSE greatest(least(end_us, coalesce(fw, t), t) - greatest(start_us, f), 0) END)::BIGINT AS avoid_us
 FROM tsa_f GROUP BY ALL""")
query("p6_task_start_avoidance", f"""SELECT user_id, {DAY}, avoid_us, hits FROM (SELECT *, count(CASE WHEN avoid_us >= 6000000000 THEN 1 END) OVER
 (PARTITION BY user_id ORDER BY local_date - DATE '1970-01-01' RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS hits FROM tsa_d)
 WHERE avoid_us >= 6000000000 AND hits >= 4""")(
    lambda c: tr.task_start_avoidance(
        c.plan.classified, tm.working_hours(c.events), c.plan.th, tm.TZ, c.plan.th.start_avoid_days
    )
)
query("p8_late_night_drift", """
SELECT user_id, isoyear(local_date) AS iso_year, weekofyear(local_date) AS iso_week, count(*) AS nights, sum(late_us)::BIGINT AS late_us FROM (
 SELECT user_id, local_date, sum(greatest(end_us - greatest(start_us, epoch_us(local_date::TIMESTAMP) + 79200000000), 0))::BIGINT AS late_us
 FROM classified WHERE category IN ('entertainment', 'browsing') GROUP BY ALL) WHERE late_us >= 1800000000 GROUP BY ALL HAVING count(*) >= 3""")(
    # wind-down at 22:00; half an hour of real consumption per night
    lambda c: tr.late_night_drift(c.plan.classified, c.plan.th, tm.TZ, 22, 1800 * US)
)


@query("m6_collector_health", f"""
SELECT user_id, device_id, max(us) AS last_seen_us, max(seq) AS last_seq, (user_id + device_id) % 7 = 0 AS revoked,
 coalesce(any_value(r), 0) AS rejected_batches, {AS_OF} - max(us) > 6 * 3600000000 AS stale
FROM ev LEFT JOIN (SELECT user_id, device_id, count(*) AS r FROM bat WHERE batch_no % 17 = 3 GROUP BY ALL) USING (user_id, device_id) GROUP BY user_id, device_id""")
def _(c):
    rejected = wire.batches(c.events).filter("batch_no % 17 = 3").groupBy("user_id", "device_id").agg(
        F.count(F.lit(1)).alias("rejected_batches")
    )
    return me.collector_health(c.events, rejected, tm.devices(c.events), AS_OF, c.plan.th.stale_s)


part("lat", "SELECT user_id, local_date, k * 13000 AS latency_s, k < 60 AS synced FROM ev")
query("m13_ops_totals", """
SELECT count(*) AS collected, count(CASE WHEN synced THEN 1 END) AS synced, (SELECT count(*) FROM wire_r WHERE reasons <> '') AS rejected,
 (SELECT sum(copies - 1)::BIGINT FROM firsts) AS duplicates, round(quantile_cont(latency_s, 0.5), 6) AS latency_p50, round(quantile_cont(latency_s, 0.95), 6) AS latency_p95 FROM lat""")(
    lambda c: ops_totals(c)
)


def ops_totals(c):
    """Collected, synced, rejected and duplicate events with exact latency quantiles."""
    from daytrace.operators import ingest as ing

    ev = c.events.select((F.col("k") * 13000).alias("latency_s"), (F.col("k") < 60).alias("synced"))
    totals = me.latency_quantiles(ev)
    rejected = ing.parse_envelope(wire.wire_events(c.events)).agg(
        F.count_if(F.size("reasons") > 0).alias("rejected")
    )
    copies = ing.dedupe_events(wire.resent_events(c.events)).agg(
        F.sum(F.col("copies") - 1).alias("duplicates")
    )
    # three one-row results side by side
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(totals).join(one(rejected), "_one").join(one(copies), "_one").drop("_one")


query("m13_ops_days", f"""
SELECT {DAY}, sum(CASE WHEN category = 'unknown' THEN len ELSE 0 END)::BIGINT / sum(len)::BIGINT AS unknown_ratio,
 round(quantile_cont(confidence, 0.5), 6) AS confidence_p50, round(quantile_cont(confidence, 0.1), 6) AS confidence_p10 FROM classified GROUP BY local_date""")(
    lambda c: me.classification_health(c.plan.classified)
)


@query("m13_ops_devices", f"""
SELECT user_id, device_id, coalesce(gaps, 0) AS seq_gaps, round(r, 9) AS mean_coverage FROM (
 SELECT user_id, device_id, sum(CASE WHEN state IN ('TRACKED','IDLE') THEN end_us - start_us ELSE 0 END)::BIGINT / sum(end_us - start_us)::BIGINT AS r FROM coverage GROUP BY ALL)
LEFT JOIN (SELECT user_id, device_id, count(*) AS gaps FROM (
 SELECT *, greatest(coalesce(max(seq_to) OVER (PARTITION BY user_id, device_id ORDER BY arrival, batch_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS last_seq FROM bat) WHERE seq_from > last_seq + 1 GROUP BY ALL) USING (user_id, device_id)""")
def _(c):
    from daytrace.operators import coverage as cov
    from daytrace.operators import ingest as ing

    gaps = ing.seq_gaps(wire.batches(c.events), c.plan.th).groupBy("user_id", "device_id").agg(
        F.count(F.lit(1)).alias("seq_gaps")
    )
    ratio = cov.coverage_ratio(c.plan.coverage, ["user_id", "device_id"])
    return ratio.join(gaps, ["user_id", "device_id"], "left").fillna(0, ["seq_gaps"]).select(
        "user_id", "device_id", "seq_gaps", F.round("coverage_ratio", 9).alias("mean_coverage")
    )


query("m14_domain_totals", f"""SELECT user_id, {DAY}, app_key, sum(end_us - start_us)::BIGINT AS total_us, count(DISTINCT browser_family) AS families,
 sum(CASE WHEN browser_family = 'brave' THEN end_us - start_us ELSE 0 END)::BIGINT AS brave_us,
 sum(CASE WHEN browser_family = 'chromium' THEN end_us - start_us ELSE 0 END)::BIGINT AS chromium_us,
 sum(CASE WHEN browser_family = 'firefox' THEN end_us - start_us ELSE 0 END)::BIGINT AS firefox_us FROM arbitrated GROUP BY user_id, local_date, app_key""")(
    lambda c: me.domain_totals(c.plan.arbitrated, ["brave", "chromium", "firefox"])
)

# --- H -----------------------------------------------------------------------------------------
part("h_cat_r", """
SELECT user_id, local_date, label AS category, CAST(round_even(sum(duration_us)::BIGINT / 60000000.0::DOUBLE, 0) AS BIGINT) AS minutes, count(*) AS sessions,
 round_even(sum(CAST(round_even(confidence * 1000000000, 0) AS BIGINT))::BIGINT / count(*) / 1000000000.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS avg_confidence
FROM acts_now a JOIN dim_cat d USING (category) WHERE NOT is_system GROUP BY user_id, local_date, label""")
part("h_cat", """
SELECT user_id, local_date, rank, category, minutes, CASE WHEN sm > 0 THEN round_even(minutes / sm * 100.0::DOUBLE, 0) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS share, sessions, avg_confidence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, local_date ORDER BY minutes DESC, category) AS rank FROM h_cat_r)
JOIN (SELECT user_id, local_date, CAST(round_even(screen_time_s * 1000000 / 60000000.0::DOUBLE, 0) AS BIGINT) AS sm FROM metrics) USING (user_id, local_date)""")
part("h_att_r", """
SELECT user_id, local_date, app_key, sum(len)::BIGINT AS total_us, count(*) AS sessions, arg_max(label, {'a': start_us, 'b': device_id}) AS category
FROM classified JOIN dim_cat USING (category) WHERE NOT is_system GROUP BY ALL""")
part("h_att", """
SELECT user_id, local_date, rank, category, sessions, CASE WHEN m < 15 THEN '<15m' WHEN m < 30 THEN '15-30m' WHEN m < 60 THEN '30-60m' WHEN m < 120 THEN '1-2h'
 WHEN m < 180 THEN '2-3h' WHEN m < 240 THEN '3-4h' ELSE '4h+' END AS bucket FROM (SELECT *, total_us / 60000000.0::DOUBLE AS m,
 row_number() OVER (PARTITION BY user_id, local_date ORDER BY total_us DESC, app_key) AS rank FROM h_att_r)""")
part("h_foc", """
SELECT user_id, local_date, count(*) AS sessions, count(CASE WHEN is_deep THEN 1 END) AS deep_sessions,
 CAST(round_even(max(end_us - start_us) / 60000000.0::DOUBLE, 0) AS BIGINT) AS longest_minutes,
 CAST(round_even(sum(end_us - start_us)::BIGINT / count(*) / 60000000.0::DOUBLE, 0) AS BIGINT) AS average_minutes,
 CAST(round_even(sum(end_us - start_us)::BIGINT / 60000000.0::DOUBLE, 0) AS BIGINT) AS total_focus_minutes,
 round_even(sum(CAST(round_even(quality * 1000000000, 0) AS BIGINT))::BIGINT / count(*) / 1000000000.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS avg_quality
FROM focus_q GROUP BY ALL""")
part("h_pat", """
SELECT user_id, rank, pattern AS type, occurrences, round_even(strength * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS strength, status FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, pattern, app_key NULLS FIRST) AS rank FROM patterns WHERE status = 'confirmed')""")
part("h_goal", """
SELECT g.user_id, g.local_date, row_number() OVER (PARTITION BY g.user_id, g.local_date ORDER BY priority, g.goal_id) AS rank, name, priority,
 CAST(round_even(target_weekly_min, 0) AS BIGINT) AS target_weekly_minutes, CAST(round_even(t.aligned_min, 0) AS BIGINT) AS aligned_minutes_today,
 CAST(round_even(t.high_min - t.aligned_min, 0) AS BIGINT) AS uncertainty, round_even(w.attainment * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS week_attainment
FROM (SELECT d.user_id, d.local_date, goal_id, name, priority, target_weekly_min FROM (SELECT DISTINCT user_id, local_date FROM m_days) d JOIN goal_dim x
  ON x.user_id = d.user_id AND NOT archived AND active_from <= d.local_date AND (active_to IS NULL OR active_to >= d.local_date)) g
JOIN goal_win t ON t.user_id = g.user_id AND t.goal_id = g.goal_id AND t.local_date = g.local_date AND t.window_days = 1
JOIN goal_win w ON w.user_id = g.user_id AND w.goal_id = g.goal_id AND w.local_date = g.local_date AND w.window_days = 7""")
query("h1_summary_categories", f"SELECT user_id, {DAY}, rank, category, minutes, share, sessions, avg_confidence FROM h_cat")(
    lambda c: su.category_summary(c.plan.current, tm.taxonomy(c.spark), c.plan.metrics)
)
query("h2_top_attention", f"SELECT user_id, {DAY}, rank, category, bucket, sessions FROM h_att")(
    lambda c: su.top_attention(c.plan.classified, tm.taxonomy(c.spark))
)
query("h3_focus_summary", f"SELECT * EXCLUDE (local_date), {DAY} FROM h_foc")(lambda c: su.focus_summary(c.plan.focus))
query("h4_confirmed_patterns", "SELECT * FROM h_pat")(lambda c: su.confirmed_patterns(c.plan.patterns))

_MIN = "CAST(round_even({c} * 1000000 / 60000000.0::DOUBLE, 0) AS BIGINT)"
_R2 = "round_even({c} * 100.0::DOUBLE, 0) / 100.0::DOUBLE"
part("h_doc", f"""
SELECT m.user_id, m.local_date, {{
 'baselines': {{'deep_work_minutes_mean': CAST(round_even(deep_work_minutes_mean, 0) AS BIGINT), 'fragmentation_mean': {_R2.format(c='fragmentation_mean')},
  'screen_minutes_mean': CAST(round_even(screen_minutes_mean, 0) AS BIGINT),
  'today_vs_mean': {{'deep_work_minutes': format('{{:+.0f}}', round_even(deep_work_s / 60.0::DOUBLE - deep_work_minutes_mean, 0)),
   'fragmentation': CASE WHEN fragmentation_index IS NOT NULL THEN format('{{:+.2f}}', round_even(({_R2.format(c='fragmentation_index')} - fragmentation_mean) * 100.0::DOUBLE, 0) / 100.0::DOUBLE) END,
   'screen_minutes': format('{{:+.0f}}', round_even({_MIN.format(c='screen_time_s')} - screen_minutes_mean, 0))}},
  'valid_days': valid_days, 'window_days': 30}},
 'categories': coalesce(c.x, []), 'context_version': 'v1',
 'data_quality': {{'caveats': []::VARCHAR[], 'coverage_ratio': {_R2.format(c='coverage_ratio')}, 'devices_reporting': coalesce(p.x, []),
  'offline_minutes': {_MIN.format(c='offline_s')}, 'unknown_ratio': {_R2.format(c='unknown_ratio')}, 'unobserved_minutes': {_MIN.format(c='unobserved_s')}}},
 'date': CAST(m.local_date AS VARCHAR),
 'focus': {{'average_minutes': coalesce(average_minutes, 0), 'avg_quality': coalesce(avg_quality, 0.0::DOUBLE), 'context_switches': context_switches,
  'deep_sessions': coalesce(deep_sessions, 0), 'fragmentation_index': {_R2.format(c='fragmentation_index')}, 'interruptions': interruptions,
  'longest_minutes': coalesce(longest_minutes, 0), 'sessions': coalesce(f.sessions, 0), 'switches_per_hour': round_even(switches_per_hour * 10.0::DOUBLE, 0) / 10.0::DOUBLE,
  'total_focus_minutes': coalesce(total_focus_minutes, 0)}},
 'goals': coalesce(g.x, []), 'patterns': coalesce(t.x, []), 'scope': 'day', 'time_of_day': []::VARCHAR[], 'top_attention': coalesce(a.x, []),
 'totals': {{'active_minutes': {_MIN.format(c='active_time_s')}, 'day_minutes': {_MIN.format(c='duration_s')}, 'observed_minutes': {_MIN.format(c='observed_s')},
  'screen_minutes': {_MIN.format(c='screen_time_s')}}},
 'weekday': dayname(m.local_date)}} AS doc
FROM metrics m
LEFT JOIN (SELECT user_id, local_date, list({{'avg_confidence': avg_confidence, 'category': category, 'minutes': minutes, 'sessions': sessions, 'share': share}} ORDER BY rank) AS x FROM h_cat WHERE rank <= 15 GROUP BY ALL) c USING (user_id, local_date)
LEFT JOIN (SELECT user_id, local_date, list({{'bucket': bucket, 'category': category, 'rank': rank, 'sessions': sessions}} ORDER BY rank) AS x FROM h_att WHERE rank <= 15 GROUP BY ALL) a USING (user_id, local_date)
LEFT JOIN h_foc f USING (user_id, local_date)
LEFT JOIN (SELECT user_id, local_date, list({{'aligned_minutes_today': aligned_minutes_today, 'name': name, 'priority': priority, 'target_weekly_minutes': target_weekly_minutes, 'uncertainty': uncertainty, 'week_attainment': week_attainment}} ORDER BY rank) AS x FROM h_goal GROUP BY ALL) g USING (user_id, local_date)
LEFT JOIN (SELECT user_id, list({{'occurrences': occurrences, 'status': status, 'strength': strength, 'type': type}} ORDER BY rank) AS x FROM h_pat WHERE rank <= 10 GROUP BY ALL) t USING (user_id)
LEFT JOIN base30 b USING (user_id, local_date)
LEFT JOIN (SELECT user_id, local_date, list(DISTINCT platform ORDER BY platform) AS x FROM (
  SELECT user_id, local_date, 'android' AS platform FROM coverage UNION ALL SELECT user_id, local_date, 'browser' FROM arbitrated) GROUP BY ALL) p USING (user_id, local_date)""")


def documents(c):
    """Summary documents of all user-days."""
    plan = c.plan
    wide = plan.metrics
    metrics, (_, goals, _, daily) = together(c.spark, lambda: stage(wide), lambda: goal_parts(c))
    tax = tm.taxonomy(c.spark)
    windows = go.windowed(daily, metrics, goals)
    active = go.active_goals(metrics.select(*USER_DAY), goals)
    platforms = plan.coverage.select(*USER_DAY, F.lit("android").alias("platform")).unionByName(
        plan.virtual_coverage.select(*USER_DAY, F.lit("browser").alias("platform"))
    )
    return su.document(
        metrics,
        su.category_summary(plan.current, tax, metrics, su.MAX_CATEGORIES),
        su.top_attention(plan.classified, tax, su.MAX_ATTENTION),
        su.focus_summary(plan.focus),
        su.goal_summary(active, windows),
        su.confirmed_patterns(plan.patterns, su.MAX_PATTERNS),
        tr.trailing_baseline(metrics, plan.th),
        platforms,
    )


query("h5_daily_summary_doc", f"""
SELECT user_id, {DAY}, replace(CAST(to_json(doc) AS VARCHAR), '"fragmentation":null,', '') AS doc FROM h_doc""")(
    lambda c: documents(c).withColumn("doc", su.canonical_json(F.col("doc")))
)
query("h6_summary_hash", f"""
SELECT user_id, {DAY}, sha256(replace(CAST(to_json(doc) AS VARCHAR), '"fragmentation":null,', '')) AS hash FROM h_doc""")(
    lambda c: documents(c).select(*USER_DAY, su.summary_hash(F.col("doc")).alias("hash"))
)
query("h7_day_score", f"""
SELECT user_id, {DAY}, CAST(round_even(greatest(0.0, least(100.0, CASE WHEN doc.data_quality.coverage_ratio < 0.6 THEN (raw + 50.0::DOUBLE) / 2 ELSE raw END)), 0) AS BIGINT) AS score FROM (
SELECT *, 50.0::DOUBLE + least(doc.focus.deep_sessions * 8.0::DOUBLE, 24.0) + least(doc.focus.total_focus_minutes / 10.0::DOUBLE, 15.0)
 - coalesce(doc.focus.fragmentation_index * 20.0::DOUBLE, 0.0) - least(doc.focus.interruptions * 1.5::DOUBLE, 15.0) - doc.data_quality.unknown_ratio * 15.0::DOUBLE
 + CASE WHEN len(doc.goals) > 0 THEN (least(CAST(list_sum(list_transform(doc.goals, lambda g: CAST(round_even(g.week_attainment * 100, 0) AS BIGINT))) AS BIGINT) / len(doc.goals) / 100.0::DOUBLE, 1.5) - 0.5::DOUBLE) * 10.0::DOUBLE ELSE 0.0 END AS raw
FROM h_doc)""")(lambda c: documents(c).select(*USER_DAY, su.day_score().alias("score")))

# --- V -----------------------------------------------------------------------------------------
part("ana", """SELECT seq AS analysis_id, user_id, CASE WHEN k % 2 = 0 THEN 'day' ELSE 'week' END AS scope, local_date, us AS created_us, value AS cost,
 CASE WHEN k % 3 = 0 THEN 'manual' ELSE 'scheduled' END AS triggered_by FROM ev""")


def analyses(c):
    """Analysis ledger of the sample: one row per event."""
    k = F.col("k")
    return c.events.select(
        F.col("seq").alias("analysis_id"),
        "user_id",
        F.when(k % 2 == 0, "day").otherwise("week").alias("scope"),
        "local_date",
        F.col("us").alias("created_us"),
        F.col("value").alias("cost"),
        F.when(k % 3 == 0, "manual").otherwise("scheduled").alias("triggered_by"),
    )


query("v1_day_view", f"""SELECT user_id, {DAY}, category, total_us, sessions, coverage_ratio, screen_time_s FROM metrics JOIN (
 SELECT user_id, local_date, category, sum(duration_us)::BIGINT AS total_us, count(*) AS sessions FROM acts_now GROUP BY ALL) USING (user_id, local_date)""")(
    lambda c: c.plan.metrics.select(*USER_DAY, "coverage_ratio", "screen_time_s").join(
        c.plan.current.groupBy(*USER_DAY, "category").agg(
            F.sum("duration_us").alias("total_us"), F.count(F.lit(1)).alias("sessions")
        ),
        USER_DAY,
    )
)
query("v2_timeline_per_device", f"""
SELECT user_id, device_id, {DAY}, 'coverage' AS kind, state AS label, start_us, end_us FROM coverage
UNION ALL SELECT user_id, device_id, {DAY}, 'coverage', 'TRACKED', start_us, end_us FROM arbitrated
UNION ALL SELECT user_id, device_id, {DAY}, 'session', app_key, start_us, end_us FROM app_sessions
UNION ALL SELECT user_id, device_id, {DAY}, 'session', app_key, start_us, end_us FROM arbitrated""")(lambda c: per_device(c.plan))


def per_device(plan):
    """Coverage and sessions of every device in one shape; browsers show domains and are
    tracked while one has focus."""
    def rows(df, kind, label):
        return df.select(*DEVICE_DAY, F.lit(kind).alias("kind"), label.alias("label"), "start_us", "end_us")

    browsers = plan.arbitrated
    return (
        rows(plan.coverage, "coverage", F.col("state"))
        .unionByName(rows(browsers, "coverage", F.lit("TRACKED")))
        .unionByName(rows(plan.app_sessions, "session", F.col("app_key")))
        .unionByName(rows(browsers, "session", F.col("app_key")))
    )


query("v3_timeline_unified", f"""
SELECT activity_id, {DAY}, label, start_us, end_us, is_cross_device, app_keys FROM acts_now JOIN dim_cat USING (category) JOIN (
 SELECT activity_id, array_to_string(list_sort(list(DISTINCT c.app_key)), ',') AS app_keys
 FROM (SELECT activity_id, unnest(session_ids) AS session_id FROM acts_now) a JOIN classified c USING (session_id) GROUP BY activity_id) USING (activity_id)""")(
    lambda c: c.plan.current.join(tm.taxonomy(c.spark), "category")
    .join(activity_apps(c.plan, c.plan.current), "activity_id")
    .select("activity_id", "local_date", "label", "start_us", "end_us", "is_cross_device", "app_keys")
)
query("v4_focus_list", f"SELECT user_id, {DAY}, label, start_us, end_us, is_deep FROM focus JOIN dim_cat USING (category)")(
    lambda c: c.plan.focus.join(tm.taxonomy(c.spark), "category")
    .select(*USER_DAY, "label", "start_us", "end_us", "is_deep")
    .orderBy(*USER_DAY, "start_us")
)
query("v5_latest_per_key", f"""SELECT user_id, scope, {DAY}, analysis_id, cost FROM (SELECT *, row_number() OVER
 (PARTITION BY user_id, scope, local_date ORDER BY created_us DESC, analysis_id DESC) AS z FROM ana) WHERE z = 1""")(
    lambda c: analyses(c)
    .groupBy("user_id", "scope", "local_date")
    .agg(F.max_by(F.struct("analysis_id", "cost"), F.struct("created_us", "analysis_id")).alias("a"))
    .select("user_id", "scope", "local_date", "a.analysis_id", "a.cost")
)
query("v6_recent_n", "SELECT seq, user_id, type, us FROM ev ORDER BY seq DESC LIMIT 500")(
    lambda c: c.events.select("seq", "user_id", "type", "us").orderBy(F.col("seq").desc()).limit(500)
)
query("v7_goals_sorted", """SELECT user_id, goal_id, name, row_number() OVER (PARTITION BY user_id ORDER BY priority, active_from, goal_id) AS position
 FROM goal_dim WHERE NOT archived""")(
    lambda c: tm.goals(c.events)
    .filter("not archived")
    .withColumn(
        "position",
        F.row_number().over(Window.partitionBy("user_id").orderBy("priority", "active_from", "goal_id")),
    )
    .select("user_id", "goal_id", "name", "position")
)
_NOW = 1705752000 * US  # 2024-01-20 12:00 UTC
query("v8_budget_and_triggers", f"""SELECT user_id,
 sum(CASE WHEN created_us >= 1704067200000000 AND created_us < {_NOW} THEN CAST(round_even(cost * 100, 0) AS BIGINT) ELSE 0 END)::BIGINT AS month_cents,
 count(CASE WHEN triggered_by = 'manual' AND created_us >= 1705723200000000 AND created_us < 1705809600000000 THEN 1 END) AS manual_today FROM ana GROUP BY user_id""")(
    lambda c: budget(analyses(c))
)


def budget(rows):
    """Month-to-date cost and manual runs of the local day, as of a given instant."""
    now = F.timestamp_micros(F.lit(_NOW))
    month = F.unix_micros(F.date_trunc("month", now))
    day = tc.local_date(now, F.lit(tm.TZ), F.lit(tm.DAY_START))
    a, b = tc.day_window(day, F.lit(tm.TZ), F.lit(tm.DAY_START))
    made = F.col("created_us")
    cents = F.rint(F.col("cost") * 100).cast("long")
    return rows.groupBy("user_id").agg(
        F.sum(F.when((made >= month) & (made < _NOW), cents).otherwise(0)).alias("month_cents"),
        F.count_if((F.col("triggered_by") == "manual") & (made >= a) & (made < b)).alias("manual_today"),
    )
