"""Sessions, coverage, classification, focus, patterns and daily metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from daytrace.config import DEVICE_DAY, US, USER_DAY
from daytrace.operators import coverage as cov
from daytrace.operators import focus as fo
from daytrace.operators import intervals as iv
from daytrace.operators import metrics as me
from daytrace.operators import patterns as pa
from daytrace.operators import sessions as se
from daytrace.plans.registry import query
from daytrace.sources import telemetry as tm

DAY = "CAST(local_date AS VARCHAR) AS local_date"

# --- C: sessions and intervals ---------------------------------------------------------------
query("c1_app_sessions", f"""SELECT user_id, device_id, {DAY}, app_key, start_us, end_us, interactions,
  truncated, merged_from FROM app_sessions""")(lambda c: c.plan.app_sessions)

query("c2_browser_sessions", f"""SELECT user_id, device_id, {DAY}, app_key, start_us, end_us, truncated,
  merged_from FROM web_sessions""")(lambda c: c.plan.browser_sessions.drop("browser_family"))

query("c3_coverage_intervals", f"SELECT user_id, device_id, {DAY}, start_us, end_us, state FROM coverage")(
    lambda c: c.plan.coverage
)

query("c3_silent_device_days", f"""SELECT user_id, device_id, {DAY}, start_us, end_us, 'UNOBSERVED' AS state FROM silent""")(
    lambda c: cov.silent_intervals(
        cov.silent_days(tm.enrolled_phones(c.events), c.plan.phone_events)
    )
)

part_c4 = f"""
SELECT user_id, device_id, {DAY}, state, min(start_us) AS start_us, max(end_us) AS end_us FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id, device_id, local_date ORDER BY start_us) AS i FROM (
    SELECT *, CASE WHEN lag(state) OVER d = state AND lag(end_us) OVER d = start_us THEN 0 ELSE 1 END AS new FROM (
      SELECT user_id, device_id, local_date, us AS start_us,
        coalesce(lead(us) OVER (PARTITION BY user_id, device_id, local_date ORDER BY us, seq), win_end) AS end_us,
        type AS state FROM ev)
    WINDOW d AS (PARTITION BY user_id, device_id, local_date ORDER BY start_us)))
GROUP BY user_id, device_id, local_date, state, i"""


@query("c4_coalesce_intervals", part_c4)
def _(c):
    """Stretches of equal event type: every event lasts until the next one of its device."""
    from daytrace.functions import timecols as tc
    from daytrace.operators.scan import chunked, scan

    th = c.plan.th
    ev = c.events.select(*DEVICE_DAY, "us", "seq", "type", "tz", "day_start_hour")
    ev = scan(
        chunked(ev, DEVICE_DAY, "us", th.chunk_s * US), DEVICE_DAY, ["us", "seq"],
        next_us=("lead", F.col("us")),
    )
    end = tc.day_window(F.col("local_date"), F.col("tz"), F.col("day_start_hour"))[1]
    rows = ev.select(
        *DEVICE_DAY, F.col("us").alias("start_us"), F.coalesce("next_us", end).alias("end_us"),
        F.col("type").alias("state"),
    )
    return iv_select(cov.coalesce_intervals(rows, DEVICE_DAY, th))


def iv_select(df):
    return df.select(*DEVICE_DAY, "state", "start_us", "end_us")


query("c5_coverage_ratio", f"""
SELECT user_id, device_id, {DAY}, observed_us, window_us, observed_us / window_us AS coverage_ratio FROM (
 SELECT user_id, device_id, local_date,
  sum(CASE WHEN state IN ('TRACKED','IDLE') THEN end_us - start_us ELSE 0 END)::BIGINT AS observed_us,
  sum(end_us - start_us)::BIGINT AS window_us FROM coverage GROUP BY ALL)""")(
    lambda c: cov.coverage_ratio(c.plan.coverage, DEVICE_DAY)
)
query("c6_screen_on_seconds", f"SELECT user_id, device_id, {DAY}, screen_on_us FROM screen")(
    lambda c: cov.screen_on(c.plan.states, c.plan.th)
)
query("c7_unlock_count", f"""SELECT user_id, {DAY}, count(CASE WHEN type = 'DEVICE_UNLOCK' THEN 1 END) AS unlocks
 FROM ev WHERE platform = 'android' GROUP BY user_id, local_date""")(
    lambda c: c.plan.phone_events.groupBy(*USER_DAY).agg(
        F.count_if(F.col("type") == "DEVICE_UNLOCK").alias("unlocks")
    )
)
query("c8_arbitrate_browsers", f"""SELECT user_id, device_id, {DAY}, browser_family, app_key, start_us, end_us,
 truncated, merged_from FROM arbitrated""")(lambda c: c.plan.arbitrated)
query("c9_union_duration", f"""
SELECT user_id, {DAY}, CAST(sum(greatest(end_us - greatest(start_us, coalesce(reach, start_us)), 0)) AS BIGINT) AS union_us
FROM (SELECT *, max(end_us) OVER (PARTITION BY user_id, local_date ORDER BY start_us, end_us
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM web_sessions) GROUP BY user_id, local_date""")(
    lambda c: iv.union_length(c.plan.browser_sessions, USER_DAY, c.plan.th)
)
query("c10_virtual_coverage", f"""SELECT user_id, {DAY}, start_us, end_us, 'TRACKED' AS state FROM arbitrated""")(
    lambda c: c.plan.virtual_coverage
)
query("c11_overlap_sweep", f"SELECT user_id, {DAY}, observed_us, dual_us FROM unified")(lambda c: c.plan.unified)
query("c12_cluster_cross_device", f"""SELECT user_id, {DAY}, category, start_us, end_us, duration_us, confidence, members,
  devices, is_cross_device, array_to_string(session_ids, ',') AS session_ids FROM activities""")(
    lambda c: c.plan.activities.select(
        *USER_DAY, "category", "start_us", "end_us", "duration_us", "confidence", "members", "devices",
        "is_cross_device", "session_ids",
    )
)
query("c13_dominant_member", "SELECT activity_id, dominant_id, source, evidence, other_ids FROM acts")(
    lambda c: c.plan.activities.select("activity_id", "dominant_id", "source", "evidence", "other_ids")
)


@query("c14_app_dwell_summary", """SELECT user_id, device_id, app_key, CAST(sum(end_us - start_us) AS BIGINT) AS total_us,
  count(*) AS opens FROM dwells GROUP BY ALL""")
def _(c):
    from daytrace.functions import timecols as tc

    end = tc.day_window(F.col("local_date"), F.lit(tm.TZ), F.lit(tm.DAY_START))[1]
    return se.dwell_summary(se.app_dwells(c.plan.phone_events, c.plan.th, end))


query("c15_no_overlap_check", f"""SELECT user_id, device_id, {DAY}, start_us, end_us, next_start FROM (
  SELECT *, lead(start_us) OVER (PARTITION BY user_id, local_date ORDER BY start_us, device_id) AS next_start FROM web_sessions)
  WHERE next_start < end_us""")(
    lambda c: cov.overlaps(c.plan.browser_sessions, c.plan.th, USER_DAY, ["start_us", "device_id"])
)
query("c16_poll_cadence", """SELECT user_id, device_id, count(*) AS polls,
  CASE WHEN count(*) > 1 THEN avg(gap) END AS mean_gap_us FROM (
  SELECT user_id, device_id, us - lag(us) OVER (PARTITION BY user_id, device_id ORDER BY us, seq) AS gap FROM ev) GROUP BY ALL""")(
    lambda c: cov.poll_cadence(c.events)
)


@query("c17_idle_media_exemption", f"SELECT user_id, device_id, {DAY}, start_us, end_us, state FROM coverage_media")
def _(c):
    states = cov.signal_states(c.plan.phone_events, c.plan.th, media_apps=["app_2", "app_3"])
    return cov.coverage_intervals(states, c.plan.th, exempt=F.col("media"))


# --- J4, D: classification --------------------------------------------------------------------
query("d1_classify_layers", f"""SELECT user_id, device_id, {DAY}, app_key, start_us, category, confidence, source, evidence
 FROM classified_apps""")(
    lambda c: c.plan.classified_apps.select(
        *DEVICE_DAY, "app_key", "start_us", "category", "confidence", "source", "evidence"
    )
)
query("d2_followed_by_work", f"""SELECT user_id, device_id, {DAY}, app_key, start_us, coalesce(followed, false) AS followed
 FROM app_priors LEFT JOIN fw USING (user_id, device_id, local_date, i) WHERE is_media""")(
    lambda c: c.plan.followed.filter("is_media").select(*DEVICE_DAY, "app_key", "start_us", "followed")
)
query("d7_domain_classify", f"""SELECT user_id, device_id, {DAY}, app_key, start_us, category, confidence, source, evidence
 FROM classified_domains""")(
    lambda c: c.plan.classified_domains.select(
        *DEVICE_DAY, "app_key", "start_us", "category", "confidence", "source", "evidence"
    )
)

# --- E: focus ---------------------------------------------------------------------------------
query("e1_switch_counts", f"""SELECT user_id, {DAY}, count(CASE WHEN prev_category <> category THEN 1 END) AS context_switches,
  count(CASE WHEN prev_category = category AND prev_app <> app_key THEN 1 END) AS tool_switches
  FROM classified GROUP BY user_id, local_date""")(lambda c: fo.switch_counts(c.plan.classified))
query("e2_interruption_flag", f"""SELECT session_id, {DAY}, coalesce(prev_category <> category AND
  (category = 'communication' OR len < 1200000000), false) AS interrupts FROM classified""")(
    lambda c: fo.interruption_flags(c.plan.classified, c.plan.th).select("session_id", "local_date", "interrupts")
)
query("e3_focus_sessions", f"""SELECT user_id, {DAY}, category, start_us, end_us, interruptions, tool_switches,
  attributed_ratio, is_deep FROM focus""")(lambda c: c.plan.focus)
query("e4_focus_quality", f"SELECT user_id, {DAY}, start_us, round(quality, 9) AS quality FROM focus_q")(
    lambda c: c.plan.focus.select(*USER_DAY, "start_us", F.round(fo.quality(), 9).alias("quality"))
)
query("e5_fragmentation_index", f"""SELECT user_id, {DAY}, round(fragmentation_index, 9) AS fragmentation_index FROM metrics""")(
    lambda c: c.plan.metrics.select(*USER_DAY, F.round("fragmentation_index", 9).alias("fragmentation_index"))
)

# --- P: patterns ------------------------------------------------------------------------------
_OCC = f"SELECT user_id, {DAY}, pattern, start_us, end_us, strength, app_key, n, measure FROM"
query("p1_distraction_burst", f"{_OCC} bursts")(lambda c: c.plan.bursts)
query("p2_habitual_checking", f"{_OCC} habits")(lambda c: pa.habitual_checking(c.plan.classified, c.plan.th))
query("p3_switch_storm", f"{_OCC} storms")(lambda c: pa.switch_storms(c.plan.classified, c.plan.th))
query("p4_post_task_avoidance", f"{_OCC} avoids")(lambda c: pa.post_task_avoidance(c.plan.classified, c.plan.th))
query("p5_pattern_promotion", "SELECT * FROM patterns")(lambda c: c.plan.patterns)

# --- M: metrics -------------------------------------------------------------------------------
query("m1_daily_metrics", f"""SELECT * EXCLUDE (local_date, fragmentation_index), {DAY},
  round(fragmentation_index, 9) AS fragmentation_index FROM metrics""")(
    lambda c: c.plan.metrics.withColumn("fragmentation_index", F.round("fragmentation_index", 9))
)
query("m2_category_totals", f"""SELECT user_id, {DAY}, category, sum(len)::BIGINT AS total_us, count(*) AS sessions
 FROM classified GROUP BY user_id, local_date, category""")(lambda c: me.category_totals(c.plan.classified))
query("m3_work_partition", f"""SELECT user_id, {DAY}, work_us, coalesce(deep_us, 0) AS deep_us, coalesce(focused_us, 0) AS focused_us,
 greatest(work_us - coalesce(deep_us, 0) - coalesce(focused_us, 0), 0) AS shallow_us
 FROM m_ses LEFT JOIN m_focus USING (user_id, local_date)""")(
    lambda c: me.work_partition(c.plan.classified, c.plan.focus)
)
query("m4_median_work_block", f"""SELECT user_id, {DAY}, median(len) AS median_us FROM classified WHERE is_work
 GROUP BY user_id, local_date""")(lambda c: me.work_median(c.plan.classified))
query("m5_distraction_seconds", f"SELECT user_id, {DAY}, distraction_us FROM burst_span")(
    lambda c: me.burst_span(c.plan.bursts, c.plan.th)
)
