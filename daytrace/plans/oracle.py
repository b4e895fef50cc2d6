"""Equivalent SQL (DuckDB dialect) of the registered queries, composed from named parts."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def compose(final: str) -> str:
    """Prefix a statement with the parts it refers to, in dependency order."""
    done: list[str] = []

    def need(sql: str, me: str | None = None) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", sql)):
            if word in PARTS and word != me and word not in done:
                need(PARTS[word], word)
                if word not in done:
                    done.append(word)

    need(final)
    if not done:
        return final.strip()
    ctes = ",\n".join(f"{n} AS ({PARTS[n]})" for n in done)
    return f"WITH RECURSIVE {ctes}\n{final.strip()}"


# --- telemetry ----------------------------------------------------------------------------
part("raw_k", """
SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
FROM events""")
part("ev", """
SELECT user_id // 15 AS user_id,
       CASE WHEN user_id % 3 = 2 THEN 2 + (user_id % 15) // 5 ELSE user_id % 3 END AS device_id,
       CASE WHEN user_id % 3 = 2 THEN 'browser' ELSE 'android' END AS platform,
       CASE WHEN user_id % 3 = 2
            THEN CASE (user_id % 15) // 5 WHEN 0 THEN 'brave' WHEN 1 THEN 'chromium' ELSE 'firefox' END
       END AS browser_family,
       event_id AS seq, epoch_us(ts) AS us, CAST(ts - INTERVAL 4 HOUR AS DATE) AS local_date,
       event_type, value, k,
       CASE WHEN user_id % 3 = 2 THEN
              CASE event_type WHEN 'view' THEN 'DOMAIN_FOCUS_START'
                              WHEN 'purchase' THEN 'DOMAIN_FOCUS_END' ELSE 'HEALTH' END
            WHEN event_type = 'view' THEN 'APP_FOREGROUND'
            WHEN event_type = 'purchase' THEN CASE WHEN k < 50 THEN 'APP_FOREGROUND' ELSE 'APP_BACKGROUND' END
            WHEN event_type = 'click' THEN 'USER_INTERACTION'
            WHEN event_type = 'signup' THEN CASE WHEN k < 80 THEN 'SCREEN_ON' ELSE 'DEVICE_UNLOCK' END
            WHEN k < 60 THEN 'SCREEN_OFF' WHEN k < 80 THEN 'DEVICE_LOCK'
            WHEN k < 86 THEN 'DEVICE_SHUTDOWN' WHEN k < 93 THEN 'DEVICE_STARTUP'
            WHEN k < 95 THEN 'COLLECTOR_STOP' ELSE 'COLLECTOR_START' END AS type,
       CASE WHEN event_type IN ('view', 'purchase') THEN 'app_' || (k % 8) END AS key,
       epoch_us(CAST(ts - INTERVAL 4 HOUR AS DATE)::TIMESTAMP) + 14400000000 AS win_start,
       epoch_us(CAST(ts - INTERVAL 4 HOUR AS DATE)::TIMESTAMP) + 14400000000 + 86400000000 AS win_end
FROM raw_k""")
part("seeds", """
SELECT * FROM (VALUES ('app_0','development',0.75::DOUBLE), ('app_1','communication',0.72),
  ('app_2','entertainment',0.60), ('app_3','social',0.65), ('app_4','browsing',0.55),
  ('app_5','writing',0.50), ('app_7','learning',0.70)) t(app_key, seed_category, seed_conf)""")
part("dim_cat", """
SELECT * FROM (VALUES ('work',NULL,'Work',false), ('deep_work','work','Deep Work',false),
 ('focused_work','work','Focused Work',false), ('development','work','Development',false),
 ('research','work','Research',false), ('writing','work','Writing',false),
 ('meetings','work','Meetings',false), ('admin','work','Admin',false),
 ('growth',NULL,'Growth',false), ('learning','growth','Learning',false),
 ('reading','growth','Reading',false), ('practice','growth','Practice',false),
 ('connection',NULL,'Connection',false), ('communication','connection','Communication',false),
 ('social','connection','Social',false), ('life',NULL,'Life',false),
 ('personal','life','Personal',false), ('exercise','life','Exercise',false),
 ('health','life','Health',false), ('errands','life','Errands',false),
 ('consumption',NULL,'Consumption',false), ('entertainment','consumption','Entertainment',false),
 ('browsing','consumption','Browsing',false), ('system',NULL,'System',true),
 ('idle','system','Idle',true), ('unobserved','system','Unobserved',true),
 ('offline','system','Offline',true), ('unknown','system','Unknown',true))
 t(category, parent, label, is_system)""")
part("rules", """
SELECT DISTINCT user_id, 'app_4' AS app_key, 'reading' AS rule_category FROM ev WHERE user_id % 7 = 0""")
part("learned", """
SELECT DISTINCT user_id, 'app_6' AS app_key, 'research' AS learned_category, 0.83::DOUBLE AS learned_conf,
  CASE WHEN user_id % 2 = 0 THEN 4 ELSE 5 END AS samples FROM ev WHERE user_id % 5 = 1""")

# --- sessions -----------------------------------------------------------------------------
def _session_parts(prefix: str, source: str, opens: str, same: str, any_: str, inter: str) -> None:
    part(f"{prefix}_g", f"""
SELECT *, row_number() OVER d AS rn,
  count(CASE WHEN type = '{opens}' AND key IS NOT NULL THEN 1 END) OVER (d ROWS UNBOUNDED PRECEDING) AS g
FROM ev WHERE platform = '{source}' WINDOW d AS (PARTITION BY user_id, device_id, local_date ORDER BY us, seq)""")
    part(f"{prefix}_h", f"""
SELECT *, first_value(key) OVER (PARTITION BY user_id, device_id, local_date, g ORDER BY rn) AS app
FROM {prefix}_g WHERE g > 0""")
    part(f"{prefix}_c", f"""
SELECT *, (type IN ({any_}) OR (type = '{same}' AND key = app)) AS closes,
  min(CASE WHEN type IN ({any_}) OR (type = '{same}' AND key = app) THEN rn END)
    OVER (PARTITION BY user_id, device_id, local_date, g) AS close_rn
FROM {prefix}_h""")
    part(f"{prefix}_o", f"""
SELECT user_id, device_id, local_date, g, app, min(us) AS o_us,
  min(CASE WHEN rn = close_rn THEN us END) AS closer_us,
  count(CASE WHEN type = '{inter}' AND (close_rn IS NULL OR rn < close_rn) THEN 1 END) AS n
FROM {prefix}_c GROUP BY ALL""")
    part(f"{prefix}_p", f"""
SELECT *, CASE WHEN lag(app) OVER d = app AND lag(closer_us) OVER d IS NULL THEN 0 ELSE 1 END AS first
FROM {prefix}_o WINDOW d AS (PARTITION BY user_id, device_id, local_date ORDER BY g)""")
    part(f"{prefix}_s", f"""
SELECT *, sum(first) OVER (PARTITION BY user_id, device_id, local_date ORDER BY g) AS s FROM {prefix}_p""")
    part(f"{prefix}_last", f"""
SELECT user_id, device_id, local_date, max(us) AS last_us FROM ev WHERE platform = '{source}' GROUP BY ALL""")
    part(f"{prefix}_raw", f"""
SELECT user_id, device_id, local_date, s, app, min(o_us) AS start_us, max(closer_us) AS closer_us,
  sum(n) AS n FROM {prefix}_s GROUP BY ALL""")
    part(f"{prefix}_end", f"""
SELECT r.*, lead(start_us) OVER (PARTITION BY user_id, device_id, local_date ORDER BY s) AS next_us, last_us
FROM {prefix}_raw r JOIN {prefix}_last USING (user_id, device_id, local_date)""")
    part(f"{prefix}_kept", f"""
SELECT user_id, device_id, local_date, app, start_us, n,
  least(coalesce(closer_us, next_us, last_us), start_us + 144000000000) AS end_us,
  coalesce(closer_us, next_us, last_us) > start_us + 144000000000
    OR (closer_us IS NULL AND next_us IS NULL) AS truncated
FROM {prefix}_end
WHERE least(coalesce(closer_us, next_us, last_us), start_us + 144000000000) - start_us >= 30000000""")
    part(f"{prefix}_m", f"""
SELECT *, CASE WHEN lag(app) OVER d = app AND start_us - lag(end_us) OVER d < 300000000 THEN 0 ELSE 1 END AS new
FROM {prefix}_kept WINDOW d AS (PARTITION BY user_id, device_id, local_date ORDER BY start_us)""")
    part(f"{prefix}_mg", f"""
SELECT *, sum(new) OVER (PARTITION BY user_id, device_id, local_date ORDER BY start_us) AS grp FROM {prefix}_m""")
    part(f"{prefix}_sessions", f"""
SELECT user_id, device_id, local_date, app AS app_key, min(start_us) AS start_us, max(end_us) AS end_us,
  CAST(sum(n) AS BIGINT) AS interactions, arg_max(truncated, start_us) AS truncated, count(*) AS merged_from
FROM {prefix}_mg GROUP BY user_id, device_id, local_date, app, grp""")


_session_parts("app", "android", "APP_FOREGROUND", "APP_BACKGROUND",
               "'SCREEN_OFF','DEVICE_LOCK','DEVICE_SHUTDOWN','COLLECTOR_STOP'", "USER_INTERACTION")
_session_parts("web", "browser", "DOMAIN_FOCUS_START", "DOMAIN_FOCUS_END", "'-'", "-")

part("arb_o", """
SELECT w.*, browser_family,
  lag(browser_family) OVER d IS NOT NULL AND lag(browser_family) OVER d <> browser_family AS new
FROM web_sessions w JOIN (SELECT user_id, device_id, min(browser_family) AS browser_family FROM ev
  WHERE platform = 'browser' GROUP BY ALL) USING (user_id, device_id)
WINDOW d AS (PARTITION BY user_id, local_date ORDER BY start_us, device_id)""")
part("arb_r", """
SELECT *, min(CASE WHEN new THEN start_us END) OVER (PARTITION BY user_id, local_date
  ORDER BY start_us, device_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM arb_o""")
part("arbitrated", """
SELECT user_id, device_id, local_date, browser_family, app_key, start_us,
  least(end_us, coalesce(next_start, end_us)) AS end_us,
  truncated OR coalesce(end_us > next_start, false) AS truncated, merged_from
FROM arb_r WHERE least(end_us, coalesce(next_start, end_us)) > start_us""")

# --- dwell (phone view) -------------------------------------------------------------------
part("dw_g", """
SELECT *, row_number() OVER d AS rn,
  count(CASE WHEN type = 'APP_FOREGROUND' AND key IS NOT NULL THEN 1 END) OVER (d ROWS UNBOUNDED PRECEDING) AS g
FROM ev WHERE platform = 'android' WINDOW d AS (PARTITION BY user_id, device_id, local_date ORDER BY us, seq)""")
part("dw_h", """
SELECT *, first_value(key) OVER (PARTITION BY user_id, device_id, local_date, g ORDER BY rn) AS app,
  min(CASE WHEN type IN ('SCREEN_OFF','DEVICE_LOCK','DEVICE_SHUTDOWN') THEN rn END)
    OVER (PARTITION BY user_id, device_id, local_date, g) AS close_rn
FROM dw_g WHERE g > 0""")
part("dw_o", """
SELECT user_id, device_id, local_date, g, app, win_end, min(us) AS o_us,
  min(CASE WHEN rn = close_rn THEN us END) AS closer_us,
  max(CASE WHEN type = 'APP_BACKGROUND' AND key = app AND (close_rn IS NULL OR rn < close_rn) THEN us END) AS soft
FROM dw_h GROUP BY ALL""")
part("dw_p", """
SELECT *, CASE WHEN lag(app) OVER d = app AND lag(closer_us) OVER d IS NULL
    AND o_us - lag(soft) OVER d <= 300000000 THEN 0 ELSE 1 END AS first,
  lead(o_us) OVER d AS next_open
FROM dw_o WINDOW d AS (PARTITION BY user_id, device_id, local_date ORDER BY g)""")
part("dw_s", """
SELECT *, sum(first) OVER (PARTITION BY user_id, device_id, local_date ORDER BY g) AS s FROM dw_p""")
part("dwells", """
SELECT user_id, device_id, local_date, app AS app_key, min(o_us) AS start_us,
  least(arg_max(coalesce(soft, closer_us, next_open, win_end), g), min(o_us) + 144000000000) AS end_us
FROM dw_s GROUP BY user_id, device_id, local_date, app, s""")

# --- coverage -----------------------------------------------------------------------------
part("sig", """
SELECT user_id, device_id, local_date, win_start, win_end, us, seq, type, key,
  last_value(CASE WHEN type = 'SCREEN_ON' THEN 1 WHEN type IN ('SCREEN_OFF','DEVICE_LOCK','DEVICE_SHUTDOWN') THEN 0 END IGNORE NULLS) OVER d AS screen,
  last_value(CASE WHEN type = 'DEVICE_SHUTDOWN' THEN 1 WHEN type = 'DEVICE_STARTUP' THEN 0 END IGNORE NULLS) OVER d AS down,
  last_value(CASE WHEN type = 'COLLECTOR_STOP' THEN 0 WHEN type = 'COLLECTOR_START' THEN 1 END IGNORE NULLS) OVER d AS alive,
  last_value(CASE WHEN type = 'USER_INTERACTION' THEN us WHEN type IN ('SCREEN_ON','SCREEN_OFF','DEVICE_LOCK') THEN -1 END IGNORE NULLS) OVER d AS touched,
  last_value(CASE WHEN type = 'SCREEN_ON' THEN us WHEN type IN ('SCREEN_OFF','DEVICE_LOCK') THEN -1 END IGNORE NULLS) OVER d AS on_since,
  last_value(CASE WHEN type = 'SCREEN_ON' THEN 1 WHEN type IN ('SCREEN_OFF','DEVICE_LOCK') THEN 0 END IGNORE NULLS) OVER d AS lit,
  last_value(CASE WHEN type = 'APP_FOREGROUND' THEN CASE WHEN key IN ('app_2','app_3') THEN 1 ELSE 0 END
                  WHEN type = 'APP_BACKGROUND' THEN 0 END IGNORE NULLS) OVER d AS media,
  lead(us) OVER (PARTITION BY user_id, device_id, local_date ORDER BY us, seq) AS next_us
FROM ev WHERE platform = 'android'
WINDOW d AS (PARTITION BY user_id, device_id, local_date ORDER BY us, seq ROWS UNBOUNDED PRECEDING)""")


def _coverage_parts(prefix: str, exempt: str) -> None:
    part(f"{prefix}_seg", f"""
SELECT *, us AS a, coalesce(next_us, win_end) AS b,
  CASE WHEN {exempt} THEN coalesce(next_us, win_end)
       ELSE coalesce(CASE WHEN touched >= 0 THEN touched END, CASE WHEN on_since >= 0 THEN on_since END, us) + 3000000000 END AS idle_at,
  CASE WHEN alive = 0 THEN 'UNOBSERVED' WHEN down = 1 THEN 'DEVICE_OFFLINE'
       WHEN coalesce(screen, 0) = 0 THEN 'TRACKED'
       WHEN coalesce(next_us, win_end) - us >= 18000000000 THEN 'UNOBSERVED' END AS fixed
FROM sig""")
    part(f"{prefix}_pieces", f"""
SELECT user_id, device_id, local_date, a AS start_us, b AS end_us, fixed AS state FROM {prefix}_seg WHERE fixed IS NOT NULL
UNION ALL SELECT user_id, device_id, local_date, a, least(greatest(idle_at, a), b), 'TRACKED' FROM {prefix}_seg WHERE fixed IS NULL
UNION ALL SELECT user_id, device_id, local_date, least(greatest(idle_at, a), b), b, 'IDLE' FROM {prefix}_seg WHERE fixed IS NULL
UNION ALL SELECT user_id, device_id, local_date, win_start, min(us), 'UNOBSERVED' FROM sig GROUP BY ALL""")
    part(f"{prefix}_f", f"""
SELECT *, CASE WHEN lag(state) OVER d = state AND lag(end_us) OVER d = start_us THEN 0 ELSE 1 END AS new
FROM {prefix}_pieces WHERE end_us > start_us
WINDOW d AS (PARTITION BY user_id, device_id, local_date ORDER BY start_us)""")
    part(f"{prefix}_i", f"""
SELECT *, sum(new) OVER (PARTITION BY user_id, device_id, local_date ORDER BY start_us) AS i FROM {prefix}_f""")
    part(prefix, f"""
SELECT user_id, device_id, local_date, min(start_us) AS start_us, max(end_us) AS end_us, state
FROM {prefix}_i GROUP BY user_id, device_id, local_date, state, i""")


_coverage_parts("coverage_seen", "false")
part("silent", """
SELECT user_id, device_id, d AS local_date, epoch_us(d::TIMESTAMP) + 14400000000 AS start_us, epoch_us(d::TIMESTAMP) + 100800000000 AS end_us
FROM (SELECT user_id, device_id, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM
  (SELECT DISTINCT user_id, device_id FROM ev WHERE platform = 'android') JOIN
  (SELECT user_id, min(local_date) AS lo, max(local_date) AS hi FROM ev GROUP BY user_id) USING (user_id)) x
WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id = x.user_id AND e.device_id = x.device_id AND e.local_date = x.d)""")
part("coverage", """
SELECT user_id, device_id, local_date, start_us, end_us, state FROM coverage_seen
UNION ALL SELECT user_id, device_id, local_date, start_us, end_us, 'UNOBSERVED' FROM silent""")
_coverage_parts("coverage_media", "media = 1")
part("screen", """
SELECT user_id, device_id, local_date, CAST(sum(CASE WHEN lit = 1 THEN coalesce(next_us,
  least(win_end, us + 18000000000)) - us ELSE 0 END) AS BIGINT) AS screen_on_us FROM sig GROUP BY ALL""")

# --- classification -----------------------------------------------------------------------
part("app_priors", """
SELECT s.*, rule_category, learned_category, learned_conf, samples, seed_category, seed_conf,
  CASE WHEN rule_category IS NOT NULL THEN rule_category WHEN samples >= 5 THEN learned_category
       WHEN seed_category IS NULL OR seed_conf < 0.55 THEN 'unknown' ELSE seed_category END AS key_category,
  rule_category IS NULL AND coalesce(samples, 0) < 5 AND coalesce(seed_category = 'entertainment', false) AS is_media,
  row_number() OVER (PARTITION BY user_id, device_id, local_date ORDER BY start_us) AS i
FROM app_sessions s LEFT JOIN seeds USING (app_key) LEFT JOIN rules USING (user_id, app_key)
LEFT JOIN learned USING (user_id, app_key)""")
part("fw_pairs", """
SELECT a.user_id, a.device_id, a.local_date, a.i AS i, b.i AS j, a.end_us AS end_i,
  b.start_us, b.end_us - b.start_us AS len,
  b.key_category IN ('deep_work','focused_work','development','research','writing')
   AND b.app_key IN (SELECT c.app_key FROM app_priors c WHERE c.user_id = a.user_id AND c.device_id = a.device_id
     AND c.local_date = a.local_date AND c.i > a.i AND c.i <= a.i + 5) AS work
FROM app_priors a JOIN app_priors b ON a.user_id = b.user_id AND a.device_id = b.device_id
 AND a.local_date = b.local_date AND b.i > a.i WHERE a.is_media""")
part("fw_first", """
SELECT user_id, device_id, local_date, i, min(j) AS f FROM fw_pairs
WHERE work AND start_us < end_i + 9000000000 GROUP BY ALL""")
part("fw_stop", """
SELECT user_id, device_id, local_date, i, f, min(CASE WHEN NOT work AND j > f THEN j END) AS z
FROM fw_first JOIN fw_pairs USING (user_id, device_id, local_date, i) GROUP BY ALL""")
part("fw", """
SELECT user_id, device_id, local_date, i, sum(len) >= 18000000000 AS followed
FROM fw_stop JOIN fw_pairs USING (user_id, device_id, local_date, i)
WHERE j >= f AND (z IS NULL OR j < z) GROUP BY ALL""")
part("classified_apps", """
SELECT user_id, device_id, local_date, app_key, start_us, end_us, 'android' AS platform,
  CASE WHEN rule_category IS NOT NULL THEN rule_category WHEN samples >= 5 THEN learned_category
    WHEN is_media AND coalesce(followed, false) THEN 'learning' ELSE key_category END AS category,
  CASE WHEN rule_category IS NOT NULL THEN 1.0 WHEN samples >= 5 THEN learned_conf
    WHEN is_media AND coalesce(followed, false) THEN 0.68 ELSE coalesce(seed_conf, 0.0) END AS confidence,
  CASE WHEN rule_category IS NOT NULL THEN 'user' WHEN samples >= 5 THEN 'learned'
    WHEN is_media AND coalesce(followed, false) THEN 'context'
    WHEN seed_category IS NULL OR seed_conf < 0.55 THEN 'unknown' ELSE 'seed' END AS source,
  CASE WHEN rule_category IS NOT NULL THEN 'l0_user_rule' WHEN samples >= 5 THEN 'l1_learned_prior'
    WHEN seed_category IS NULL THEN 'l4_no_seed_entry'
    WHEN is_media AND coalesce(followed, false) THEN 'l2_seed_catalogue,l3_followed_by_development'
    WHEN seed_conf < 0.55 THEN 'l2_seed_catalogue,l4_below_floor' ELSE 'l2_seed_catalogue' END AS evidence
FROM app_priors LEFT JOIN fw USING (user_id, device_id, local_date, i)""")
part("classified_domains", """
SELECT user_id, device_id, local_date, app_key, start_us, end_us, 'browser' AS platform,
  CASE WHEN seed_category IS NULL OR seed_conf < 0.55 THEN 'unknown' ELSE seed_category END AS category,
  coalesce(seed_conf, 0.0) AS confidence,
  CASE WHEN seed_category IS NULL OR seed_conf < 0.55 THEN 'unknown' ELSE 'seed' END AS source,
  CASE WHEN seed_category IS NULL THEN 'l4_no_seed_entry' WHEN seed_conf < 0.55
    THEN 'l2_seed_catalogue,l4_below_floor' ELSE 'l2_seed_catalogue' END AS evidence
FROM arbitrated LEFT JOIN seeds USING (app_key)""")
part("classified", """
SELECT *, user_id || ':' || device_id || ':' || start_us AS session_id, end_us - start_us AS len,
  category IN ('deep_work','focused_work','development','research','writing','meetings','admin') AS is_work,
  row_number() OVER d AS idx, lag(category) OVER d AS prev_category, lag(app_key) OVER d AS prev_app
FROM (SELECT * FROM classified_apps UNION ALL SELECT * FROM classified_domains)
WINDOW d AS (PARTITION BY user_id, local_date ORDER BY start_us, device_id)""")

# --- clustering ---------------------------------------------------------------------------
part("cl_rows", """
SELECT *, row_number() OVER (PARTITION BY user_id, local_date, category ORDER BY start_us, device_id) AS n
FROM classified""")
part("cl_rec", """
SELECT user_id, local_date, category, n, [{'c': 1, 'd': device_id, 'e': end_us}] AS m, 1 AS cluster, 1 AS top, session_id
FROM cl_rows WHERE n = 1
UNION ALL
SELECT x.user_id, x.local_date, x.category, x.n,
  list_append(r.m, {'c': coalesce(x.hit, r.top + 1), 'd': x.device_id, 'e': x.end_us}),
  coalesce(x.hit, r.top + 1), CASE WHEN x.hit IS NULL THEN r.top + 1 ELSE r.top END, x.session_id
FROM (SELECT b.*, list_min(list_transform(list_filter(r.m, lambda q: q.d <> b.device_id AND b.start_us - q.e <= 3000000000), lambda q: q.c)) AS hit
      FROM cl_rec r JOIN cl_rows b ON b.user_id = r.user_id AND b.local_date = r.local_date AND b.category = r.category AND b.n = r.n + 1) x
JOIN cl_rec r ON x.user_id = r.user_id AND x.local_date = r.local_date AND x.category = r.category AND x.n = r.n + 1""")
part("clustered", """
SELECT c.*, r.cluster FROM cl_rows c JOIN cl_rec r USING (user_id, local_date, category, n)""")
part("cl_reach", """
SELECT *, max(end_us) OVER (PARTITION BY user_id, local_date, category, cluster ORDER BY start_us, device_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM clustered""")
part("activities", """
SELECT user_id, local_date, category, min(start_us) AS start_us, max(end_us) AS end_us,
  CAST(sum(greatest(end_us - greatest(start_us, coalesce(reach, start_us)), 0)) AS BIGINT) AS duration_us,
  CASE WHEN count(*) = 1 THEN max(confidence)
       ELSE CAST(sum(CAST(round_even(confidence * len, 0) AS BIGINT)) AS BIGINT) / CAST(sum(len) AS BIGINT) END AS confidence,
  count(*) AS members, count(DISTINCT device_id) AS devices, count(DISTINCT device_id) > 1 AS is_cross_device,
  arg_max({'s': source, 'e': evidence, 'i': session_id}, {'a': len, 'b': -start_us, 'c': -device_id}) AS dom,
  list(session_id ORDER BY start_us, device_id) AS session_ids,
  min(CASE WHEN platform = 'android' THEN app_key END) AS app_key
FROM cl_reach GROUP BY user_id, local_date, category, cluster""")
part("acts", """
SELECT * EXCLUDE (dom), dom.s AS source, dom.e AS evidence, dom.i AS dominant_id,
  user_id || ':' || category || ':' || start_us || ':' || dom.i AS activity_id,
  array_to_string(list_filter(session_ids, lambda x: x <> dom.i), ',') AS other_ids
FROM activities""")

part("acts_now", """
SELECT * REPLACE (CASE WHEN category = 'unknown' AND members = 1 THEN 'reading' ELSE category END AS category,
  CASE WHEN category = 'unknown' AND members = 1 THEN 1.0::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN category = 'unknown' AND members = 1 THEN 'user' ELSE source END AS source,
  CASE WHEN category = 'unknown' AND members = 1 THEN activity_id || '+' ELSE activity_id END AS activity_id)
FROM acts""")

# --- unions and sweeps ----------------------------------------------------------------------
part("spans", """
SELECT user_id, local_date, start_us, end_us FROM coverage WHERE state IN ('TRACKED','IDLE')
UNION ALL SELECT user_id, local_date, start_us, end_us FROM arbitrated""")
part("sweep_edges", """
SELECT user_id, local_date, t_us, sum(d) AS d FROM (
  SELECT user_id, local_date, start_us AS t_us, 1 AS d FROM spans
  UNION ALL SELECT user_id, local_date, end_us, -1 FROM spans) GROUP BY ALL""")
part("sweep_run", """
SELECT *, sum(d) OVER w AS active, lead(t_us) OVER w - t_us AS span FROM sweep_edges
WINDOW w AS (PARTITION BY user_id, local_date ORDER BY t_us)""")
part("unified", """
SELECT user_id, local_date, CAST(sum(CASE WHEN active >= 1 THEN coalesce(span, 0) ELSE 0 END) AS BIGINT) AS observed_us,
  CAST(sum(CASE WHEN active >= 2 THEN coalesce(span, 0) ELSE 0 END) AS BIGINT) AS dual_us
FROM sweep_run GROUP BY ALL""")

# --- focus ----------------------------------------------------------------------------------
part("fo_rec", """
SELECT user_id, local_date, idx AS i, idx AS j, category AS cat, app_key AS tail_app, start_us AS s0,
  end_us AS last, len AS work, 0 AS breaks, CAST(NULL AS BIGINT) AS broke_at, 0 AS tools
FROM classified
UNION ALL
SELECT r.user_id, r.local_date, r.i, c.idx, r.cat,
  CASE WHEN c.category = r.cat THEN c.app_key ELSE r.tail_app END, r.s0,
  CASE WHEN c.category = r.cat THEN c.end_us ELSE r.last END,
  CASE WHEN c.category = r.cat THEN r.work + c.len ELSE r.work END,
  CASE WHEN c.category = r.cat THEN r.breaks ELSE r.breaks + 1 END,
  CASE WHEN c.category = r.cat THEN r.broke_at ELSE c.start_us END,
  CASE WHEN c.category = r.cat AND c.app_key <> r.tail_app THEN r.tools + 1 ELSE r.tools END
FROM fo_rec r JOIN classified c ON c.user_id = r.user_id AND c.local_date = r.local_date AND c.idx = r.j + 1
WHERE c.category = r.cat OR ((c.category = 'communication' OR c.len < 1200000000) AND c.len <= 900000000
  AND (r.broke_at IS NULL OR c.start_us - r.broke_at >= 3000000000))""")
part("fo_block", """
SELECT *, last - s0 AS span, CASE WHEN last > s0 THEN work / (last - s0) ELSE 0.0 END AS ratio
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, local_date, i ORDER BY j DESC) AS rk FROM fo_rec) WHERE rk = 1""")
part("fo_ok", """
SELECT *, row_number() OVER (PARTITION BY user_id, local_date ORDER BY i) AS q FROM fo_block
WHERE span >= 9000000000 AND breaks <= greatest(1.0, span / 9000000000) AND ratio >= 0.80""")
part("fo_pick", """
SELECT user_id, local_date, i, j, q FROM fo_ok WHERE q = 1
UNION ALL
SELECT p.user_id, p.local_date, o.i, o.j, o.q FROM fo_pick p
JOIN fo_ok o ON o.user_id = p.user_id AND o.local_date = p.local_date AND o.q =
  (SELECT min(z.q) FROM fo_ok z WHERE z.user_id = p.user_id AND z.local_date = p.local_date AND z.i > p.j)""")
part("focus", """
SELECT user_id, local_date, cat AS category, s0 AS start_us, last AS end_us, CAST(breaks AS BIGINT) AS interruptions,
  CAST(tools AS BIGINT) AS tool_switches, ratio AS attributed_ratio,
  span >= 27000000000 AND breaks <= 1 AND tools / greatest(span / 1000000 / 3600, 1 / 3600) <= 2.0
   AND ratio >= 0.90 AND cat IN ('deep_work','focused_work','development','research','writing','meetings','admin') AS is_deep
FROM fo_ok JOIN fo_pick USING (user_id, local_date, i, j)""")
part("focus_q", """
SELECT *, 0.35 * least((end_us - start_us) / 60000000.0::DOUBLE / 60, 1.0)
 + 0.25 * (1 - interruptions / greatest(1.0, (end_us - start_us) / 60000000.0::DOUBLE / 15))
 + 0.20 * (1 - least(tool_switches / greatest((end_us - start_us) / 3600000000.0::DOUBLE, 1 / 3600) / 6, 1.0)) + 0.20 * 0.0 AS quality
FROM focus""")

# --- patterns -------------------------------------------------------------------------------
part("bu_rows", """
SELECT *, row_number() OVER w AS x, sum(len) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM classified WHERE NOT is_work
WINDOW w AS (PARTITION BY user_id, local_date ORDER BY start_us, device_id)""")
part("bu_win", """
SELECT *, max(x) OVER w AS r, max(s) OVER w - s + len AS total_us, arg_max(end_us, x) OVER w AS last_end FROM bu_rows
WINDOW w AS (PARTITION BY user_id, local_date ORDER BY start_us RANGE BETWEEN CURRENT ROW AND 9000000000 FOLLOWING)""")
part("bu_ok", """SELECT *, r - x + 1 AS n FROM bu_win WHERE r - x + 1 >= 3 AND total_us >= 3000000000""")
part("ha_rows", """
SELECT *, row_number() OVER (PARTITION BY user_id, local_date, app_key ORDER BY start_us, device_id) AS x FROM classified""")
part("ha_win", """
SELECT *, max(x) OVER w AS r, arg_max(end_us, x) OVER w AS last_end FROM ha_rows
WINDOW w AS (PARTITION BY user_id, local_date, app_key ORDER BY start_us RANGE BETWEEN CURRENT ROW AND 18000000000 FOLLOWING)""")
part("ha_ok", """
SELECT a.user_id, a.local_date, a.app_key, a.x, a.r, a.start_us, a.last_end, a.r - a.x + 1 AS n, median(b.len) AS median_us
FROM ha_win a JOIN ha_rows b ON a.user_id = b.user_id AND a.local_date = b.local_date AND a.app_key = b.app_key
 AND b.x BETWEEN a.x AND a.r
WHERE a.r - a.x + 1 >= 2 GROUP BY ALL HAVING median(b.len) <= 3600000000""")
part("st_rows", """
SELECT *, sum(CASE WHEN prev_category IS NOT NULL AND prev_category <> category THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id, local_date ORDER BY idx ROWS UNBOUNDED PRECEDING) AS upto, idx AS x FROM classified""")
part("st_win", """
SELECT *, max(x) OVER w AS r, max(upto) OVER w - upto AS n, arg_max(end_us, x) OVER w AS last_end FROM st_rows
WINDOW w AS (PARTITION BY user_id, local_date ORDER BY start_us RANGE BETWEEN CURRENT ROW AND 12000000000 FOLLOWING)""")
part("st_ok", """SELECT * FROM st_win WHERE n >= 4""")


def _pick_parts(prefix: str, keys: list[str]) -> None:
    on = " AND ".join(f"o.{k} = p.{k}" for k in keys)
    zon = " AND ".join(f"z.{k} = p.{k}" for k in keys)
    cols = ", ".join(keys)
    part(f"{prefix}_pick", f"""
SELECT {cols}, min(x) AS x, arg_min(r, x) AS r FROM {prefix}_ok GROUP BY {cols}
UNION ALL
SELECT {', '.join('p.' + k for k in keys)}, o.x, o.r FROM {prefix}_pick p JOIN {prefix}_ok o ON {on} AND o.x =
 (SELECT min(z.x) FROM {prefix}_ok z WHERE {zon} AND z.x > p.r)""")


_pick_parts("bu", ["user_id", "local_date"])
_pick_parts("ha", ["user_id", "local_date", "app_key"])
_pick_parts("st", ["user_id", "local_date"])
part("bursts", """
SELECT user_id, local_date, 'DISTRACTION_BURST' AS pattern, start_us, last_end AS end_us,
  least(CAST(total_us AS BIGINT) / 6000000000.0::DOUBLE, 1.0) AS strength, NULL::VARCHAR AS app_key, CAST(n AS BIGINT) AS n,
  CAST(total_us AS BIGINT) / 1000000.0::DOUBLE AS measure
FROM bu_ok JOIN bu_pick USING (user_id, local_date, x, r)""")
part("habits", """
SELECT user_id, local_date, 'HABITUAL_CHECKING' AS pattern, start_us, last_end AS end_us,
  least(n / 4.0::DOUBLE, 1.0) AS strength, app_key, CAST(n AS BIGINT) AS n, median_us / 1000000.0::DOUBLE AS measure
FROM ha_ok JOIN ha_pick USING (user_id, local_date, app_key, x, r)""")
part("storms", """
SELECT user_id, local_date, 'SWITCH_STORM' AS pattern, start_us, last_end AS end_us,
  least(CAST(n AS BIGINT) / 8.0::DOUBLE, 1.0) AS strength, NULL::VARCHAR AS app_key, CAST(n AS BIGINT) AS n, CAST(n AS DOUBLE) AS measure
FROM st_ok JOIN st_pick USING (user_id, local_date, x, r)""")
part("av_rows", """
SELECT *, lead(category) OVER w AS nc, lead(is_work) OVER w AS nw, lead(start_us) OVER w AS ns, lead(end_us) OVER w AS ne,
  min(CASE WHEN is_work THEN start_us END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_work
FROM classified WINDOW w AS (PARTITION BY user_id, local_date ORDER BY idx)""")
part("avoids", """
SELECT user_id, local_date, 'POST_TASK_AVOIDANCE' AS pattern, end_us AS start_us, ne AS end_us, 0.7::DOUBLE AS strength,
  NULL::VARCHAR AS app_key, len AS n, (ne - ns) / 1000000.0::DOUBLE AS measure
FROM av_rows WHERE is_work AND len >= 12000000000 AND NOT nw AND ns - end_us <= 1800000000 AND ne - ns >= 6000000000
 AND NOT coalesce(next_work <= end_us + 18000000000, false)""")
part("occurrences", """
SELECT * FROM bursts UNION ALL SELECT * FROM habits UNION ALL SELECT * FROM storms UNION ALL SELECT * FROM avoids""")
part("patterns", """
SELECT user_id, pattern, app_key, count(*) AS occurrences, count(DISTINCT local_date) AS days,
  min(start_us) AS first_us, max(end_us) AS last_us, max(strength) AS strength,
  CASE WHEN count(*) >= 3 AND count(DISTINCT local_date) >= 3 THEN 'confirmed' ELSE 'candidate' END AS status
FROM occurrences GROUP BY ALL""")

# --- metrics --------------------------------------------------------------------------------
part("bs_o", """
SELECT user_id, local_date, start_us, end_us, max(end_us) OVER (PARTITION BY user_id, local_date ORDER BY start_us, end_us
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bursts""")
part("burst_span", """
SELECT user_id, local_date, CAST(sum(greatest(end_us - greatest(start_us, coalesce(reach, start_us)), 0)) AS BIGINT) AS distraction_us
FROM bs_o GROUP BY ALL""")
part("m_days", """
SELECT user_id, local_date, min(win_start) AS day_start_us, min(win_end) AS day_end_us,
  count(CASE WHEN type = 'DEVICE_UNLOCK' THEN 1 END) AS unlock_count FROM (
 SELECT user_id, local_date, win_start, win_end, type FROM ev UNION ALL SELECT user_id, local_date, start_us, end_us, NULL FROM silent)
GROUP BY ALL""")
part("m_cov", """
SELECT user_id, local_date,
  sum(CASE WHEN state = 'TRACKED' THEN end_us - start_us ELSE 0 END)::BIGINT AS tracked_us,
  sum(CASE WHEN state = 'IDLE' THEN end_us - start_us ELSE 0 END)::BIGINT AS idle_us,
  sum(CASE WHEN state = 'UNOBSERVED' THEN end_us - start_us ELSE 0 END)::BIGINT AS unobserved_us,
  sum(CASE WHEN state = 'DEVICE_OFFLINE' THEN end_us - start_us ELSE 0 END)::BIGINT AS offline_us
FROM coverage GROUP BY ALL""")
part("m_screen", """SELECT user_id, local_date, sum(screen_on_us)::BIGINT AS screen_us FROM screen GROUP BY ALL""")
part("m_ses", """
SELECT user_id, local_date, sum(len)::BIGINT AS session_us,
  sum(CASE WHEN is_work THEN len ELSE 0 END)::BIGINT AS work_us,
  sum(CASE WHEN category = 'communication' THEN len ELSE 0 END)::BIGINT AS communication_us,
  sum(CASE WHEN category = 'learning' THEN len ELSE 0 END)::BIGINT AS learning_us,
  sum(CASE WHEN category = 'entertainment' THEN len ELSE 0 END)::BIGINT AS entertainment_us,
  sum(CASE WHEN category = 'social' THEN len ELSE 0 END)::BIGINT AS social_us,
  sum(CASE WHEN category = 'unknown' THEN len ELSE 0 END)::BIGINT AS unknown_us,
  count(CASE WHEN prev_category <> category THEN 1 END) AS context_switches,
  median(CASE WHEN is_work THEN len END) AS median_us
FROM classified GROUP BY ALL""")
part("m_focus", """
SELECT user_id, local_date, sum(CASE WHEN is_deep THEN end_us - start_us ELSE 0 END)::BIGINT AS deep_us,
  sum(CASE WHEN NOT is_deep THEN end_us - start_us ELSE 0 END)::BIGINT AS focused_us,
  sum(interruptions)::BIGINT AS interruptions, max(end_us - start_us) AS longest_us, count(*) AS n_focus
FROM focus GROUP BY ALL""")
part("m_all", """
SELECT user_id, local_date, day_start_us, day_end_us, unlock_count, day_end_us - day_start_us AS day_us,
  coalesce(tracked_us,0) AS tracked_us, coalesce(idle_us,0) AS idle_us, coalesce(unobserved_us,0) AS unobserved_us,
  coalesce(offline_us,0) AS offline_us, coalesce(screen_us,0) AS screen_us, coalesce(observed_us,0) AS observed_us,
  coalesce(dual_us,0) AS dual_us, coalesce(session_us,0) AS session_us, coalesce(work_us,0) AS work_us,
  coalesce(communication_us,0) AS communication_us, coalesce(learning_us,0) AS learning_us,
  coalesce(entertainment_us,0) AS entertainment_us, coalesce(social_us,0) AS social_us, coalesce(unknown_us,0) AS unknown_us,
  coalesce(context_switches,0) AS context_switches, coalesce(median_us,0) AS median_us, coalesce(deep_us,0) AS deep_us,
  coalesce(focused_us,0) AS focused_us, coalesce(interruptions,0) AS interruptions, coalesce(longest_us,0) AS longest_us,
  coalesce(n_focus,0) AS n_focus, coalesce(distraction_us,0) AS distraction_us,
  greatest(coalesce(screen_us,0) - coalesce(idle_us,0), 0) AS active_us
FROM m_days LEFT JOIN m_cov USING (user_id, local_date) LEFT JOIN m_screen USING (user_id, local_date)
LEFT JOIN unified USING (user_id, local_date) LEFT JOIN m_ses USING (user_id, local_date)
LEFT JOIN m_focus USING (user_id, local_date) LEFT JOIN burst_span USING (user_id, local_date)""")
part("m_sw", """
SELECT *, observed_us / day_us AS coverage_ratio, CASE WHEN active_us > 0
  THEN context_switches / greatest(active_us / 3600000000.0::DOUBLE, 1 / 3600) ELSE 0.0 END AS switches_per_hour FROM m_all""")
part("metrics", """
SELECT user_id, local_date, day_start_us, day_end_us, day_us / 1e6 AS duration_s, observed_us / 1e6 AS observed_s,
  tracked_us / 1e6 AS tracked_s, idle_us / 1e6 AS idle_s, unobserved_us / 1e6 AS unobserved_s, offline_us / 1e6 AS offline_s,
  coverage_ratio, dual_us / 1e6 AS dual_device_s, screen_us / 1e6 AS screen_time_s, active_us / 1e6 AS active_time_s,
  deep_us / 1e6 AS deep_work_s, focused_us / 1e6 AS focused_work_s,
  greatest(work_us - (deep_us + focused_us), 0) / 1e6 AS shallow_work_s, communication_us / 1e6 AS communication_s,
  learning_us / 1e6 AS learning_s, entertainment_us / 1e6 AS entertainment_s, social_us / 1e6 AS social_s,
  distraction_us / 1e6 AS distraction_s, unknown_us / 1e6 AS unknown_s,
  CASE WHEN session_us > 0 THEN unknown_us / session_us ELSE 0.0 END AS unknown_ratio, context_switches, switches_per_hour,
  interruptions, CASE WHEN coverage_ratio >= 0.6 THEN 0.5 * least(switches_per_hour / 12, 1.0)
   + 0.3 * (1 - (deep_us + focused_us) / greatest(work_us, deep_us + focused_us, 1000000))
   + 0.2 * (1 - greatest(0.0, least(median_us / 60000000.0::DOUBLE / 30, 1.0))) END AS fragmentation_index,
  longest_us / 1e6 AS longest_focus_s, CASE WHEN n_focus > 0 THEN (deep_us + focused_us) / 1e6 / n_focus ELSE 0.0 END AS avg_focus_s,
  n_focus AS focus_session_count, unlock_count, false AS tz_transition
FROM m_sw""")
