"""Content scan, privacy gate, claim checks, domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from daytrace import catalog
from daytrace.config import USER_DAY
from daytrace.operators import claims as cm
from daytrace.operators import privacy as pv
from daytrace.plans.oracle import part
from daytrace.plans.registry import query
from daytrace.sources.tables import stage

DAY = "CAST(local_date AS VARCHAR) AS local_date"

# --- T1, T2 ------------------------------------------------------------------------------------
_TOKENS = r"regexp_extract_all({t}, '[A-Za-z0-9+/_=\-]{{32,}}')"
_ENTROPY = """log2(length(tok)::DOUBLE) - list_sum(list_transform(list_sort(list_distinct(string_split(tok, ''))),
  lambda x: (length(tok) - length(replace(tok, x, '')))::DOUBLE * log2((length(tok) - length(replace(tok, x, '')))::DOUBLE))) / length(tok)"""


def _violations(t: str) -> str:
    checks = [
        ("too_long", f"length({t}) > 500"),
        ("url", rf"regexp_matches({t}, '[a-zA-Z][a-zA-Z0-9+.\-]*://') OR regexp_matches({t}, '(?i)\b[a-zA-Z0-9-]+\.(com|org|net|io|dev|co|app|gov|edu)\b')"),
        ("email_shaped", f"contains({t}, '@')"),
        ("long_digit_run", rf"regexp_matches({t}, '\d{{7,}}')"),
        ("path_separator", rf"regexp_matches({t}, '[/\\]')"),
        ("high_entropy_token", f"len(list_filter({_TOKENS.format(t=t)}, lambda tok: round({_ENTROPY}, 9) > 3.5)) > 0"),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks)
    return f"array_to_string(list_filter([{items}], lambda v: v IS NOT NULL), ',')"


part("scan_doc", f"SELECT doc_id, source, lang, {_violations('text')} AS violations FROM documents")
part("scan_conv", f"SELECT conv_id, turn, role, {_violations('text')} AS violations FROM conversations")
part("scan_page", f"SELECT page_id, {_violations('html')} AS violations FROM pages")
query("t1_content_scan", "SELECT doc_id, violations FROM scan_doc")(
    lambda c: c.table("documents").select("doc_id", pv.violations(F.col("text")).alias("violations"))
)
query("t1_content_scan_conversations", "SELECT conv_id, turn, violations FROM scan_conv")(
    lambda c: c.table("conversations").select(
        "conv_id", "turn", pv.violations(F.col("text")).alias("violations")
    )
)
query("t1_content_scan_pages", "SELECT page_id, violations FROM scan_page")(
    lambda c: c.table("pages").select("page_id", pv.violations(F.col("html")).alias("violations"))
)
query("t2_scan_report", "SELECT source, lang, count(*) AS texts, count(CASE WHEN violations = '' THEN 1 END) AS clean, count(CASE WHEN violations = '' THEN 1 END) / count(*) AS clean_share, "
    + ", ".join(f"count(CASE WHEN list_contains(string_split(violations, ','), '{v}') THEN 1 END) AS {v}" for v in (
        "too_long", "url", "email_shaped", "long_digit_run", "path_separator", "high_entropy_token"))
    + " FROM scan_doc GROUP BY source, lang")(
    lambda c: pv.scan_report(
        c.table("documents").select("source", "lang", pv.violations(F.col("text")).alias("violations")),
        ["source", "lang"],
    )
)

# --- T3, T4 ------------------------------------------------------------------------------------


def event_payloads(c):
    """Small payloads made of events; some carry a foreign key or a leaking name."""
    k = F.col("k")
    name = (
        F.when(k % 10 == 0, "http://a.b")
        .when(k % 10 == 1, "call 5551234567")
        .when(k % 10 == 2, "a/b")
        .when(k % 10 == 3, "x@y")
        .otherwise("plain")
    )
    return c.events.select(
        "seq",
        F.to_json(
            F.struct(
                F.col("event_type").alias("category"),
                k.alias("minutes"),
                name.alias("name"),
                F.when(k % 7 == 0, k).alias("props"),
                F.when(k % 11 == 0, F.col("user_id")).alias("user_id"),
            )
        ).alias("payload"),
    )


part("pay", """
SELECT seq, k, CASE k % 10 WHEN 0 THEN 'http://a.b' WHEN 1 THEN 'call 5551234567' WHEN 2 THEN 'a/b' WHEN 3 THEN 'x@y' ELSE 'plain' END AS name,
 '{"category":"' || event_type || '","minutes":' || k || ',"name":"' ||
 CASE k % 10 WHEN 0 THEN 'http://a.b' WHEN 1 THEN 'call 5551234567' WHEN 2 THEN 'a/b' WHEN 3 THEN 'x@y' ELSE 'plain' END || '"' ||
 CASE WHEN k % 7 = 0 THEN ',"props":' || k ELSE '' END || CASE WHEN k % 11 = 0 THEN ',"user_id":' || user_id ELSE '' END || '}' AS payload FROM ev""")
query("t3_json_key_allowlist", """SELECT seq, array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'props' END, CASE WHEN k % 11 = 0 THEN 'user_id' END],
 lambda v: v IS NOT NULL), ',') AS disallowed FROM ev""")(
    lambda c: event_payloads(c).select(
        "seq", pv.flat_disallowed(F.col("payload"), catalog.SUMMARY_KEYS).alias("disallowed")
    )
)


@query("t3_json_key_allowlist_nested", """SELECT doc_id, 'data_quality.doc_id,patterns[0].text,patterns[1].text' AS disallowed, 9 AS key_count FROM documents""")
def _(c):
    """Nested payloads with the whole document text inside."""
    item = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("text").alias("text"))
    docs = c.table("documents").select(
        "doc_id",
        F.to_json(
            F.struct(
                F.col("source").alias("category"),
                F.struct(F.lit(0.5).alias("coverage_ratio"), "doc_id").alias("data_quality"),
                F.array(item("first"), item("second")).alias("patterns"),
            )
        ).alias("payload"),
    )
    return pv.walk_payloads(docs, "payload", catalog.SUMMARY_KEYS).select("doc_id", "disallowed", "key_count")


@query("t4_payload_gate", """SELECT seq, array_to_string(list_sort(list_filter([CASE WHEN name <> 'plain' THEN 'name' END, CASE WHEN k % 7 = 0 THEN 'props' END,
 CASE WHEN k % 11 = 0 THEN 'user_id' END], lambda v: v IS NOT NULL)), ',') AS rejected_fields,
 CASE WHEN name <> 'plain' OR k % 7 = 0 OR k % 11 = 0 THEN 'rejected' ELSE 'allowed' END AS outcome,
 3 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS key_count, sha256(payload) AS payload_sha256 FROM pay""")
def _(c):
    return pv.gate(pv.walk_payloads(event_payloads(c), "payload", catalog.SUMMARY_KEYS)).drop("payload")


# --- T5..T8 ------------------------------------------------------------------------------------
_NUM = r"regexp_extract_all({t}, '-?\d+(?:\.\d+)?%?')"


def _grounded(t: str, ctx: str) -> str:
    near = "len(list_filter({ctx}, lambda q: abs({v} - q) <= greatest(abs(q) * 0.02::DOUBLE, 0.005::DOUBLE))) > 0"
    value = "rtrim(raw, '%')::DOUBLE"
    ok = f"({near.format(ctx=ctx, v=value)}) OR (ends_with(raw, '%') AND {near.format(ctx=ctx, v=value + ' / 100')})"
    return f"len(list_filter({_NUM.format(t=t)}, lambda raw: NOT ({ok}))) = 0"


query("t5_grounded_claims", f"SELECT doc_id, {_grounded('text', '[n_chars::DOUBLE, doc_id::DOUBLE, length(text)::DOUBLE]')} AS grounded FROM documents")(
    lambda c: c.table("documents").select(
        "doc_id",
        cm.numbers_grounded(
            F.col("text"),
            F.array(F.col("n_chars").cast("double"), F.col("doc_id").cast("double"), F.length("text").cast("double")),
        ).alias("grounded"),
    )
)
part("order_docs", """SELECT o_orderkey AS order_key, '{"order":' || o_orderkey || ',"note":"a \\"7\\" of 9, [3]","x5":[true,null,' || (o_orderkey % 7 - 3) || ',{"deep":['
 || o_custkey || ',[[' || (o_orderkey % 100) || '.25]]],"e":1.5e3}],"status":"' || o_orderstatus || '42"' || CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE '}' END AS doc FROM orders""")


@query("t5_document_numbers", """
SELECT order_key, coalesce(array_to_string(list_transform(list_sort(nums), lambda x: CAST(CAST(round_even(x * 100, 0) AS BIGINT) AS VARCHAR)), ','), '') AS hundredths
FROM order_docs LEFT JOIN (SELECT d.order_key, list(j.value::DOUBLE) AS nums FROM (SELECT * FROM order_docs WHERE json_valid(doc)) d, json_tree(d.doc) j
 WHERE j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') GROUP BY ALL) USING (order_key)""")
def _(c):
    """All numbers of nested documents made from the orders; every fiftieth is cut off and has none."""
    key, text = F.col("o_orderkey"), lambda x: x.cast("string")
    doc = F.concat(
        F.lit('{"order":'), text(key), F.lit(',"note":"a \\"7\\" of 9, [3]","x5":[true,null,'), text(key % 7 - 3),
        F.lit(',{"deep":['), text(F.col("o_custkey")), F.lit(",[["), text(key % 100), F.lit('.25]]],"e":1.5e3}],"status":"'),
        F.col("o_orderstatus"), F.lit('42"'), F.when(key % 50 == 0, "").otherwise("}"),
    )
    numbers = F.transform(F.array_sort(cm.document_numbers(doc)), lambda x: F.rint(x * 100).cast("long"))
    return c.table("orders").select(key.alias("order_key"), numbers.alias("hundredths"))


_NOTES = ["no disorder here", "disorderly queue", "ADHD noted", "a mental illness", "Burn-out", "burnout", "calm"]
part("notes", "SELECT seq, [" + ", ".join(f"'{n}'" for n in _NOTES) + f"][k % {len(_NOTES)} + 1] AS note FROM ev")
_TERMS = "|".join(catalog.REJECTED_TERMS)
query("t6_term_reject", rf"""SELECT 'note' AS kind, seq AS id, regexp_matches(note, '(?i)\b({_TERMS})\b') AS rejected FROM notes
 UNION ALL SELECT 'document', doc_id, regexp_matches(text, '(?i)\b({_TERMS})\b') FROM documents""")(
    lambda c: c.events.select(
        F.lit("note").alias("kind"),
        F.col("seq").alias("id"),
        F.element_at(F.lit(_NOTES), F.col("k") % len(_NOTES) + 1).alias("text"),
    )
    .unionByName(
        c.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    )
    .select("kind", "id", cm.has_rejected_term(F.col("text")).alias("rejected"))
)
_PATHS = ["user.id", "user.missing", "values[0]", "values[1]", "values[2]", "note", "", "user.id.deep"]


@query("t7_evidence_resolves", "SELECT seq, ['" + "','".join(_PATHS) + """'][k % 8 + 1] AS path, k % 8 IN (0, 2, 3, 5) AS resolves FROM ev""")
def _(c):
    """Paths into a nested document per event; null values are present, missing keys are not."""
    doc = F.to_json(
        F.struct(
            F.struct(F.col("user_id").alias("id"), F.col("type").alias("type")).alias("user"),
            F.array(F.col("k"), F.lit(None).cast("int")).alias("values"),
            F.lit(None).cast("string").alias("note"),
        ),
        {"ignoreNullFields": "false"},
    )
    path = F.element_at(F.lit(_PATHS), F.col("k") % 8 + 1)
    return c.events.select("seq", path.alias("path"), cm.path_resolves(doc, path).alias("resolves"))


part("claim_ctx", """SELECT user_id, local_date, coverage_ratio, unknown_ratio, CAST(round_even(screen_time_s / 60.0::DOUBLE, 0) AS BIGINT) AS sm, interruptions AS itr, fragmentation_index AS fr,
 CAST(local_date - DATE '1970-01-01' AS BIGINT) + user_id AS h FROM metrics""")
part("claim_docs", """SELECT *, json_object('data_quality', json_object('coverage_ratio', coverage_ratio, 'unknown_ratio', unknown_ratio),
 'focus', json_object('interruptions', itr, 'fragmentation_index', fr), 'totals', json_object('screen_minutes', sm)) AS doc FROM claim_ctx""")
part("claim_nums", """SELECT c.user_id, c.local_date, list(j.value::DOUBLE) AS nums FROM claim_docs c, json_tree(c.doc) j
 WHERE j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') GROUP BY ALL""")
part("claim_texts", """
SELECT *, 1 AS n, 'Screen time was ' || (CASE WHEN h % 5 = 0 THEN sm * 2 + 1000 ELSE sm END) || ' minutes' AS claim, 'totals.screen_minutes' AS path, 'FACT' AS st, 0.9::DOUBLE AS cf FROM claim_docs
UNION ALL SELECT *, 2, 'The day was fragmented', 'focus.fragmentation_index', 'INFERENCE', 0.6 FROM claim_docs
UNION ALL SELECT *, 3, CASE WHEN h % 3 = 0 THEN 'A burnout sign: ' || itr ELSE itr || ' interruptions' END,
 CASE WHEN h % 7 = 0 THEN 'focus.breaks' ELSE 'focus.interruptions' END, 'FACT', 0.8 FROM claim_docs""")
part("claim_rows", f"""
SELECT t.*, json_exists(doc, '$.' || path) AND {_grounded('claim', 'nums')} AND NOT regexp_matches(claim, '(?i)\\b({_TERMS})\\b') AS kept
FROM claim_texts t JOIN claim_nums USING (user_id, local_date)""")


def day_claims(c):
    """Three claims per user-day: screen time (sometimes off), fragmentation, interruptions
    (sometimes with a bad path or word)."""
    m = c.plan.metrics
    minutes = F.rint(F.col("screen_time_s") / 60.0).cast("long")
    h = F.unix_date("local_date").cast("long") + F.col("user_id")
    doc = F.to_json(
        F.struct(
            F.struct("coverage_ratio", "unknown_ratio").alias("data_quality"),
            F.struct("interruptions", "fragmentation_index").alias("focus"),
            F.struct(minutes.alias("screen_minutes")).alias("totals"),
        ),
        {"ignoreNullFields": "false"},
    )
    row = lambda n, claim, ev, status, conf: F.struct(
        F.lit(n).alias("n"), claim.alias("claim"), ev.alias("evidence"),
        F.lit(status).alias("epistemic_status"), F.lit(conf).alias("confidence"),
    )
    off = F.when(h % 5 == 0, minutes * 2 + 1000).otherwise(minutes)
    claims = F.array(
        row(1, F.format_string("Screen time was %d minutes", off), F.array(F.lit("totals.screen_minutes")), "FACT", 0.9),
        row(2, F.lit("The day was fragmented"), F.array(F.lit("focus.fragmentation_index")), "FACT", 0.6),
        row(
            3,
            F.when(h % 3 == 0, F.concat(F.lit("A burnout sign: "), F.col("interruptions").cast("string")))
            .otherwise(F.format_string("%d interruptions", F.col("interruptions"))),
            F.array(F.when(h % 7 == 0, "focus.breaks").otherwise("focus.interruptions")),
            "FACT",
            0.8,
        ),
    )
    df = m.select(
        *USER_DAY, "coverage_ratio", "unknown_ratio", h.alias("h"), doc.alias("doc"),
        F.lit("").alias("narrative"), F.explode(claims).alias("x"),
    )
    return df.select(*df.columns[:-1], "x.*")


query("t8_claim_policy", f"""SELECT user_id, {DAY}, n, kept, st AS epistemic_status,
 CASE WHEN coverage_ratio < 0.6 OR unknown_ratio > 0.3 THEN least(cf, 0.7::DOUBLE) ELSE cf END AS confidence FROM claim_rows""")(
    lambda c: cm.check_claims(day_claims(c)).select(*USER_DAY, "n", "kept", "epistemic_status", "confidence")
)


@query("t8_analysis_status", f"""SELECT user_id, {DAY}, count(*) AS claims, count(CASE WHEN kept THEN 1 END) AS kept,
 CASE WHEN h % 4 <> 0 THEN 50 END AS day_score, CASE WHEN h % 4 = 0 OR NOT bool_and(kept) THEN 'partial' ELSE 'ok' END AS status
 FROM claim_rows GROUP BY user_id, local_date, h""")
def _(c):
    """Every fourth analysis claims a score outside the band around the reference score."""
    checked = stage(cm.check_claims(day_claims(c)))
    scores = checked.filter("n = 1").select(
        *USER_DAY, F.lit(50).alias("day_score"),
        F.when(F.col("h") % 4 == 0, 66).otherwise(60).alias("reference_score"),
    )
    return cm.analysis_status(checked, scores, USER_DAY)


# --- T9 ----------------------------------------------------------------------------------------
# Public suffixes of the sample hosts, with one- and two-label entries.
SUFFIXES = ["com", "org", "net", "io", "dev", "uk", "co.uk", "example.org"]


@query("t9_registrable_domain", """
SELECT page_id, CASE WHEN len(l) > s THEN array_to_string(l[len(l) - s:], '.') END AS domain FROM (
 SELECT page_id, l, CASE WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'example.org') THEN 2 ELSE 1 END AS s FROM (
  SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.') AS l FROM pages))""")
def _(c):
    suffixes = c.spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    pages = c.table("pages").select("page_id", "url")
    return pv.registrable_domain(pages, "url", suffixes).select("page_id", "domain")


# Rules of every kind, and hosts that end in each of them; unlisted top labels too.
RULES = ["com", "com.au", "au", "jp", "co.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "uk", "co.uk"]
HOSTS = ["a.com.au", "b.co.jp", "kobe.jp", "x.kobe.jp", "city.kobe.jp", "ck", "shop.ck", "www.ck", "co.uk", "unlisted.zz"]


@query("t9_suffix_rules", f"""
WITH h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'p' || page_id || '.' END || [{", ".join(f"'{h}'" for h in HOSTS)}][page_id % {len(HOSTS)} + 1] AS host FROM pages),
l AS (SELECT page_id, string_split(host, '.') AS l FROM h),
r AS (SELECT unnest([{", ".join(f"'{r}'" for r in RULES)}]) AS rule),
m AS (SELECT page_id, l, rule, len(string_split(rule, '.')) AS n, rule LIKE '!%' AS ex FROM l LEFT JOIN r ON
  CASE WHEN rule LIKE '!%' THEN '.' || array_to_string(l, '.') LIKE '%.' || rule[2:]
       WHEN rule LIKE '*%' THEN len(l) >= len(string_split(rule, '.')) AND array_to_string(l, '.') LIKE '%' || rule[2:]
       ELSE '.' || array_to_string(l, '.') LIKE '%.' || rule END),
b AS (SELECT page_id, any_value(l) AS l, coalesce(max(CASE WHEN ex THEN n - 1 END), max(n), 1) AS s FROM m GROUP BY page_id)
SELECT page_id, CASE WHEN len(l) > s AND len(l) > 1 THEN array_to_string(l[len(l) - s:], '.') END AS domain FROM b""")
def _(c):
    """Plain, wildcard and exception rules from a table, over hosts made from the pages' ids."""
    rules = c.spark.createDataFrame([(r,) for r in RULES], "suffix string")
    front = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".")))
    host = F.concat(front, F.element_at(F.lit(HOSTS), (F.col("page_id") % len(HOSTS) + 1).cast("int")))
    pages = c.table("pages").select("page_id", F.concat(F.lit("https://"), host, F.lit("/x")).alias("url"))
    return pv.registrable_domain(pages, "url", rules).select("page_id", "domain")
