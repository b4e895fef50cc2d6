"""Sequence rules on hand-made timelines, and against brute force on random ones."""

import datetime as dt
import random
from dataclasses import replace

import pytest

from daytrace.config import Thresholds
from daytrace.operators import classify as cl
from daytrace.operators import focus as fo
from daytrace.operators import intervals as iv
from daytrace.operators import metrics as me
from daytrace.operators import patterns as pa
from daytrace.plans.day import DayPlan
from daytrace.sources import telemetry as tm
from pyspark.sql import functions as F

TH = replace(Thresholds(), chunk_s=600)
MIN = 60
DAYS = [dt.date(2024, 1, d) for d in range(1, 9)]


def timeline(spark, days):
    """Classified sessions; per day a list of (category, app, start_s, end_s, device)."""
    data = [
        (1, dev, day, app, s * 10**6, e * 10**6, cat, 0.5 + (i % 5) / 10, "seed", ["x"], "android", f"{day}:{dev}:{s}")
        for day, items in days
        for i, (cat, app, s, e, dev) in enumerate(items)
    ]
    return spark.createDataFrame(
        data,
        "user_id long, device_id int, local_date date, app_key string, start_us long, end_us long, category string, "
        "confidence double, source string, evidence array<string>, platform string, session_id string",
    )


def one(spark, items):
    return timeline(spark, [(DAYS[0], [(*i, 0) for i in items])])


class TestFocus:
    def run(self, spark, items):
        out = fo.focus_sessions(one(spark, items), TH).orderBy("start_us").collect()
        return [(r.category, r.start_us // 10**6, r.end_us // 10**6, r.interruptions, r.tool_switches, r.is_deep) for r in out]

    def test_deep_work(self, spark):
        items = [("development", "ide", 0, 30 * MIN), ("development", "term", 30 * MIN, 50 * MIN)]
        assert self.run(spark, items) == [("development", 0, 50 * MIN, 0, 1, True)]

    def test_brief_interruption_is_tolerated(self, spark):
        items = [("writing", "w", 0, 20 * MIN), ("social", "s", 20 * MIN, 21 * MIN), ("writing", "w", 21 * MIN, 40 * MIN)]
        assert self.run(spark, items) == [("writing", 0, 40 * MIN, 1, 0, False)]

    def test_long_interruption_splits(self, spark):
        items = [("writing", "w", 0, 20 * MIN), ("social", "s", 20 * MIN, 25 * MIN), ("writing", "w", 25 * MIN, 45 * MIN)]
        assert self.run(spark, items) == [("writing", 0, 20 * MIN, 0, 0, False), ("writing", 25 * MIN, 45 * MIN, 0, 0, False)]

    def test_close_interruptions_break(self, spark):
        items = [
            ("writing", "w", 0, 16 * MIN), ("social", "s", 16 * MIN, 17 * MIN), ("writing", "w", 17 * MIN, 18 * MIN),
            ("social", "s", 18 * MIN, 19 * MIN), ("writing", "w", 19 * MIN, 22 * MIN),
        ]
        assert self.run(spark, items) == [("writing", 0, 18 * MIN, 1, 0, False)]

    def test_entertainment_is_never_deep(self, spark):
        assert self.run(spark, [("entertainment", "v", 0, 60 * MIN)]) == [("entertainment", 0, 60 * MIN, 0, 0, False)]


class TestPatterns:
    def test_burst(self, spark):
        items = [("social", "a", i * 200, i * 200 + 120) for i in range(4)]
        (r,) = pa.distraction_bursts(one(spark, items), TH).collect()
        assert (r.n, r.measure, r.start_us, r.end_us) == (4, 480.0, 0, 720 * 10**6)
        assert r.strength == 0.8

    def test_work_is_no_burst(self, spark):
        items = [("writing", "a", i * 200, i * 200 + 120) for i in range(4)]
        assert pa.distraction_bursts(one(spark, items), TH).isEmpty()

    def test_habit(self, spark):
        items = [("social", "a", i * 300, i * 300 + 30) for i in range(6)]
        (r,) = pa.habitual_checking(one(spark, items), TH).collect()
        assert (r.app_key, r.n, r.measure) == ("a", 6, 30.0)

    def test_storm(self, spark):
        items = [(("social", "writing")[i % 2], "a", i * 30, i * 30 + 20) for i in range(30)]
        (r,) = pa.switch_storms(one(spark, items), TH).collect()
        assert r.n == 29

    def test_avoidance_needs_no_return_to_work(self, spark):
        base = [("writing", "w", 0, 25 * MIN), ("social", "s", 26 * MIN, 40 * MIN)]
        assert pa.post_task_avoidance(one(spark, base), TH).count() == 1
        back = base + [("writing", "w", 50 * MIN, 60 * MIN)]
        assert pa.post_task_avoidance(one(spark, back), TH).count() == 0


def brute_clusters(rows, gap):
    """First cluster with a fitting member on another device, searched row by row."""
    clusters = []
    for r in sorted(rows, key=lambda r: (r[2], r[4])):
        home = next(
            (c for c in clusters if any(
                m[0] == r[0] and m[4] != r[4] and max(m[2], r[2]) - min(m[3], r[3]) <= gap for m in c)),
            None,
        )
        if home is None:
            clusters.append([r])
        else:
            home.append(r)
    return sorted(sorted((m[2], m[4]) for m in c) for c in clusters)


def test_clusters_match_brute_force(spark):
    rng = random.Random(3)
    days = []
    for day in DAYS:
        items, seen = [], set()
        for _ in range(40):
            s, dev = rng.randrange(0, 20000, 10), rng.randrange(3)
            if (s, dev) not in seen:
                seen.add((s, dev))
                items.append((rng.choice(["writing", "social"]), "a", s, s + rng.randrange(10, 900), dev))
        days.append((day, items))
    got = iv.cluster_cross_device(timeline(spark, days), TH).collect()
    for day, items in days:
        groups = {}
        for r in got:
            if r.local_date == day:
                groups.setdefault((r.category, r.island, r.cluster), []).append((r.start_us // 10**6, r.device_id))
        assert sorted(sorted(g) for g in groups.values()) == brute_clusters(items, TH.cluster_gap_s)


def test_clusters_of_thousands_of_devices(spark):
    rng = random.Random(9)
    items = [("writing", "a", s, s + rng.randrange(10, 2000), dev) for dev in range(3000) for s in [rng.randrange(0, 80000, 10)]]
    got = iv.cluster_cross_device(timeline(spark, [(DAYS[0], items)]), TH).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.island, r.cluster), []).append((r.start_us // 10**6, r.device_id))
    assert sorted(sorted(g) for g in groups.values()) == brute_clusters(items, TH.cluster_gap_s)


def block_at(rows, i, th):
    """The block that begins at row i by its definition, and the place behind it; None if it is none."""
    own = [k for k in range(i, len(rows)) if rows[k][0] == rows[i][0]]
    foreign = [k for k in range(i + 1, len(rows)) if rows[k][0] != rows[i][0]]

    def length(k):
        return rows[k][3] - rows[k][2]

    def ends(q):
        k = foreign[q]
        short = rows[k][0] == "communication" or length(k) < th.interruption_max_s
        soon = q > 0 and rows[k][2] - rows[foreign[q - 1]][2] < th.interruption_cluster_s
        return not short or length(k) > th.tolerance_s or soon

    stop = next((foreign[q] for q in range(len(foreign)) if ends(q)), len(rows))
    own = [k for k in own if k < stop]
    breaks = sum(k < stop for k in foreign)
    span, work = rows[own[-1]][3] - rows[i][2], sum(map(length, own))
    tools = sum(rows[a][1] != rows[b][1] for a, b in zip(own, own[1:]))
    if span < th.focus_min_s or breaks > max(1, span / th.per_interruption_s) or work / span < th.focus_min_ratio:
        return None
    deep = span >= th.deep_min_s and breaks <= 1 and work / span >= th.deep_min_ratio
    deep = deep and tools / (span / 3600) <= th.deep_max_switch_rate and rows[i][0] in ("writing", "development")
    return (rows[i][0], rows[i][2], rows[own[-1]][3], breaks, tools, deep), stop


def test_focus_matches_brute_force(spark):
    rng, days, want = random.Random(11), [], []
    for n, day in enumerate(DAYS):
        rows, t, at = [], 0, 0
        for _ in range(150):
            t += rng.choice([0, 0, 5, 60, 200])
            cat = rng.choice(["writing"] * 4 + ["development", "social", "communication"])
            rows.append((cat, rng.choice("ab"), t, t + rng.choice([20, 60, 80, 100, 400, 1500]), len(rows) % (1, 4, 1)[n % 3]))
            t = rows[-1][3] if n % 3 != 1 else t + rng.choice([1, 50, 300])
        days.append((day, rows))
        while at < len(rows):
            found = block_at(rows, at, TH)
            if found:
                want.append((day, *found[0]))
            at = found[1] if found else at + 1
    got = fo.focus_sessions(timeline(spark, days), TH).collect()
    got = [(r.local_date, r.category, r.start_us // 10**6, r.end_us // 10**6, r.interruptions, r.tool_switches, r.is_deep) for r in got]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_focus_runs_in_the_jvm(spark):
    plan = fo.focus_sessions(one(spark, [("writing", "w", 0, 20 * MIN)]), TH)
    assert "Python" not in plan._jdf.queryExecution().toString() and "InPandas" not in plan._jdf.queryExecution().toString()


def test_followed_by_work_matches_brute_force(spark):
    rng, data, want = random.Random(5), [], {}
    apps = {"m": "entertainment", "d": "development", "w": "writing", "s": "social"}
    for n, day in enumerate(DAYS):
        t, items = 0, []
        for _ in range(40):
            t += rng.choice([0, 30, 300, 1200])
            length = rng.choice([60, 300, 900, 1500])
            items.append((rng.choice("mmddddws"), t, t + length))
            t += length
        for i, (a, s, e) in enumerate(items):
            data.append((1, 0, day, a, s * 10**6, e * 10**6, apps[a], a == "m"))
            if a != "m":
                continue
            later = items[i + 1:]
            good = {x[0] for x in later[:5]} & {"d", "w"}
            firsts = [j for j, x in enumerate(later) if x[0] in good and x[1] < e + 900]
            total = 0
            for x in later[firsts[0]:] if firsts else []:
                if x[0] not in good:
                    break
                total += x[2] - x[1]
            want[(n, s)] = total >= 1800
    df = spark.createDataFrame(
        data,
        "user_id long, device_id int, local_date date, app_key string, start_us long, end_us long, key_category string, is_media boolean",
    )
    got = {
        (DAYS.index(r.local_date), r.start_us // 10**6): r.followed
        for r in cl.followed_by_work(df, TH).filter("is_media").collect()
    }
    assert got == want and any(want.values()) and not all(want.values())


def test_learned_prior(spark):
    day = 86400 * 10**6
    data = [(1, "a", "writing", 0, 0), (1, "a", "social", day, 1)] + [(1, "a", "social", (2 + i) * day, 2 + i) for i in range(5)]
    df = spark.createDataFrame(data, "user_id long, app_key string, category string, us long, seq long")
    (r,) = cl.learned_prior_fold(df, TH).collect()
    n, conf = 1, 0.75
    for _ in range(5):
        grown = n * 0.5 ** (1 / 60) + 1
        conf, n = min(0.95, 0.75 + 0.04 * (grown - 1)), max(1, round(grown))
    assert (r.category, r.samples) == ("social", n) and r.confidence == pytest.approx(conf)


def test_union_and_sweep(spark):
    spans = spark.createDataFrame(
        [(1, 0, 10), (1, 5, 20), (1, 30, 40), (1, 35, 36)], "user_id long, start_us long, end_us long"
    )
    (u,) = iv.union_length(spans, ["user_id"], TH).collect()
    (s,) = iv.overlap_sweep(spans, ["user_id"], TH).collect()
    assert (u.union_us, s.observed_us, s.dual_us) == (30, 30, 6)


def test_arbitration_cuts_the_earlier_family(spark):
    data = [
        (1, 2, DAYS[0], "brave", "x", 0, 100, False, 1),
        (1, 3, DAYS[0], "firefox", "y", 40, 60, False, 1),
        (1, 2, DAYS[0], "brave", "z", 60, 90, False, 1),
    ]
    df = spark.createDataFrame(
        data,
        "user_id long, device_id int, local_date date, browser_family string, app_key string, start_us long, end_us long, truncated boolean, merged_from long",
    )
    out = iv.arbitrate(df).orderBy("start_us").collect()
    assert [(r.app_key, r.start_us, r.end_us, r.truncated) for r in out] == [
        ("x", 0, 40, True), ("y", 40, 60, False), ("z", 60, 90, False)]


@pytest.mark.parametrize("case", ["outlier", "spread", "ties", "one"])
def test_quantiles_by_refinement(spark, case):
    rng = random.Random(6)
    values = {
        "outlier": [rng.random() for _ in range(500)] + [1e9],
        "spread": [10.0 ** rng.uniform(-20, 20) * rng.choice([-1, 1]) for _ in range(300)],
        "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(400)],
        "one": [7.25],
    }[case]
    rows = [("a", v, rng.randint(1, 4)) for v in values] + [("b", float(i), 1) for i in range(11)]
    df = spark.createDataFrame(rows, "key string, v double, n long").repartition(3)
    got = me.exact_quantiles(df, ["key"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, buckets=16, most=8)
    for r in got.collect():
        flat = sorted(v for k, v, n in rows if k == r.key for _ in range(n))
        for p, mine in ((0.5, r.p50), (0.95, r.p95), (0.0, r.p0), (1.0, r.p100)):
            at = p * (len(flat) - 1)
            low, high = flat[int(at)], flat[-int(-at // 1)]
            assert mine == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-9, abs=1e-5)


def test_corrections_survive_a_recompute(spark):
    sample = tm.sample_plan(spark, "/root/testdata/sf0.001")
    acts = sample.activities
    first, second, other = [r.activity_id for r in acts.orderBy("activity_id").select("activity_id").limit(3).collect()]
    log = spark.createDataFrame(
        [(first, "writing", 5, 1), (first, "admin", 5, 2), (second, "admin", 9, 1), (second, "reading", 3, 7), ("gone", "admin", 1, 1)],
        "activity_id string, corrected_category string, us long, seq long",
    )
    for _ in range(2):  # every plan computes its activities anew
        run = DayPlan(sample.events, sample.seeds, sample.th, rules=sample.rules, learned=sample.learned, corrections=lambda _: log)
        now = {r.activity_id: r for r in run.current.collect()}
        assert len(now) == acts.count()
        assert (now[first + "+"].category, now[first + "+"].confidence, now[first + "+"].source) == ("admin", 1.0, "user")
        assert now[second + "+"].category == "admin" and first not in now and other in now
        assert run.activities.filter(F.col("activity_id") == first).count() == 1


def test_domain_priors_take_the_longest_listed_name(spark):
    seeds = spark.createDataFrame(
        [("google.com", "browsing", 0.55), ("docs.Google.com", "writing", 0.6), ("localhost", "development", 0.55), ("", "social", 0.9)],
        "app_key string, seed_category string, seed_conf double",
    )
    want = {
        "docs.google.com": "writing", "x.docs.google.com.": "writing", "Mail.Google.com": "browsing", "google.com": "browsing",
        "notgoogle.com": None, "google.com.test": None, "localhost": "development", "com": None, "": None, None: None,
    }
    rows = [(h, i) for i, h in enumerate([*want, *want])]
    got = cl.with_domain_priors(spark.createDataFrame(rows, "app_key string, name int"), seeds).collect()
    assert sorted(r["name"] for r in got) == list(range(len(rows)))
    assert {r.app_key: r.seed_category for r in got} == want
    assert not cl.with_domain_priors(spark.createDataFrame([], "app_key string, name int"), seeds).take(1)
