"""Hand-made device-days, one device per case, run together in both scan modes."""

from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import functions as F

from conftest import rel
from daytrace.config import Thresholds
from daytrace.operators import sessions as se

MODES = {"whole": replace(Thresholds(), chunk_s=86400), "chunked": replace(Thresholds(), chunk_s=60)}
FG, BG, TOUCH = "APP_FOREGROUND", "APP_BACKGROUND", "USER_INTERACTION"
H = 3600

# case -> (events, expected (app, start, end, interactions, truncated, merged_from))
CASES = {
    "foreground_to_background": (
        [(0, FG, "a"), (10, TOUCH, None), (300, BG, "a"), (310, TOUCH, None)],
        [("a", 0, 300, 1, False, 1)],
    ),
    "next_app_closes": (
        [(0, FG, "a"), (100, FG, "b"), (200, BG, "b")],
        [("a", 0, 100, 0, False, 1), ("b", 100, 200, 0, False, 1)],
    ),
    "repeated_foreground_stays_open": (
        [(0, FG, "a"), (90, FG, "a"), (100, TOUCH, None), (200, "SCREEN_OFF", None)],
        [("a", 0, 200, 1, False, 1)],
    ),
    "stray_background_is_ignored": (
        [(0, BG, "a"), (10, FG, "b"), (50, BG, "a"), (100, BG, "b")],
        [("b", 10, 100, 0, False, 1)],
    ),
    "open_session_ends_at_last_event": ([(0, FG, "a"), (500, "HEALTH", None)], [("a", 0, 500, 0, True, 1)]),
    "four_hour_cap": (
        [(0, FG, "a"), (5 * H, FG, "b"), (5 * H + 60, BG, "b")],
        [("a", 0, 4 * H, 0, True, 1), ("b", 5 * H, 5 * H + 60, 0, False, 1)],
    ),
    "short_sessions_are_dropped": (
        [(0, FG, "a"), (2, BG, "a"), (60, FG, "b"), (63, BG, "b")],
        [("b", 60, 63, 0, False, 1)],
    ),
    "bounce_merges_below_the_gap_only": (
        [(0, FG, "a"), (10, BG, "a"), (39, FG, "a"), (60, BG, "a"), (90, FG, "a"), (120, BG, "a")],
        [("a", 0, 60, 0, False, 2), ("a", 90, 120, 0, False, 1)],
    ),
    "equal_times_follow_seq": (
        [(0, FG, "a"), (60, BG, "a"), (60, FG, "b"), (120, "DEVICE_LOCK", None)],
        [("a", 0, 60, 0, False, 1), ("b", 60, 120, 0, False, 1)],
    ),
    "foreground_without_package": ([(0, FG, None), (5, FG, "a"), (50, BG, "a")], [("a", 5, 50, 0, False, 1)]),
}


def all_cases(events, cases):
    return reduce(
        lambda a, b: a.unionByName(b), [events(rows, device=i) for i, (rows, _) in enumerate(cases.values())]
    ).coalesce(1)


@pytest.fixture(params=MODES)
def th(request):
    return MODES[request.param]


def test_app_sessions(events, th):
    out = se.app_sessions(all_cases(events, CASES), th).orderBy("device_id", "start_us").collect()
    for i, (name, (_, want)) in enumerate(CASES.items()):
        got = [
            (r.app_key, rel(r.start_us), rel(r.end_us), r.interactions, r.truncated, r.merged_from)
            for r in out
            if r.device_id == i
        ]
        assert got == want, name


def test_browser_ignores_screen_events(events, th):
    rows = [(0, "DOMAIN_FOCUS_START", "x"), (50, "SCREEN_OFF", None), (100, "DOMAIN_FOCUS_END", "x")]
    out = se.browser_sessions(events(rows), th).collect()
    assert [(r.app_key, rel(r.start_us), rel(r.end_us)) for r in out] == [("x", 0, 100)]


def test_dwell_resumes_within_gap(events, th):
    rows = [(0, FG, "a"), (1, BG, "a"), (31, FG, "a"), (33, BG, "a"), (100, FG, "a"), (101, FG, "b")]
    out = se.app_dwells(events(rows), th, F.lit(None).cast("long")).orderBy("start_us", "app_key")
    got = [(r.app_key, rel(r.start_us), r.end_us and rel(r.end_us)) for r in out.collect()]
    # least() of an unknown end and the cap is the cap
    assert got == [("a", 0, 33), ("a", 100, 101), ("b", 101, 101 + 4 * H)]
