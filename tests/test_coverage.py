"""Hand-made device-days, one device per case, run together in both scan modes."""

from dataclasses import replace

import pytest

from conftest import rel
from daytrace.config import Thresholds
from daytrace.operators import coverage as cov
from test_sessions import all_cases

MODES = {"whole": replace(Thresholds(), chunk_s=86400), "chunked": replace(Thresholds(), chunk_s=120)}
START, END = -2 * 3600, 22 * 3600  # the day window around the base instant

CASES = {
    "idle_after_silence_with_screen_on": (
        [(0, "SCREEN_ON", None), (60, "USER_INTERACTION", None), (1000, "SCREEN_OFF", None)],
        [("UNOBSERVED", START, 0), ("TRACKED", 0, 360), ("IDLE", 360, 1000), ("TRACKED", 1000, END)],
    ),
    "long_gap_with_screen_on": (
        [(0, "SCREEN_ON", None), (1800, "SCREEN_OFF", None)],
        [("UNOBSERVED", START, 1800), ("TRACKED", 1800, END)],
    ),
    "shutdown_until_startup": (
        [(0, "DEVICE_SHUTDOWN", None), (600, "DEVICE_STARTUP", None)],
        [("UNOBSERVED", START, 0), ("DEVICE_OFFLINE", 0, 600), ("TRACKED", 600, END)],
    ),
    "stopped_collector_beats_shutdown": (
        [(0, "COLLECTOR_STOP", None), (10, "DEVICE_SHUTDOWN", None), (600, "COLLECTOR_START", None)],
        [("UNOBSERVED", START, 600), ("DEVICE_OFFLINE", 600, END)],
    ),
    "many_events": (
        [
            (0, "SCREEN_ON", None), (0, "USER_INTERACTION", None), (400, "APP_FOREGROUND", "a"),
            (700, "DEVICE_LOCK", None), (900, "SCREEN_ON", None), (2000, "HEALTH", None),
        ],
        [
            ("UNOBSERVED", START, 0), ("TRACKED", 0, 300), ("IDLE", 300, 700), ("TRACKED", 700, 1200),
            ("IDLE", 1200, 2000), ("UNOBSERVED", 2000, END),
        ],
    ),
}
SCREEN = {
    "idle_after_silence_with_screen_on": 1000, "long_gap_with_screen_on": 1800, "shutdown_until_startup": 0,
    "stopped_collector_beats_shutdown": 0,
    # on 0-700, 900-2000, then capped two polls after the last event
    "many_events": 700 + 1100 + 1800,
}


@pytest.fixture(params=MODES)
def th(request):
    return MODES[request.param]


def test_coverage_and_screen_time(events, th):
    states = cov.signal_states(all_cases(events, CASES), th)
    out = cov.coverage_intervals(states, th).orderBy("device_id", "start_us").collect()
    on = {r.device_id: r.screen_on_us / 1e6 for r in cov.screen_on(states, th).collect()}
    for i, (name, (_, want)) in enumerate(CASES.items()):
        got = [(r.state, rel(r.start_us), rel(r.end_us)) for r in out if r.device_id == i]
        assert got == want, name
        assert got[0][1] == START and got[-1][2] == END
        assert on[i] == SCREEN[name], name


def test_shutdown_does_not_end_screen_time(events, th):
    rows = [(0, "SCREEN_ON", None), (100, "DEVICE_SHUTDOWN", None), (300, "SCREEN_OFF", None)]
    (r,) = cov.screen_on(cov.signal_states(events(rows), th), th).collect()
    assert r.screen_on_us == 300_000_000


def test_media_time_is_not_idle(events, th):
    rows = [(0, "SCREEN_ON", None), (10, "APP_FOREGROUND", "tv"), (1500, "SCREEN_OFF", None)]
    states = cov.signal_states(events(rows), th, media_apps=["tv"])
    out = cov.coverage_intervals(states, th, exempt=states["media"]).collect()
    assert "IDLE" not in {r.state for r in out}


def test_enrolled_days_without_events_are_unobserved(spark, events):
    import datetime as dt

    from daytrace.plans.day import DayPlan
    from daytrace.sources import telemetry as tm

    ev = events([(0, "SCREEN_ON", None), (60, "SCREEN_OFF", None)])
    enrolled = spark.createDataFrame(
        [(1, 0, "UTC", 4, dt.date(2023, 12, 31), dt.date(2024, 1, 2))],
        "user_id long, device_id int, tz string, day_start_hour int, first_date date, last_date date",
    )
    plan = DayPlan(ev, tm.priors(spark, {}), Thresholds(), enrolled=enrolled)
    got = {r.local_date: r for r in plan.metrics.collect()}
    assert sorted(got) == [dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert got[dt.date(2024, 1, 2)].unobserved_s == 86400 and got[dt.date(2024, 1, 2)].coverage_ratio == 0
