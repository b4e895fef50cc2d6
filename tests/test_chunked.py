"""The width of the time chunks does not change the rows."""

from dataclasses import replace

import pytest

from conftest import SF
from daytrace.operators import attribution as at
from daytrace.operators import sessions as se
from daytrace.plans.day import DayPlan
from daytrace.sources import telemetry as tm
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def plans(spark):
    whole = tm.sample_plan(spark, SF)
    plan = lambda s: DayPlan(
        whole.events, whole.seeds, replace(tm.SAMPLE, chunk_s=s), rules=whole.rules, learned=whole.learned
    )
    return plan(40 * 86400), plan(1800)


def rows(df):
    return sorted(df.select(*sorted(df.columns)).toPandas().astype(str).itertuples(index=False))


@pytest.mark.parametrize("step", ["app_sessions", "browser_sessions", "coverage", "unified"])
def test_same_rows(plans, step):
    whole, split = plans
    got = rows(getattr(split, step))
    assert got and got == rows(getattr(whole, step))


def test_same_dwells(plans):
    a, b = [rows(se.app_dwells(p.phone_events, p.th, F.lit(2_000_000_000_000_000))) for p in plans]
    assert a and a == b


def test_same_attribution(plans):
    a, b = [rows(at.attribute(at.signals(p.browser_events), p.th, tm.SAMPLE.wake_bound_s * 10**6)) for p in plans]
    assert a and a == b


def test_wide_chunks_where_no_user_day_is_large(spark, plans):
    whole = plans[0]
    day = lambda n: DayPlan(whole.events, whole.seeds, tm.SAMPLE, rules=whole.rules, learned=whole.learned, whole_rows=n)
    assert day(0).th == tm.SAMPLE and day(None).th == tm.SAMPLE
    assert day(10**6).th == replace(tm.SAMPLE, chunk_s=7 * 86400)
    assert rows(day(10**6).coverage) == rows(plans[1].coverage)
