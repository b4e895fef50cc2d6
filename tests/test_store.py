"""Partitioned events, marks of changed days, derived tables, retention."""

import datetime as dt
import uuid

import pytest

from conftest import SF
from daytrace.config import USER_DAY
from daytrace.operators import metrics as me
from daytrace.plans.day import DayPlan
from daytrace.sources import store as st
from daytrace.sources import telemetry as tm
from daytrace.sources.tables import checkpoint_dir
from pyspark.sql import functions as F

FIRST, LAST = dt.date(2024, 1, 10), dt.date(2024, 1, 12)


def folder(spark):
    return f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def events(spark):
    return tm.sample_plan(spark, SF).events


@pytest.fixture(scope="module")
def store(spark, events):
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    out = st.EventStore(spark, folder(spark), fields, buckets=3)
    out.append(events)
    return out


def files_of(df):
    return sorted(df.inputFiles())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_are_pruned_to_their_partitions(spark, store, events):
    got = store.read((FIRST, LAST))
    want = events.where(F.col("local_date").between(F.lit(FIRST), F.lit(LAST)))
    assert got.count() == want.count() > 0
    line = next(x for x in plan_of(got).splitlines() if "PartitionFilters" in x)
    assert "day" in line.split("PartitionFilters: [")[1].split("]")[0]
    read = spark.read.parquet(store.path).where(F.col("day").between(F.lit(FIRST - st.SLACK), F.lit(LAST + st.SLACK)))
    assert {r.day for r in read.select("day").distinct().collect()} <= {FIRST + dt.timedelta(days=k) for k in range(-1, 4)}


def test_marked_days_are_pruned_by_day_and_bucket(spark, store, events):
    marks = events.where("user_id = 0").where(F.col("local_date") == F.lit(FIRST)).select(*USER_DAY).distinct()
    got = store.of(marks)
    assert got.count() == events.join(marks, USER_DAY, "left_semi").count() > 0
    line = next(x for x in plan_of(got).splitlines() if "PartitionFilters" in x)
    filters = line.split("PartitionFilters: [")[1]
    assert "day" in filters and "bucket" in filters


def test_a_plan_over_some_days_gives_their_rows(spark, store):
    whole = tm.sample_plan(spark, SF)
    some = DayPlan(store.all(), whole.seeds, tm.SAMPLE, rules=whole.rules, learned=whole.learned, days=(FIRST, LAST))
    got = me.category_totals(some.classified).collect()
    want = me.category_totals(whole.classified).where(F.col("local_date").between(F.lit(FIRST), F.lit(LAST))).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def rows(table):
    return sorted((r.user_id, r.local_date.day, r.n) for r in table.read().collect())


def test_marks_that_come_during_a_recompute_stay(spark):
    base = folder(spark)
    day = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    frame = lambda data: spark.createDataFrame(data, "user_id long, local_date date, us long")
    at = lambda d: int(dt.datetime(d.year, d.month, d.day, 12, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    events = st.EventStore(spark, f"{base}/events", "user_id bigint, local_date date, us bigint")
    queue = st.MarkQueue(spark, f"{base}/marks")
    table = st.DerivedTable(spark, f"{base}/table", "user_id bigint, local_date date, n bigint")
    first = frame([(u, d, at(d)) for u in (1, 2, 3) for d in day])
    events.append(first)
    queue.mark(first)
    reads = []

    def build(ev):
        reads.append(1)
        out = ev.groupBy(*USER_DAY).agg(F.count("*").alias("n"))
        if len(reads) == 2:  # while the second one runs, user 3 sends one more event of the same day
            more = frame([(3, day[0], at(day[0]) + 2)])
            out = spark.createDataFrame(out.collect(), out.schema)
            queue.mark(more)
            events.append(more)
        return out

    assert st.recompute(events.of, queue, build, table)
    assert rows(table) == [(u, d.day, 1) for u in (1, 2, 3) for d in day]
    more = frame([(3, day[0], at(day[0]) + 1)])
    queue.mark(more)
    events.append(more)
    assert st.recompute(events.of, queue, build, table)
    assert (3, 1, 2) in rows(table)
    assert st.recompute(events.of, queue, build, table)
    assert (3, 1, 3) in rows(table) and len(rows(table)) == 9
    assert not st.recompute(events.of, queue, build, table) and len(reads) == 3


def test_a_day_that_becomes_empty_goes(spark):
    base = folder(spark)
    table = st.DerivedTable(spark, f"{base}/table", "user_id bigint, local_date date, n bigint")
    data = spark.createDataFrame([(u, dt.date(2024, 1, d), 5) for u in (1, 2) for d in (1, 2)], "user_id long, local_date date, n long")
    table.replace(data, data)
    table.replace(data.where("user_id = 1 and day(local_date) = 1"), data.limit(0))
    assert rows(table) == [(1, 2, 5), (2, 1, 5), (2, 2, 5)]
    table.replace(data, data.where("user_id = 2"))
    assert rows(table) == [(2, 1, 5), (2, 2, 5)]


def test_retention_drops_old_partitions_only(spark):
    base = folder(spark)
    events = st.EventStore(spark, f"{base}/events", "user_id bigint, local_date date, us bigint, synced boolean")
    day = 86400 * 10**6
    data = [(u, dt.date(1970, 1, 1) + dt.timedelta(days=d), d * day + u, not (u == 2 and d == 3)) for u in range(5) for d in range(10)]
    events.append(spark.createDataFrame(data, "user_id long, local_date date, us long, synced boolean"))
    young = {f for d, f in st.partition_values(spark, events.path).items() if d >= "1970-01-07"}
    before = {f: st.data_files(spark, next(iter(st.partition_values(spark, f).values()))) for f in young}
    gone = st.retire(spark, events.path, "day", dt.date(1970, 1, 7), needed=~F.col("synced"))
    assert gone == [f"1970-01-0{d}" for d in (1, 2, 3, 5, 6)]
    left = sorted((r.user_id, r.us // day) for r in events.all().collect())
    assert left == sorted([(2, 3)] + [(u, d) for u in range(5) for d in range(6, 10)])
    assert before == {f: st.data_files(spark, next(iter(st.partition_values(spark, f).values()))) for f in young}
    assert st.retire(spark, events.path, "day", dt.date(1970, 1, 7), needed=~F.col("synced")) == []
    assert st.retire(spark, f"{base}/absent", "day", dt.date(1970, 1, 7)) == []
