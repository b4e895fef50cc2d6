"""Registered queries next to their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from daytrace.plans import catalogue
from scripts.check import TABLES, compare

KEYS = [
    "a2_envelope_validate", "a3_batch_atomic_reject", "a10_ingest_receipt", "c11_overlap_sweep",
    "c12_cluster_cross_device", "d1_classify_layers", "d7_domain_catalogue", "a14_app_catalogue", "d3_learned_prior_fold", "e3_focus_sessions", "p5_pattern_promotion",
    "m1_daily_metrics", "m9_trend_change", "g2_goal_window", "h5_daily_summary_doc", "t4_payload_gate",
    "s1_stream_attribution", "s2_wake_reconcile", "s3_stream_ingest", "s4_late_recompute", "s5_stream_sessions",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, key):
    got = entry.queries()[key](spark, SF).toPandas()
    assert len(got)
    assert compare(got, duck.execute(entry.oracle_sql()[key]).df()) == "ok"


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_results_do_not_change_between_runs(spark):
    q = entry.queries()["e3_focus_sessions"]
    a, b = (q(spark, SF).toPandas() for _ in range(2))
    assert compare(a, b) == "ok"
