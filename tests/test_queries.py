"""Registered queries against their SQL on the smallest tables.

A spread of queries runs by default; TIDEGAUGE_ALL_QUERIES=1 runs every one.
"""

import os

import pytest

import __spark_entry__ as driver
from tests.conftest import SMALL
from tidegauge.catalog.check import difference, duckdb_over

DEFAULT = (
    "slice_longest_run_and_latest_load", "win01_daily_metrics_supplier", "agg01_resample_weekly",
    "agg04_operational_summary", "agg05_backlog_episodes", "agg08_scenario_summary", "fn10_kpi_table",
    "agg18_risk_signals", "q05_clean_default", "q05_clean_conservative", "agg28_repair_report",
    "q06_audit_findings", "aud10_row_evidence", "win12_rolling_stats", "win14_exponential_means",
    "fc14_fold_table", "fc20_conformal_adjustment", "fc31_monitor_metrics", "fc22_hybrid_one_corrector",
    "fc07_medians_and_spans", "fc08_ridge_two_features", "fc27_fitted_provenance", "fc33_monitor_outcomes",
    "agg25_manifest_of_lags", "set02_exclusion_reasons", "srt04_report_anomalies", "srt04_report_appendix",
    "fc29_importance_two_features", "fc35_located_differences", "fc31_monitor_state",
)
NAMES = sorted(driver.oracle_sql()) if os.environ.get("TIDEGAUGE_ALL_QUERIES") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return duckdb_over(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = driver.queries()[name](spark, SMALL).toPandas()
    assert difference(got, con.execute(driver.oracle_sql()[name]).df()) is None


def test_every_sql_names_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert not driver.entry(spark).isEmpty()
