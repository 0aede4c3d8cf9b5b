from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidegauge.catalog import fixtures as fx
from tidegauge.operators import kpis as K
from tidegauge.operators.scenario import Scenario
from tidegauge.plans import analysis as A
from tidegauge.plans.experiment import verify_pipeline
from tidegauge.operators.metrics import daily_metrics


def test_period_is_cut_before_metrics_but_after_for_the_dashboard(spark):
    df, spec = fx.dense_daily(spark, SMALL, "flag")
    cut = A.analyse_clean(K.anomaly_rows.__globals__["flag_anomalies"](df), spec, A.AnalysisConfig("1997-01-01"))
    first = cut.daily.where("date = '1997-01-01'").collect()
    assert first and all(r.growth_pct is None for r in first)
    metrics, _ = fx.metrics(spark, SMALL, "flag")
    chart = A.chart_data(metrics, spec, "1997-01-01", None, "daily")
    assert not chart.where("date = '1997-01-01' and growth_pct is not null").isEmpty()


def test_scenario_query(spark):
    df, spec = fx.dense_daily(spark, SMALL, "flag")
    found = A.scenario_query(A.analyse_clean(K.flag_anomalies(df), spec), Scenario(5, 60))
    counted = found.episodes.groupBy("series").count()
    joined = found.summary.join(counted, "series", "left")
    assert joined.where(F.col("stress_episodes") != F.coalesce("count", F.lit(0))).isEmpty()


def test_layers_are_written_and_verify(spark, tmp_path):
    raw, spec = fx.dirty(spark, SMALL, "flag")
    layers = A.layered_etl(raw, str(tmp_path / "lake"), spec)
    counts = A.layer_counts(layers)
    assert counts["silver"][0] == counts["metrics"][0] == counts["features"][0] > 0
    rebuilt = daily_metrics(layers["silver"], spec, trusted=True)
    assert verify_pipeline({"metrics": rebuilt}, {"metrics": layers["metrics"]}, spec) == {"metrics": None}
    assert spark.read.json(str(tmp_path / "lake" / "audit_raw")).count() > 0


def test_report_tables(spark):
    df, spec = fx.dense_daily(spark, SMALL, "flag")
    tables = A.report(A.analyse_clean(K.flag_anomalies(df), spec))
    assert tables["executive_summary"].first().executive_summary.startswith("Load: mean ")
    assert tables["appendix"].groupBy("series").count().agg(F.max("count")).first()[0] == 60
    assert tables["insights"].count() > 0 and tables["operations"].count() == 42
