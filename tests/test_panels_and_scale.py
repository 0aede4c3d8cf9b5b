import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidegauge.catalog import fixtures as fx
from tidegauge.operators import features as X
from tidegauge.operators.audit import AuditConfig, audit, check_prepared, raise_for_findings, robust_limits
from tidegauge.operators.clean import calendar_tasks, densify
from tidegauge.operators.episodes import backlog_episodes
from tidegauge.operators.metrics import daily_metrics
from tidegauge.operators.ordered import add_positions, expected_metrics
from tidegauge.operators.quantiles import exact_quantiles
from tidegauge.operators.resample import resample
from tidegauge.spec import COUNTS, SRC_ROW, CapacityError, DataQualityError, SeriesSpec


@pytest.fixture(scope="module")
def panel(spark):
    df, spec = fx.metrics(spark, SMALL, "flag")
    return df.persist(), spec


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_equals_each_series_alone(panel):
    df, spec = panel
    alone = SeriesSpec()
    for key in ("A", "N"):
        one = df.where(F.col("series") == key)
        bare = one.drop("series", "total_load", "net_intake", "growth_pct", "roll7", "roll14", "offset_ratio", "streak")
        again = daily_metrics(bare, alone, trusted=True)
        assert again.exceptAll(one.select(again.columns)).isEmpty()
        a = backlog_episodes(again, alone)
        b = backlog_episodes(df, spec).where(F.col("series") == key).select(a.columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_keyed_plans_have_no_single_partition(panel, spark):
    df, spec = fx.metrics(spark, SMALL, "supplier")
    for out in (df, backlog_episodes(df, spec), resample(df, spec, "weekly"), X.build_features(df, spec).frame):
        assert "SinglePartition" not in plan(out)


def test_metrics_and_episodes_share_one_exchange_by_series(spark):
    df, spec = fx.metrics(spark, SMALL, "supplier")
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(backlog_episodes(df, spec)))
    assert len(exchanges) == 2  # (series, date) for the roll-up, then series


def test_tasks_of_a_dense_panel_are_dealt_by_its_calendar(spark):
    """Few present days that become many: a task gets a bounded share of the calendar, however small the input."""
    days = spark.range(400).select(
        (F.col("id") % 200).alias("series"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.when(F.col("id") < 200, 0).otherwise(999).cast("int")).alias("date"),
        F.lit(1).alias("n"),
    )
    days = days.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) series, DATE'2020-01-01' date, 1 n UNION ALL SELECT 1000, NULL, 1"))
    spec = SeriesSpec.of("series")
    assert calendar_tasks(days, SeriesSpec()) is None and calendar_tasks(days, spec) is None
    assert calendar_tasks(days.where("false"), spec, 10) is None and calendar_tasks(days, spec, 200_001) is None
    tasks = calendar_tasks(days, spec, 10_000)
    assert tasks == 21
    dense = densify(days, spec, tasks=tasks)
    sizes = [r["count"] for r in dense.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_001 and max(sizes) <= 30_000
    plain = densify(days, spec)
    assert dense.exceptAll(plain).isEmpty() and plain.exceptAll(dense).isEmpty()


def test_supplier_panel_is_dealt_by_its_calendar(spark, monkeypatch):
    plain, spec = fx.metrics(spark, SMALL, "supplier")
    monkeypatch.setattr(fx, "calendar_tasks", lambda rows, spec: calendar_tasks(rows, spec, 2_000))
    dealt, _ = fx.metrics(spark, SMALL, "supplier")
    found = re.findall(r"hashpartitioning\(series#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(dealt))
    assert len(found) == 1 and int(found[0]) > 8
    assert len(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(backlog_episodes(dealt, spec)))) == 2
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()


def test_scan_reads_only_needed_columns(spark):
    text = plan(fx.lineitem_daily(spark, SMALL, "supplier")[0])
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_unkeyed_duplicates_are_refused(spark):
    df = spark.sql("select date'2023-01-01' date, 1L stock_a, 1L stock_b, 1L transfer, 1L discharge from range(2)")
    with pytest.raises(CapacityError, match="one row per series"):
        daily_metrics(df)
    keyed = df.withColumn("k", F.lit(1))
    with pytest.raises(Exception, match="duplicate reporting date"):
        daily_metrics(keyed, SeriesSpec.of("k")).collect()


def hot(spark):
    """A third of all rows share one series and one date; values tie heavily."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("series"),
        F.when(F.col("id") % 3 == 0, F.lit("2023-05-05").cast("date"))
        .otherwise(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 211).cast("int")))
        .alias("date"),
        F.col("id").alias(SRC_ROW),
        *[((F.xxhash64("id", F.lit(c)) % 50) * 1.0).alias(c) for c in COUNTS],
    )


def test_exact_quantiles_on_hot_groups(spark):
    df = hot(spark)
    probs = {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0, "e": 1 / 3}
    got = {r.series: r for r in exact_quantiles(df, ["series"], "intake", probs, accuracy=20).collect()}
    want = df.groupBy("series").agg(F.percentile("intake", F.array(*map(F.lit, probs.values()))).alias("q"))
    for r in want.collect():
        assert [got[r.series][n] for n in probs] == pytest.approx(r.q, abs=1e-9)


def test_exact_quantiles_on_small_groups(spark):
    df = spark.range(600).select((F.col("id") % 37 % 11).alias("g"), (F.xxhash64("id") % 1000 / 7.0).alias("x"))
    probs = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.25}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, probs.values()))).alias("q")).collect():
        assert [got[r.g][n] for n in probs] == pytest.approx(r.q, abs=1e-9)


def test_positions_and_chunks_equal_plain_windows(spark):
    df, spec = hot(spark), SeriesSpec.of("series")
    placed = add_positions(df, spec, bucket=F.floor(F.col(SRC_ROW) / 100))
    wrong = placed.withColumn(
        "_rn", F.expr("row_number() over (partition by series order by date, src_row)")
    ).where("_rn <> _pos")
    assert wrong.isEmpty() and placed.count() == 6000
    load, net = F.col("stock_a") + F.col("stock_b"), F.col("transfer") - F.col("discharge")
    plain = expected_metrics(df, spec, load, net)
    chunked = expected_metrics(df, spec, load, net, chunk_rows=40).select(plain.columns)
    assert plain.exceptAll(chunked).isEmpty() and chunked.exceptAll(plain).isEmpty()


def test_robust_limits_are_exact(spark):
    df, spec = hot(spark), SeriesSpec.of("series")
    got = {r.series: r for r in robust_limits(df, spec).collect()}
    middle = df.groupBy("series").agg(*[F.median(c).alias(c) for c in COUNTS]).collect()
    for m in middle:
        assert [got[m.series][f"_med_{c}"] for c in COUNTS] == [m[c] for c in COUNTS]
        own = df.where(F.col("series") == m.series)
        off = own.agg(*[F.median(F.abs(F.col(c) - F.lit(m[c]))).alias(c) for c in COUNTS]).first()
        assert [got[m.series][f"_mad_{c}"] for c in COUNTS] == [off[c] for c in COUNTS]


def test_audit_is_quiet_on_clean_metrics_and_loud_on_noise(panel, spark):
    df, spec = panel
    found = audit(df, spec, AuditConfig(outlier_threshold=None))
    codes = {r.code for r in found.findings.collect()}
    assert codes <= {"TRANSFER_EXCEEDS_STOCK_A", "DISCHARGE_EXCEEDS_STOCK_B"}
    bad = audit(df.withColumn("streak", F.col("streak") + 1), spec)
    assert "DERIVED_METRIC_MISMATCH:streak" in {r.code for r in bad.findings.collect()}
    with pytest.raises(DataQualityError):
        raise_for_findings(bad)
    assert audit(spark.createDataFrame([], df.schema), spec).findings.first().code == "EMPTY_DATASET"
    assert audit(df.drop("intake"), spec).findings.first().columns == ["intake"]
    check_prepared(df, spec)


def test_exponential_means_cross_chunks(spark):
    import pandas as pd

    n = 1500
    df = spark.range(n).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (F.sin("id") * 100).alias("x"),
    )
    wanted = [("x", 7, "e7"), ("x", 30, "e30"), ("x", 2, "e2")]
    got = X.exponential_means(df, SeriesSpec(), wanted).orderBy("date").toPandas()
    for _, span, name in wanted:
        want = got.x.shift(1).ewm(span=span, adjust=False, min_periods=span).mean()
        pd.testing.assert_series_equal(got[name], want, check_names=False, rtol=1e-9, atol=1e-9)


def test_gap_in_smoothing_is_an_error(spark):
    df = spark.sql("select date_add(date'2020-01-01', cast(id as int)) date, if(id = 3, null, id) x from range(6)")
    with pytest.raises(Exception, match="gap inside x"):
        X.exponential_means(df, SeriesSpec(), [("x", 2, "e")]).collect()


def test_feature_selection_excludes_the_future(panel):
    df, spec = panel
    built = X.build_features(df, spec)
    kept, reasons = X.select_safe_features(built.frame)
    assert not [c for c in kept if "target" in c or "next_" in c]
    why = {r.feature: r.reason for r in reasons.collect()}
    code = {c: text.partition(":")[0] for c, text in why.items()}
    assert code["target_total_load_t_plus_7d"] == "future"
    assert code["operational_stock_ratio"] == "same_day"
    with pytest.raises(CapacityError):
        X.split_features(built, "unknown")
