"""Queries that write tables to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.catalog.cleaning import final_sql, prefix, repaired_sql
from tidegauge.catalog.fixtures import daily_sql, dense_daily, dirty, lineitem_daily, metrics, with_metrics
from tidegauge.catalog.forecast import BY, CAL, FRAME, PRED, WIDE, _baselines, _stored
from tidegauge.catalog.registry import register
from tidegauge.operators import clean as C
from tidegauge.operators.audit import AuditConfig, audit
from tidegauge.operators.features import lags, scrub
from tidegauge.operators.forecast import evaluate as V
from tidegauge.operators.forecast import hybrid as H
from tidegauge.operators.forecast import prepare as P
from tidegauge.operators.metrics import daily_metrics
from tidegauge.operators.orderstats import column_facts
from tidegauge.plans import analysis as A
from tidegauge.plans import experiment as X
from tidegauge.session import cut_lineage, shared_folder
from tidegauge.sources import readers, writers
from tidegauge.spec import COUNTS, PREDICTION_COLUMNS, SRC_ROW, add_sql


def _path(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@register(
    "src01_snk01_csv_round_trip",
    f"""WITH daily AS ({daily_sql('supplier')}) SELECT CAST(series AS VARCHAR) AS series, strftime(date, '%Y-%m-%d') AS date,
    {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in COUNTS)} FROM daily""",
)
def _(spark, sf):
    days, spec = lineitem_daily(spark, sf, "supplier")
    path = _path(spark)
    writers.write_csv(days, path)
    raw = readers.read_raw_csv(spark, path, header=days.columns, extra=spec.keys)
    return raw.drop(SRC_ROW)


@register(
    "src01_csv_then_clean",
    f"""WITH daily AS ({daily_sql(None)}) SELECT count(*) AS reported_days, CAST(sum(intake) AS BIGINT) AS intake,
    CAST(sum(transfer) AS BIGINT) AS transfer, CAST(sum(discharge) AS BIGINT) AS discharge FROM daily""",
)
def _(spark, sf):
    days, spec = lineitem_daily(spark, sf)
    path = _path(spark)
    writers.write_csv(days, path)
    data = C.clean(readers.read_raw_csv(spark, path, header=days.columns), spec).data
    return data.agg(
        F.count_if(~F.col("is_imputed_date")).alias("reported_days"),
        *[F.sum(c).alias(c) for c in ("intake", "transfer", "discharge")],
    )


@register(
    "src01_csv_of_two_column_orders",
    f"""WITH daily AS ({daily_sql('supplier')}) SELECT CAST(series AS VARCHAR) AS series, strftime(date, '%Y-%m-%d') AS date,
    {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in COUNTS)} FROM daily""",
)
def _(spark, sf):
    days, spec = lineitem_daily(spark, sf, "supplier")
    path = _path(spark)
    early = F.year("date") < 1998
    writers.write_csv(days.where(early), f"{path}/a")
    turned = days.where(~early).select(*spec.keys, *reversed(COUNTS), "date")
    writers.write_csv(turned.withColumnRenamed("date", " Date* "), f"{path}/b")
    raw = readers.read_raw_csv(spark, [f"{path}/a", f"{path}/b"], names={" Date* ": "date"}, extra=spec.keys)
    return raw.drop(SRC_ROW)


@register(
    "src03_snk02_parquet_round_trip",
    f"WITH daily AS ({daily_sql('nation')}) SELECT *, CAST(year(date) AS INTEGER) AS year FROM daily",
)
def _(spark, sf):
    days, spec = lineitem_daily(spark, sf, "nation")
    path = _path(spark)
    writers.write_parquet(days.withColumn("year", F.year("date")), path, partition_by=["year"])
    return readers.read_feature_table(spark, path, spec)


@register(
    "snk03_strict_json_round_trip",
    with_metrics("nation") + " SELECT series, date, growth_pct, streak FROM m", ("growth_pct",),
)
def _(spark, sf):
    df, spec = metrics(spark, sf, "nation")
    path = _path(spark)
    writers.write_json(df.select(*spec.index, "growth_pct", "streak"), path)
    return spark.read.schema("series bigint, date date, growth_pct double, streak int").json(path)


@register(
    "snk04_event_log",
    with_metrics("nation") + """ SELECT CASE WHEN year(date) < 1996 THEN 'early' ELSE 'late' END AS run, series, date, streak, growth_pct
    FROM m WHERE streak >= 3""",
    ("growth_pct",),
)
def _(spark, sf):
    df, spec = metrics(spark, sf, "nation")
    events = cut_lineage(df.where("streak >= 3").select(*spec.index, "streak", "growth_pct"))
    early, late = events.where("year(date) < 1996"), events.where("year(date) >= 1996")
    path = _path(spark)
    writers.write_attempt(late, path, "late")  # fails before its commit
    writers.append_run(early, path, "early")
    writers.append_run(late, path, "late")
    writers.append_run(early, path, "early")  # a retry of what was done
    return readers.read_runs(spark, path, events.schema)


@register(
    "src05_set01_prediction_round_trip",
    PRED + """ SELECT origin AS forecast_origin_date, target_date, actual AS actual_value, model AS model_name, fc AS reconstructed_absolute_prediction,
    fold, backlog_state FROM pred""",
    ("actual_value", "reconstructed_absolute_prediction"),
)
def _(spark, sf):
    out, _, _ = _baselines(spark, sf)
    path = _path(spark)
    writers.write_csv(out.select(*PREDICTION_COLUMNS), path)
    return readers.read_predictions(spark, path).select(
        "forecast_origin_date", "target_date", "actual_value", "model_name",
        "reconstructed_absolute_prediction", "fold", "backlog_state",
    )


@register(
    "snk07_layered_etl",
    prefix() + repaired_sql() + f""", fin AS ({final_sql()}) SELECT series, date, {', '.join(COUNTS)}, quality_flag, stock_a + stock_b AS total_load FROM fin""",
)
def _(spark, sf):
    raw, spec = dirty(spark, sf, BY)
    layers = A.layered_etl(raw, _path(spark), spec)
    return layers["features"].select(*spec.index, *COUNTS, "quality_flag", "total_load")


@register(
    "prj14_non_finite_scrub",
    with_metrics("nation") + " SELECT series, date, CASE WHEN transfer > 0 THEN discharge / CAST(transfer AS DOUBLE) END AS ratio FROM m",
    ("ratio",),
)
def _(spark, sf):
    df, spec = metrics(spark, sf, "nation")
    ratio = F.when(F.col("transfer") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide("discharge", "transfer")
    )
    return scrub(df.select(*spec.index, ratio.alias("ratio")))


@register(
    "aud06_prj05_text_flags",
    with_metrics("nation") + """ SELECT * FROM (
    SELECT series, 'INVALID_BOOLEAN_FLAG:anomaly_transfer' AS code, count(*) FILTER (WHERE day(date) = 9) AS affected_rows FROM m GROUP BY 1
    UNION ALL SELECT series, 'INCONSISTENT_FLAG:anomaly_transfer', count(*) FILTER (WHERE day(date) = 9 AND anomaly_transfer) FROM m GROUP BY 1) WHERE affected_rows > 0""",
)
def _(spark, sf):
    df, spec = metrics(spark, sf, "nation")
    text = F.when(F.dayofmonth("date") == 9, "maybe").otherwise(
        F.when(F.col("anomaly_transfer"), " YES ").otherwise("n")
    )
    days = df.select(*spec.index, *COUNTS, text.alias("anomaly_transfer"))
    found = audit(days, spec, AuditConfig(outlier_threshold=None))
    return found.findings.where("code like '%FLAG%'").select("series", "code", "affected_rows")


@register(
    "set04_disjoint_partitions",
    FRAME + """ SELECT 'development' AS part, count(*) AS shared_rows FROM (
    SELECT date, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos,
    count(*) OVER (PARTITION BY series) - greatest(1, ceil(count(*) OVER (PARTITION BY series) * CAST(0.2 AS DOUBLE))) AS s FROM p)
    WHERE pos < s - 7 AND day(date) <= 3""",
)
def _(spark, sf):
    df, spec = metrics(spark, sf, BY)
    parts = P.partition_labels(P.prepare_forecast(df, spec).frame.select(*spec.index), spec)
    # beside the holdout, some days of development that must be found as shared
    late = parts.where("part = 'holdout' OR day(date) <= 3").select(*spec.index)
    both = parts.where("part = 'development'").join(late, list(spec.index), "left_semi")
    return both.agg(F.lit("development").alias("part"), F.count(F.lit(1)).alias("shared_rows"))


FLOWS = ("intake", "transfer", "discharge", "net_intake", "stock_a", "stock_b")


@register(
    "set02_exclusion_reasons",
    FRAME + " " + " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, 'same_day' AS reason, count({c}) AS known_rows, count(DISTINCT {c}) AS values FROM m" for c in FLOWS]
        + [f"SELECT '{name}', 'future', count({x}), count(DISTINCT {x}) FROM p" for name, x in ((P.TARGET, "target"), (P.CHANGE, "target - cur"))]
    ),
)
def _(spark, sf):
    df, spec = metrics(spark, sf, BY)
    prepared = P.prepare_forecast(df, spec)
    reasons = P.exclusion_manifest(prepared, [*df.columns, P.TARGET, P.CHANGE]).where(F.col("feature").isin(*FLOWS, P.TARGET, P.CHANGE))
    facts = column_facts(df, FLOWS).unionByName(column_facts(prepared.frame, (P.TARGET, P.CHANGE)))
    known = facts.select(F.col("column").alias("feature"), (F.col("rows") - F.col("missing_values")).alias("known_rows"), F.col("unique_values").alias("values"))
    return reasons.join(known, "feature")


@register(
    "jn07_coverage_checked_join",
    WIDE + " SELECT series, origin AS forecast_origin_date, actual AS actual_value, half_drift AS external_prediction FROM wide",
    ("actual_value", "external_prediction"),
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    keys = [*spec.keys, "forecast_origin_date"]
    oof = out.where("fold <> 'holdout'")
    held = oof.where("model_name = 'persistence'").select(*keys, "actual_value")
    theirs = oof.where("model_name = 'half_drift'").select(
        *keys, F.col("actual_value").alias("actual"), F.col(V.FORECAST).alias("prediction")
    )
    return V.coverage_checked(held, theirs, keys)


@register("fc22_residual_hybrid")
def _(spark, sf):
    rows, calendar, prepared, spec = _stored(spark, sf)
    base = cut_lineage(X.baseline_predictions(rows.where("role = 'validation'"), spec).where("model_name = 'seven_day_drift'"))
    groups = {"compact": prepared.compact, "expanded": prepared.expanded}
    grid = H.correctors(groups, X.RIDGE_ALPHAS)
    found = H.residual_hybrid(base, prepared.frame, spec, calendar, prepared.config, grid, "seven_day_drift_hybrid")
    both = found.inner.unionByName(found.predictions)
    return V.regression_metrics(both, ["model_name", "configuration", "evaluation_label", "fold"])


@register(
    "fc27_leakage_audit",
    CAL + """, a AS (SELECT p.*, lead(cur, 7) OVER (PARTITION BY series ORDER BY date) AS later FROM p),
    r AS (SELECT a.*, fold, date <= train_last AS train FROM a JOIN folds ON date <= train_last OR date BETWEEN first_day AND last_day_),
    g AS (SELECT fold, count(*) FILTER (train) AS training_rows, count(*) FILTER (NOT train) AS validation_rows,
      max(date) FILTER (train) AS last_training_day, min(date) FILTER (NOT train) AS first_validation_day,
      count(*) FILTER (later <> target) AS label_faults FROM r GROUP BY 1)
    SELECT *, CAST(date_diff('day', last_training_day, first_validation_day) - 1 AS INTEGER) AS gap_days,
      date_diff('day', last_training_day, first_validation_day) > 7 AS labels_known FROM g""",
)
def _(spark, sf):
    _, calendar, prepared, spec = _stored(spark, sf)
    return P.leakage_facts(prepared.frame, spec, [calendar.holdout, *calendar.folds])


@register("fc35_verify_layers")
def _(spark, sf):
    days, spec = dense_daily(spark, sf, "nation")
    path = _path(spark)
    writers.write_parquet(daily_metrics(days, spec, trusted=True), path)
    stored = readers.read_feature_table(spark, path, spec)
    rebuilt = daily_metrics(dense_daily(spark, sf, "nation")[0], spec, trusted=True)
    found = X.verify_pipeline({"metrics": rebuilt}, {"metrics": stored}, spec)
    return spark.createDataFrame(list(found.items()), "layer string, first_difference string")


@register(
    "fc35_located_differences",
    with_metrics("nation") + """ SELECT 'daily' AS layer, '1998' AS in_year, '1998-03' AS in_month, 'intake' AS field, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right,
      CAST(0 AS BIGINT) AS null_places, count(*) AS changed_values FROM m WHERE date BETWEEN DATE '1998-03-05' AND DATE '1998-03-07' HAVING count(*) > 0
    UNION ALL SELECT 'metrics', '2000', '2000-02', '(rows)', count(*), 0, 0, 0 FROM m WHERE date = DATE '2000-02-29' HAVING count(*) > 0
    UNION ALL SELECT 'metrics', '2000', '2000-02', 'roll7', 0, 0, count(*), 0 FROM m WHERE date = DATE '2000-02-09' AND roll7 IS NOT NULL HAVING count(*) > 0
    UNION ALL SELECT 'metrics', '1999', strftime(date, '%Y-%m'), 'streak', 0, 0, 0, count(*) FROM m WHERE year(date) = 1999 AND day(date) = 31 GROUP BY 3""",
)
def _(spark, sf):
    daily, spec = dense_daily(spark, sf, "nation")
    derived, _ = metrics(spark, sf, "nation")
    # the lags stay as they are and must not be named
    lagged = add_sql(derived, lags(spec, (1, 7))).select(*spec.index, "lag_1d_total_load", "lag_7d_total_load")
    day = F.col(spec.date)
    wrong = {
        "daily": daily.withColumn("intake", F.col("intake") + day.between("1998-03-05", "1998-03-07").cast("int")),
        "metrics": derived.where(day != "2000-02-29").withColumns({
            "roll7": F.when(day != "2000-02-09", F.col("roll7")),
            "streak": F.col("streak") - ((F.year(day) == 1999) & (F.dayofmonth(day) == 31)).cast("int"),
        }),
        "lags": lagged,
    }
    stored = {}
    for name, table in wrong.items():
        path = _path(spark)
        writers.write_parquet(table, path)
        stored[name] = readers.read_feature_table(spark, path, spec)
    found = X.locate_layers({"daily": daily, "metrics": derived, "lags": lagged}, stored, spec)
    return found.select("layer", "in_year", "in_month", "field", "only_left", "only_right", "null_places", "changed_values")


@register("q08_single_model_run")
def _(spark, sf):
    df, spec = metrics(spark, sf, BY)
    predictions, _, _ = X.single_model_run(df, spec)
    return V.regression_metrics(predictions, ["model_name", "configuration", "fold"])


