"""Queries over forecast partitions, errors, intervals, blends, gates and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.fixtures import metrics, with_metrics
from tidegauge.catalog.registry import register
from tidegauge.operators.forecast import boosted as B
from tidegauge.operators.forecast import ensemble as N
from tidegauge.operators.forecast import evaluate as V
from tidegauge.operators.forecast import gate as G
from tidegauge.operators.forecast import hybrid as H
from tidegauge.operators.forecast import importance as M
from tidegauge.operators.forecast import intervals as I
from tidegauge.operators.forecast import ledger as K
from tidegauge.operators.forecast import linear as L
from tidegauge.operators.forecast import monitor as O
from tidegauge.operators.forecast import prepare as P
from tidegauge.operators.forecast.smoothing import smoothing_forecasts, too_short
from tidegauge.plans import experiment as X
from tidegauge.session import cut_lineage

BY = "flag"
W = "PARTITION BY series ORDER BY date"
FC = "reconstructed_absolute_prediction"

FRAME = f"""{with_metrics(BY)}, p AS (SELECT * FROM (SELECT series, date, CAST(total_load AS DOUBLE) AS cur,
   CAST(lag(total_load, 7) OVER ({W}) AS DOUBLE) AS lag7, CAST(lead(total_load, 7) OVER ({W}) AS DOUBLE) AS target, is_imputed_date,
   anomaly_transfer OR anomaly_discharge OR anomaly_negative AS has_anomaly, net_intake AS net_at, streak > 0 AS backlog_state,
   total_load / CAST(12000 AS DOUBLE) AS util FROM m) WHERE target IS NOT NULL)"""
CAL = FRAME + """, c0 AS (SELECT min(date) AS f, max(date) AS l, date_diff('day', min(date), max(date)) + 1 AS n FROM p),
  c1 AS (SELECT *, n - greatest(1, CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS hs FROM c0),
  c2 AS (SELECT *, hs - 7 AS dev, CASE WHEN hs - 7 < 5 * 56 + 67 THEN greatest(14, (hs - 7 - 67) // 5) ELSE 56 END AS size FROM c1),
  folds AS (SELECT CAST(i AS INTEGER) AS fold, CAST(f + CAST(dev - (6 - i) * size - 8 AS INTEGER) AS DATE) AS train_last,
      CAST(f + CAST(dev - (6 - i) * size AS INTEGER) AS DATE) AS first_day,
      CAST(f + CAST(dev - (5 - i) * size - 1 AS INTEGER) AS DATE) AS last_day_ FROM c2, range(1, 6) r(i)
    UNION ALL SELECT 0, f + CAST(dev - 1 AS INTEGER), f + CAST(hs AS INTEGER), l FROM c2)"""
HELD = CAL + """, held AS (SELECT p.*, fold FROM p JOIN folds ON date BETWEEN first_day AND last_day_)"""


def _rows(model, forecast):
    return f"""SELECT series, date AS origin, date + 7 AS target_date, target AS actual, cur, '{model}' AS model, {forecast} AS fc,
      CASE WHEN fold = 0 THEN 'holdout' ELSE CAST(fold AS VARCHAR) END AS fold, is_imputed_date, has_anomaly, backlog_state, util >= 0.8 AS stress, net_at, util FROM held"""


PRED = HELD + f""", pred AS ({_rows('persistence', 'cur')} UNION ALL {_rows('seven_day_drift', '2 * cur - lag7')}
   UNION ALL {_rows('half_drift', '1.5 * cur - CAST(0.5 AS DOUBLE) * lag7')})"""


def _prepared(spark, sf):
    df, spec = metrics(spark, sf, BY)
    return P.prepare_forecast(df, spec), spec


def _held(spark, sf):
    prepared, spec = _prepared(spark, sf)
    calendar = P.plan_calendar(prepared.frame, spec, prepared.config)
    rows = P.assign_folds(prepared.frame, spec, [calendar.holdout, *calendar.folds])
    return rows, calendar, prepared, spec


def _stored(spark, sf):
    """Held rows over a frame that is written once, for queries that fit models."""
    prepared, spec = _prepared(spark, sf)
    frame = cut_lineage(prepared.frame)
    prepared = P.Prepared(frame, prepared.compact, prepared.expanded, spec, prepared.config)
    calendar = P.plan_calendar(frame, spec, prepared.config)
    rows = P.assign_folds(frame, spec, [calendar.holdout, *calendar.folds])
    return rows, calendar, prepared, spec


def _baselines(spark, sf):
    rows, calendar, prepared, spec = _held(spark, sf)
    held = rows.where("role = 'validation'")
    half = 1.5 * F.col(P.CURRENT) - 0.5 * F.col("load_lag_7")
    forecasts = {"persistence": V.persistence(), "seven_day_drift": V.drift(), "half_drift": half}
    return V.stacked_predictions(held, spec, forecasts, ""), calendar, spec


@register(
    "fc01_change_target",
    FRAME + " SELECT series, date, target - cur AS target_change, cur + (target - cur) AS rebuilt FROM p",
    ("target_change", "rebuilt"),
)
def _(spark, sf):
    prepared, _ = _prepared(spark, sf)
    return prepared.frame.select(
        "series", "date", F.col(P.CHANGE).alias("target_change"),
        P.reconstruct(F.col(P.CURRENT), F.col(P.CHANGE)).alias("rebuilt"),
    )


@register(
    "fc02_fc03_baseline_predictions",
    PRED + " SELECT series, origin AS forecast_origin_date, target_date, actual AS actual_value, model AS model_name, fc AS reconstructed_absolute_prediction, fc - cur AS predicted_change_7d, fold FROM pred",
    ("actual_value", FC, "predicted_change_7d"),
)
def _(spark, sf):
    out, _, _ = _baselines(spark, sf)
    return out.select("series", "forecast_origin_date", "target_date", "actual_value", "model_name", FC, "predicted_change_7d", "fold")


@register(
    "fc04_partition_labels",
    FRAME + """ SELECT series, date, CAST(pos AS INTEGER) AS position, CASE WHEN pos >= s THEN 'holdout' WHEN pos >= s - 7 THEN 'embargo' ELSE 'development' END AS part FROM (
    SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos,
    count(*) OVER (PARTITION BY series) - greatest(1, ceil(count(*) OVER (PARTITION BY series) * CAST(0.2 AS DOUBLE))) AS s FROM p)""",
)
def _(spark, sf):
    prepared, spec = _prepared(spark, sf)
    return P.partition_labels(prepared.frame.select(*spec.index), spec)


@register(
    "jn11_fold_assignment",
    CAL + """ SELECT series, date, fold, CASE WHEN date <= train_last THEN 'train' ELSE 'validation' END AS role FROM p JOIN folds
    ON date <= train_last OR date BETWEEN first_day AND last_day_""",
)
def _(spark, sf):
    rows, _, _, _ = _held(spark, sf)
    return rows.select("series", "date", "fold", "role")


METRICS = """count(*) AS rows, avg(abs(actual - fc)) AS mae, sqrt(avg((actual - fc) * (actual - fc))) AS rmse,
    avg(CASE WHEN abs(actual) > 1e-12 THEN abs((actual - fc) / actual) END) * 100 AS mape_percent,
    1 - sum((actual - fc) * (actual - fc)) / nullif(count(*) * var_pop(actual), 0) AS r2,
    avg(abs(actual - fc)) / nullif(avg(abs(actual - cur)), 0) AS mase_vs_persistence,
    coalesce((avg(abs(actual - cur)) - avg(abs(actual - fc))) / nullif(avg(abs(actual - cur)), 0) * 100, 0) AS mae_improvement_vs_persistence_percent,
    avg(abs(actual - cur)) AS persistence_mae"""
METRIC_NAMES = ("mae", "rmse", "mape_percent", "r2", "mase_vs_persistence", "mae_improvement_vs_persistence_percent", "persistence_mae")


@register(
    "fc13_regression_metrics",
    PRED + f" SELECT series, model AS model_name, fold, {METRICS} FROM pred GROUP BY 1, 2, 3", METRIC_NAMES,
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    return V.regression_metrics(out, [*spec.keys, "model_name", "fold"])


@register(
    "fc14_fold_table",
    PRED + f""" SELECT model_name, 'default' AS configuration, x.fold, rows, {', '.join(METRIC_NAMES)}, c0.f AS training_start, train_last AS training_end,
    first_day AS validation_start, last_day_ AS validation_end, 7 AS gap_rows FROM
    (SELECT model AS model_name, fold, {METRICS} FROM pred WHERE fold <> 'holdout' GROUP BY 1, 2) x JOIN folds ON CAST(folds.fold AS VARCHAR) = x.fold, c0""",
    METRIC_NAMES,
)
def _(spark, sf):
    out, calendar, _ = _baselines(spark, sf)
    return V.fold_table(out.where("fold <> 'holdout'"), calendar)


SCORES = PRED + """, ft AS (SELECT model, fold, avg(abs(actual - fc)) AS mae FROM pred WHERE fold <> 'holdout' GROUP BY 1, 2),
  sc AS (SELECT model AS model_name, avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae, max(mae) AS worst_mae, count(*) AS folds FROM ft GROUP BY 1)"""


@register(
    "srt06_fc15_model_ranking",
    SCORES + " SELECT *, 'default' AS configuration, CAST(row_number() OVER (ORDER BY mean_mae, std_mae, model_name) AS INTEGER) AS rank FROM sc",
    ("mean_mae", "std_mae", "worst_mae"),
)
def _(spark, sf):
    out, calendar, _ = _baselines(spark, sf)
    return V.ranking(V.select_best(V.candidate_scores(V.fold_table(out.where("fold <> 'holdout'"), calendar))))


@register(
    "fc34_comparison_table",
    SCORES + f""", ho AS (SELECT model AS model_name, {METRICS} FROM pred WHERE fold = 'holdout' GROUP BY 1)
    SELECT sc.*, 'default' AS configuration, ho.rows AS holdout_rows, {', '.join(f'ho.{c} AS holdout_{c}' for c in METRIC_NAMES)} FROM sc LEFT JOIN ho USING (model_name)""",
    ("mean_mae", "std_mae", "worst_mae", *[f"holdout_{c}" for c in METRIC_NAMES]),
)
def _(spark, sf):
    out, calendar, _ = _baselines(spark, sf)
    scores = V.candidate_scores(V.fold_table(out.where("fold <> 'holdout'"), calendar))
    return V.comparison_table(scores, V.regression_metrics(out.where("fold = 'holdout'"), ["model_name"]))


@register(
    "fc17_prediction_faults",
    PRED + """ SELECT count(*) AS rows, count(*) FILTER (WHERE fc IS NULL OR actual IS NULL OR day(origin) = 17) AS not_finite,
    count(*) FILTER (WHERE day(origin) IN (11, 12)) AS misordered FROM pred""",
)
def _(spark, sf):
    day = F.day("forecast_origin_date")
    faulty = _baselines(spark, sf)[0].withColumns(
        {
            V.FORECAST: F.when(day != 17, F.col(V.FORECAST)),
            "lower_interval": F.when(day == 11, F.lit(2.0)).otherwise(F.lit(-1.0)),
            "median_prediction": F.lit(0.0),
            "upper_interval": F.when(day == 12, F.lit(-2.0)).otherwise(F.lit(1.0)),
        }
    )
    return faulty.agg(*V.prediction_faults())


def _promotion_sql(challenger: str) -> str:
    checks = {
        "mean_walk_forward_mae_better_than_persistence": "mae < base",
        "holdout_mae_better_than_persistence": "late < late_base",
        "validation_fold_majority": "wins >= ceil(folds / 2)",
        "worst_fold_within_limit": "worst <= worst_base * CAST(1.5 AS DOUBLE)",
        "leakage_audit_passed": "folds = 5",
        "same_eligible_dates": "n = n_base",
        "reproducible_fixed_seed": "folds > 0",
        "real_and_synthetic_results_not_conflated": "folds > 0",
    }
    rows = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {v} AS passed, {v0} AS value, {v1} AS bound FROM d" for k, v, v0, v1 in (
        (k, v, *(("mae", "base") if k.startswith("mean") else ("late", "late_base") if k.startswith("holdout") else ("CAST(wins AS DOUBLE)", "ceil(folds / 2)")
         if k.startswith("validation") else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")))
        for k, v in checks.items()))
    return PRED + f""", e AS (SELECT fold, count(*) FILTER (model = '{challenger}') AS n, count(*) FILTER (model = 'persistence') AS n_base,
      avg(abs(actual - fc)) FILTER (model = '{challenger}') AS own, avg(abs(actual - fc)) FILTER (model = 'persistence') AS per FROM pred GROUP BY 1),
    d AS (SELECT sum(own * n) FILTER (fold <> 'holdout') / sum(n) FILTER (fold <> 'holdout') AS mae, sum(per * n) FILTER (fold <> 'holdout') / sum(n) FILTER (fold <> 'holdout') AS base,
      max(own) FILTER (fold = 'holdout') AS late, max(per) FILTER (fold = 'holdout') AS late_base, count(*) FILTER (fold <> 'holdout' AND own < per) AS wins,
      count(*) FILTER (fold <> 'holdout') AS folds, max(own) FILTER (fold <> 'holdout') AS worst, max(per) FILTER (fold <> 'holdout') AS worst_base,
      sum(n) FILTER (fold <> 'holdout') AS n, sum(n_base) FILTER (fold <> 'holdout') AS n_base FROM e) {rows}"""


def _promotion(spark, sf, challenger):
    out, calendar, spec = _baselines(spark, sf)
    late = F.col("fold") == "holdout"
    found = G.promotion_decision(out.where(~late), out.where(late), spec, challenger, len(calendar.folds) == 5)
    shown = {
        "mean_walk_forward_mae_better_than_persistence": (found.challenger_mae, found.baseline_mae),
        "holdout_mae_better_than_persistence": (found.challenger_holdout_mae, found.baseline_holdout_mae),
        "validation_fold_majority": (float(found.fold_wins), float(found.required_fold_wins)),
    }
    rows = [(k, bool(v), *shown.get(k, (None, None))) for k, v in found.checks.items()]
    return spark.createDataFrame(rows, "check string, passed boolean, value double, bound double")


for _challenger in ("seven_day_drift", "half_drift"):
    register(f"fc26_promotion_checks_{_challenger}", _promotion_sql(_challenger), ("value", "bound"))(
        lambda spark, sf, c=_challenger: _promotion(spark, sf, c)
    )


RESIDUAL = PRED + """, oof AS (SELECT *, CAST(fold AS INTEGER) AS k FROM pred WHERE fold <> 'holdout' AND model = 'seven_day_drift'),
  fs AS (SELECT CASE WHEN fold = 'holdout' THEN 6 ELSE CAST(fold AS INTEGER) END AS k, min(origin) AS first_day FROM pred GROUP BY 1),
  cuts AS (SELECT oof.series, fs.k, quantile_cont(actual - fc, 0.1) AS q10, quantile_cont(actual - fc, 0.5) AS q50, quantile_cont(actual - fc, 0.9) AS q90
    FROM fs JOIN oof ON oof.k < fs.k AND oof.target_date < fs.first_day GROUP BY 1, 2),
  band AS (SELECT t.*, fc + q10 AS lo, fc + q50 AS mid, fc + q90 AS hi FROM (
    SELECT *, CASE WHEN fold = 'holdout' THEN 6 ELSE CAST(fold AS INTEGER) END AS k FROM pred WHERE model = 'seven_day_drift') t JOIN cuts USING (series, k))"""


def _banded(spark, sf, baselines=None):
    out, calendar, spec = baselines or _baselines(spark, sf)
    own = out.where("model_name = 'seven_day_drift'")
    labels = [str(f.number) for f in calendar.folds] + ["holdout"]
    return I.residual_intervals(own.where("fold <> 'holdout'"), own, spec, labels), spec


@register(
    "fc18_fc19_residual_intervals",
    RESIDUAL + " SELECT series, origin AS forecast_origin_date, fold, lo AS lower_interval, mid AS median_prediction, hi AS upper_interval FROM band",
    I.BOUNDS,
)
def _(spark, sf):
    return _banded(spark, sf)[0].select("series", "forecast_origin_date", "fold", *I.BOUNDS)


CONF = RESIDUAL + """, sc AS (SELECT series, greatest(lo - actual, actual - hi, 0) AS score, row_number() OVER (PARTITION BY series ORDER BY origin) AS rn,
    count(*) OVER (PARTITION BY series) AS n FROM band WHERE fold <> 'holdout'),
  cal AS (SELECT series, score, count(*) OVER (PARTITION BY series) AS cnt, row_number() OVER (PARTITION BY series ORDER BY score) AS rk FROM sc
    WHERE rn <= greatest(1, floor(n * CAST(0.8 AS DOUBLE)))),
  delta AS (SELECT series, max(score) FILTER (WHERE rk = ceil(least(1, ceil((cnt + 1) * CAST(0.8 AS DOUBLE)) / cnt) * (cnt - 1)) + 1) AS conformal_adjustment,
    max(cnt) AS calibration_rows FROM cal GROUP BY series)"""


@register("fc20_conformal_adjustment", CONF + " SELECT * FROM delta", ("conformal_adjustment",))
def _(spark, sf):
    banded, spec = _banded(spark, sf)
    return I.conformal_adjustment(banded.where("fold <> 'holdout'"), spec)


INSIDE = "CAST(actual BETWEEN lo - d AND hi + d AS DOUBLE)"
COVER_COLS = ("coverage_percent", "coverage_normal_percent", "coverage_stress_percent", "coverage_anomaly_percent", "coverage_imputed_percent", "mean_width")


@register(
    "fc21_interval_coverage",
    CONF + f""" SELECT series, fold, avg({INSIDE}) * 100 AS coverage_percent, avg({INSIDE}) FILTER (WHERE NOT (backlog_state OR stress)) * 100 AS coverage_normal_percent,
    avg({INSIDE}) FILTER (WHERE backlog_state OR stress) * 100 AS coverage_stress_percent, avg({INSIDE}) FILTER (WHERE has_anomaly) * 100 AS coverage_anomaly_percent,
    avg({INSIDE}) FILTER (WHERE is_imputed_date) * 100 AS coverage_imputed_percent, avg(hi - lo + 2 * d) AS mean_width
    FROM (SELECT band.*, conformal_adjustment AS d FROM band JOIN delta USING (series)) GROUP BY 1, 2""",
    COVER_COLS,
)
def _(spark, sf):
    banded, spec = _banded(spark, sf)
    delta = I.conformal_adjustment(banded.where("fold <> 'holdout'"), spec)
    return I.coverage_metrics(I.widen(banded, delta, spec), ["series", "fold"])


WIDE = PRED + """, wide AS (SELECT series, origin, max(actual) AS actual, max(fold) AS fold, max(fc) FILTER (WHERE model = 'persistence') AS persistence,
   max(fc) FILTER (WHERE model = 'seven_day_drift') AS seven_day_drift, max(fc) FILTER (WHERE model = 'half_drift') AS half_drift FROM pred WHERE fold <> 'holdout' GROUP BY 1, 2)"""
MEMBERS = ("persistence", "seven_day_drift", "half_drift")


@register("jn06_model_alignment", WIDE + " SELECT series, origin AS forecast_origin_date, actual AS actual_value, fold, persistence, seven_day_drift, half_drift FROM wide", ("actual_value", *MEMBERS))
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    return V.align_models(out.where("fold <> 'holdout'"), spec, MEMBERS)


@register(
    "fc24_weight_grid_two",
    WIDE + """ SELECT i / CAST(20 AS DOUBLE) AS w1, (20 - i) / CAST(20 AS DOUBLE) AS w2,
    avg(abs(actual - (i / CAST(20 AS DOUBLE) * persistence + (20 - i) / CAST(20 AS DOUBLE) * seven_day_drift))) AS mae FROM wide, range(0, 21) r(i) GROUP BY i""",
    ("w1", "w2", "mae"),
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    members = MEMBERS[:2]
    return N.grid_errors(V.align_models(out.where("fold <> 'holdout'"), spec, members), members)


@register(
    "fc24_weight_grid_three",
    WIDE + """ SELECT i / CAST(20 AS DOUBLE) AS w1, j / CAST(20 AS DOUBLE) AS w2, (20 - i - j) / CAST(20 AS DOUBLE) AS w3,
    avg(abs(actual - (i / CAST(20 AS DOUBLE) * persistence + j / CAST(20 AS DOUBLE) * seven_day_drift + (20 - i - j) / CAST(20 AS DOUBLE) * half_drift))) AS mae
    FROM wide, range(0, 21) r(i), range(0, 21) s(j) WHERE i + j <= 20 GROUP BY i, j""",
    ("w1", "w2", "w3", "mae"),
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    return N.grid_errors(V.align_models(out.where("fold <> 'holdout'"), spec, MEMBERS), MEMBERS)


@register(
    "fc25_residual_correlations",
    WIDE + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS model, '{b}' AS other, corr({a} - actual, {b} - actual) AS correlation FROM wide"
        for a in MEMBERS for b in MEMBERS
    ),
    ("correlation",),
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    return N.residual_correlations(out.where("fold <> 'holdout'"), spec, MEMBERS)


@register(
    "fc25_blend_metrics",
    WIDE + """ SELECT fold, count(*) AS rows, avg(abs(actual - (CAST(0.6 AS DOUBLE) * seven_day_drift + CAST(0.4 AS DOUBLE) * persistence))) AS mae FROM wide GROUP BY fold""",
    ("mae",),
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    mixed = N.blend(out.where("fold <> 'holdout'"), spec, {"seven_day_drift": 0.6, "persistence": 0.4})
    return V.regression_metrics(mixed, ["fold"]).select("fold", "rows", "mae")


@register(
    "fc26_jn04_fold_comparison",
    WIDE + """ SELECT fold, count(*) AS rows, avg(abs(actual - half_drift)) AS challenger_mae, avg(abs(actual - persistence)) AS persistence_mae,
    avg(abs(actual - half_drift)) < avg(abs(actual - persistence)) AS won FROM wide GROUP BY fold""",
    ("challenger_mae", "persistence_mae"),
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    return G.fold_comparison(out.where("fold <> 'holdout'"), spec, "half_drift")


@register(
    "jn03_oof_residuals",
    WIDE + " SELECT series, origin AS forecast_origin_date, actual, half_drift AS prediction, actual - half_drift AS residual FROM wide",
    ("actual", "prediction", "residual"),
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    oof = out.where("fold <> 'holdout'")
    keys = [*spec.keys, "forecast_origin_date"]
    actual = oof.where("model_name = 'persistence'").select(*keys, F.col("actual_value").alias("actual"))
    predicted = oof.where("model_name = 'half_drift'").select(*keys, F.col(FC).alias("prediction"))
    return V.oof_residuals(actual, predicted, keys)


WEEKDAY = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][isodow(origin)]"


@register(
    "fc28_fn14_error_by_regime",
    PRED + f""", t AS (SELECT p.*, actual - fc AS gap, CASE WHEN fc <= a THEN 'low' WHEN fc <= b THEN 'medium' ELSE 'high' END AS band FROM
      (SELECT * FROM pred WHERE model = 'seven_day_drift' AND fold = 'holdout') p JOIN
      (SELECT series, quantile_cont(fc, CAST(1 AS DOUBLE) / 3) AS a, quantile_cont(fc, CAST(2 AS DOUBLE) / 3) AS b FROM pred WHERE model = 'seven_day_drift' AND fold = 'holdout' GROUP BY 1) USING (series)),
    d AS (
      SELECT series, gap, 'day_of_week' AS dimension, {WEEKDAY} AS regime FROM t
      UNION ALL SELECT series, gap, 'month', monthname(origin) FROM t
      UNION ALL SELECT series, gap, 'forecast_load_band', band FROM t
      UNION ALL SELECT series, gap, 'net_intake_magnitude', CASE WHEN abs(net_at) <= 10 THEN 'low' WHEN abs(net_at) <= 50 THEN 'moderate' ELSE 'high' END FROM t
      UNION ALL SELECT series, gap, 'backlog_state', CASE WHEN backlog_state THEN 'True' ELSE 'False' END FROM t
      UNION ALL SELECT series, gap, 'capacity_utilization_band', CASE WHEN util <= 0.6 THEN 'normal' WHEN util <= 0.8 THEN 'watch' ELSE 'stress' END FROM t
      UNION ALL SELECT series, gap, 'anomaly_status', CASE WHEN has_anomaly THEN 'anomaly' ELSE 'normal' END FROM t
      UNION ALL SELECT series, gap, 'imputation_status', CASE WHEN is_imputed_date THEN 'imputed' ELSE 'observed' END FROM t
      UNION ALL SELECT series, gap, 'pressure_regime', CASE WHEN backlog_state OR stress THEN 'high_pressure' ELSE 'normal' END FROM t)
    SELECT series, dimension, regime, count(*) AS rows, avg(abs(gap)) AS mae, avg(gap) AS mean_residual, sqrt(avg(gap * gap)) AS rmse FROM d GROUP BY 1, 2, 3""",
    ("mae", "mean_residual", "rmse"),
)
def _(spark, sf):
    rows, _, _, spec = _held(spark, sf)
    late = rows.where("role = 'validation' AND fold = 0")
    drift = V.prediction_rows(late, spec, V.drift(), "seven_day_drift", "")
    context = late.select(*spec.keys, F.col("date").alias("forecast_origin_date"), "net_intake_at_origin", "capacity_utilization")
    return V.error_by_regime(drift.join(context, [*spec.keys, "forecast_origin_date"]), spec)


MON = RESIDUAL + """, al AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY origin DESC) AS back, row_number() OVER (PARTITION BY series ORDER BY origin) AS seat,
    count(*) OVER (PARTITION BY series) AS n FROM band WHERE fold = 'holdout'),
  al2 AS (SELECT *, seat <= greatest(1, n // 2) AS early, actual - fc AS gap FROM al)"""
PSI = """, e0 AS (SELECT series, list_distinct(quantile_cont(cur, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS ed FROM al2 WHERE early GROUP BY series),
  e1 AS (SELECT series, list_sort(ed) AS ed FROM e0),
  eb AS (SELECT series, unnest(ed[2:len(ed)-1]) AS edge FROM e1),
  bn AS (SELECT a.series, a.origin, any_value(a.early) AS early, count(eb.edge) AS bin FROM al2 a LEFT JOIN eb ON eb.series = a.series AND eb.edge <= a.cur GROUP BY 1, 2),
  cnt AS (SELECT series, bin, count(*) FILTER (WHERE early) AS r, count(*) FILTER (WHERE NOT early) AS q FROM bn GROUP BY 1, 2),
  shr AS (SELECT series, greatest(r / CAST(sum(r) OVER (PARTITION BY series) AS DOUBLE), 1e-6) AS r, greatest(q / CAST(sum(q) OVER (PARTITION BY series) AS DOUBLE), 1e-6) AS q FROM cnt),
  psi AS (SELECT series, sum((q - r) * ln(q / r)) AS input_psi FROM shr GROUP BY 1)"""
ROLL = """SELECT series, least(30, max(n)) AS rolling_window, avg(abs(gap)) FILTER (WHERE back <= 30) AS rolling_mae,
    avg(abs(actual - cur)) FILTER (WHERE back <= 30) AS rolling_persistence_mae,
    avg(CAST(actual BETWEEN lo AND hi AS DOUBLE)) FILTER (WHERE back <= 30) * 100 AS interval_coverage_percent,
    avg(CAST(is_imputed_date AS DOUBLE)) FILTER (WHERE back <= 30) * 100 AS imputation_rate_percent,
    avg(abs(gap)) FILTER (WHERE back <= 30) / nullif(avg(abs(actual - cur)) FILTER (WHERE back <= 30), 0) AS rolling_mase,
    coalesce(abs(avg(gap) FILTER (WHERE NOT early) - avg(gap) FILTER (WHERE early)) / nullif(stddev_pop(gap) FILTER (WHERE early), 0), 0) AS residual_shift FROM al2 GROUP BY series"""
MON_COLS = ("rolling_mae", "rolling_persistence_mae", "interval_coverage_percent", "imputation_rate_percent", "rolling_mase", "residual_shift", "input_psi")


def _monitored(spark, sf):
    out, calendar, spec = _baselines(spark, sf)
    out = cut_lineage(out)
    banded, _ = _banded(spark, sf, (out, calendar, spec))
    base = out.where("model_name = 'persistence' AND fold = 'holdout'")
    own = banded.where("fold = 'holdout'")
    return base.unionByName(own.select(*base.columns)), spec


@register(
    "fc31_monitor_metrics",
    MON + PSI + f""" SELECT r.*, input_psi, input_psi > 0.25 AS input_drift, residual_shift > 1 AS residual_drift,
    rolling_mae > rolling_persistence_mae * 1.25 AS degraded FROM ({ROLL}) r JOIN psi USING (series)""",
    MON_COLS,
)
def _(spark, sf):
    rows, spec = _monitored(spark, sf)
    return O.monitoring_metrics(rows, spec, "seven_day_drift")


@register(
    "fc31_monitor_state",
    MON + PSI + f""" SELECT r.*, input_psi, input_psi > 0.25 AS input_drift, residual_shift > 1 AS residual_drift,
    rolling_mae > rolling_persistence_mae * 1.25 AS degraded FROM ({ROLL}) r JOIN psi USING (series)""",
    MON_COLS,
)
def _(spark, sf):
    rows, spec = _monitored(spark, sf)
    aligned = cut_lineage(O.aligned_rows(rows, spec, "seven_day_drift")).selectExpr(
        "*", "row_number() OVER (PARTITION BY series ORDER BY forecast_origin_date) AS at", "count(*) OVER (PARTITION BY series) AS n",
    )
    # the early half is the reference; the rest comes in two batches, the second of which repeats days of the first
    state = cut_lineage(O.open_state(aligned.where("at <= greatest(1, n DIV 2)"), spec))
    for batch in ("at > n DIV 2 AND at <= n * 3 DIV 4", "at > n * 2 DIV 3"):
        state = cut_lineage(O.updated_state(state, aligned.where(batch), spec))
    return O.state_metrics(state, spec)


@register("fc32_stability_index", MON + PSI + " SELECT series, input_psi FROM psi", ("input_psi",))
def _(spark, sf):
    rows, spec = _monitored(spark, sf)
    dated = rows.where("model_name = 'seven_day_drift'").withColumns(
        {
            "_at": F.expr("row_number() OVER (PARTITION BY series ORDER BY forecast_origin_date)"),
            "_n": F.expr("count(*) OVER (PARTITION BY series)"),
        }
    )
    return O.stability_index(dated, spec, F.col("current_load"), F.col("_at") <= F.floor(F.col("_n") / 2))


@register(
    "q10_fc33_monitor_decision",
    MON + f""" SELECT series, CASE WHEN d THEN 'degraded' ELSE 'approved' END AS model_status, CASE WHEN d THEN 'persistence' ELSE 'seven_day_drift' END AS active_model
    FROM (SELECT series, rolling_mae > rolling_persistence_mae * 1.25 AS d FROM ({ROLL}))""",
)
def _(spark, sf):
    rows, spec = _monitored(spark, sf)
    decided = X.monitor(rows, spec, O.Registry("seven_day_drift", True, "seven_day_drift"))
    return decided.select("series", "model_status", "active_model")


REGISTRIES = {
    "approved_or_degraded": O.Registry("seven_day_drift", True, "seven_day_drift"),
    "unpromoted": O.Registry("ridge", False, "persistence"),
    "mismatch": O.Registry("ridge", True, "elastic_net"),
    "no_artifact": O.Registry("blend", True, "blend", ("persistence", "ridge"), ("elastic_net",)),
}


@register(
    "fc33_monitor_outcomes",
    MON + f""", d AS (SELECT series, rolling_mae > rolling_persistence_mae * 1.25 AS bad FROM ({ROLL})),
    limits AS (SELECT series, rolling_mae > rolling_persistence_mae * 0.01 AS bad FROM ({ROLL}))
    SELECT series, 'approved_or_degraded' AS registry, CASE WHEN bad THEN 'degraded' ELSE 'approved' END AS model_status,
      CASE WHEN bad THEN 'persistence' ELSE 'seven_day_drift' END AS active_model, CASE WHEN bad THEN 'error_too_large' ELSE 'within_limit' END AS code FROM d
    UNION ALL SELECT series, 'tight_limit', CASE WHEN bad THEN 'degraded' ELSE 'approved' END, CASE WHEN bad THEN 'persistence' ELSE 'seven_day_drift' END,
      CASE WHEN bad THEN 'error_too_large' ELSE 'within_limit' END FROM limits
    UNION ALL SELECT series, r, 'fallback', 'persistence', c FROM d, (VALUES ('unpromoted', 'not_promoted'), ('mismatch', 'registry_mismatch'), ('no_artifact', 'missing_artifact')) v(r, c)""",
)
def _(spark, sf):
    rows, spec = _monitored(spark, sf)
    found = cut_lineage(O.monitoring_metrics(rows, spec, "seven_day_drift"))
    tight = O.MonitorConfig(degradation_ratio=0.01)
    parts = [O.fallback_decision(found, r).withColumn("registry", F.lit(name)) for name, r in REGISTRIES.items()]
    strict = cut_lineage(O.monitoring_metrics(rows, spec, "seven_day_drift", tight))
    parts.append(O.fallback_decision(strict, REGISTRIES["approved_or_degraded"], tight).withColumn("registry", F.lit("tight_limit")))
    return V.union_predictions(parts).select("series", "registry", "model_status", "active_model", F.substring_index("reason", ":", 1).alias("code"))


@register(
    "prj18_champion_row",
    PRED + """ SELECT series, forecast_origin_date, target_date, reconstructed_absolute_prediction, horizon_days FROM (
    SELECT series, origin AS forecast_origin_date, target_date, fc AS reconstructed_absolute_prediction, CAST(date_diff('day', origin, target_date) AS INTEGER) AS horizon_days,
    row_number() OVER (PARTITION BY series ORDER BY origin DESC) AS k FROM pred WHERE model = 'half_drift') WHERE k = 1""",
    (FC,),
)
def _(spark, sf):
    out, _, spec = _baselines(spark, sf)
    return V.champion_row(out, spec, "half_drift").select("series", "forecast_origin_date", "target_date", FC, "horizon_days")


# ---- fitted statistics that SQL can work out -----------------------------------
PAIR = (P.CURRENT, "load_lag_7")
TRAIN = CAL + """, tr AS (SELECT p.*, fold FROM p JOIN folds ON date <= train_last)"""


def _pair_sums(spark, sf):
    rows, calendar, prepared, spec = _stored(spark, sf)
    return L.fold_sums(rows.where("role = 'train'"), PAIR, P.CHANGE, spec.date), rows, calendar, prepared, spec


def _solved(n, alpha, x1, x2, y, group, source):
    """SQL of ridge on two standardised features after median filling: weights on the raw scale and the intercept."""
    return f"""(SELECT *, ((n + {alpha}) * n * t1 - n * rho * n * t2) / det / s1 AS b1, ((n + {alpha}) * n * t2 - n * rho * n * t1) / det / s2 AS b2 FROM (
      SELECT *, (n + {alpha}) * (n + {alpha}) - n * rho * n * rho AS det FROM (
      SELECT {group}, CAST(count(*) AS DOUBLE) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, stddev_pop({x1}) AS s1, stddev_pop({x2}) AS s2,
        corr({x1}, {x2}) AS rho, covar_pop({x1}, {y}) / stddev_pop({x1}) AS t1, covar_pop({x2}, {y}) / stddev_pop({x2}) AS t2 FROM {source} GROUP BY {group})))"""


FILLED = TRAIN + """, md AS (SELECT fold, quantile_cont(cur, 0.5) AS c50, quantile_cont(lag7, 0.5) AS l50 FROM tr GROUP BY 1),
  z AS (SELECT fold, cur, coalesce(lag7, l50) AS lag, target - cur AS y, date FROM tr JOIN md USING (fold))"""


@register(
    "fc07_medians_and_spans",
    TRAIN + " " + " UNION ALL ".join(
        f"""SELECT fold, '{c}' AS feature, quantile_cont({x}, 0.5) AS median, avg(CAST({x} IS NULL AS DOUBLE)) AS missing,
        min(date) FILTER ({x} IS NOT NULL) AS first_day, max(date) FILTER ({x} IS NOT NULL) AS last_day FROM tr GROUP BY 1"""
        for c, x in zip(PAIR, ("cur", "lag7"))
    ),
    ("median", "missing"),
)
def _(spark, sf):
    sums, *_ = _pair_sums(spark, sf)
    rows = [(f, c, s.medians[c], s.missing[c], *s.spans[c]) for f, s in sums.items() for c in PAIR]
    return spark.createDataFrame(rows, "fold int, feature string, median double, missing double, first_day date, last_day date")


@register(
    "fc08_ridge_two_features",
    FILLED + f" SELECT fold, b1 AS weight_{PAIR[0]}, b2 AS weight_{PAIR[1]}, my - b1 * m1 - b2 * m2 AS intercept FROM {_solved('n', '100', 'cur', 'lag', 'y', 'fold', 'z')}",
    tuple(f"weight_{c}" for c in PAIR) + ("intercept",),
)
def _(spark, sf):
    sums, *_ = _pair_sums(spark, sf)
    models = {f: L.ridge(s, L.fit_processor(s, PAIR, correlation_limit=1.0), 100.0) for f, s in sums.items()}
    rows = [(f, *[float(m.weights[c]) for c in PAIR], m.intercept) for f, m in models.items()]
    return spark.createDataFrame(rows, f"fold int, weight_{PAIR[0]} double, weight_{PAIR[1]} double, intercept double")


@register(
    "fc27_fitted_provenance",
    TRAIN + """, e AS (SELECT fold, 'median' AS kind, 'current_total_load' AS name, min(date) AS first_day, max(date) AS last_day FROM tr WHERE cur IS NOT NULL GROUP BY 1
      UNION ALL SELECT fold, 'median', 'load_lag_7', min(date), max(date) FROM tr WHERE lag7 IS NOT NULL GROUP BY 1
      UNION ALL SELECT fold, k.kind, k.name, min(date), max(date) FROM tr, (VALUES ('kept', 'current_total_load'), ('kept', 'load_lag_7'),
        ('weight', 'intercept'), ('weight', 'current_total_load'), ('weight', 'load_lag_7'), ('trees', 'all')) k(kind, name) GROUP BY 1, 2, 3),
    spoilt AS (SELECT fold, kind, name, first_day, CASE WHEN kind = 'trees' AND fold = 3 THEN first_validation ELSE last_day END AS last_day, first_validation
      FROM e JOIN (SELECT fold, first_day AS first_validation FROM folds) USING (fold))
    SELECT CASE WHEN kind = 'trees' THEN 'boosted_trees' ELSE 'linear' END AS source, fold, kind, name, first_day, last_day, last_day + 7 AS label_known,
      first_validation AS validation_from, last_day + 7 >= first_validation AS late FROM spoilt""",
)
def _(spark, sf):
    sums, rows, calendar, _, spec = _pair_sums(spark, sf)
    processors = {f: L.fit_processor(s, PAIR, correlation_limit=1.0) for f, s in sums.items()}
    models = {f: L.ridge(sums[f], p, 100.0) for f, p in processors.items()}
    # one validation day slips into the rows that fold 3's trees are fitted on, and must be found
    slipped = (F.col("fold") == 3) & (F.col(spec.date) == F.lit(calendar.folds[2].first))
    trained = rows.where((F.col("role") == "train") | slipped)
    entries = [K.fitted_statistics(spark, "linear", sums, processors, models), K.trained_rows(trained, spec, "boosted_trees", "trees", "all")]
    found = K.audited(V.union_predictions(entries), [calendar.holdout, *calendar.folds])
    return found.select("source", "fold", "kind", "name", "first_day", "last_day", "label_known", "validation_from", "late")


HYBRID = PRED + f""", rs AS (SELECT series, origin AS date, cur, lag7, target, actual - fc AS y, fc, pr.fold FROM pred pr
    JOIN (SELECT series AS s2, date AS d2, lag7, target FROM p) ON s2 = series AND d2 = origin WHERE model = 'seven_day_drift'),
  span AS (SELECT min(date) AS a, date_diff('day', min(date), max(date)) + 1 AS days FROM rs WHERE fold <> 'holdout'),
  sz AS (SELECT *, greatest(14, days // 6) AS size FROM span),
  walks AS (SELECT 'inner' AS walk, CAST(i AS VARCHAR) AS label, CAST(a + CAST(days - (4 - i) * size - 8 AS INTEGER) AS DATE) AS until,
      CAST(a + CAST(days - (4 - i) * size AS INTEGER) AS DATE) AS f, CAST(a + CAST(days - (3 - i) * size - 1 AS INTEGER) AS DATE) AS l FROM sz, range(1, 4) r(i)
    UNION ALL SELECT 'outer', CASE WHEN fold = 0 THEN 'holdout' ELSE CAST(fold AS VARCHAR) END, train_last, first_day, last_day_ FROM folds),
  tr AS (SELECT rs.*, walk, label FROM rs JOIN walks ON date <= until),
  md AS (SELECT walk, label, quantile_cont(lag7, 0.5) AS l50 FROM tr GROUP BY 1, 2),
  z AS (SELECT tr.walk, tr.label, cur, coalesce(lag7, l50) AS lag, y FROM tr JOIN md ON md.walk = tr.walk AND md.label = tr.label),
  fit AS {_solved('n', '100', 'cur', 'lag', 'y', 'walk, label', 'z')},
  fixed AS (SELECT rs.*, w.walk, w.label, fc + coalesce(my + b1 * (cur - m1) + b2 * (coalesce(lag7, l50) - m2), 0) AS hy
    FROM rs JOIN walks w ON date BETWEEN w.f AND w.l LEFT JOIN fit ON fit.walk = w.walk AND fit.label = w.label LEFT JOIN md ON md.walk = w.walk AND md.label = w.label)"""


@register(
    "fc22_hybrid_one_corrector",
    HYBRID + """ SELECT walk, label AS fold, count(*) AS rows, avg(abs(target - hy)) AS mae, sqrt(avg((target - hy) * (target - hy))) AS rmse, avg(hy) AS mean_forecast
    FROM fixed GROUP BY 1, 2""",
    ("mae", "rmse", "mean_forecast"),
)
def _(spark, sf):
    out, calendar, spec = _baselines(spark, sf)
    prepared, _ = _prepared(spark, sf)
    config = P.ForecastConfig(correlation_limit=0.999999)
    one = [H.Corrector("pair_a100", PAIR, 100.0)]
    found = H.residual_hybrid(out.where("model_name = 'seven_day_drift'"), prepared.frame, spec, calendar, config, one, "hybrid")
    both = found.inner.withColumn("walk", F.lit("inner")).unionByName(found.predictions.withColumn("walk", F.lit("outer")))
    means = both.groupBy("walk", "fold").agg(F.avg(FC).alias("mean_forecast"))
    return V.regression_metrics(both, ["walk", "fold"]).select("walk", "fold", "rows", "mae", "rmse").join(means, ["walk", "fold"])


def _permuted(source, fold, row):
    """SQL that sends each row number of ``source`` (fold, i, n, a, b and ``row``) through the keyed permutation of the a x b grid."""
    at = f"SELECT fold, i, n, a, b, {fold} AS key, {row} // b AS hi, {row} % b AS lo FROM {source}"
    for k in (1, 2, 3, 4):
        changed, other, size = ("hi", "lo", "a") if k % 2 else ("lo", "hi", "b")
        x = f"(({other} + key + {k * 104729}) % {M.PRIME})"
        at = f"SELECT * REPLACE (({changed} + ((({x} * {x}) % {M.PRIME}) * 48271 + {x}) % {M.PRIME}) % {size} AS {changed}) FROM ({at})"
    return f"SELECT fold, i, n, a, b, hi * b + lo AS v FROM ({at})"


SEEDED = f"(CAST(fold AS BIGINT) * 15485863 + {42 * 7919})"


@register(
    "fc29_importance_two_features",
    FILLED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", fit AS {_solved('n', '100', 'cur', 'lag', 'y', 'fold', 'z')},
    v AS (SELECT p.fold, cur AS x1, coalesce(lag7, l50) AS x2, target - cur AS y, my, m1, m2, b1, b2,
        row_number() OVER (PARTITION BY p.fold ORDER BY date, substr(md5(series), 1, 2), series) - 1 AS i, count(*) OVER (PARTITION BY p.fold) AS n
      FROM (SELECT p.*, fold FROM p JOIN folds ON date BETWEEN first_day AND last_day_ WHERE fold > 0) p JOIN md ON md.fold = p.fold JOIN fit ON fit.fold = p.fold),
    grid AS (SELECT fold, i, n, a, (n + a - 1) // a AS b FROM (SELECT fold, i, v.n, CAST(ceil(sqrt(v.n)) AS BIGINT) AS a FROM v)),
    walk AS ({_permuted('grid', SEEDED, 'i')} UNION ALL {_permuted('(SELECT * FROM walk WHERE v >= n)', SEEDED, 'v')}),
    met AS (SELECT own.*, sent.x1 AS o1, sent.x2 AS o2, own.my + own.b1 * (own.x1 - own.m1) + own.b2 * (own.x2 - own.m2) AS pr
      FROM v own JOIN walk w ON w.fold = own.fold AND w.v = own.i JOIN v sent ON sent.fold = w.fold AND sent.i = w.i),
    inc AS (SELECT fold, '{PAIR[0]}' AS feature, avg(abs(y - pr - b1 * (o1 - x1))) - avg(abs(y - pr)) AS up FROM met GROUP BY 1
      UNION ALL SELECT fold, '{PAIR[1]}', avg(abs(y - pr - b2 * (o2 - x2))) - avg(abs(y - pr)) FROM met GROUP BY 1)
    SELECT feature, avg(up) AS mean_mae_increase, stddev_pop(up) AS std_mae_increase, count(DISTINCT fold) AS folds FROM inc GROUP BY 1""",
    ("mean_mae_increase", "std_mae_increase"),
)
def _(spark, sf):
    sums, rows, _, _, spec = _pair_sums(spark, sf)
    models = {f: L.ridge(s, L.fit_processor(s, PAIR, correlation_limit=1.0), 100.0) for f, s in sums.items() if f > 0}
    return M.permutation_importance(rows.where("role = 'validation' AND fold > 0"), spec, models, P.CHANGE).drop("interpretation_note")


# ---- fitted models: no SQL equivalent -------------------------------------------
@register("fc07_feature_processor")
def _(spark, sf):
    rows, _, prepared, _ = _stored(spark, sf)
    sums = L.fold_sums(rows.where("role = 'train'"), prepared.expanded, P.CHANGE)
    out = []
    for f, s in sums.items():
        fitted = L.fit_processor(s, prepared.expanded)
        out += [(f, c, True, "kept", fitted.medians[c]) for c in fitted.selected]
        out += [(f, c, False, why, None) for c, why in fitted.reasons.items()]
    return spark.createDataFrame(out, "fold int, feature string, kept boolean, reason string, median double")


@register("fc08_fc09_linear_candidates")
def _(spark, sf):
    rows, calendar, prepared, spec = _stored(spark, sf)
    sums = L.fold_sums(rows.where("role = 'train'"), prepared.expanded, P.CHANGE)
    groups = {"compact": prepared.compact, "expanded": prepared.expanded}
    candidates = X.linear_candidates(sums, groups, prepared.config)
    out = X.linear_predictions(rows.where("role = 'validation'"), spec, candidates)
    return V.regression_metrics(out, ["model_name", "configuration", "fold"])


@register("fc10_fc30_boosted_gain")
def _(spark, sf):
    rows, _, prepared, _ = _stored(spark, sf)
    sums = L.fold_sums(rows.where("role = 'train'"), prepared.compact, P.CHANGE)
    processors = {f: L.fit_processor(s, prepared.compact) for f, s in sums.items()}
    models = B.boost_folds(rows, processors, P.CHANGE, B.BoostConfig())
    trees = F.lit(B.trees_used(models[0]))
    return B.gain_importance(models[0], processors[0], spark).withColumn("trees", trees)


@register("fc11_exponential_smoothing")
def _(spark, sf):
    rows, calendar, _, spec = _stored(spark, sf)
    smooth = smoothing_forecasts(rows, spec, [calendar.holdout, *calendar.folds])
    out = V.prediction_rows(smooth, spec, P.reconstruct(F.col(P.CURRENT), F.col("predicted_change")), "exponential_smoothing", "")
    skipped = too_short(rows, spec).select(*spec.keys, F.when(F.col("fold") == 0, "holdout").otherwise(F.col("fold").cast("string")).alias("fold"), "training_days", "reason")
    return V.regression_metrics(out, [*spec.keys, "fold"]).unionByName(skipped, allowMissingColumns=True)


@register("fc29_permutation_importance")
def _(spark, sf):
    rows, _, prepared, spec = _stored(spark, sf)
    sums = L.fold_sums(rows.where("role = 'train' AND fold > 0"), prepared.compact, P.CHANGE)
    models = {f: L.ridge(s, L.fit_processor(s, prepared.compact), 100.0) for f, s in sums.items()}
    return M.permutation_importance(rows.where("role = 'validation' AND fold > 0"), spec, models, P.CHANGE)


@register("fc36_smoke_pipeline")
def _(spark, sf):
    df, spec = metrics(spark, sf, BY)
    found = X.smoke_pipeline(df, spec)
    values = {**found["metrics"], "interval_coverage_percent": found["interval_coverage_percent"]}
    return spark.createDataFrame(
        [(k, float(v)) for k, v in values.items()], "measure string, value double"
    )


@register("q09_experiment_scores")
def _(spark, sf):
    df, spec = metrics(spark, sf, BY)
    experiment = X.run_experiment(df, spec, boosters=(B.BoostConfig(),))
    return X.comparison(experiment)
