"""Prediction rows, error metrics, fold tables, selection and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.calendar import WEEKDAYS
from tidegauge.functions.scalars import right_closed_band
from tidegauge.operators.forecast.prepare import CURRENT, TARGET, Calendar
from tidegauge.operators.quantiles import attach
from tidegauge.spec import PREDICTION_COLUMNS, PREDICTION_SCHEMA, CapacityError, SeriesSpec

FORECAST = "reconstructed_absolute_prediction"

# Month names for the error table.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
)


def persistence() -> Column:
    """Forecast the current load."""
    return F.col(CURRENT)


def drift() -> Column:
    """Forecast the current load plus its change over the last seven days."""
    return 2 * F.col(CURRENT) - F.col("load_lag_7")


def prediction_rows(
    rows: DataFrame, spec: SeriesSpec, forecast: Column, model: str | Column, label: str,
    configuration: str | Column = "default",
) -> DataFrame:
    """Long prediction rows with the documented columns, plus keys and configuration."""
    unknown = F.lit(None).cast("double")
    model, configuration = (F.lit(x) if isinstance(x, str) else x for x in (model, configuration))
    return rows.select(
        *spec.keys,
        F.col(spec.date).alias("forecast_origin_date"),
        "target_date",
        F.col(TARGET).alias("actual_value"),
        F.col(CURRENT).alias("current_load"),
        model.alias("model_name"),
        (forecast - F.col(CURRENT)).alias("predicted_change_7d"),
        forecast.alias(FORECAST),
        F.col(CURRENT).alias("persistence_prediction"),
        unknown.alias("lower_interval"),
        unknown.alias("median_prediction"),
        unknown.alias("upper_interval"),
        F.lit(label).alias("evaluation_label"),
        F.when(F.col("fold") == 0, "holdout").otherwise(F.col("fold").cast("string")).alias("fold"),
        "is_imputed_date",
        "has_anomaly",
        "backlog_state",
        "capacity_stress",
        configuration.alias("configuration"),
    )


def stacked_predictions(
    rows: DataFrame, spec: SeriesSpec, forecasts: dict[str, Column], label: str
) -> DataFrame:
    """Prediction rows of several models from one scan of the rows."""
    entries = F.array(
        *[F.struct(F.lit(m).alias("_model"), c.alias("_forecast")) for m, c in forecasts.items()]
    )
    long = rows.select("*", F.inline(entries))
    return prediction_rows(long, spec, F.col("_forecast"), F.col("_model"), label)


def union_predictions(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_aggregates(actual: Column, forecast: Column, baseline: Column) -> dict[str, Column]:
    """The common metric set as aggregate expressions."""
    gap = actual - forecast
    n = F.count(gap)
    mae = F.avg(F.abs(gap))
    base = F.avg(F.abs(actual - baseline))
    share = F.when(F.abs(actual) > 1e-12, F.abs(F.try_divide(gap, actual)))
    spread = F.var_pop(actual)
    return {
        "rows": n,
        "mae": mae,
        "rmse": F.sqrt(F.avg(gap * gap)),
        "mape_percent": F.avg(share) * 100,
        "r2": F.when(n > 1, 1 - F.try_divide(F.sum(gap * gap), n * spread)).otherwise(F.lit(0.0)),
        "mase_vs_persistence": F.try_divide(mae, base),
        "mae_improvement_vs_persistence_percent": F.coalesce(
            F.try_divide(base - mae, base) * 100, F.lit(0.0)
        ),
        "persistence_mae": base,
    }


def regression_metrics(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Error metrics of long prediction rows per group."""
    found = error_aggregates(
        F.col("actual_value"), F.col(FORECAST), F.col("persistence_prediction")
    )
    return predictions.groupBy(*by).agg(*[c.alias(n) for n, c in found.items()])


def fold_table(predictions: DataFrame, calendar: Calendar, gap: int = 7) -> DataFrame:
    """Metrics per model, configuration and fold, with the dates of each fold."""
    metrics = regression_metrics(predictions, ["model_name", "configuration", "fold"])
    spark = predictions.sparkSession
    bounds = spark.createDataFrame(
        [
            (str(f.number), calendar.first, f.train_last, f.first, f.last, gap)
            for f in calendar.folds
        ],
        "fold string, training_start date, training_end date, validation_start date, "
        "validation_end date, gap_rows int",
    )
    return metrics.join(F.broadcast(bounds), "fold", "left")


def shared_origins(predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Predictions of the origins that every candidate covers, so that all are ranked on the same rows."""
    keys = [*spec.keys, "fold", "forecast_origin_date"]
    candidate = F.concat_ws("|", "model_name", "configuration")
    total = predictions.agg(F.count_distinct(candidate).alias("_total"))
    full = attach(predictions.groupBy(*keys).agg(F.count_distinct(candidate).alias("_n")), total, [])
    return predictions.join(full.where("_n = _total").select(*keys), keys, "left_semi")


def candidate_scores(folds: DataFrame) -> DataFrame:
    """Mean, population SD and worst fold error of each candidate."""
    return folds.groupBy("model_name", "configuration").agg(
        F.avg("mae").alias("mean_mae"),
        F.stddev_pop("mae").alias("std_mae"),
        F.max("mae").alias("worst_mae"),
        F.count(F.lit(1)).alias("folds"),
    )


def select_best(scores: DataFrame) -> DataFrame:
    """Best configuration of each model: lowest mean error, then SD, then name."""
    order = Window.partitionBy("model_name").orderBy("mean_mae", "std_mae", "configuration")
    return scores.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def ranking(scores: DataFrame) -> DataFrame:
    """Models in order of walk-forward error."""
    order = Window.orderBy("mean_mae", "std_mae", "model_name")
    return scores.withColumn("rank", F.row_number().over(order))


def comparison_table(walk_forward: DataFrame, holdout: DataFrame) -> DataFrame:
    """Walk-forward and holdout metrics side by side per model."""
    late = holdout.select(
        "model_name",
        *[F.col(c).alias(f"holdout_{c}") for c in holdout.columns if c != "model_name"],
    )
    return walk_forward.join(late, "model_name", "left")


def check_predictions(df: DataFrame) -> DataFrame:
    """Raise unless the table has the documented columns and finite core numbers."""
    missing = [c for c in PREDICTION_COLUMNS if c not in df.columns]
    if missing:
        raise CapacityError("Prediction table lacks column(s): " + ", ".join(missing))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in PREDICTION_SCHEMA.fields if kinds[f.name] != f.dataType]
    if wrong:
        raise CapacityError("Prediction column(s) of another type: " + ", ".join(wrong))
    state = df.agg(*prediction_faults()).first()
    if not state.rows:
        raise CapacityError("Prediction table is empty.")
    if state.not_finite:
        raise CapacityError(f"{state.not_finite} prediction row(s) hold a non-finite number.")
    if state.misordered:
        raise CapacityError(f"{state.misordered} prediction row(s) have crossing intervals.")
    return df


def prediction_faults() -> list[Column]:
    core = ("actual_value", "current_load", "predicted_change_7d", FORECAST, "persistence_prediction")
    bad = F.lit(False)
    for c in core:
        x = F.col(c)
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    crossed = (F.col("lower_interval") > F.col("median_prediction")) | (
        F.col("median_prediction") > F.col("upper_interval")
    )
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("not_finite"),
        F.count_if(F.coalesce(crossed, F.lit(False))).alias("misordered"),
    ]


def oof_residuals(actual: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of actual and predicted on their keys; duplicate keys are an error."""
    for df in (actual, predicted):
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise CapacityError("Residual keys must be unique.")
    joined = actual.join(predicted, list(keys), "inner").dropna(subset=["actual", "prediction"])
    return joined.withColumn("residual", F.col("actual") - F.col("prediction"))


def align_models(predictions: DataFrame, spec: SeriesSpec, models: Sequence[str]) -> DataFrame:
    """One row per origin with a column per model; origins some model lacks are dropped.

    A conditional aggregate does the work of the n-way join with one shuffle.
    """
    wide = predictions.where(F.col("model_name").isin(*models)).groupBy(
        *spec.keys, "forecast_origin_date"
    ).agg(
        F.max("actual_value").alias("actual_value"),
        F.max("fold").alias("fold"),
        *[F.max(F.when(F.col("model_name") == m, F.col(FORECAST))).alias(m) for m in models],
    )
    return wide.dropna(subset=list(models))


def coverage_checked(
    holdout: DataFrame, external: DataFrame, keys: Sequence[str], tolerance: float = 1e-9
) -> DataFrame:
    """External predictions on every holdout row, or an error when one is missing or disagrees."""
    theirs = external.select(
        *keys, F.col("actual").alias("_actual"), F.col("prediction").alias("external_prediction")
    )
    joined = holdout.join(theirs, list(keys), "left")
    state = joined.agg(
        F.count_if(F.col("external_prediction").isNull()).alias("missing"),
        F.max(F.abs(F.col("_actual") - F.col("actual_value"))).alias("gap"),
    ).first()
    if state.missing:
        raise CapacityError(f"External predictions miss {state.missing} holdout row(s).")
    if (state.gap or 0) > tolerance:
        raise CapacityError("External actual values differ from the holdout.")
    return joined.drop("_actual")


def tercile_bands(df: DataFrame, spec: SeriesSpec, column: str) -> Column:
    """Low, medium or high third of a series' values; edges are right-closed."""
    edges = F.percentile(F.col(column), F.array(F.lit(1 / 3), F.lit(2 / 3))).over(spec.partition())
    return right_closed_band(F.col(column), [edges[0], edges[1]], ("low", "medium", "high"))


def error_by_regime(predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows, errors and bias by nine regime dimensions.

    ``predictions`` are prediction rows with ``net_intake_at_origin`` and
    ``capacity_utilization`` added. Each row is spread over the nine dimensions and
    combined before the shuffle.
    """
    banded = predictions.withColumn("_band", tercile_bands(predictions, spec, FORECAST))
    gap = F.col("actual_value") - F.col(FORECAST)
    origin = F.col("forecast_origin_date")
    text = lambda c: F.when(F.col(c), "True").otherwise("False")
    pressure = F.col("backlog_state") | F.col("capacity_stress")
    dimensions = {
        "day_of_week": F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(origin) + 1),
        "month": F.element_at(F.array(*map(F.lit, MONTHS)), F.month(origin)),
        "forecast_load_band": F.col("_band"),
        "net_intake_magnitude": right_closed_band(
            F.abs(F.col("net_intake_at_origin")), [10, 50], ("low", "moderate", "high")
        ),
        "backlog_state": text("backlog_state"),
        "capacity_utilization_band": right_closed_band(
            F.col("capacity_utilization"), [0.6, 0.8], ("normal", "watch", "stress")
        ),
        "anomaly_status": F.when(F.col("has_anomaly"), "anomaly").otherwise("normal"),
        "imputation_status": F.when(F.col("is_imputed_date"), "imputed").otherwise("observed"),
        "pressure_regime": F.when(pressure, "high_pressure").otherwise("normal"),
    }
    cells = F.array(
        *[F.struct(F.lit(n).alias("dimension"), c.alias("regime")) for n, c in dimensions.items()]
    )
    return (
        banded.select(*spec.keys, gap.alias("_gap"), F.inline(cells))
        .groupBy(*spec.keys, "dimension", "regime")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(F.abs("_gap")).alias("mae"),
            F.avg("_gap").alias("mean_residual"),
            F.sqrt(F.avg(F.col("_gap") * F.col("_gap"))).alias("rmse"),
        )
    )


def champion_row(
    predictions: DataFrame, spec: SeriesSpec, model: str, origin: str | None = None
) -> DataFrame:
    """Newest prediction of a model per series, or the one of an exact origin date."""
    rows = predictions.where(F.col("model_name") == model)
    if origin is not None:
        rows = rows.where(F.col("forecast_origin_date") == F.lit(origin).cast("date"))
    newest = Window.partitionBy(*spec.keys).orderBy(F.desc("forecast_origin_date"))
    return (
        rows.withColumn("_rank", F.row_number().over(newest))
        .where("_rank = 1")
        .drop("_rank")
        .withColumn("horizon_days", F.datediff("target_date", "forecast_origin_date"))
    )
