"""Prediction intervals from earlier residuals, conformal widening and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.forecast.evaluate import FORECAST
from tidegauge.operators.quantiles import attach, exact_quantiles
from tidegauge.spec import SeriesSpec

QUANTILES = {"q10": 0.10, "q50": 0.50, "q90": 0.90}
BOUNDS = ("lower_interval", "median_prediction", "upper_interval")


def ordered_interval(lower: Column, median: Column, upper: Column) -> Column:
    """The three values in ascending order, as a struct."""
    three = F.array_sort(F.array(lower, median, upper))
    return F.struct(
        three[0].alias(BOUNDS[0]), three[1].alias(BOUNDS[1]), three[2].alias(BOUNDS[2])
    )


def crossing_rate(lower: Column, median: Column, upper: Column) -> Column:
    """Percent of rows whose raw quantiles cross."""
    return F.avg(((lower > median) | (median > upper)).cast("double")) * 100


def _place(later: Sequence[str]) -> Column:
    place = F.lit(None).cast("int")
    for i, label in enumerate(later):
        place = F.when(F.col("fold") == label, F.lit(i)).otherwise(place)
    return place


def earlier_residuals(oof: DataFrame, target: DataFrame, spec: SeriesSpec, later: Sequence[str]) -> DataFrame:
    """The residuals (``_gap``) that each fold of ``target`` may know, by its place ``_for`` in ``later``: those of
    earlier folds whose outcome day lies before the fold's first day."""
    starts = target.groupBy(_place(later).alias("_for")).agg(F.min("forecast_origin_date").alias("_start"))
    spread = (
        oof.select(
            *spec.keys, "forecast_origin_date", "target_date", _place(later).alias("_at"),
            (F.col("actual_value") - F.col(FORECAST)).alias("_gap"),
        )
        .where("_at is not null")
        .withColumn("_for", F.explode(F.sequence(F.col("_at") + 1, F.lit(len(later)))))
        .where(F.col("_for") < len(later))
    )
    # one row per fold: at most len(later) rows
    return spread.join(F.broadcast(starts), "_for").where("target_date < _start")


def residual_intervals(
    oof: DataFrame, target: DataFrame, spec: SeriesSpec, later: Sequence[str]
) -> DataFrame:
    """Attach residual quantiles of earlier folds to rows of later folds.

    ``later`` lists fold labels in time order; a fold sees the residuals of the folds before it, of its own
    series, as far as their outcomes were known. Rows without earlier residuals are dropped.
    """
    spread = earlier_residuals(oof, target, spec, later)
    by = [*spec.keys, "_for"]
    cuts = exact_quantiles(spread, by, "_gap", QUANTILES).drop("n")
    rows = target.withColumn("_for", _place(later)).join(cuts, by)
    interval = ordered_interval(*[F.col(FORECAST) + F.col(q) for q in QUANTILES])
    return rows.drop(*BOUNDS).select("*", interval.alias("_i")).select(
        *[c for c in rows.columns if c not in (*BOUNDS, "_for", *QUANTILES)], "_i.*"
    )


def conformal_adjustment(
    oof: DataFrame, spec: SeriesSpec, share: float = 0.8, coverage: float = 0.8
) -> DataFrame:
    """Width to add on both sides per series, from the earliest ``share`` of its rows.

    The adjustment is an order statistic of the nonconformity score ("higher"
    interpolation), picked by rank. A series is bounded by its calendar.
    """
    keys = list(spec.keys)
    whole = Window.partitionBy(*keys)
    timed = whole.orderBy("forecast_origin_date", "model_name")
    score = F.greatest(
        F.col("lower_interval") - F.col("actual_value"),
        F.col("actual_value") - F.col("upper_interval"),
        F.lit(0.0),
    )
    placed = oof.select(
        *keys,
        score.alias("_score"),
        F.row_number().over(timed).alias("_rn"),
        F.count(F.lit(1)).over(whole).alias("_n"),
    )
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    held = placed.where(F.col("_rn") <= cut).select(
        *keys,
        "_score",
        F.count(F.lit(1)).over(whole).alias("_m"),
        F.row_number().over(whole.orderBy("_score")).alias("_rank"),
    )
    chance = F.least(F.lit(1.0), F.ceil((F.col("_m") + 1) * F.lit(coverage)) / F.col("_m"))
    wanted = F.ceil(chance * (F.col("_m") - 1)) + 1
    return held.groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == wanted, F.col("_score"))).alias("conformal_adjustment"),
        F.max("_m").alias("calibration_rows"),
    )


def widen(rows: DataFrame, adjustment: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Lower and upper bounds moved out by the conformal adjustment of the series."""
    joined = attach(rows, adjustment.drop("calibration_rows"), list(spec.keys))
    delta = F.col("conformal_adjustment")
    return joined.withColumns(
        {
            "lower_interval": F.col("lower_interval") - delta,
            "upper_interval": F.col("upper_interval") + delta,
        }
    ).drop("conformal_adjustment")


def coverage_metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Percent inside the interval overall and in four regimes, and the mean width."""
    inside = F.col("actual_value").between(F.col("lower_interval"), F.col("upper_interval"))
    stress = F.col("backlog_state") | F.col("capacity_stress")
    masks = {
        "normal": ~stress,
        "stress": stress,
        "anomaly": F.col("has_anomaly"),
        "imputed": F.col("is_imputed_date"),
    }
    hit = inside.cast("double")
    return rows.groupBy(*by).agg(
        (F.avg(hit) * 100).alias("coverage_percent"),
        *[(F.avg(F.when(m, hit)) * 100).alias(f"coverage_{n}_percent") for n, m in masks.items()],
        F.avg(F.col("upper_interval") - F.col("lower_interval")).alias("mean_width"),
    )


def attach_intervals(rows: DataFrame, intervals: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Fill the interval columns of prediction rows by origin date."""
    keys = [*spec.keys, "forecast_origin_date"]
    return rows.drop(*BOUNDS).join(intervals.select(*keys, *BOUNDS), keys, "left")
