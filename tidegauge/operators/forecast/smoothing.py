"""Exponential smoothing of many short series: a parameter grid scored in parallel."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.forecast.prepare import CHANGE, CURRENT, TARGET, DatedFold
from tidegauge.spec import SeriesSpec

# Workers receive this module's functions with the task: they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = tuple(itertools.product((0.2, 0.5, 0.8), (0.05, 0.2), (0.05, 0.2)))
_DAMPING = 0.9
_SEASON = 7


def smooth(values: np.ndarray, grid: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Damped additive trend with an additive weekly season, for all grid points in one pass over the days.

    ``grid`` has a row (level, trend, season weight) per point. Returns the squared error of each point and its
    forecasts, a column per point.
    """
    alpha, beta, gamma = np.asarray(grid, float).T
    first = values[:_SEASON].mean()
    season = np.repeat((values[:_SEASON] - first)[:, None], len(alpha), axis=1)
    level, trend, error = np.full(len(alpha), first), np.zeros(len(alpha)), np.zeros(len(alpha))
    for i, y in enumerate(values):
        s = season[i % _SEASON].copy()
        expected = level + _DAMPING * trend
        error += (y - expected - s) ** 2
        new = alpha * (y - s) + (1 - alpha) * expected
        trend = beta * (new - level) + (1 - beta) * _DAMPING * trend
        season[i % _SEASON] = gamma * (y - expected) + (1 - gamma) * s
        level = new
    damp = np.cumsum(_DAMPING ** np.arange(1, steps + 1))
    return error, level + damp[:, None] * trend + season[(len(values) + np.arange(steps)) % _SEASON]


def smoothing_forecasts(
    rows: DataFrame, spec: SeriesSpec, folds: Sequence[DatedFold], column: str = CHANGE
) -> DataFrame:
    """Forecast change per series, fold and validation day with the best grid point.

    ``rows`` come from :func:`assign_folds`. A group is one series in one fold, at most one row per
    calendar day, and tries all grid points at once; of equal errors the first point wins. The forecast
    runs over the gap and the validation days and keeps the latter. Series under two seasons get no
    forecast; :func:`too_short` names them.
    """
    keys = list(spec.keys)
    steps = {f.number: ((f.first - f.train_last).days - 1, (f.last - f.first).days + 1) for f in folds}
    train = rows.where("role = 'train'").select(*keys, spec.date, "fold", column)
    by = [*keys, "fold"]
    schema = T.StructType([train.schema[k] for k in by] + [T.StructField("_path", T.ArrayType(T.DoubleType()))])
    date, grid = spec.date, np.array(GRID)

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(date)
        head = series.iloc[0]
        gap, length = steps[int(head["fold"])]
        values = series[column].to_numpy(float)
        if len(values) < 2 * _SEASON:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        errors, paths = smooth(values, grid, gap + length)
        return pd.DataFrame({k: [head[k]] for k in by} | {"_path": [paths[gap:, errors.argmin()].tolist()]})

    best = train.groupBy(*by).applyInPandas(run, schema).select(
        *by, F.posexplode("_path").alias("_step", "predicted_change")
    )
    starts = F.lit(None).cast("date")
    for f in folds:
        starts = F.when(F.col("fold") == f.number, F.lit(f.first)).otherwise(starts)
    dated = best.select(
        *keys, "fold", F.date_add(starts, F.col("_step")).alias(date), "predicted_change"
    )
    held = rows.where("role = 'validation'")
    return held.join(dated, [*keys, "fold", date])


def too_short(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Series and folds that smoothing gives no forecast for, with their training days and a reason."""
    days = rows.where("role = 'train'").groupBy(*spec.keys, "fold").agg(F.count("*").alias("training_days"))
    known = rows.select(*spec.keys, "fold").distinct().join(days, [*spec.keys, "fold"], "left")
    short = known.withColumn("training_days", F.coalesce("training_days", F.lit(0).cast("long")))
    return short.where(F.col("training_days") < 2 * _SEASON).withColumn(
        "reason", F.format_string(f"%d training days; two seasons ({2 * _SEASON}) are needed", "training_days")
    )


__all__ = ["CURRENT", "GRID", "TARGET", "smooth", "smoothing_forecasts", "too_short"]
