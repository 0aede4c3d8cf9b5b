"""Member choice, weight grid and evaluation of a convex blend of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.forecast.evaluate import FORECAST, align_models
from tidegauge.spec import SeriesSpec

ENSEMBLE = "validation_weighted_ensemble"


def choose_members(
    predictions: DataFrame, spec: SeriesSpec, ranked: Sequence[str], limit: int = 3,
    similar: float = 0.999, common: int = 30,
) -> list[str]:
    """Best models that are not near copies of every model already chosen.

    All pairwise correlations come from one aggregate over at most eleven columns.
    """
    names = list(ranked)
    wide = predictions.where(F.col("model_name").isin(*names)).groupBy(
        *spec.keys, "forecast_origin_date"
    ).agg(*[F.max(F.when(F.col("model_name") == m, F.col(FORECAST))).alias(m) for m in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    if not pairs:
        return ["persistence", "seven_day_drift"]
    facts = wide.agg(
        *[F.corr(a, b).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)],
        *[
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n_{i}")
            for i, (a, b) in enumerate(pairs)
        ],
    ).first()
    table = {frozenset(p): (facts[f"r_{i}"], facts[f"n_{i}"]) for i, p in enumerate(pairs)}
    chosen: list[str] = []
    for name in names:
        differs = any(
            table[frozenset((name, c))][1] >= common
            and table[frozenset((name, c))][0] is not None
            and abs(table[frozenset((name, c))][0]) < similar
            for c in chosen
        )
        if not chosen or differs:
            chosen.append(name)
        if len(chosen) == limit:
            break
    return chosen if len(chosen) >= 2 else ["persistence", "seven_day_drift"]


def weight_grid(members: int, step: float = 0.05) -> list[tuple[float, ...]]:
    """All non-negative weights on the grid that add up to one."""
    if members not in (2, 3):
        raise ValueError("The weight grid supports two or three models.")
    units = round(1 / step)
    if members == 2:
        return [(a / units, (units - a) / units) for a in range(units + 1)]
    return [
        (a / units, b / units, (units - a - b) / units)
        for a in range(units + 1)
        for b in range(units - a + 1)
    ]


def grid_errors(aligned: DataFrame, members: Sequence[str], step: float = 0.05) -> DataFrame:
    """Mean absolute error of every grid point, all in one pass over the predictions."""
    grid = weight_grid(len(members), step)
    mixes = [" + ".join(f"{w!r}D * `{m}`" for w, m in zip(point, members)) for point in grid]
    wide = aligned.selectExpr(
        *[f"avg(abs(actual_value - ({mix}))) AS e{i}" for i, mix in enumerate(mixes)]
    )
    entries = ", ".join(
        "named_struct(" + ", ".join(
            f"'w{j + 1}', {w!r}D" for j, w in enumerate(point)
        ) + f", 'mae', e{i})"
        for i, point in enumerate(grid)
    )
    return wide.selectExpr(f"inline(array({entries}))")


def best_weights(aligned: DataFrame, members: Sequence[str], step: float = 0.05) -> dict[str, float]:
    """Grid point of least error; a tie goes to the larger earlier weights."""
    columns = [f"w{i + 1}" for i in range(len(members))]
    row = grid_errors(aligned, members, step).orderBy(
        F.round("mae", 12), *[F.desc(c) for c in columns]
    ).first()
    weights = {m: row[c] for m, c in zip(members, columns)}
    active = {m: w for m, w in weights.items() if w > 0}
    if len(active) >= 2:
        total = sum(active.values())
        return {m: w / total for m, w in active.items()}
    return weights


def blend(predictions: DataFrame, spec: SeriesSpec, weights: Mapping[str, float]) -> DataFrame:
    """Prediction rows of the blend, on the origins that every member covers."""
    members = list(weights)
    mix = None
    for m in members:
        term = F.max(F.when(F.col("model_name") == m, F.col(FORECAST))) * F.lit(weights[m])
        mix = term if mix is None else mix + term
    keep = [
        c for c in predictions.columns
        if c not in (*spec.keys, "forecast_origin_date", "model_name", "configuration", FORECAST,
                     "predicted_change_7d")
    ]
    rows = predictions.where(F.col("model_name").isin(*members)).groupBy(
        *spec.keys, "forecast_origin_date"
    ).agg(
        *[F.any_value(c).alias(c) for c in keep],
        mix.alias(FORECAST),
        F.count_distinct("model_name").alias("_members"),
    )
    rows = rows.where(F.col("_members") == len(members)).withColumns(
        {
            "model_name": F.lit(ENSEMBLE),
            "configuration": F.lit("oof_nonnegative_mae_grid"),
            "predicted_change_7d": F.col(FORECAST) - F.col("current_load"),
        }
    )
    return rows.select(*predictions.columns)


def residual_correlations(predictions: DataFrame, spec: SeriesSpec, members: Sequence[str]) -> DataFrame:
    """Pearson correlation of member residuals, long form."""
    aligned = align_models(predictions, spec, members)
    gaps = aligned.select(*[(F.col(m) - F.col("actual_value")).alias(m) for m in members])
    wide = gaps.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a in members for b in members])
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("model"), F.lit(b).alias("other"), F.col(f"{a}__{b}").alias("correlation"))
            for a in members
            for b in members
        ]
    )
    return wide.select(F.inline(entries))
