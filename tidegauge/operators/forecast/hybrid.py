"""Residual hybrid: a base model plus a linear correction learnt from its own out-of-fold residuals.

Three walks share one pass over the residual rows, as folds of one split:

* inner folds walk over the days that have out-of-fold residuals and choose the corrector,
* every outer fold is corrected by what the residuals of days before it teach; before the first there
  are none, so the hybrid is its base there,
* the holdout is corrected by a fit on all residuals.

No correction sees a residual whose label was unknown when its fold began: the borders are those of the
base's own folds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.forecast import evaluate as V
from tidegauge.operators.forecast import linear as L
from tidegauge.operators.forecast import prepare as P
from tidegauge.session import cut_lineage
from tidegauge.spec import CapacityError, SeriesSpec

RESIDUAL, BASE = "_residual", "_base"
#: Inner folds are numbered from here, above all outer ones.
_INNER = 100
INNER_LABEL = "development_inner_oof"


@dataclass(frozen=True)
class Corrector:
    """Ridge on a group of features."""

    name: str
    columns: tuple[str, ...]
    alpha: float


@dataclass
class Hybrid:
    """Rows of the outer folds and the holdout, rows of the inner folds, and how the corrector was chosen."""

    predictions: DataFrame
    inner: DataFrame
    inner_scores: DataFrame
    corrector: Corrector
    sums: dict[int, L.FoldSums]
    processors: dict[int, L.Processor]
    models: dict[int, L.LinearModel]


def correctors(groups: Mapping[str, Sequence[str]], alphas: Sequence[float]) -> list[Corrector]:
    return [Corrector(f"{g}_a{a:g}", tuple(columns), a) for g, columns in groups.items() for a in alphas]


def residual_rows(base: DataFrame, frame: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The features of each predicted day, with the base's forecast and residual. ``base`` holds one model."""
    told = base.select(
        *spec.keys,
        F.col("forecast_origin_date").alias(spec.date),
        (F.col("actual_value") - F.col(V.FORECAST)).alias(RESIDUAL),
        F.col(V.FORECAST).alias(BASE),
    )
    return frame.join(told, list(spec.index))


def inner_folds(first: dt.date, last: dt.date, gap: int, least_days: int = 100) -> list[P.DatedFold]:
    """Three validation blocks at the end of the days with residuals, each a gap after its training days."""
    days = (last - first).days + 1
    if days < least_days:
        raise CapacityError(f"{days} days with out-of-fold residuals, but a hybrid needs {least_days}.")
    size = max(14, days // 6)
    starts = [first + dt.timedelta(days=days - (3 - i) * size) for i in range(3)]
    return [
        P.DatedFold(_INNER + 1 + i, s - dt.timedelta(days=gap + 1), s, s + dt.timedelta(days=size - 1))
        for i, s in enumerate(starts)
    ]


def residual_hybrid(
    base: DataFrame, frame: DataFrame, spec: SeriesSpec, calendar: P.Calendar, config: P.ForecastConfig,
    candidates: Sequence[Corrector], name: str,
) -> Hybrid:
    """Nested cross-fitting of ``candidates`` over the rows of one base model (folds and holdout).

    The corrector with the least mean error over the inner folds is chosen, the first by name of equal ones.
    """
    rows = cut_lineage(residual_rows(base, frame, spec))
    outer = [f for f in calendar.folds if f.number > calendar.folds[0].number]
    walk = inner_folds(calendar.folds[0].first, calendar.folds[-1].last, config.gap)
    split = cut_lineage(P.assign_folds(rows, spec, [*walk, calendar.holdout, *outer]))
    columns = list(dict.fromkeys(c for k in candidates for c in k.columns))
    sums = L.fold_sums(split.where("role = 'train'"), columns, RESIDUAL, spec.date)

    def processed(corrector: Corrector, fold: int) -> L.Processor:
        return L.fit_processor(sums[fold], corrector.columns, config.missing_limit, config.correlation_limit)

    def fitted(corrector: Corrector, fold: int) -> L.LinearModel:
        return L.ridge(sums[fold], processed(corrector, fold), corrector.alpha)

    held = split.where("role = 'validation'")
    keep = [*spec.index, "fold", P.TARGET, P.CURRENT, *P.CONTEXT, BASE]
    grid = [{f.number: fitted(k, f.number) for f in walk} for k in candidates]
    scored = L.predict_candidates(held.where(F.col("fold") > _INNER), grid, keep)
    long = scored.select("*", F.posexplode("_changes").alias("_i", "_correction")).withColumn("fold", F.col("fold") - _INNER)
    names = F.array(*[F.lit(k.name) for k in candidates])
    corrected = F.col(BASE) + F.col("_correction")
    inner = cut_lineage(V.prediction_rows(long, spec, corrected, name, INNER_LABEL, F.element_at(names, F.col("_i") + 1)))
    scores = V.candidate_scores(V.regression_metrics(inner, ["model_name", "configuration", "fold"]))
    best = scores.orderBy("mean_mae", "configuration").first().configuration
    corrector = next(k for k in candidates if k.name == best)

    numbers = [f.number for f in (calendar.holdout, *outer)]
    models = {n: fitted(corrector, n) for n in numbers}
    late = L.predict_candidates(held.where(F.col("fold").isin(numbers)), [models], keep)
    late = late.withColumn("_correction", F.col("_changes")[0]).select(*keep, "_correction")
    first = calendar.folds[0]
    early = rows.where(F.col(spec.date).between(F.lit(first.first), F.lit(first.last)))
    early = early.withColumns({"fold": F.lit(first.number), "_correction": F.lit(0.0)}).select(*keep, "_correction")
    label = F.when(F.col("fold") == "holdout", "final_holdout").otherwise("development_oof")
    out = V.prediction_rows(early.unionByName(late), spec, corrected, name, "", corrector.name)
    return Hybrid(out.withColumn("evaluation_label", label), inner, scores, corrector, sums, {n: processed(corrector, n) for n in numbers}, models)
