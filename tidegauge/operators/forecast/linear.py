"""Train-only feature processing and penalised linear models from one distributed pass.

Training rows are reduced on the executors to cross-product sums per fold. Every
mean, deviation, correlation and coefficient follows from those sums, so the driver
sees matrices of at most 70 x 70 per fold whatever the number of rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.orderstats import wide_quantiles
from tidegauge.spec import CapacityError


@dataclass
class Processor:
    """Medians, the columns kept for one fold, and why the others were dropped."""

    fold: int
    medians: dict[str, float]
    selected: list[str]
    reasons: dict[str, str]


@dataclass
class FoldSums:
    """Cross products of [1, features - median, target] over the training rows of a fold."""

    fold: int
    columns: list[str]
    medians: dict[str, float]
    missing: dict[str, float]
    constant: set[str]
    matrix: np.ndarray
    reasons: dict[str, str] = field(default_factory=dict)
    #: First and last day of the rows in the sums, and of those with a value of each column.
    span: tuple[dt.date | None, dt.date | None] = (None, None)
    spans: dict[str, tuple[dt.date | None, dt.date | None]] = field(default_factory=dict)

    @property
    def rows(self) -> float:
        return self.matrix[0, 0]

    def moments(self, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means of the shifted features, their covariance, and covariance with the target."""
        at = [1 + self.columns.index(n) for n in names]
        n = self.rows
        mean = self.matrix[0, at] / n
        cov = self.matrix[np.ix_(at, at)] / n - np.outer(mean, mean)
        target = self.matrix[at, -1] / n - mean * self.matrix[0, -1] / n
        return mean, cov, target


def _column_facts(train: DataFrame, features: Sequence[str], day: str | None) -> dict[int, dict]:
    """Per fold, from one aggregate without a row per cell: missing share, ends and first and last day of every column."""
    seen = F.lit(None).cast("date") if day is None else F.col(day)
    measures = [F.min(seen).alias("first"), F.max(seen).alias("last")]
    for i, c in enumerate(features):
        known = F.col(c).isNotNull()
        measures += [
            F.avg((~known).cast("double")).alias(f"missing_{i}"), F.min(c).alias(f"low_{i}"), F.max(c).alias(f"high_{i}"),
            F.min(F.when(known, seen)).alias(f"first_{i}"), F.max(F.when(known, seen)).alias(f"last_{i}"),
        ]
    return {r["fold"]: r.asDict() for r in train.groupBy("fold").agg(*measures).collect()}


def _partial_sums(features: list[str], target: str, centers: Mapping[int, np.ndarray]):
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, rows in batch.groupby("fold"):
                x = np.nan_to_num(rows[features].to_numpy(float) - centers[int(fold)])
                z = np.column_stack([np.ones(len(rows)), x, rows[target].to_numpy(float)])
                sums[int(fold)] = sums.get(int(fold), 0.0) + z.T @ z
        for fold, matrix in sums.items():
            flat = matrix.ravel()
            yield pd.DataFrame({"fold": fold, "cell": np.arange(flat.size), "value": flat})

    return reduce


def fold_sums(train: DataFrame, features: Sequence[str], target: str, day: str | None = None) -> dict[int, FoldSums]:
    """Cross-product sums for every fold of ``train`` (columns: fold, features, target).

    With ``day`` the sums also hold the first and last day of the rows that went into them.
    """
    features = list(features)
    train = train.select("fold", *features, target, *([day] if day else []))
    facts = _column_facts(train, features, day)
    folds = sorted(facts)
    middle = wide_quantiles(train, "fold", features, {"median": 0.5})
    medians = {f: {c: middle.get((f, c), {}).get("median") for c in features} for f in folds}
    centers = {f: np.array([medians[f][c] or 0.0 for c in features], dtype=float) for f in folds}
    parts = train.mapInPandas(
        _partial_sums(features, target, centers), "fold int, cell int, value double"
    )
    side = len(features) + 2
    matrices = {f: np.zeros(side * side) for f in folds}
    summed = parts.groupBy("fold", "cell").agg(F.sum("value").alias("v")).toPandas()
    for fold, cells in summed.groupby("fold"):
        matrices[int(fold)][cells["cell"].to_numpy()] = cells["v"].to_numpy()
    out = {}
    for f in folds:
        known, names = facts[f], list(enumerate(features))
        out[f] = FoldSums(
            f, features, medians[f],
            {c: known[f"missing_{i}"] for i, c in names},
            {c for i, c in names if known[f"low_{i}"] is not None and known[f"low_{i}"] == known[f"high_{i}"]},
            matrices[f].reshape(side, side),
            span=(known["first"], known["last"]),
            spans={c: (known[f"first_{i}"], known[f"last_{i}"]) for i, c in names},
        )
    return out


def fit_processor(
    sums: FoldSums, features: Sequence[str], missing_limit: float = 0.30, correlation_limit: float = 0.98
) -> Processor:
    """Drop sparse, empty, constant and duplicated features, in column order."""
    _, cov, _ = sums.moments(features)
    deviation = np.sqrt(np.maximum(np.diag(cov), 0))
    sparse = np.array([sums.missing[c] > missing_limit for c in features])
    empty = np.array([sums.medians[c] is None for c in features])
    flat = np.array([c in sums.constant for c in features]) | (deviation <= 1e-12)
    alive = ~(sparse | empty | flat)
    if not alive.any():
        raise CapacityError("Filtering leaves no feature.")
    scale = np.where(deviation > 0, deviation, 1.0)
    alike = np.abs(cov / np.outer(scale, scale)) > correlation_limit
    kept = np.zeros(len(features), bool)
    twin: dict[int, int] = {}
    for i in np.flatnonzero(alive):
        earlier = np.flatnonzero(alike[i] & kept)
        if earlier.size:
            twin[i] = int(earlier[0])
        else:
            kept[i] = True
    reasons = {}
    for i, c in enumerate(features):
        if sparse[i]:
            reasons[c] = f"sparse: {sums.missing[c]:.3f} of the training values are null, the limit is {missing_limit:.3f}"
        elif empty[i]:
            reasons[c] = "empty: no training value"
        elif flat[i]:
            reasons[c] = f"flat: standard deviation {deviation[i]:.3g} in training"
        elif i in twin:
            j = twin[i]
            reasons[c] = f"twin: correlation {abs(cov[i, j]) / (scale[i] * scale[j]):.4f} with {features[j]} in training"
    selected = [c for c, k in zip(features, kept) if k]
    return Processor(sums.fold, {c: sums.medians[c] for c in selected}, selected, reasons)


@dataclass(frozen=True)
class LinearModel:
    """Intercept and one weight per median-filled raw column."""

    intercept: float
    weights: dict[str, float]
    medians: dict[str, float]

    def sql(self) -> str:
        """Prediction as a column expression."""
        terms = [f"{self.intercept!r}D"]
        terms += [
            f"{w!r}D * coalesce({c}, {float(self.medians[c])!r}D)"
            for c, w in self.weights.items()
            if w != 0.0
        ]
        return " + ".join(terms)


def _standardised(sums: FoldSums, processor: Processor):
    mean, cov, target = sums.moments(processor.selected)
    scale = np.sqrt(np.diag(cov))
    return mean, scale, cov / np.outer(scale, scale), target / scale


def _model(sums: FoldSums, processor: Processor, mean, scale, weights) -> LinearModel:
    raw = weights / scale
    medians = np.array([processor.medians[c] for c in processor.selected])
    centre = sums.matrix[0, -1] / sums.rows
    intercept = centre - float(raw @ (mean + medians))
    return LinearModel(
        float(intercept),
        {c: float(w) for c, w in zip(processor.selected, raw)},
        dict(processor.medians),
    )


def ridge(sums: FoldSums, processor: Processor, alpha: float) -> LinearModel:
    """Squared penalty on standardised weights: ``||y - Xw||^2 + alpha * ||w||^2``."""
    mean, scale, corr, target = _standardised(sums, processor)
    n = sums.rows
    weights = np.linalg.solve(n * corr + alpha * np.eye(len(scale)), n * target)
    return _model(sums, processor, mean, scale, weights)


def elastic_net(
    sums: FoldSums, processor: Processor, alpha: float, l1_ratio: float,
    passes: int = 20_000, tolerance: float = 1e-7,
) -> LinearModel:
    """Mixed penalty on standardised weights by cyclic coordinate descent on the sums."""
    mean, scale, corr, target = _standardised(sums, processor)
    sparse, shrink = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w = np.zeros(len(scale))
    gradient = target.copy()
    for _ in range(passes):
        largest = 0.0
        for j in range(len(w)):
            pull = gradient[j] + corr[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - sparse, 0.0) / (corr[j, j] + shrink)
            step = new - w[j]
            if step:
                gradient -= corr[j] * step
                w[j] = new
                largest = max(largest, abs(step))
        if largest <= tolerance * max(1.0, np.abs(w).max()):
            break
    return _model(sums, processor, mean, scale, w)


def predict_candidates(
    rows: DataFrame, models: Sequence[Mapping[int, LinearModel]], keep: Sequence[str]
) -> DataFrame:
    """Predictions of many models as one array column, by a matrix product per batch.

    Every model maps a fold to its weights. The rows are read once whatever the number
    of models; only ``keep`` and the array travel on.
    """
    columns = sorted({c for m in models for f in m.values() for c in f.weights})
    folds = sorted({f for m in models for f in m})
    blocks = {}
    for f in folds:
        weights = np.zeros((len(columns), len(models)))
        medians = np.zeros(len(columns))
        offsets = np.zeros(len(models))
        for j, model in enumerate(models):
            offsets[j] = model[f].intercept
            for c, w in model[f].weights.items():
                weights[columns.index(c), j] = w
                medians[columns.index(c)] = model[f].medians[c]
        blocks[f] = (weights, medians, offsets)
    keep = list(keep)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                weights, medians, offsets = blocks[int(fold)]
                x = part[[f"_x_{c}" for c in columns]].to_numpy(float)
                x = np.where(np.isnan(x), medians, x)
                yield part[keep].assign(_changes=list(x @ weights + offsets))

    extra = [c for c in ("fold",) if c not in keep]
    source = rows.selectExpr(*keep, *extra, *[f"{c} AS _x_{c}" for c in columns])
    kinds = ", ".join(f"`{c}` {t}" for c, t in source.select(*keep).dtypes)
    return source.mapInPandas(score, f"{kinds}, _changes array<double>")
