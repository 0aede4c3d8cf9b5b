"""Provenance of fitted objects: which label days every fitted statistic has seen.

A ledger has one row per fitted statistic: the fold it serves, its source (``linear``, ``hybrid`` ...), kind
(``median``, ``kept``, ``weight``, ``trees``, ``residual_quantile``), name and value, and the first and last origin day that went
into it. The days are aggregated with the statistics, from the rows themselves, so a row that slipped
into a fit shows, whatever the fold's plan says. An origin day's label is known ``horizon`` days later.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.forecast import linear as L
from tidegauge.operators.forecast import prepare as P
from tidegauge.spec import SeriesSpec

SCHEMA = "source string, fold int, kind string, name string, value double, first_day date, last_day date"


def fitted_statistics(
    spark: SparkSession, source: str, sums: Mapping[int, L.FoldSums], processors: Mapping[int, L.Processor],
    models: Mapping[int, L.LinearModel] | None = None,
) -> DataFrame:
    """Ledger of the medians and kept features of every fold, and of one model's weights.

    Columns times folds rows, whatever the number of training rows.
    """
    rows = []
    for fold, processor in processors.items():
        s = sums[fold]
        for c in processor.selected:
            rows.append((source, fold, "median", c, processor.medians[c], *s.spans[c]))
            rows.append((source, fold, "kept", c, 1.0, *s.span))
        model = (models or {}).get(fold)
        if model is not None:
            rows.append((source, fold, "weight", "intercept", model.intercept, *s.span))
            rows += [(source, fold, "weight", c, w, *s.span) for c, w in model.weights.items()]
    return spark.createDataFrame(rows, SCHEMA)


def trained_rows(rows: DataFrame, spec: SeriesSpec, source: str, kind: str, name: str) -> DataFrame:
    """Ledger of a model that is fitted on ``rows`` (column fold) as a whole; value is their number.

    How many trees of a walk-forward fold are kept is a choice between candidates by its validation
    rows, like that between models, and no fitted statistic.
    """
    grouped = rows.groupBy(F.col("fold").cast("int").alias("fold")).agg(
        F.count("*").cast("double").alias("value"), F.min(spec.date).alias("first_day"), F.max(spec.date).alias("last_day")
    )
    named = {"source": source, "kind": kind, "name": name}
    return grouped.withColumns({k: F.lit(v) for k, v in named.items()}).select("source", "fold", "kind", "name", "value", "first_day", "last_day")


def interval_residuals(residuals: DataFrame, later: Sequence[str], source: str = "intervals") -> DataFrame:
    """Ledger of the residual quantiles of each fold, from the rows of :func:`intervals.earlier_residuals`.

    Value is the number of residuals; the holdout counts as fold 0.
    """
    numbers = F.array(*[F.lit(0 if x == "holdout" else int(x)) for x in later])
    grouped = residuals.groupBy(F.element_at(numbers, F.col("_for") + 1).alias("fold")).agg(
        F.count("*").cast("double").alias("value"), F.min("forecast_origin_date").alias("first_day"), F.max("forecast_origin_date").alias("last_day")
    )
    named = {"source": source, "kind": "residual_quantile", "name": "earlier_folds"}
    return grouped.withColumns({k: F.lit(v) for k, v in named.items()}).select("source", "fold", "kind", "name", "value", "first_day", "last_day")


def audited(ledger: DataFrame, folds: Sequence[P.DatedFold], horizon: int = 7) -> DataFrame:
    """The ledger with the day its last label was known, the fold's first validation day, and whether it came too late.

    The fold table is a short literal; a statistic of a fold that isn't in it is late.
    """
    entries = F.array(*[F.struct(F.lit(f.number).alias("fold"), F.lit(f.first).alias("first")) for f in folds])
    own = F.filter(entries, lambda f: f["fold"] == F.col("fold"))
    first = F.try_element_at(F.transform(own, lambda f: f["first"]), F.lit(1))
    out = ledger.withColumns({"label_known": F.date_add("last_day", horizon), "validation_from": first})
    return out.withColumn("late", F.coalesce(F.col("label_known") >= F.col("validation_from"), F.lit(True)))
