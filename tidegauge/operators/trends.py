"""Period changes, slopes, profiles, correlations, risk signals and top movements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.calendar import WEEKDAYS
from tidegauge.functions.scalars import joined_labels, percent_of_magnitude, truthy
from tidegauge.spec import (
    ANOMALY_DISCHARGE,
    ANOMALY_TRANSFER,
    DISCHARGE,
    GROWTH,
    INTAKE,
    NET_INTAKE,
    STOCK_A,
    STOCK_B,
    TOTAL_LOAD,
    TRANSFER,
    CapacityError,
    SeriesSpec,
)

# The measures of the correlation matrix.
MEASURES = (INTAKE, TRANSFER, DISCHARGE, STOCK_A, STOCK_B, TOTAL_LOAD, NET_INTAKE)

# Risk signal names, in the order they are joined.
SIGNALS = (
    "High system load",
    "Elevated net intake",
    "Unusual load change",
    "Transfer constraint anomaly",
    "Discharge constraint anomaly",
)


def recent_change(df: DataFrame, spec: SeriesSpec, days: int = 30) -> DataFrame:
    """Percent change of the mean load of the last rows against the rows before them."""
    known = df.where(F.col(TOTAL_LOAD).isNotNull())
    n = F.count(F.lit(1)).over(spec.partition())
    marked = known.withColumns({"_n": n, "_back": F.row_number().over(spec.reversed())})
    w = F.least(F.lit(days), F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
    now = F.avg(F.when(F.col("_back") <= w, F.col(TOTAL_LOAD)))
    before = F.avg(
        F.when((F.col("_back") > w) & (F.col("_back") <= 2 * w), F.col(TOTAL_LOAD))
    )
    return marked.groupBy(*spec.keys).agg(
        F.coalesce(percent_of_magnitude(now, before), F.lit(0.0)).alias("recent_change_percent")
    )


def endpoint_change(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Percent change between the first and last load; 0 when undefined."""
    first = F.min_by(TOTAL_LOAD, spec.date)
    last = F.max_by(TOTAL_LOAD, spec.date)
    change = F.when(F.count(F.lit(1)) >= 2, percent_of_magnitude(last, first))
    return df.groupBy(*spec.keys).agg(
        F.coalesce(change, F.lit(0.0)).alias("endpoint_change_percent")
    )


def trend_slope(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Least-squares slope of load on row position; unknown loads keep their position."""
    placed = df.withColumn("_x", F.row_number().over(spec.ordered()).cast("double"))
    slope = F.regr_slope(F.col(TOTAL_LOAD).cast("double"), F.col("_x"))
    return placed.groupBy(*spec.keys).agg(F.coalesce(slope, F.lit(0.0)).alias("trend_slope"))


def weekday_profile(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean flows by weekday, all seven days present, 0 where a day never occurs."""
    measures = (INTAKE, TRANSFER, DISCHARGE, NET_INTAKE)
    day = F.weekday(spec.date)
    wide = df.groupBy(*spec.keys).agg(
        *[
            F.coalesce(F.avg(F.when(day == i, F.col(c))), F.lit(0.0)).alias(f"_{c}_{i}")
            for i in range(7)
            for c in measures
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("weekday_number"),
                F.lit(WEEKDAYS[i]).alias("weekday"),
                *[F.col(f"_{c}_{i}").alias(c) for c in measures],
            )
            for i in range(7)
        ]
    )
    return wide.select(*spec.keys, F.inline(rows))


def monthly_heatmap(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean load by year with twelve fixed month columns."""
    return df.groupBy(*spec.keys, F.year(spec.date).alias("year")).agg(
        *[
            F.avg(F.when(F.month(spec.date) == m, F.col(TOTAL_LOAD))).alias(f"m{m:02d}")
            for m in range(1, 13)
        ]
    )


def correlation_matrix(
    df: DataFrame, spec: SeriesSpec, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Pairwise-complete Pearson correlations in long form; undefined is 0.

    All pairs come from one aggregate pass.
    """
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i:]]

    def guarded(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        varies = (F.min(F.when(both, x)) < F.max(F.when(both, x))) & (
            F.min(F.when(both, y)) < F.max(F.when(both, y))
        )
        return F.when(varies, F.corr(x, y))

    wide = df.groupBy(*spec.keys).agg(
        *[F.coalesce(guarded(a, b), F.lit(0.0)).alias(f"_{a}__{b}") for a, b in pairs]
    )
    order = {m: i for i, m in enumerate(measures)}
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("measure"),
                F.lit(b).alias("other"),
                F.col(f"_{a}__{b}" if order[a] <= order[b] else f"_{b}__{a}").alias("correlation"),
            )
            for a in measures
            for b in measures
        ]
    )
    return wide.select(*spec.keys, F.inline(rows))


def risk_signals(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows with at least one risk signal, with a severity.

    Thresholds are exact quantiles of the series, taken as window aggregates over the
    partition the rows already share, so nothing is joined back.
    """
    w = spec.partition()
    load, net, growth = F.col(TOTAL_LOAD), F.col(NET_INTAKE), F.col(GROWTH)
    limits = df.withColumns(
        {
            "_load": F.percentile(load, 0.95).over(w),
            "_net": F.percentile(net, 0.90).over(w),
            "_growth": F.coalesce(F.percentile(F.abs(growth), 0.95).over(w), F.lit(0.0)),
        }
    )
    move = F.abs(F.coalesce(growth, F.lit(0.0)))
    now, press = F.coalesce(load, F.lit(0)), F.coalesce(net, F.lit(0))
    hits = [
        now >= F.col("_load"),
        (press > 0) & (press >= F.col("_net")),
        (move >= F.col("_growth")) & (F.col("_growth") > 0),
        truthy(F.col(ANOMALY_TRANSFER)),
        truthy(F.col(ANOMALY_DISCHARGE)),
    ]
    count = F.lit(0)
    for hit in hits:
        count = count + F.coalesce(hit, F.lit(False)).cast("int")
    severity = F.when(hits[3] | hits[4] | (count >= 3), "Critical").otherwise("Watch")
    return limits.where(count > 0).select(
        *spec.index,
        severity.alias("severity"),
        F.when(hits[3] | hits[4] | (count >= 3), 0).otherwise(1).alias("severity_rank"),
        joined_labels(*zip(hits, SIGNALS)).alias("signals"),
        now.cast("long").alias(TOTAL_LOAD),
        press.cast("long").alias(NET_INTAKE),
        F.coalesce(growth, F.lit(0.0)).alias(GROWTH),
    )


def top_movements(df: DataFrame, spec: SeriesSpec, rows: int = 10) -> DataFrame:
    """Largest absolute daily growth of each series; the earlier date wins a tie."""
    order = Window.partitionBy(*spec.keys).orderBy(
        F.abs(F.col(GROWTH)).desc(), F.col(spec.date).asc()
    )
    return (
        df.where(F.col(GROWTH).isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rows)
        .select(
            *spec.index,
            TOTAL_LOAD,
            NET_INTAKE,
            GROWTH,
            F.when(F.col(GROWTH) > 0, "Increase").otherwise("Decrease").alias("direction"),
            "rank",
        )
    )


def describe(df: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample SD, minimum, quartiles and maximum per series and column."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("_x"))
            for c in columns
        ]
    )
    x = F.col("_x")
    return df.select(*spec.keys, F.inline(cells)).groupBy(*spec.keys, "measure").agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.percentile(x, 0.25).alias("p25"),
        F.percentile(x, 0.5).alias("p50"),
        F.percentile(x, 0.75).alias("p75"),
        F.max(x).alias("max"),
    )


def error_quantiles(df: DataFrame, spec: SeriesSpec, actual: str, predicted: str) -> DataFrame:
    """Mean residual, and median, 90th percentile and maximum of the absolute error."""
    gap = F.col(actual) - F.col(predicted)
    return df.groupBy(*spec.keys).agg(
        F.avg(gap).alias("mean_residual"),
        F.percentile(F.abs(gap), 0.5).alias("median_absolute_error"),
        F.percentile(F.abs(gap), 0.9).alias("p90_absolute_error"),
        F.max(F.abs(gap)).cast("double").alias("max_absolute_error"),
    )


def histogram(df: DataFrame, spec: SeriesSpec, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the minimum and maximum of each series."""
    x = F.col(column).cast("double")
    w = spec.partition()
    ranged = df.where(x.isNotNull()).select(
        *spec.keys, x.alias("_x"), F.min(x).over(w).alias("_lo"), F.max(x).over(w).alias("_hi")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(
        F.lit(bins - 1),
        F.coalesce(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), width)), F.lit(0)),
    )
    return (
        ranged.withColumn("bin", slot.cast("long"))
        .groupBy(*spec.keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(F.col("_lo") + F.col("bin") * width).alias("lower_edge"),
        )
    )


def newest_first(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], rows: int) -> DataFrame:
    """Bounded report appendix: the latest rows of each series."""
    if rows < 1:
        raise CapacityError("rows must be at least 1.")
    rank = F.row_number().over(spec.reversed())
    return (
        df.withColumn("rank", rank)
        .where(F.col("rank") <= rows)
        .select(*spec.index, *[c for c in columns if c in df.columns], "rank")
    )


def paginate(
    df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 100, maximum: int = 5000
) -> tuple[DataFrame, dict[str, int | bool]]:
    """One page in a total order, with the position of the page in the whole."""
    if offset < 0:
        raise CapacityError("offset must not be negative.")
    if not 1 <= limit <= maximum:
        raise CapacityError(f"limit must be between 1 and {maximum}.")
    total = df.count()
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page, {
        "offset": offset,
        "limit": limit,
        "total_rows": total,
        "returned_rows": max(0, min(limit, total - offset)),
        "has_previous": offset > 0,
        "has_next": offset + limit < total,
    }
