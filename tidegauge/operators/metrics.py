"""Daily load, pressure, growth, smoothing and streak metrics over a panel of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import finite, percent_change, safe_ratio
from tidegauge.spec import (
    DISCHARGE,
    GROWTH,
    NET_INTAKE,
    OFFSET_RATIO,
    ROLL7,
    ROLL14,
    STOCK_A,
    STOCK_B,
    STREAK,
    TOTAL_LOAD,
    TRANSFER,
    SeriesSpec,
    ensure_daily,
    require_columns,
)


def one_row_per_day(spec: SeriesSpec, value: Column) -> Column:
    """``value``, or a runtime error where a series repeats a date.

    The check rides on the window that the metrics need anyway, so it costs no
    extra pass; it fires before a wrong number can leave the job.
    """
    repeated = F.lag(spec.date).over(spec.ordered()) == F.col(spec.date)
    return F.when(
        repeated, F.raise_error(F.lit("duplicate reporting date in a daily series"))
    ).otherwise(value)


def positive_run(flag: Column, spec: SeriesSpec, position: Column) -> Column:
    """Length so far of the run of true flags that ends at each row (0 when false).

    ``position`` is the row number in the series. The run length is the distance to
    the last false row, so one running maximum replaces run ids and a second sort.
    """
    last_false = F.max(F.when(~F.coalesce(flag, F.lit(False)), position)).over(spec.running())
    return (position - F.coalesce(last_false, F.lit(0))).cast("int")


def daily_metrics(
    df: DataFrame, spec: SeriesSpec = SeriesSpec(), *, trusted: bool = False
) -> DataFrame:
    """Add the seven derived metrics to daily rows.

    ``trusted`` says the caller built ``df`` by grouping on series and date. Other
    unkeyed input is checked first, because its window runs in a single task.
    """
    require_columns(df, [*spec.index, STOCK_A, STOCK_B, TRANSFER, DISCHARGE])
    if not trusted and not spec.keys:
        ensure_daily(df, spec)
    w = spec.ordered()
    based = df.withColumns(
        {
            TOTAL_LOAD: F.col(STOCK_A) + F.col(STOCK_B),
            NET_INTAKE: F.col(TRANSFER) - F.col(DISCHARGE),
            OFFSET_RATIO: safe_ratio(
                F.col(DISCHARGE), F.coalesce(F.col(TRANSFER), F.lit(0)) + 1
            ),
        }
    )
    load = F.col(TOTAL_LOAD)
    ranked = based.withColumns(
        {
            "_pos": one_row_per_day(spec, F.row_number().over(w)),
            "_prev": F.lag(load).over(w),
            ROLL7: F.avg(load).over(spec.trailing(7)),
            ROLL14: F.avg(load).over(spec.trailing(14)),
        }
    )
    return ranked.withColumns(
        {
            GROWTH: percent_change(load, F.col("_prev")),
            STREAK: positive_run(F.col(NET_INTAKE) > 0, spec, F.col("_pos")),
        }
    ).drop("_pos", "_prev")


def rolling_load(df: DataFrame, spec: SeriesSpec, days: int, name: str = "custom_trend") -> DataFrame:
    """Moving average of the load over a chosen number of days, from the first row on."""
    if days < 1:
        raise ValueError("days must be at least 1.")
    return df.withColumn(name, F.avg(TOTAL_LOAD).over(spec.trailing(days)))


def rolling_volatility(
    df: DataFrame, spec: SeriesSpec, days: int = 30, name: str = "rolling_volatility"
) -> DataFrame:
    """Population SD of growth over trailing rows, null until two growth values exist."""
    if days < 2:
        raise ValueError("days must be at least 2.")
    w = spec.trailing(days)
    growth = finite(F.col(GROWTH))
    return df.withColumn(
        name, F.when(F.count(growth).over(w) >= 2, F.stddev_pop(growth).over(w))
    )


def cumulative_net(df: DataFrame, spec: SeriesSpec, name: str = "cumulative_net") -> DataFrame:
    return df.withColumn(
        name, F.sum(F.coalesce(F.col(NET_INTAKE), F.lit(0))).over(spec.running())
    )


def as_metrics(df: DataFrame, spec: SeriesSpec, clean) -> DataFrame:
    """Pass an already derived table through; otherwise clean it and derive.

    ``clean`` is the callable used on raw or cleaned input.
    """
    if {TOTAL_LOAD, NET_INTAKE, GROWTH, OFFSET_RATIO, STREAK} <= set(df.columns):
        return ensure_daily(df, spec)
    return daily_metrics(clean(df), spec, trusted=True)
