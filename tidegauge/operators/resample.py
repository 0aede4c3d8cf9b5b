"""Weekly and monthly summaries that treat stocks and flows differently."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.calendar import parse_granularity, period_end
from tidegauge.functions.scalars import percent_change, safe_ratio
from tidegauge.spec import (
    ANOMALY_DISCHARGE,
    ANOMALY_TRANSFER,
    DISCHARGE,
    GROWTH,
    IMPUTED_DATE,
    INTAKE,
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
)


@dataclass(frozen=True)
class ResampleRule:
    """Which columns end a period, add up over it, or hold if any day holds."""

    last: tuple[str, ...]
    total: tuple[str, ...]
    any_true: tuple[str, ...] = ()
    recompute: tuple[str, ...] = ()


_LOADS = (STOCK_A, STOCK_B, TOTAL_LOAD)
_ROLLS = (ROLL7, ROLL14)
_FLOWS = (INTAKE, TRANSFER, DISCHARGE, NET_INTAKE)
_SCENARIO = (
    "utilisation_a", "utilisation_b", "utilisation_total",
    "headroom_a", "headroom_b", "headroom_total",
)

# The column sets each view aggregates.
RULES = {
    "analysis": ResampleRule(
        (*_LOADS, *_ROLLS, STREAK), _FLOWS,
        (ANOMALY_TRANSFER, ANOMALY_DISCHARGE, IMPUTED_DATE),
        (TOTAL_LOAD, NET_INTAKE, GROWTH, OFFSET_RATIO),
    ),
    "overview": ResampleRule((*_LOADS, *_ROLLS, GROWTH, STREAK), _FLOWS, (), (OFFSET_RATIO,)),
    "trends": ResampleRule((*_LOADS, *_ROLLS, "custom_trend"), _FLOWS, (), (GROWTH,)),
    "kpis": ResampleRule(
        (*_LOADS, GROWTH, *_ROLLS, STREAK, "rolling_volatility"),
        (TRANSFER, DISCHARGE, NET_INTAKE), (), (OFFSET_RATIO,),
    ),
    "insights": ResampleRule((*_LOADS, *_ROLLS, GROWTH), _FLOWS),
    "backlog": ResampleRule((TOTAL_LOAD, STOCK_A, STOCK_B, STREAK), (TRANSFER, DISCHARGE, NET_INTAKE)),
    "capacity": ResampleRule((*_LOADS, *_ROLLS, *_SCENARIO), (TRANSFER, DISCHARGE, NET_INTAKE)),
}


def _last_known(column: str, date: str) -> Column:
    """Value on the latest day of the period that has one."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(date)))


def resample(
    df: DataFrame,
    spec: SeriesSpec,
    granularity: str,
    rule: ResampleRule | str = "analysis",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Aggregate dense daily rows to periods labelled by their last calendar day."""
    level = parse_granularity(granularity)
    if level == "daily":
        return df
    rule = RULES[rule] if isinstance(rule, str) else rule
    present = set(df.columns)
    aggregates = [_last_known(c, spec.date).alias(c) for c in rule.last if c in present]
    aggregates += [F.sum(c).alias(c) for c in rule.total if c in present]
    aggregates += [F.bool_or(c).alias(c) for c in rule.any_true if c in present]
    aggregates += list(extra)
    periods = (
        df.withColumn("_period", period_end(F.col(spec.date), level))
        .groupBy(*spec.keys, "_period")
        .agg(*aggregates)
        .withColumnRenamed("_period", spec.date)
    )
    if TOTAL_LOAD in rule.recompute and {STOCK_A, STOCK_B} <= present:
        periods = periods.withColumn(TOTAL_LOAD, F.col(STOCK_A) + F.col(STOCK_B))
    if NET_INTAKE in rule.recompute:
        periods = periods.withColumn(NET_INTAKE, F.col(TRANSFER) - F.col(DISCHARGE))
    if GROWTH in rule.recompute:
        load = F.col(TOTAL_LOAD)
        periods = periods.withColumn(
            GROWTH, percent_change(load, F.lag(load).over(spec.ordered()))
        )
    if OFFSET_RATIO in rule.recompute:
        periods = periods.withColumn(
            OFFSET_RATIO, safe_ratio(F.col(DISCHARGE), F.col(TRANSFER) + 1)
        )
    return periods


def monthly_profile(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Month-end table with mean, peak and closing load and the monthly flow totals."""
    return (
        df.withColumn("_period", F.last_day(spec.date))
        .groupBy(*spec.keys, "_period")
        .agg(
            F.avg(TOTAL_LOAD).alias("load_mean"),
            F.max(TOTAL_LOAD).alias("load_max"),
            _last_known(TOTAL_LOAD, spec.date).alias("load_last"),
            F.sum(INTAKE).alias(INTAKE),
            F.sum(TRANSFER).alias(TRANSFER),
            F.sum(DISCHARGE).alias(DISCHARGE),
            F.sum(NET_INTAKE).alias(NET_INTAKE),
        )
        .withColumnRenamed("_period", spec.date)
    )


def annual_pressure(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Net intake by calendar year."""
    return df.groupBy(*spec.keys, F.year(spec.date).alias("year")).agg(
        F.sum(NET_INTAKE).alias("net_total"),
        F.avg(NET_INTAKE).alias("net_mean"),
        F.count_if(F.col(NET_INTAKE) > 0).alias("positive_days"),
        F.max(NET_INTAKE).alias("net_peak"),
    )
