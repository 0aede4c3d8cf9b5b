"""Headline figures, classified KPIs, comparisons, alerts and period summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import finite, percent_of_magnitude, safe_ratio
from tidegauge.operators.clean import flag_anomalies
from tidegauge.operators.metrics import positive_run, rolling_volatility
from tidegauge.operators.quantiles import attach
from tidegauge.spec import (
    ANOMALY_DISCHARGE,
    ANOMALY_TRANSFER,
    DISCHARGE,
    GROWTH,
    IMPUTED_DATE,
    NET_INTAKE,
    OFFSET_RATIO,
    STREAK,
    TOTAL_LOAD,
    TRANSFER,
    CapacityError,
    SeriesSpec,
)

# KPI keys in display order with their texts.
LOAD_KPI = "total_load"
NET_KPI = "net_intake_pressure"
VOLATILITY_KPI = "load_volatility_index"
BACKLOG_KPI = "backlog_accumulation_rate"
OFFSET_KPI = "discharge_offset_ratio"
KPI_KEYS = (LOAD_KPI, NET_KPI, VOLATILITY_KPI, BACKLOG_KPI, OFFSET_KPI)



def _kpi(label: str, unit: str, formula: str, rises: bool, wanted_high: bool = False) -> tuple:
    """Name, unit, description, formula, whether high is good, and the alert text of a KPI."""
    side = "below" if wanted_high else "above"
    alert = f"{label}: {side} its bound" + (", and rising" if rises else "")
    return label, unit, f"{formula}, in {unit}", formula, wanted_high, alert


KPI_TEXT = {
    LOAD_KPI: _kpi("Total Active Load", "count", "stock_a + stock_b", True),
    NET_KPI: _kpi("Net Intake Pressure", "count/day", "transfer - discharge", False),
    VOLATILITY_KPI: _kpi("Load Volatility Index", "%", "population SD of daily total load growth (%)", False),
    BACKLOG_KPI: _kpi("Backlog Accumulation Rate", "consecutive days", "longest consecutive run where net intake > 0", False),
    OFFSET_KPI: _kpi("Discharge Offset Ratio", "ratio", "discharge / (transfer + 1)", False, wanted_high=True),
}


@dataclass(frozen=True)
class KpiConfig:
    """Classification thresholds and comparison windows."""

    comparison_days: int = 30
    load_watch: float = 1.0
    load_critical: float = 5.0
    net_watch: float = 25.0
    net_critical: float = 75.0
    volatility_watch: float = 1.0
    volatility_critical: float = 2.0
    backlog_watch: int = 3
    backlog_critical: int = 7
    offset_watch: float = 0.90
    offset_critical: float = 0.75
    volatility_days: int = 30

    def __post_init__(self) -> None:
        if self.comparison_days < 1:
            raise ValueError("comparison_days must be at least 1.")
        if self.volatility_days < 2:
            raise ValueError("volatility_days must be at least 2.")
        for name in ("load", "net", "volatility"):
            if not 0 <= getattr(self, f"{name}_watch") < getattr(self, f"{name}_critical"):
                raise ValueError(f"{name} thresholds must satisfy 0 <= watch < critical.")
        if not 1 <= self.backlog_watch < self.backlog_critical:
            raise ValueError("backlog thresholds must satisfy 1 <= watch < critical.")
        if not 0 <= self.offset_critical < self.offset_watch <= 1:
            raise ValueError("offset thresholds must satisfy 0 <= critical < watch <= 1.")


def headline(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Five headline KPIs per series in one aggregate."""
    date = F.col(spec.date)
    growth = finite(F.col(GROWTH))
    latest = {c: F.max_by(F.coalesce(F.col(c), F.lit(0)), date)
              for c in (TOTAL_LOAD, NET_INTAKE, TRANSFER, DISCHARGE)}
    return df.groupBy(*spec.keys).agg(
        latest[TOTAL_LOAD].cast("long").alias(LOAD_KPI),
        latest[NET_INTAKE].cast("long").alias(NET_KPI),
        F.coalesce(F.stddev_pop(growth), F.lit(0.0)).alias(VOLATILITY_KPI),
        F.max(STREAK).cast("long").alias(BACKLOG_KPI),
        F.coalesce(
            safe_ratio(latest[DISCHARGE], latest[TRANSFER] + 1), F.lit(0.0)
        ).alias(OFFSET_KPI),
    )


def operational_summary(df: DataFrame, spec: SeriesSpec, threshold_days: int = 3) -> DataFrame:
    """Twenty-field summary of a period, one aggregate per series.

    An elevated episode is counted on the day its streak reaches the threshold, so no
    episode table is needed.
    """
    date = F.col(spec.date)
    load, net = F.col(TOTAL_LOAD), F.col(NET_INTAKE)
    imputed = F.col(IMPUTED_DATE) if IMPUTED_DATE in df.columns else F.lit(False)
    flags = [F.col(c) for c in (ANOMALY_TRANSFER, ANOMALY_DISCHARGE)]
    return df.groupBy(*spec.keys).agg(
        F.min(date).alias("period_start"),
        F.max(date).alias("period_end"),
        F.count(F.lit(1)).alias("daily_observations"),
        F.max_by(load, date).cast("long").alias("latest_system_load"),
        F.avg(load).alias("average_system_load"),
        F.max(load).cast("long").alias("peak_system_load"),
        F.min_by(date, F.struct(-load, date)).alias("peak_system_load_date"),
        F.max_by(net, date).cast("long").alias("latest_net_intake"),
        F.sum(net).cast("long").alias("cumulative_net_intake"),
        F.count_if(net > 0).alias("positive_pressure_days"),
        F.coalesce(F.stddev_pop(finite(F.col(GROWTH))), F.lit(0.0)).alias("load_volatility_index"),
        F.max(STREAK).cast("long").alias("longest_backlog_streak"),
        F.max_by(STREAK, date).cast("long").alias("current_backlog_streak"),
        F.lit(threshold_days).cast("long").alias("backlog_threshold_days"),
        F.count_if(F.col(STREAK) == threshold_days).alias("elevated_backlog_episodes"),
        F.max_by(OFFSET_RATIO, date).alias("latest_discharge_offset_ratio"),
        F.sum(TRANSFER).cast("long").alias("total_transfers"),
        F.sum(DISCHARGE).cast("long").alias("total_discharges"),
        F.count_if(flags[0] | flags[1]).alias("logical_anomaly_rows"),
        F.count_if(imputed).alias("imputed_dates"),
    )


def snapshot(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Flow totals, flow ratio and quality counts of a period."""
    return df.groupBy(*spec.keys).agg(
        F.sum(TRANSFER).alias("total_transfers"),
        F.sum(DISCHARGE).alias("total_discharges"),
        F.sum(NET_INTAKE).alias("cumulative_net_intake"),
        safe_ratio(F.sum(DISCHARGE), F.sum(TRANSFER) + 1).alias("flow_ratio"),
        F.count_if(F.col(ANOMALY_TRANSFER) | F.col(ANOMALY_DISCHARGE)).alias("anomaly_days"),
        F.count_if(IMPUTED_DATE).alias("imputed_days"),
    )


def as_of(df: DataFrame, spec: SeriesSpec, day: str | None) -> DataFrame:
    """Rows dated on or before a day."""
    if day is None:
        return df
    return df.where(F.col(spec.date) <= F.lit(day).cast("date"))


def reporting_period(
    df: DataFrame, spec: SeriesSpec, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows of an inclusive period; an open end keeps everything on that side."""
    if start is not None and end is not None and str(start) > str(end):
        raise CapacityError("start must be on or before end.")
    if start is not None:
        df = df.where(F.col(spec.date) >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col(spec.date) <= F.lit(str(end)).cast("date"))
    return df


def _recent_blocks(df: DataFrame, spec: SeriesSpec, days: int) -> DataFrame:
    """Mark each row's distance from the end and the comparison window of its series."""
    n = F.count(F.lit(1)).over(spec.partition())
    return df.withColumns({"_n": n, "_back": F.row_number().over(spec.reversed())}).withColumn(
        "_w", F.least(F.lit(days), F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
    )


def _block_streak(df: DataFrame, spec: SeriesSpec) -> Column:
    """Run of positive net intake, restarted where the block changes."""
    positive = F.coalesce(F.col(NET_INTAKE) > 0, F.lit(False))
    in_series = positive_run(positive, spec, F.col("_fwd"))
    return F.least(in_series, F.col("_in_block"))


def _with_block_positions(df: DataFrame, spec: SeriesSpec, days: int) -> DataFrame:
    marked = _recent_blocks(df, spec, days).where(F.col("_back") <= 2 * F.col("_w"))
    current = F.col("_back") <= F.col("_w")
    start = F.when(current, F.col("_w")).otherwise(F.least(2 * F.col("_w"), F.col("_n")))
    placed = marked.withColumns(
        {
            "_current": current,
            "_fwd": F.row_number().over(spec.ordered()),
            "_in_block": (start - F.col("_back") + 1).cast("int"),
        }
    )
    return placed.withColumn("_run", _block_streak(placed, spec))


def comparison_baselines(df: DataFrame, spec: SeriesSpec, days: int = 30) -> DataFrame:
    """Prior-window value of each KPI; null for series of fewer than two rows."""
    marked = _with_block_positions(df, spec, days)
    prior = marked.where(~F.col("_current"))
    return prior.groupBy(*spec.keys).agg(
        F.avg(TOTAL_LOAD).alias(LOAD_KPI),
        F.avg(NET_INTAKE).alias(NET_KPI),
        F.coalesce(F.stddev_pop(finite(F.col(GROWTH))), F.lit(0.0)).alias(VOLATILITY_KPI),
        F.max("_run").cast("double").alias(BACKLOG_KPI),
        safe_ratio(F.sum(DISCHARGE), F.sum(TRANSFER) + 1).alias(OFFSET_KPI),
    )


def window_deltas(df: DataFrame, spec: SeriesSpec, days: int = 30) -> DataFrame:
    """Current window against the window before it, both in one aggregate.

    A series of one row compares with itself.
    """
    marked = _with_block_positions(df, spec, days)
    date = F.col(spec.date)
    current = F.col("_current")
    alone = F.max("_n") == 1

    def pair(make) -> Column:
        now, before = make(current), make(~current)
        return now - F.when(alone, now).otherwise(before)

    def latest(side: Column) -> Column:
        return F.max_by(F.col(TOTAL_LOAD), F.when(side, date)).cast("double")

    def mean(side: Column) -> Column:
        return F.avg(F.when(side, F.col(NET_INTAKE)))

    def spread(side: Column) -> Column:
        return F.stddev_pop(F.when(side, finite(F.col(GROWTH))))

    def longest(side: Column) -> Column:
        return F.max(F.when(side, F.col("_run"))).cast("double")

    def offset(side: Column) -> Column:
        return safe_ratio(
            F.sum(F.when(side, F.col(DISCHARGE))), F.sum(F.when(side, F.col(TRANSFER))) + 1
        )

    return marked.groupBy(*spec.keys).agg(
        pair(latest).alias("load_delta"),
        pair(mean).alias("net_delta"),
        F.coalesce(pair(spread), F.lit(0.0)).alias("volatility_delta"),
        pair(longest).alias("backlog_delta"),
        pair(offset).alias("offset_delta"),
    )


def direction(delta: Column, tolerance: float = 1e-12) -> Column:
    return (
        F.when(delta.isNull(), "unavailable")
        .when(delta > tolerance, "increase")
        .when(delta < -tolerance, "decrease")
        .otherwise("unchanged")
    )


def classify(key: Column, value: Column, change: Column, config: KpiConfig) -> Column:
    """Status of a KPI value under its own thresholds."""
    c = config
    load = (
        F.when(change.isNull(), "stable")
        .when(change >= c.load_critical, "critical")
        .when(change >= c.load_watch, "watch")
        .when(change <= -c.load_watch, "favorable")
        .otherwise("stable")
    )
    net = (
        F.when(value >= c.net_critical, "critical")
        .when(value >= c.net_watch, "watch")
        .when(value <= 0, "favorable")
        .otherwise("stable")
    )
    volatility = (
        F.when(value >= c.volatility_critical, "critical")
        .when(value >= c.volatility_watch, "watch")
        .otherwise("stable")
    )
    backlog = (
        F.when(value >= c.backlog_critical, "critical")
        .when(value >= c.backlog_watch, "watch")
        .when(value == 0, "favorable")
        .otherwise("stable")
    )
    offset = (
        F.when(value < c.offset_critical, "critical")
        .when(value < c.offset_watch, "watch")
        .when(value >= 1, "favorable")
        .otherwise("stable")
    )
    return (
        F.when(value.isNull(), "insufficient_data")
        .when(key == LOAD_KPI, load)
        .when(key == NET_KPI, net)
        .when(key == VOLATILITY_KPI, volatility)
        .when(key == BACKLOG_KPI, backlog)
        .when(key == OFFSET_KPI, offset)
    )


def formatted(key: Column, value: Column) -> Column:
    """Human-readable KPI value."""
    whole = F.format_number(F.rint(value), 0)
    signed = F.concat(F.when(F.rint(value) >= 0, "+").otherwise(""), whole)
    return (
        F.when(key == LOAD_KPI, whole)
        .when(key == NET_KPI, signed)
        .when(key == VOLATILITY_KPI, F.concat(F.format_string("%.2f", value), F.lit("%")))
        .when(key == BACKLOG_KPI, F.concat(whole, F.lit(" day(s)")))
        .when(key == OFFSET_KPI, F.concat(F.format_string("%.1f", value * 100), F.lit("%")))
    )


def kpi_table(df: DataFrame, spec: SeriesSpec, config: KpiConfig = KpiConfig()) -> DataFrame:
    """Long KPI table: one row per series and KPI with comparison, status and texts."""
    keys = list(spec.keys)
    values = headline(df, spec).select(
        *keys, *[F.col(k).cast("double").alias(f"v_{k}") for k in KPI_KEYS]
    )
    base = comparison_baselines(df, spec, config.comparison_days).select(
        *keys, *[F.col(k).alias(f"c_{k}") for k in KPI_KEYS]
    )
    ends = df.groupBy(*keys).agg(F.max(spec.date).alias("as_of"))
    wide = attach(attach(values, ends, keys), base, keys)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(k).alias("kpi"),
                F.lit(KPI_TEXT[k][0]).alias("name"),
                F.col(f"v_{k}").alias("value"),
                F.col(f"c_{k}").alias("comparison_value"),
                F.lit(KPI_TEXT[k][1]).alias("unit"),
                F.lit(KPI_TEXT[k][2]).alias("description"),
                F.lit(KPI_TEXT[k][3]).alias("formula"),
                F.lit(KPI_TEXT[k][4]).alias("higher_is_better"),
            )
            for i, k in enumerate(KPI_KEYS)
        ]
    )
    rows = wide.select(*keys, "as_of", F.inline(entries))
    value, comparison = F.col("value"), F.col("comparison_value")
    rows = rows.withColumns(
        {
            "delta": value - comparison,
            "delta_percent": percent_of_magnitude(value, comparison),
            "formatted_value": formatted(F.col("kpi"), value),
        }
    )
    return rows.withColumns(
        {
            "status": classify(F.col("kpi"), value, F.col("delta_percent"), config),
            "direction": direction(F.col("delta")),
        }
    )


def kpi_summary_table(table: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Display columns of the KPI table."""
    return table.select(
        *spec.keys, "ordinal", "name", "formatted_value", "status", "direction",
        "comparison_value", "delta", "delta_percent", "unit", "as_of", "formula",
    )


def alerts(table: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row per KPI in watch or critical state."""
    message = F.lit(None).cast("string")
    for k in KPI_KEYS:
        message = F.when(F.col("kpi") == k, F.lit(KPI_TEXT[k][5])).otherwise(message)
    return table.where(F.col("status").isin("watch", "critical")).select(
        *spec.keys,
        "kpi",
        F.col("status").alias("severity"),
        F.concat(F.initcap("status"), F.lit(": "), F.col("name")).alias("title"),
        F.concat(message, F.lit(" Current value: "), F.col("formatted_value"), F.lit(".")).alias(
            "message"
        ),
        "as_of",
    )


def kpi_trends(df: DataFrame, spec: SeriesSpec, days: int = 30) -> DataFrame:
    """Daily series of the five KPI concepts."""
    return rolling_volatility(df, spec, days).select(
        *spec.index,
        F.col(TOTAL_LOAD).alias(LOAD_KPI),
        F.col(NET_INTAKE).alias(NET_KPI),
        F.col("rolling_volatility").alias(VOLATILITY_KPI),
        F.coalesce(F.col(STREAK), F.lit(0)).alias(BACKLOG_KPI),
        finite(F.col(OFFSET_RATIO)).alias(OFFSET_KPI),
    )


def period_summary(df: DataFrame, spec: SeriesSpec, days: int = 30) -> DataFrame:
    """Latest, mean, minimum and maximum of each KPI over the period; undefined is 0."""
    date = F.col(spec.date)
    vol = rolling_volatility(df, spec, days)
    columns = {
        LOAD_KPI: TOTAL_LOAD, NET_KPI: NET_INTAKE, VOLATILITY_KPI: "rolling_volatility",
        BACKLOG_KPI: STREAK, OFFSET_KPI: OFFSET_RATIO,
    }
    aggregates = [F.stddev_pop(finite(F.col(GROWTH))).alias("_volatility")]
    for k, c in columns.items():
        aggregates += [
            F.max_by(F.col(c), date).cast("double").alias(f"l_{k}"),
            F.avg(c).alias(f"a_{k}"),
            F.min(c).cast("double").alias(f"n_{k}"),
            F.max(c).cast("double").alias(f"x_{k}"),
        ]
    wide = vol.groupBy(*spec.keys).agg(*aggregates)
    zero = F.lit(0.0)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(KPI_TEXT[k][0]).alias("name"),
                F.coalesce(
                    F.col("_volatility") if k == VOLATILITY_KPI else F.col(f"l_{k}"), zero
                ).alias("latest"),
                F.coalesce(F.col(f"a_{k}"), zero).alias("period_average"),
                F.coalesce(F.col(f"n_{k}"), zero).alias("period_minimum"),
                F.coalesce(F.col(f"x_{k}"), zero).alias("period_maximum"),
                F.lit(KPI_TEXT[k][1]).alias("unit"),
            )
            for i, k in enumerate(KPI_KEYS)
        ]
    )
    return wide.select(*spec.keys, F.inline(entries))


def anomaly_rows(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows that break a logical constraint, with a fixed column set."""
    if ANOMALY_TRANSFER not in df.columns:
        df = flag_anomalies(df)
    columns = ["stock_a", TRANSFER, "stock_b", DISCHARGE, ANOMALY_TRANSFER, ANOMALY_DISCHARGE]
    if "quality_flag" in df.columns:
        columns.append("quality_flag")
    hit = F.coalesce(F.col(ANOMALY_TRANSFER) | F.col(ANOMALY_DISCHARGE), F.lit(False))
    return df.where(hit).select(*spec.index, *columns)
