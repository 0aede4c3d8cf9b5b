"""Runs of consecutive days: backlog and stress episodes, high-pressure intervals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.metrics import positive_run
from tidegauge.spec import NET_INTAKE, STREAK, TOTAL_LOAD, SeriesSpec


def runs(
    df: DataFrame, spec: SeriesSpec, flag: Column, aggregates: Mapping[str, Column]
) -> DataFrame:
    """One row per maximal run of rows where ``flag`` holds.

    The run is named by its row number minus its length so far, which is constant in
    the run. Grouping by series and that number reuses the window's partitioning, so
    no second exchange is planned. ``status`` is Active when the run touches the last
    date of its series.
    """
    marked = df.withColumns(
        {
            "_hit": F.coalesce(flag, F.lit(False)),
            "_pos": F.row_number().over(spec.ordered()),
            "_last": F.max(spec.date).over(spec.whole()),
        }
    )
    marked = marked.withColumn("_len", positive_run(F.col("_hit"), spec, F.col("_pos")))
    return (
        marked.where("_hit")
        .withColumn("_run", F.col("_pos") - F.col("_len"))
        .groupBy(*spec.keys, "_run")
        .agg(
            F.min(spec.date).alias("episode_start"),
            F.max(spec.date).alias("episode_end"),
            F.count(F.lit(1)).alias("duration_days"),
            *[c.alias(name) for name, c in aggregates.items()],
            F.max("_last").alias("_last"),
        )
        .withColumn(
            "status",
            F.when(F.col("episode_end") == F.col("_last"), "Active").otherwise("Closed"),
        )
        .drop("_run", "_last")
    )


def backlog_episodes(df: DataFrame, spec: SeriesSpec, threshold_days: int = 3) -> DataFrame:
    """Runs of positive net intake; elevated when at least ``threshold_days`` long."""
    if threshold_days < 1:
        raise ValueError("threshold_days must be at least 1.")
    net = F.coalesce(F.col(NET_INTAKE), F.lit(0))
    found = runs(
        df,
        spec,
        net > 0,
        {
            "cumulative_net": F.sum(net).cast("long"),
            "peak_pressure": F.max(net).cast("long"),
            "average_pressure": F.avg(net.cast("double")),
        },
    )
    return found.select(
        *spec.keys,
        "episode_start",
        "episode_end",
        "duration_days",
        "cumulative_net",
        "peak_pressure",
        "average_pressure",
        (F.col("duration_days") >= threshold_days).alias("elevated"),
        "status",
    )


def by_severity_of_backlog(episodes: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Report order: longest first, then largest cumulative intake, then earliest."""
    return episodes.orderBy(
        *spec.keys,
        F.desc("duration_days"),
        F.desc("cumulative_net"),
        "episode_start",
    )


def stress_episodes(scenario: DataFrame, spec: SeriesSpec, warning_threshold: float = 80.0) -> DataFrame:
    """Runs of total utilisation at or above the warning threshold."""
    return runs(
        scenario,
        spec,
        F.col("utilisation_total") >= warning_threshold,
        {
            "peak_utilisation": F.max("utilisation_total"),
            "minimum_headroom": F.min("headroom_total").cast("long"),
            "peak_load": F.max(TOTAL_LOAD).cast("long"),
        },
    ).select(
        *spec.keys,
        "episode_start",
        "episode_end",
        "duration_days",
        "peak_utilisation",
        "minimum_headroom",
        "peak_load",
        "status",
    )


def high_pressure_intervals(episodes: DataFrame, spec: SeriesSpec, threshold_days: int = 3) -> DataFrame:
    """Each long enough episode from the day it reached the threshold to its end."""
    return episodes.where(F.col("duration_days") >= threshold_days).select(
        *spec.keys,
        F.date_add("episode_start", threshold_days - 1).alias("interval_start"),
        F.col("episode_end").alias("interval_end"),
    )


def high_backlog_periods(df: DataFrame, spec: SeriesSpec, threshold_days: int = 3) -> DataFrame:
    """Stretches of consecutive calendar days whose streak is at least the threshold."""
    high = df.where(F.col(STREAK) >= threshold_days)
    rank = F.row_number().over(spec.ordered())
    return (
        high.withColumn("_anchor", F.date_sub(F.col(spec.date), rank))
        .groupBy(*spec.keys, "_anchor")
        .agg(
            F.min(spec.date).alias("interval_start"),
            F.max(spec.date).alias("interval_end"),
        )
        .drop("_anchor")
    )


def current_streak(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Positive run still open on the last date of each series."""
    return df.groupBy(*spec.keys).agg(
        F.max_by(STREAK, spec.date).cast("long").alias("current_streak")
    )
