"""Capacity scenarios: utilisation, headroom, status and their summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.episodes import stress_episodes
from tidegauge.spec import STOCK_A, STOCK_B, TOTAL_LOAD, SeriesSpec


@dataclass(frozen=True)
class Scenario:
    """Planning capacities and thresholds. They are assumptions, not measurements."""

    capacity_a: int
    capacity_b: int
    warning: float = 80.0
    critical: float = 95.0
    name: str = "scenario"

    def __post_init__(self) -> None:
        if self.capacity_a <= 0 or self.capacity_b <= 0:
            raise ValueError("Capacities must be positive.")
        if not 0 < self.warning < self.critical:
            raise ValueError("Thresholds must satisfy 0 < warning < critical.")


def _used(load: Column, capacity: Column) -> Column:
    return load / capacity * 100


def _add(df: DataFrame, cap_a: Column, cap_b: Column, warning: Column, critical: Column) -> DataFrame:
    total = cap_a + cap_b
    out = df.withColumns(
        {
            "utilisation_a": _used(F.col(STOCK_A), cap_a),
            "utilisation_b": _used(F.col(STOCK_B), cap_b),
            "utilisation_total": _used(F.col(TOTAL_LOAD), total),
            "headroom_a": cap_a - F.col(STOCK_A),
            "headroom_b": cap_b - F.col(STOCK_B),
            "headroom_total": total - F.col(TOTAL_LOAD),
        }
    )
    used = F.col("utilisation_total")
    return out.withColumn(
        "capacity_status",
        F.when(used >= critical, "Critical")
        .when(used >= warning, "Warning")
        .otherwise("Within planning range"),
    )


def capacity_scenario(df: DataFrame, scenario: Scenario) -> DataFrame:
    """Add utilisation, headroom and status columns to daily metrics."""
    return _add(
        df,
        F.lit(scenario.capacity_a),
        F.lit(scenario.capacity_b),
        F.lit(scenario.warning),
        F.lit(scenario.critical),
    )


def capacity_scenarios(df: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Daily metrics under several scenarios at once; the name joins the series keys.

    The scenarios are a literal array the caller wrote, expanded row by row: no join.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(s.capacity_a).alias("_cap_a"),
                F.lit(s.capacity_b).alias("_cap_b"),
                F.lit(float(s.warning)).alias("_warn"),
                F.lit(float(s.critical)).alias("_crit"),
            )
            for s in scenarios
        ]
    )
    wide = df.select("*", F.inline(table))
    out = _add(wide, F.col("_cap_a"), F.col("_cap_b"), F.col("_warn"), F.col("_crit"))
    return out.drop("_cap_a", "_cap_b", "_warn", "_crit")


def scenario_summary(
    scenario_days: DataFrame, spec: SeriesSpec, scenario: Scenario
) -> DataFrame:
    """One row per series: latest and peak utilisation, day counts, stress episodes."""
    used = F.col("utilisation_total")
    date = F.col(spec.date)
    keys = list(spec.keys)
    opened = F.coalesce(F.lag(used).over(spec.ordered()) >= scenario.warning, F.lit(False))
    marked = scenario_days.withColumn("_opens", (used >= scenario.warning) & ~opened)
    return marked.groupBy(*keys).agg(
        F.lit(scenario.capacity_a).cast("long").alias("planning_capacity_a"),
        F.lit(scenario.capacity_b).cast("long").alias("planning_capacity_b"),
        F.lit(scenario.capacity_a + scenario.capacity_b).cast("long").alias("planning_capacity"),
        F.lit(float(scenario.warning)).alias("warning_threshold_percent"),
        F.lit(float(scenario.critical)).alias("critical_threshold_percent"),
        F.max_by(used, date).alias("latest_utilisation"),
        F.max_by("headroom_total", date).cast("long").alias("latest_headroom"),
        F.max_by("capacity_status", date).alias("latest_status"),
        F.max(used).alias("peak_utilisation"),
        F.min_by(date, F.struct(-used, date)).alias("peak_date"),
        F.count_if(used >= scenario.warning).alias("warning_days"),
        F.count_if(used >= scenario.critical).alias("critical_days"),
        F.count_if("_opens").alias("stress_episodes"),
    )


def suggested_capacity(df: DataFrame, spec: SeriesSpec, column: str = TOTAL_LOAD) -> DataFrame:
    """Rounded planning ceiling 15 % above the observed peak of each series."""
    peak = F.col("peak").cast("double")
    digits = F.greatest(F.lit(1.0), F.floor(F.log10(F.when(peak > 0, peak))).cast("double") - 1)
    order = F.pow(F.lit(10.0), digits)
    return (
        df.groupBy(*spec.keys)
        .agg(F.max(F.coalesce(F.col(column), F.lit(0))).alias("peak"))
        .select(
            *spec.keys,
            F.when(peak <= 0, F.lit(100))
            .otherwise(F.ceil(peak * 1.15 / order) * order)
            .cast("long")
            .alias("suggested_capacity"),
        )
    )


__all__ = [
    "Scenario",
    "capacity_scenario",
    "capacity_scenarios",
    "scenario_summary",
    "stress_episodes",
    "suggested_capacity",
]
