"""Roll raw facts up to one row per series and day."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.spec import COUNTS, DATE, SeriesSpec


def rollup_days(
    facts: DataFrame, keys: Mapping[str, Column], day: Column, measures: Mapping[str, Column]
) -> DataFrame:
    """Aggregate facts by series key and day.

    All measures are sums and counts, so Spark combines them before the shuffle and
    a key that holds a third of the facts ships only one row per day and task.
    """
    return (
        facts.select(
            *[c.alias(k) for k, c in keys.items()], day.cast("date").alias(DATE), "*"
        )
        .groupBy(*keys, DATE)
        .agg(*[c.alias(name) for name, c in measures.items()])
    )


def lineitem_measures() -> dict[str, Column]:
    """Stand-in flows and stocks over line items."""
    return {
        "intake": F.count(F.lit(1)),
        "stock_a": F.count_if(F.col("l_discount") <= 0.06),
        "transfer": F.count_if(F.col("l_linestatus") == "F"),
        "stock_b": F.sum("l_quantity").cast("long"),
        "discharge": F.count_if(F.col("l_quantity") <= 25),
    }


def lineitem_facts(
    spark: SparkSession, sf_dir: str, by: str | None = None
) -> tuple[DataFrame, dict[str, Column]]:
    """Line items, and the series key as a column of them: one series, or by flag, nation or supplier."""
    facts = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys: dict[str, Column] = {}
    if by == "flag":
        keys = {"series": F.col("l_returnflag")}
    elif by == "supplier":
        keys = {"series": F.col("l_suppkey")}
    elif by == "nation":
        # adaptive execution broadcasts the dimension if it measures small
        suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
        facts = facts.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        keys = {"series": F.col("s_nationkey").cast("long")}
    elif by is not None:
        raise ValueError("by must be None, 'flag', 'nation' or 'supplier'.")
    return facts, keys


def lineitem_daily(spark: SparkSession, sf_dir: str, by: str | None = None) -> tuple[DataFrame, SeriesSpec]:
    """Daily fixture from line items: one series, or a panel by flag, nation or supplier."""
    facts, keys = lineitem_facts(spark, sf_dir, by)
    days = rollup_days(facts, keys, F.col("l_shipdate"), lineitem_measures())
    return days.select(*keys, DATE, *COUNTS), SeriesSpec.of(*keys)


def lineitem_days(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Series key and day of every line item, not rolled up: two columns to measure a panel by."""
    facts, keys = lineitem_facts(spark, sf_dir, by)
    return facts.select(*[c.alias(k) for k, c in keys.items()], F.col("l_shipdate").cast("date").alias(DATE))
