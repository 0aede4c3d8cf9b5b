"""Named queries: a DataFrame builder and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

# Fraction digits kept in results: engines add doubles in different orders.
DIGITS = 6

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), DIGITS) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def register(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Decorator that records a builder, and its SQL with ``doubles`` rounded alike."""

    def record(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
        if sql is not None:
            if doubles:
                swaps = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles)
                ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})"
            else:
                ORACLES[name] = sql
        return build

    return record
