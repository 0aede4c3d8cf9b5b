"""Column names, schemas and the series specification shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CapacityError(ValueError):
    """A request that cannot be computed safely."""


class DataQualityError(CapacityError):
    """Input that a strict gate rejected."""


DATE = "date"
INTAKE = "intake"
STOCK_A = "stock_a"
TRANSFER = "transfer"
STOCK_B = "stock_b"
DISCHARGE = "discharge"

FLOWS = (INTAKE, TRANSFER, DISCHARGE)
STOCKS = (STOCK_A, STOCK_B)
COUNTS = (INTAKE, STOCK_A, TRANSFER, STOCK_B, DISCHARGE)
REQUIRED = (DATE, *COUNTS)

TOTAL_LOAD = "total_load"
NET_INTAKE = "net_intake"
GROWTH = "growth_pct"
ROLL7 = "roll7"
ROLL14 = "roll14"
OFFSET_RATIO = "offset_ratio"
STREAK = "streak"
DERIVED = (TOTAL_LOAD, NET_INTAKE, GROWTH, ROLL7, ROLL14, OFFSET_RATIO, STREAK)

IMPUTED_DATE = "is_imputed_date"
IMPUTED_COUNT = "imputed_value_count"
HAS_IMPUTED = "has_imputed_values"
ANOMALY_TRANSFER = "anomaly_transfer"
ANOMALY_DISCHARGE = "anomaly_discharge"
ANOMALY_NEGATIVE = "anomaly_negative"
ANOMALY_ANY = "anomaly_any"
QUALITY = "quality_flag"

SRC_ROW = "src_row"

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED])

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("forecast_origin_date", T.DateType()),
        T.StructField("target_date", T.DateType()),
        T.StructField("actual_value", T.DoubleType()),
        T.StructField("current_load", T.DoubleType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("predicted_change_7d", T.DoubleType()),
        T.StructField("reconstructed_absolute_prediction", T.DoubleType()),
        T.StructField("persistence_prediction", T.DoubleType()),
        T.StructField("lower_interval", T.DoubleType()),
        T.StructField("median_prediction", T.DoubleType()),
        T.StructField("upper_interval", T.DoubleType()),
        T.StructField("evaluation_label", T.StringType()),
        T.StructField("fold", T.StringType()),
        T.StructField("is_imputed_date", T.BooleanType()),
        T.StructField("has_anomaly", T.BooleanType()),
        T.StructField("backlog_state", T.BooleanType()),
        T.StructField("capacity_stress", T.BooleanType()),
    ]
)
PREDICTION_COLUMNS = tuple(PREDICTION_SCHEMA.fieldNames())


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns name a series and which one dates its rows.

    With no keys the whole table is one series and its windows run in one task.
    That is acceptable because a series holds at most one row per calendar day;
    :func:`ensure_daily` is the guard for tables of unknown origin.
    """

    keys: tuple[str, ...] = ()
    date: str = DATE

    @classmethod
    def of(cls, *keys: str) -> SeriesSpec:
        return cls(tuple(keys))

    @property
    def index(self) -> tuple[str, ...]:
        return (*self.keys, self.date)

    def partition(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def ordered(self) -> WindowSpec:
        return self.partition().orderBy(F.col(self.date).asc())

    def reversed(self) -> WindowSpec:
        return self.partition().orderBy(F.col(self.date).desc())

    def trailing(self, rows: int) -> WindowSpec:
        """The current row and the ``rows - 1`` rows before it."""
        return self.ordered().rowsBetween(-(rows - 1), 0)

    def history(self, rows: int) -> WindowSpec:
        """The ``rows`` rows before the current row."""
        return self.ordered().rowsBetween(-rows, -1)

    def running(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        return self.partition().rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )

    def over(self, frame: str = "", order: str = "") -> str:
        """SQL window clause, for tables of many expressions.

        One SQL text costs one call into the JVM; the same expression built from
        column functions costs a dozen, which adds up over hundreds of columns.
        """
        keys = ", ".join(f"`{k}`" for k in self.keys)
        by = f"PARTITION BY {keys} " if keys else ""
        return f"OVER ({by}ORDER BY {order or f'`{self.date}`'}{' ' + frame if frame else ''})"

    def over_history(self, rows: int) -> str:
        return self.over(f"ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING")

    def over_trailing(self, rows: int) -> str:
        return self.over(f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW")

    def over_ahead(self, rows: int) -> str:
        return self.over(f"ROWS BETWEEN 1 FOLLOWING AND {rows} FOLLOWING")

    def cols(self, *more: str) -> list[Column]:
        return [F.col(c) for c in (*self.index, *more)]


def add_sql(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Append new columns given as SQL text, in one call."""
    return df.selectExpr("*", *[f"{text} AS `{name}`" for name, text in columns.items()])


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise with the full list of absent columns before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise CapacityError("Missing required column(s): " + ", ".join(missing))


def ensure_daily(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Reject a table that holds a null date or several rows per series and day."""
    require_columns(df, spec.index)
    bad = (
        df.groupBy(*spec.index)
        .count()
        .where((F.col("count") > 1) | F.col(spec.date).isNull())
        .limit(1)
        .collect()
    )
    if bad:
        raise CapacityError(
            "A daily series needs one row per series and date; first offender: "
            f"{bad[0].asDict()}"
        )
    return df
