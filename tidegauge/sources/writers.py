"""Writers: CSV, Parquet, strict JSON and append-only logs, refusing to overwrite by default."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalars import finite
from tidegauge.spec import REQUIRED, CapacityError


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def source_first(df: DataFrame, first: Sequence[str] = REQUIRED) -> DataFrame:
    """Documented source columns first, the rest after in their own order."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def write_csv(df: DataFrame, path: str, *, force: bool = False) -> None:
    """CSV with ISO dates, a header and newline line ends."""
    (
        df.write.mode(_mode(force))
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .option("lineSep", "\n")
        .option("encoding", "UTF-8")
        .csv(path)
    )


def write_parquet(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), force: bool = False
) -> None:
    df.write.mode(_mode(force)).partitionBy(*partition_by).parquet(path)


def _strict(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(value)
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _strict(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: _strict(item, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [
            _strict(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite numbers become null and decimals double, at any nesting depth."""
    return df.select(
        *[_strict(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def write_json(
    df: DataFrame, path: str, *, maximum_rows: int | None = None, force: bool = False
) -> None:
    """Strict JSON lines. A row limit raises instead of truncating."""
    if maximum_rows is not None and df.limit(maximum_rows + 1).count() > maximum_rows:
        raise CapacityError(f"Result holds more than {maximum_rows:,} rows.")
    (
        json_safe(df)
        .write.mode(_mode(force))
        .option("ignoreNullFields", False)
        .option("dateFormat", "yyyy-MM-dd")
        .json(path)
    )


def append_events(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines event log."""
    json_safe(df).write.mode("append").option("ignoreNullFields", False).json(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Append the events of one run to a log that :func:`tidegauge.sources.readers.read_runs` reads.

    Each call is an attempt with a folder of its own. A marker row is appended once all its events are written, so
    an attempt that fails half-way is never read, and of a run that is written again the first commit counts.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError("A run id needs letters, digits, dots, hyphens or underscores.")
    attempt = write_attempt(df, path, run)
    marker = df.sparkSession.range(1).select(
        F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at")
    )
    marker.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def write_attempt(df: DataFrame, path: str, run: str) -> str:
    """Write the events of a run without committing them; the attempt's id."""
    attempt = uuid.uuid4().hex
    json_safe(df).write.option("ignoreNullFields", False).option("dateFormat", "yyyy-MM-dd").json(f"{path}/events/run={run}/attempt={attempt}")
    return attempt
