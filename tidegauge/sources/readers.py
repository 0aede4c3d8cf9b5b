"""Readers: string-first CSV, dated feature tables, records and prediction tables."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.spec import (
    PREDICTION_SCHEMA,
    REQUIRED,
    SRC_ROW,
    CapacityError,
    SeriesSpec,
    ensure_daily,
)

# Cell texts that a string-first CSV scan treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def canonical_name(name: str) -> str:
    """Header without byte-order mark, footnote asterisks or repeated whitespace."""
    return " ".join(name.replace("\ufeff", "").split()).rstrip("*").strip()


def canonical_columns(
    df: DataFrame,
    names: Mapping[str, str] | None = None,
    *,
    extra: Sequence[str] = (),
    on_collision: str = "error",
) -> DataFrame:
    """Rename headers to the engine's names and project to the required columns.

    ``names`` maps a source header (canonicalised) to an engine column. With
    ``on_collision='last'`` the last of several equal headers wins.
    """
    if on_collision not in ("error", "last"):
        raise ValueError("on_collision must be 'error' or 'last'.")
    mapping = {canonical_name(k): v for k, v in (names or {}).items()}
    targets = [mapping.get(canonical_name(c), canonical_name(c)) for c in df.columns]
    repeated = sorted({t for t in targets if targets.count(t) > 1})
    if repeated and on_collision == "error":
        raise CapacityError("Several columns normalise to the same name: " + ", ".join(repeated))
    wanted = [*extra, *REQUIRED]
    missing = [c for c in wanted if c not in targets]
    if missing:
        raise CapacityError("Missing required column(s): " + ", ".join(missing))
    last = {target: position for position, target in enumerate(targets)}
    unique = df.toDF(*[f"_c{i}" for i in range(len(targets))])
    return unique.select(*[F.col(f"_c{last[c]}").alias(c) for c in wanted])


def _header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in the first line of a path's first file."""
    lines = spark.read.text(path).head(1)
    found = next(csv.reader([lines[0][0].lstrip("\ufeff")]), []) if lines else []
    if not found:
        raise CapacityError(f"The CSV source has no columns: {path}")
    return tuple(found)


def _scan(
    spark: SparkSession, paths: list[str], header: tuple[str, ...], names: Mapping[str, str] | None,
    extra: Sequence[str], on_collision: str, checked: bool,
) -> DataFrame:
    """Rows of files with one header. Unless names are blank or repeated, each file's header is checked."""
    positional = [f"_c{i}" for i in range(len(header))]
    by_name = checked and len(set(header)) == len(header) and all(h.strip() for h in header)
    fields = [T.StructField(c, T.StringType()) for c in (header if by_name else positional)]
    scan = (
        spark.read.option("header", True)
        .option("enforceSchema", not by_name)
        .option("multiLine", False)
        .option("encoding", "UTF-8")
        .schema(T.StructType(fields))
        .csv(paths)
        .select(
            "*",
            F.monotonically_increasing_id().alias("tg_order"),
            F.col("_metadata.file_path").alias("tg_file"),
            F.col("_metadata.file_block_start").alias("tg_block"),
        )
        .toDF(*positional, "tg_order", "tg_file", "tg_block")
    )
    cells = [F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(h) for c, h in zip(positional, header)]
    named = canonical_columns(
        scan.select(*cells, "tg_order", "tg_file", "tg_block"),
        names,
        extra=(*extra, "tg_order", "tg_file", "tg_block"),
        on_collision=on_collision,
    )
    return named.select(*extra, *REQUIRED, F.struct("tg_file", "tg_block", "tg_order").alias(SRC_ROW))


def read_raw_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    header: Sequence[str] | None = None,
    names: Mapping[str, str] | None = None,
    extra: Sequence[str] = (),
    max_rows: int | None = None,
    on_collision: str = "error",
) -> DataFrame:
    """Scan CSV files with every field as text, plus the source row order.

    Types are decided later, where failures can be counted. Every path has its own header, and
    paths of one header are scanned together; a file under a path whose header differs from the
    path's first one is an error, never read into wrong columns. ``header`` skips the one-line
    peeks when the caller knows the columns of all files. ``src_row`` sorts by file, then by
    position in the file: it is the only record of source order.
    """
    paths = [path] if isinstance(path, str) else list(path)
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        groups.setdefault(tuple(header) if header else _header_of(spark, p), []).append(p)
    parts = [_scan(spark, own, columns, names, extra, on_collision, header is None) for columns, own in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if max_rows is not None and out.limit(max_rows + 1).count() > max_rows:
        raise CapacityError(f"Source holds more than {max_rows:,} rows.")
    if out.isEmpty():
        raise CapacityError("The CSV source is empty.")
    return out


def read_feature_table(
    spark: SparkSession, path: str, spec: SeriesSpec = SeriesSpec(), *, verify: bool = True
) -> DataFrame:
    """Parquet table with one dated row per series and day."""
    df = spark.read.parquet(path)
    if spec.date not in df.columns:
        raise CapacityError(f"Feature table has no {spec.date!r} column.")
    df = df.withColumn(spec.date, F.col(spec.date).cast("date"))
    if df.isEmpty():
        raise CapacityError("Feature table is empty.")
    return ensure_daily(df, spec) if verify else df


def from_records(
    spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType | None = None
) -> DataFrame:
    """Table of request records; every field is text unless a schema says otherwise."""
    if not isinstance(rows, (list, tuple)) or not rows:
        raise CapacityError("Records must be a non-empty list of objects.")
    if not all(isinstance(r, Mapping) for r in rows):
        raise CapacityError("Every record must be an object.")
    if schema is None:
        fields = list(dict.fromkeys(k for r in rows for k in r))
        schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
        rows = [{k: None if v is None else str(v) for k, v in r.items()} for r in rows]
    return spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in rows], schema)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Long-form prediction table stored as CSV."""
    return (
        spark.read.schema(PREDICTION_SCHEMA)
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def read_runs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Events of the committed runs of a log, each run once, with its id as ``run``.

    One attempt counts per run, the first that was committed; the log needs at least one. The markers are a row
    per attempt, grouped on the executors, and are joined on the partition columns of the events.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*fields.fields, T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())])
    commits = spark.read.schema("run string, attempt string, committed_at timestamp").parquet(f"{path}/commits")
    first = commits.groupBy("run").agg(F.min(F.struct("committed_at", "attempt")).getField("attempt").alias("attempt"))
    return spark.read.schema(whole).json(f"{path}/events").join(first, ["run", "attempt"]).drop("attempt")
