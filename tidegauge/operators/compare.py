"""Table equivalence, content fingerprints, profiles and provenance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalars import is_blank
from tidegauge.operators.clean import missing_days
from tidegauge.session import cut_lineage
from tidegauge.spec import (
    DISCHARGE,
    IMPUTED_DATE,
    INTAKE,
    TOTAL_LOAD,
    CapacityError,
    SeriesSpec,
)

DECIMALS = 10


def kind_of(data_type: T.DataType) -> str:
    """Type family: widths of one family count as the same."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    return "string"


def schema_fingerprint(df: DataFrame) -> str:
    """Hash of column names, order and type families."""
    fields = [(f.name, kind_of(f.dataType)) for f in df.schema.fields]
    return hashlib.sha256(json.dumps(fields).encode()).hexdigest()


def _canonical(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    kind = kind_of(field.dataType)
    if kind == "numeric":
        # Adding zero turns -0.0 into 0.0.
        c = (F.round(c.cast("double"), DECIMALS) + 0.0).cast("string")
    elif kind == "datetime":
        c = c.cast("timestamp").cast("string")
    else:
        c = c.cast("string")
    return F.coalesce(F.concat(F.lit("="), c), F.lit("~"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies the content: row count and two combinations of row hashes.

    Rows carry their key, so any order of rows and partitions gives the same value and
    the work is a single partial aggregate. Sub-precision noise and signed zero do not
    matter; values, null positions, names and column order do.
    """
    row = F.concat_ws("\u001f", *[_canonical(f) for f in df.schema.fields])
    hashed = df.select(F.xxhash64(row).alias("h"), F.xxhash64(F.lit(7), row).alias("g"))
    return hashed.agg(
        F.lit(schema_fingerprint(df)).alias("schema_hash"),
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("h").alias("xor_hash"),
        F.sum(F.col("g").cast("decimal(38,0)")).alias("sum_hash"),
    )


@dataclass(frozen=True)
class Tolerance:
    relative: float = 1e-12
    absolute: float = 1e-9


def difference_counts(
    left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: Tolerance = Tolerance(),
    exact: Sequence[str] = (), by: Sequence[str] = (),
) -> DataFrame:
    """One row of mismatch counts from one full join on the keys, or one for each value of ``by`` (among the keys).

    For every other column: rows whose null position differs, and rows whose values
    differ beyond the tolerance (not at all for non-numeric and ``exact`` columns).
    """
    keys = list(keys)
    columns = [c for c in left.columns if c not in keys]
    kinds = {f.name: kind_of(f.dataType) for f in left.schema.fields}
    a = left.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = a.join(b, keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    counts = [
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
    ]
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if kinds[c] == "numeric" and c not in exact:
            limit = tolerance.absolute + tolerance.relative * F.abs(y)
            differs = F.abs(x - y) > limit
        else:
            differs = x != y
        counts.append(F.count_if(both & (x.isNull() != y.isNull())).alias(f"nulls_{c}"))
        counts.append(F.count_if(both & F.coalesce(differs, F.lit(False))).alias(f"values_{c}"))
    return joined.groupBy(*by).agg(*counts)


def _leaves(df: DataFrame, ranges: Mapping[str, Column]) -> DataFrame:
    """Fingerprint of the rows of every finest range: one partial aggregate, and fingerprints add up to coarser ones."""
    row = F.concat_ws("\u001f", *[_canonical(f) for f in df.schema.fields])
    placed = df.select(
        *[F.coalesce(c.cast("string"), F.lit("~")).alias(n) for n, c in ranges.items()],
        F.xxhash64(row).alias("_x"), F.xxhash64(F.lit(7), row).cast("decimal(38,0)").alias("_s"), F.lit(1).alias("_c"),
    )
    return _merged(placed, list(ranges))


def _merged(leaves: DataFrame, by: list[str]) -> DataFrame:
    # a sum can't overflow below 10**19 rows
    return leaves.groupBy(*by).agg(F.sum("_c").alias("_c"), F.bit_xor("_x").alias("_x"), F.sum("_s").cast("decimal(38,0)").alias("_s"))


def located_differences(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ranges: Mapping[str, Column],
    tolerance: Tolerance = Tolerance(), exact: Sequence[str] = (),
) -> DataFrame:
    """Where two tables of the same columns differ: a row per finest range and column with a difference.

    ``ranges`` name expressions over the keys, from coarse to fine (year, month). Each table is read once into
    fingerprints of its finest ranges, which are merged and compared level by level; rows are joined in ranges that
    differ only. ``field`` is a column, or ``(rows)`` for rows that one side lacks. Equal tables, empty ones included,
    give no row. Keys must be unique on each side. A null in a key is a value of the range ``~`` and matches nothing.
    """
    names, keys = list(ranges), list(keys)
    if left.columns != right.columns or set(names) & set(left.columns):
        raise CapacityError("Both tables need the same columns, and ranges names of their own.")
    sides = [cut_lineage(_leaves(df, ranges)) for df in (left, right)]
    differing = None
    for depth in range(1, len(names) + 1):
        by = names[:depth]
        if differing is not None:
            sides = [s.join(differing, names[: depth - 1], "left_semi") for s in sides]
        a, b = (_merged(s, by) for s in sides)
        b = b.select(*by, *[F.col(c).alias(f"{c}2") for c in ("_c", "_x", "_s")])
        same = F.lit(True)
        for c in ("_c", "_x", "_s"):
            same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
        differing = a.join(b, by, "full_outer").where(~same).select(*by)
    differing = cut_lineage(differing)
    rows = [
        df.select("*", *[F.coalesce(c.cast("string"), F.lit("~")).alias(n) for n, c in ranges.items()]).join(differing, names, "left_semi")
        for df in (left, right)
    ]
    counts = difference_counts(*rows, [*keys, *names], tolerance, exact, by=names)
    zero = F.lit(0).cast("long")
    cells = [F.struct(F.lit("(rows)").alias("field"), F.col("only_left"), F.col("only_right"), zero.alias("null_places"), zero.alias("changed_values"))]
    cells += [
        F.struct(
            F.lit(c).alias("field"), zero.alias("only_left"), zero.alias("only_right"),
            F.col(f"nulls_{c}").alias("null_places"), F.col(f"values_{c}").alias("changed_values"),
        )
        for c in left.columns if c not in keys
    ]
    return counts.select(*names, F.inline(F.array(*cells))).where("only_left + only_right + null_places + changed_values > 0")


def first_difference(
    left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: Tolerance = Tolerance(),
    exact: Sequence[str] = (),
) -> str | None:
    """Name of the first check that fails, or None when the tables are equivalent."""
    if left.columns != right.columns:
        return "column order or names changed"
    if schema_fingerprint(left) != schema_fingerprint(right):
        return "schema fingerprint changed"
    state = difference_counts(left, right, keys, tolerance, exact).first().asDict()
    if state["only_left"] != state["only_right"]:
        return "row count changed"
    if state["only_left"]:
        return "row keys changed"
    for prefix, text in (("nulls_", "missing-value locations"), ("values_", "values")):
        for name, count in state.items():
            if name.startswith(prefix) and count:
                return f"{text} changed in column {name[len(prefix):]!r}"
    return None


def dataset_profile(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows, columns, date span, missing cells and repeated dates.

    Repeats come from a count per date first, so no list of dates is kept anywhere.
    """
    missing = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        lost = is_blank(c) if isinstance(f.dataType, T.StringType) else c.isNull()
        missing = missing + lost.cast("int")
    per_day = df.select(date, missing.alias("_m")).groupBy(date).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_m")
    )
    return per_day.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
        F.coalesce(F.sum("_m"), F.lit(0)).cast("long").alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_dates"),
    )


def provenance_audit(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Span, gaps and the identity "load change is intake minus discharge" per series."""
    keys = list(spec.keys)
    change = F.col(TOTAL_LOAD) - F.lag(TOTAL_LOAD).over(spec.ordered())
    checked = df.withColumn("_gap", change - (F.col(INTAKE) - F.col(DISCHARGE)))
    near = F.avg(F.when(F.col("_gap").isNotNull(), (F.abs("_gap") <= 10).cast("double"))) * 100
    imputed = F.count_if(IMPUTED_DATE) if IMPUTED_DATE in df.columns else F.lit(0).cast("long")
    span = F.datediff(F.max(spec.date), F.min(spec.date)) + 1
    out = checked.groupBy(*keys).agg(
        F.min(spec.date).alias("range_start"),
        F.max(spec.date).alias("range_end"),
        F.count(F.lit(1)).alias("rows"),
        (span - F.count(F.lit(1))).cast("long").alias("missing_dates"),
        imputed.alias("imputed_dates"),
        F.median(F.abs("_gap")).alias("median_absolute_residual"),
        F.coalesce(near, F.lit(0.0)).alias("percent_within_10"),
    )
    return out.withColumn("approximately_satisfied", F.col("percent_within_10") >= 80.0)


def disjoint(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    """True when no key occurs on both sides."""
    return left.select(*keys).join(right.select(*keys), list(keys), "left_semi").isEmpty()


__all__ = [
    "Tolerance", "dataset_profile", "difference_counts", "disjoint", "fingerprint",
    "first_difference", "kind_of", "located_differences", "missing_days", "provenance_audit", "schema_fingerprint",
]
