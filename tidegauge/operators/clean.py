"""Repair raw text rows into a complete daily panel with audit columns and a report.

Everything is derived from one grouped pass over the raw rows. Grouping by series and
date resolves duplicates, counts defects and records the span of source positions per
day, so neither duplicate removal nor the chronology check sorts raw rows, and a hot
series or date is combined before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import (
    exceeds,
    finite,
    invalid_count,
    is_blank,
    is_fractional,
    joined_labels,
    parse_count,
    parse_date,
)
from tidegauge.spec import (
    ANOMALY_ANY,
    ANOMALY_DISCHARGE,
    ANOMALY_NEGATIVE,
    ANOMALY_TRANSFER,
    COUNTS,
    DATE,
    DISCHARGE,
    FLOWS,
    HAS_IMPUTED,
    IMPUTED_COUNT,
    IMPUTED_DATE,
    QUALITY,
    REQUIRED,
    SRC_ROW,
    STOCK_A,
    STOCK_B,
    STOCKS,
    TRANSFER,
    CapacityError,
    DataQualityError,
    SeriesSpec,
    require_columns,
)

FILLS = ("interpolate", "forward_fill", "zero", "none")

#: Dense days that one task sorts, in the windows over a panel.
TASK_DAYS = 400_000

# Row labels, in the order they are joined.
LABEL_IMPUTED_DATE = "Imputed date"
LABEL_IMPUTED_VALUES = "Imputed values"
LABEL_TRANSFER = "Transfer > stock A"
LABEL_DISCHARGE = "Discharge > stock B"
LABEL_NEGATIVE = "Negative count"
LABEL_OK = "OK"


@dataclass(frozen=True)
class CleanPolicy:
    """Repair choices. :data:`CONSERVATIVE` is the fixed-policy variant."""

    fill_missing_dates: bool = True
    duplicates: str = "last"
    stocks: str = "interpolate"
    flows: str = "zero"
    round_fractions: bool = True
    clip_negatives: bool = False
    accounting_negatives: bool = True
    zero_unresolved: bool = False
    label_imputed_values: bool = True
    strict: bool = False
    strict_logic: bool = False

    def __post_init__(self) -> None:
        if self.duplicates not in ("first", "last", "error"):
            raise ValueError("duplicates must be 'first', 'last' or 'error'.")
        for name in ("stocks", "flows"):
            if getattr(self, name) not in FILLS:
                raise ValueError(f"{name} must be one of: {', '.join(FILLS)}.")


CONSERVATIVE = CleanPolicy(
    accounting_negatives=False, zero_unresolved=True, label_imputed_values=False
)


@dataclass(frozen=True)
class Cleaned:
    """Clean daily rows, one report row per series, and the list of issues."""

    data: DataFrame
    report: DataFrame
    issues: DataFrame
    spec: SeriesSpec


def typed_rows(raw: DataFrame, spec: SeriesSpec, accounting_negatives: bool = True) -> DataFrame:
    """Parsed dates and counts plus per-row defect flags, still one row per raw row."""
    require_columns(raw, [*spec.keys, *REQUIRED, SRC_ROW])
    blank = F.lit(True)
    for c in REQUIRED:
        blank = blank & is_blank(F.col(c))
    return raw.select(
        *spec.keys,
        SRC_ROW,
        blank.alias("_blank"),
        parse_date(F.col(DATE)).alias(spec.date),
        *[parse_count(F.col(c), accounting_negatives).alias(c) for c in COUNTS],
        *[invalid_count(F.col(c), accounting_negatives).alias(f"_bad_{c}") for c in COUNTS],
    )


def _days(typed: DataFrame, spec: SeriesSpec, keep: str) -> DataFrame:
    pick = F.min_by if keep == "first" else F.max_by
    usable = F.col(spec.date).isNotNull() & ~F.col("_blank")
    return typed.groupBy(
        *spec.keys, F.when(usable, F.col(spec.date)).alias(spec.date)
    ).agg(
        *[pick(c, SRC_ROW).alias(c) for c in COUNTS],
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("_blank").alias("_blank_rows"),
        F.min(SRC_ROW).alias("_first_row"),
        F.max(SRC_ROW).alias("_last_row"),
        *[F.count_if(F.col(f"_bad_{c}") & usable).alias(f"_bad_{c}") for c in COUNTS],
    )


def keep_one_per_day(
    rows: DataFrame, spec: SeriesSpec, columns: tuple[str, ...] = COUNTS, keep: str = "last"
) -> DataFrame:
    """First or last row of each series and day in source order, without sorting rows."""
    pick = F.min_by if keep == "first" else F.max_by
    return rows.groupBy(*spec.index).agg(*[pick(c, SRC_ROW).alias(c) for c in columns])


def calendar_tasks(rows: DataFrame, spec: SeriesSpec, task_days: int = TASK_DAYS) -> int | None:
    """How many tasks hold the dense calendar of all series at about ``task_days`` days each.

    ``rows`` needs the series keys and the date only and may repeat days. None when one
    task can hold the whole panel, or when there is a single series, which is never split.
    """
    if not spec.keys:
        return None
    span = F.datediff(F.max(spec.date), F.min(spec.date)) + 1
    days = rows.groupBy(*spec.keys).agg(span.cast("long").alias("_days")).agg(F.sum("_days")).first()[0]
    return -(-days // task_days) if days and days > task_days else None


def densify(
    days: DataFrame, spec: SeriesSpec, flag: str = IMPUTED_DATE, tasks: int | None = None
) -> DataFrame:
    """Insert the calendar days missing between the first and last day of each series.

    Each present day spawns the gap that follows it, so no spine table is built and
    no join is needed; inserted rows carry nulls.

    Adaptive execution sizes its partitions by the present days, before the gaps are
    filled. ``tasks``, from :func:`calendar_tasks`, deals the series by what they become;
    later windows by series reuse that exchange.
    """
    if tasks:
        days = days.repartition(tasks, *spec.keys)
    following = F.lead(spec.date).over(spec.ordered())
    until = F.coalesce(F.date_sub(following, 1), F.col(spec.date))
    others = [c for c in days.columns if c not in spec.index]
    expanded = (
        days.withColumn("_until", until)
        .withColumn("_day", F.explode(F.sequence(F.col(spec.date), F.col("_until"))))
        .withColumn("_new", F.col("_day") != F.col(spec.date))
    )
    return expanded.select(
        *spec.keys,
        F.col("_day").alias(spec.date),
        *[F.when(~F.col("_new"), F.col(c)).alias(c) for c in others],
        F.col("_new").alias(flag),
    )


def missing_days(days: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Calendar days absent between the first and last day of each series."""
    return densify(days.select(*spec.index), spec, "_missing").where("_missing").drop("_missing")


def interpolate_time(column: str, spec: SeriesSpec) -> Column:
    """Linear in elapsed time between known neighbours; the ends take the nearest value.

    Time is measured in nanoseconds and the slope is formed first: results that fall on
    a half then round to a reproducible side.
    The look-ahead runs over the reversed window, where it is a running value; a
    forward window open to the end would rescan the rest of the series per row.
    """
    value, date = F.col(column), F.col(spec.date)
    seen = F.when(value.isNotNull(), date)
    before, ahead = spec.running(), spec.reversed().rowsBetween(Window.unboundedPreceding, 0)
    left, left_day = (F.last(x, ignorenulls=True).over(before) for x in (value, seen))
    right, right_day = (F.last(x, ignorenulls=True).over(ahead) for x in (value, seen))
    day = F.lit(86_400e9)
    slope = F.try_divide(right - left, F.datediff(right_day, left_day) * day)
    between = slope * (F.datediff(date, left_day) * day) + left
    return F.coalesce(value.cast("double"), between, left, right)


def forward_then_backward(column: str, spec: SeriesSpec) -> Column:
    value = F.col(column)
    ahead = spec.reversed().rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(
        F.last(value, ignorenulls=True).over(spec.running()),
        F.last(value, ignorenulls=True).over(ahead),
    )


def fill(column: str, spec: SeriesSpec, policy: str) -> Column:
    """One missing-value policy applied to a count column."""
    if policy == "interpolate":
        return interpolate_time(column, spec)
    if policy == "forward_fill":
        return forward_then_backward(column, spec)
    if policy == "zero":
        return F.coalesce(F.col(column), F.lit(0.0))
    if policy == "none":
        return F.col(column)
    raise ValueError(f"Unknown fill policy: {policy}")


def flag_anomalies(df: DataFrame) -> DataFrame:
    """Logical-constraint flags per row; an unknown side is not a violation."""
    negative = F.lit(False)
    for c in COUNTS:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    flagged = df.withColumns(
        {
            ANOMALY_TRANSFER: exceeds(F.col(TRANSFER), F.col(STOCK_A)),
            ANOMALY_DISCHARGE: exceeds(F.col(DISCHARGE), F.col(STOCK_B)),
            ANOMALY_NEGATIVE: negative,
        }
    )
    return flagged.withColumn(
        ANOMALY_ANY,
        F.col(ANOMALY_TRANSFER) | F.col(ANOMALY_DISCHARGE) | F.col(ANOMALY_NEGATIVE),
    )


def quality_label(with_imputed_values: bool = True) -> Column:
    pairs = [(F.col(IMPUTED_DATE), LABEL_IMPUTED_DATE)]
    if with_imputed_values:
        pairs.append((F.col(HAS_IMPUTED), LABEL_IMPUTED_VALUES))
    pairs += [
        (F.col(ANOMALY_TRANSFER), LABEL_TRANSFER),
        (F.col(ANOMALY_DISCHARGE), LABEL_DISCHARGE),
        (F.col(ANOMALY_NEGATIVE), LABEL_NEGATIVE),
    ]
    return joined_labels(*pairs, default=LABEL_OK)


def _repair(days: DataFrame, spec: SeriesSpec, policy: CleanPolicy) -> DataFrame:
    counted = days.where(F.col(spec.date).isNotNull()).select(*spec.index, *COUNTS)
    if policy.fill_missing_dates:
        daily = densify(counted, spec)
    else:
        daily = counted.withColumn(IMPUTED_DATE, F.lit(False))
    daily = daily.withColumns({f"_was_{c}": F.col(c) for c in COUNTS})
    daily = daily.withColumns(
        {c: fill(c, spec, policy.stocks) for c in STOCKS}
        | {c: fill(c, spec, policy.flows) for c in FLOWS}
    )
    filled = {c: F.col(f"_was_{c}").isNull() & F.col(c).isNotNull() for c in COUNTS}
    imputed = F.lit(0)
    for c in COUNTS:
        imputed = imputed + filled[c].cast("int")
    fractional = F.lit(0)
    unresolved = F.lit(0)
    for c in COUNTS:
        fractional = fractional + is_fractional(F.col(c)).cast("int")
        unresolved = unresolved + F.col(c).isNull().cast("int")
    daily = daily.withColumns(
        {
            IMPUTED_COUNT: imputed.cast("short"),
            "_fractional": fractional,
            "_unresolved": unresolved,
            "_missing_reported": sum(
                (F.col(f"_was_{c}").isNull() & ~F.col(IMPUTED_DATE)).cast("int")
                for c in COUNTS
            ),
        }
    ).withColumn(HAS_IMPUTED, F.col(IMPUTED_COUNT) > 0)
    if policy.zero_unresolved:
        daily = daily.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in COUNTS})
    if policy.round_fractions:
        daily = daily.withColumns({c: F.rint(F.col(c)) for c in COUNTS})
    negative_cells = F.lit(0)
    for c in COUNTS:
        negative_cells = negative_cells + F.coalesce(F.col(c) < 0, F.lit(False)).cast("int")
    daily = daily.withColumn("_negative_cells", negative_cells)
    if policy.clip_negatives:
        daily = daily.withColumns(
            {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0))) for c in COUNTS}
        )
    if policy.round_fractions:
        daily = daily.withColumns({c: finite(F.col(c)).cast("long") for c in COUNTS})
    flagged = flag_anomalies(daily).withColumn(ANOMALY_NEGATIVE, F.col("_negative_cells") > 0)
    flagged = flagged.withColumn(
        ANOMALY_ANY,
        F.col(ANOMALY_TRANSFER) | F.col(ANOMALY_DISCHARGE) | F.col(ANOMALY_NEGATIVE),
    )
    return flagged.withColumn(QUALITY, quality_label(policy.label_imputed_values))


_DAILY_COLUMNS = (
    *COUNTS, IMPUTED_DATE, IMPUTED_COUNT, HAS_IMPUTED, ANOMALY_TRANSFER, ANOMALY_DISCHARGE,
    ANOMALY_NEGATIVE, ANOMALY_ANY, QUALITY,
)


def out_of_order(days: DataFrame, spec: SeriesSpec) -> Column:
    """True on a day whose first source row precedes the last row of the day before.

    Source order rises with the date exactly when no day has this.
    """
    return F.coalesce(
        F.lag("_last_row").over(spec.ordered()) > F.col("_first_row"), F.lit(False)
    )


def _report(days: DataFrame, repaired: DataFrame, spec: SeriesSpec) -> DataFrame:
    keys = list(spec.keys)
    dated = F.col(spec.date).isNotNull()
    source = (
        days.withColumn("_late", dated & out_of_order(days, spec))
        .groupBy(*keys)
        .agg(
            F.sum("_rows").alias("source_rows"),
            F.sum("_blank_rows").alias("empty_rows_removed"),
            F.coalesce(F.sum(F.when(~dated, F.col("_rows") - F.col("_blank_rows"))), F.lit(0))
            .alias("invalid_date_rows_removed"),
            F.coalesce(F.sum(F.when(dated, F.col("_rows") - 1)), F.lit(0))
            .alias("duplicate_rows_removed"),
            F.bool_or("_late").alias("chronology_repaired"),
            *[F.sum(f"_bad_{c}").alias(f"invalid_{c}") for c in COUNTS],
        )
    )
    result = repaired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.min(spec.date).alias("reporting_start"),
        F.max(spec.date).alias("reporting_end"),
        F.count_if(IMPUTED_DATE).alias("missing_dates_inserted"),
        F.sum("_missing_reported").alias("missing_reported_values"),
        F.sum(F.col(IMPUTED_COUNT).cast("long")).alias("numeric_values_imputed"),
        F.count_if(HAS_IMPUTED).alias("rows_with_imputed_values"),
        F.sum("_unresolved").alias("unresolved_values"),
        F.sum("_fractional").alias("fractional_values"),
        F.sum("_negative_cells").alias("negative_values_found"),
        F.count_if(ANOMALY_NEGATIVE).alias("negative_rows"),
        F.count_if(ANOMALY_TRANSFER).alias("transfer_anomalies"),
        F.count_if(ANOMALY_DISCHARGE).alias("discharge_anomalies"),
        F.count_if(F.col(ANOMALY_TRANSFER) | F.col(ANOMALY_DISCHARGE)).alias(
            "logical_anomaly_rows"
        ),
    )
    if keys:
        return source.join(result, keys, "left")
    one = F.lit(1)
    return source.withColumn("_k", one).join(result.withColumn("_k", one), "_k").drop("_k")


def _issue_rows(report: DataFrame, spec: SeriesSpec, policy: CleanPolicy) -> DataFrame:
    """Long list of the repairs that happened, at most one row per code and column."""
    rounded = "warning" if policy.round_fractions else "error"
    clipped = "warning" if policy.clip_negatives else "error"
    # Severity, code, affected column and the report field that counts it.
    table: list[tuple[str, str, str | None, Column]] = [
        ("warning", "EMPTY_ROWS_REMOVED", None, F.col("empty_rows_removed")),
        ("error", "INVALID_DATES_REMOVED", DATE, F.col("invalid_date_rows_removed")),
        ("warning", "CHRONOLOGY_SORTED", None, F.col("chronology_repaired").cast("long")),
        *[("error", "INVALID_NUMERIC_VALUES", c, F.col(f"invalid_{c}")) for c in COUNTS],
        ("error", "DUPLICATE_DATES_RESOLVED", DATE, F.col("duplicate_rows_removed")),
        ("warning", "MISSING_DATES_INSERTED", None, F.col("missing_dates_inserted")),
        ("warning", "NUMERIC_VALUES_IMPUTED", None, F.col("rows_with_imputed_values")),
        ("error", "UNRESOLVED_MISSING_VALUES", None, F.col("unresolved_values")),
        (rounded, "FRACTIONAL_COUNTS", None, F.col("fractional_values")),
        (clipped, "NEGATIVE_COUNTS", None, F.col("negative_rows")),
        ("error", "TRANSFER_EXCEEDS_STOCK_A", TRANSFER, F.col("transfer_anomalies")),
        ("error", "DISCHARGE_EXCEEDS_STOCK_B", DISCHARGE, F.col("discharge_anomalies")),
    ]
    if policy.zero_unresolved:
        table.append(("error", "MISSING_VALUE", None, F.col("missing_reported_values")))
    entries = F.array(
        *[
            F.struct(
                F.lit(severity).alias("severity"),
                F.lit(code).alias("code"),
                F.lit(column).cast("string").alias("column"),
                F.coalesce(count, F.lit(0)).cast("long").alias("affected_rows"),
            )
            for severity, code, column, count in table
        ]
    )
    return report.select(*spec.keys, F.inline(entries)).where("affected_rows > 0")


def clean(
    raw: DataFrame, spec: SeriesSpec = SeriesSpec(), policy: CleanPolicy = CleanPolicy()
) -> Cleaned:
    """Repair raw text rows. Lazy, unless a policy asks for a strict check."""
    typed = typed_rows(raw, spec, policy.accounting_negatives)
    keep = "last" if policy.duplicates == "error" else policy.duplicates
    days = _days(typed, spec, keep)
    repaired = _repair(days, spec, policy)
    report = _report(days, repaired, spec)
    issues = _issue_rows(report, spec, policy)
    if policy.duplicates == "error":
        repeated = days.where((F.col("_rows") > 1) & F.col(spec.date).isNotNull())
        affected = repeated.agg(F.sum("_rows")).first()[0]
        if affected:
            raise CapacityError(f"Duplicate reporting dates affect {affected} rows.")
    if policy.strict and not issues.where("severity = 'error'").isEmpty():
        raise DataQualityError("Strict cleaning rejected the source: it has error findings.")
    if policy.strict_logic and not issues.where("code like '%_EXCEEDS_%'").isEmpty():
        raise DataQualityError("Strict cleaning rejected rows that break a logical constraint.")
    data = repaired.select(*spec.index, *_DAILY_COLUMNS)
    return Cleaned(data, report, issues, spec)


def clean_conservative(raw: DataFrame, spec: SeriesSpec = SeriesSpec(), **changes) -> Cleaned:
    """The fixed-policy variant: what is left unknown after filling becomes zero."""
    return clean(raw, spec, replace(CONSERVATIVE, **changes))


def reject_if_empty(cleaned: Cleaned) -> Cleaned:
    """Raise when no row survived: everything blank, or no valid date."""
    if cleaned.data.isEmpty():
        raise CapacityError("The source holds no populated row with a valid date.")
    return cleaned
