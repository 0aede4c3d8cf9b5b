"""Audit of raw, cleaned or metric-enriched tables that changes nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import (
    exceeds,
    finite,
    invalid_boolean,
    invalid_count,
    is_blank,
    is_fractional,
    parse_boolean,
    parse_count,
    parse_date,
)
from tidegauge.operators.clean import out_of_order
from tidegauge.operators.ordered import expected_metrics
from tidegauge.operators.quantiles import attach, exact_quantiles
from tidegauge.session import cut_lineage
from tidegauge.spec import (
    ANOMALY_DISCHARGE,
    ANOMALY_TRANSFER,
    COUNTS,
    DATE,
    DERIVED,
    DISCHARGE,
    GROWTH,
    INTAKE,
    NET_INTAKE,
    OFFSET_RATIO,
    REQUIRED,
    ROLL7,
    ROLL14,
    SRC_ROW,
    STOCK_A,
    STOCK_B,
    STREAK,
    TOTAL_LOAD,
    TRANSFER,
    CapacityError,
    DataQualityError,
    SeriesSpec,
)

# Severities from least to most severe, and what each finding costs.
SEVERITIES = ("info", "warning", "error", "critical")
DEDUCTIONS = {"info": 0, "warning": 4, "error": 12, "critical": 35}

FINDING_TYPE = (
    "struct<severity:string,category:string,code:string,message:string,"
    "affected_rows:bigint,columns:array<string>,examples:array<string>>"
)


@dataclass(frozen=True)
class AuditConfig:
    require_complete_series: bool = True
    allow_fractions: bool = False
    check_derived: bool = True
    check_stock_flow: bool = False
    stock_flow_tolerance: float = 1.0
    absolute_tolerance: float = 1e-6
    relative_tolerance: float = 1e-6
    outlier_threshold: float | None = 8.0
    strict_warnings: bool = False
    #: A display limit of evidence rows per series, for callers that want one.
    maximum_flagged_rows: int | None = None

    def __post_init__(self) -> None:
        tolerances = (
            self.stock_flow_tolerance, self.absolute_tolerance, self.relative_tolerance
        )
        if min(tolerances) < 0:
            raise ValueError("Tolerances must be non-negative.")
        if self.outlier_threshold is not None and self.outlier_threshold <= 0:
            raise ValueError("outlier_threshold must be positive or None.")
        if self.maximum_flagged_rows is not None and self.maximum_flagged_rows < 1:
            raise ValueError("maximum_flagged_rows must be positive.")


@dataclass(frozen=True)
class Audit:
    """Findings, one summary row per series, and flagged rows with their codes."""

    findings: DataFrame
    summary: DataFrame
    evidence: DataFrame
    spec: SeriesSpec


@dataclass(frozen=True)
class _Check:
    severity: str
    category: str
    code: str
    message: str
    columns: tuple[str, ...]
    flag: Column


EMPTY = ("critical", "structure", "EMPTY_DATASET",
         "no rows", 0, [], [])


def schema_findings(df: DataFrame) -> list[tuple]:
    """Schema problems that make the row checks pointless. Runs no job."""
    names = [c.strip() for c in df.columns]
    repeated = sorted({c for c in names if names.count(c) > 1})
    if repeated:
        return [("critical", "schema", "AMBIGUOUS_COLUMNS",
                 "columns of one name", 0, repeated, [])]
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        return [("critical", "schema", "MISSING_REQUIRED_COLUMNS",
                 "columns missing", 0, missing, [])]
    return []


def _typed(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    if SRC_ROW not in df.columns:
        df = df.withColumn(SRC_ROW, F.unix_date(F.col(DATE).cast("date")).cast("long"))
    blank = F.lit(True)
    for c in REQUIRED:
        blank = blank & is_blank(F.col(c).cast("string"))
    text = {c: F.col(c).cast("string") for c in REQUIRED}
    supplied = [c for c in (*DERIVED, ANOMALY_TRANSFER, ANOMALY_DISCHARGE) if c in df.columns]
    return df.select(
        *spec.keys,
        SRC_ROW,
        blank.alias("_blank"),
        parse_date(text[DATE]).alias(spec.date),
        F.struct(*[text[c].alias(c) for c in REQUIRED]).alias("_source"),
        *[parse_count(text[c]).alias(c) for c in COUNTS],
        *[invalid_count(text[c]).alias(f"_bad_{c}") for c in COUNTS],
        *[F.col(c).alias(f"_given_{c}") for c in supplied],
    )


def robust_limits(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Median, median absolute deviation and finite count per series and count column.

    Sketch-bracketed selection: exact, and no task holds the values of a series.
    """
    keys = list(spec.keys)
    cells = rows.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("_col"), finite(F.col(c)).alias("_val"))
                    for c in COUNTS
                ]
            )
        ),
    )
    per = [*keys, "_col"]
    middle = exact_quantiles(cells, per, "_val", {"_med": 0.5}).withColumnRenamed("n", "_fin")
    off = attach(cells, middle, per).withColumn("_dev", F.abs(F.col("_val") - F.col("_med")))
    spread = exact_quantiles(off, per, "_dev", {"_mad": 0.5}).drop("n")
    both = middle.join(spread, per)
    return both.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_col") == c, F.col(source))).alias(f"{source}_{c}")
            for c in COUNTS
            for source in ("_med", "_mad", "_fin")
        ]
    )


def _close(actual: Column, expected: Column, config: AuditConfig) -> Column:
    gap = F.abs(actual - expected)
    allowed = config.absolute_tolerance + config.relative_tolerance * F.abs(expected)
    both_missing = actual.isNull() & expected.isNull()
    return both_missing | F.coalesce(gap <= allowed, F.lit(False))


def _checks(rows: DataFrame, config: AuditConfig) -> list[_Check]:
    blank = F.col("_blank")
    checks = [
        _Check("warning", "completeness", "EMPTY_ROWS",
               "all required columns are blank", (), blank),
        _Check("error", "temporal", "INVALID_DATES",
               "date: the text fits no declared layout", (DATE,),
               F.col("_no_date") & ~blank),
        _Check("error", "temporal", "DUPLICATE_DATES",
               "date: the series has another row of this day", (DATE,),
               F.coalesce(F.col("_same_day") > 1, F.lit(False))),
    ]
    fraction_severity = "warning" if config.allow_fractions else "error"
    for c in COUNTS:
        value, bad = F.col(c), F.col(f"_bad_{c}")
        infinite = F.coalesce(F.abs(value) == float("inf"), F.lit(False))
        checks += [
            _Check("error", "numeric", f"INVALID_NUMERIC_VALUES:{c}",
                   f"{c}: the text is no number", (c,), bad & ~blank),
            _Check("error", "numeric", f"MISSING_NUMERIC_VALUES:{c}",
                   f"{c}: blank in a row that is not blank", (c,),
                   value.isNull() & ~bad & ~blank),
            _Check("error", "numeric", f"NONFINITE_VALUES:{c}",
                   f"{c}: infinite", (c,), infinite),
            _Check(fraction_severity, "numeric", f"FRACTIONAL_COUNTS:{c}",
                   f"{c}: not a whole number", (c,), is_fractional(value)),
            _Check("error", "numeric", f"NEGATIVE_COUNTS:{c}",
                   f"{c}: below zero", (c,),
                   F.coalesce(value < 0, F.lit(False))),
        ]
        if config.outlier_threshold is not None:
            mad = F.col(f"_mad_{c}")
            score = 0.6745 * F.abs(finite(value) - F.col(f"_med_{c}")) / F.nullif(mad, F.lit(0.0))
            far = (F.col(f"_fin_{c}") >= 10) & (mad > 0) & (score > config.outlier_threshold)
            checks.append(
                _Check("warning", "plausibility", f"ROBUST_OUTLIERS:{c}",
                       f"{c}: robust z-score above {config.outlier_threshold:g}", (c,),
                       F.coalesce(far, F.lit(False)))
            )
    over_a = exceeds(F.col(TRANSFER), F.col(STOCK_A))
    over_b = exceeds(F.col(DISCHARGE), F.col(STOCK_B))
    checks += [
        _Check("error", "logical", "TRANSFER_EXCEEDS_STOCK_A",
               f"{TRANSFER} > {STOCK_A}", (TRANSFER, STOCK_A), over_a),
        _Check("error", "logical", "DISCHARGE_EXCEEDS_STOCK_B",
               f"{DISCHARGE} > {STOCK_B}", (DISCHARGE, STOCK_B), over_b),
    ]
    for name, expected in ((ANOMALY_TRANSFER, over_a), (ANOMALY_DISCHARGE, over_b)):
        if f"_given_{name}" in rows.columns:
            given = F.col(f"_given_{name}")
            checks += [
                _Check("error", "audit", f"INVALID_BOOLEAN_FLAG:{name}",
                       f"{name}: neither true nor false", (name,),
                       invalid_boolean(given)),
                _Check("error", "audit", f"INCONSISTENT_FLAG:{name}",
                       f"{name}: unlike the rule computed from the row", (name,),
                       parse_boolean(given) != expected),
            ]
    if config.check_derived:
        load = F.col(STOCK_A) + F.col(STOCK_B)
        expected = {
            TOTAL_LOAD: load,
            NET_INTAKE: F.col(TRANSFER) - F.col(DISCHARGE),
            OFFSET_RATIO: F.try_divide(F.col(DISCHARGE), F.col(TRANSFER) + 1),
            GROWTH: F.col("_x_growth") if "_x_growth" in rows.columns else None,
            ROLL7: F.col("_x_roll7") if "_x_growth" in rows.columns else None,
            ROLL14: F.col("_x_roll14") if "_x_growth" in rows.columns else None,
            STREAK: F.col("_x_streak") if "_x_growth" in rows.columns else None,
        }
        for name, value in expected.items():
            if f"_given_{name}" in rows.columns:
                given = finite(F.col(f"_given_{name}").cast("string").try_cast("double"))
                checks.append(
                    _Check("error", "metric_integrity", f"DERIVED_METRIC_MISMATCH:{name}",
                           f"{name}: unlike the value computed from the counts", (name,),
                           ~_close(given, value, config))
                )
    if config.check_stock_flow:
        a_gap = F.abs(F.col(STOCK_A) - (F.col("_prev_a") + F.col(INTAKE) - F.col(TRANSFER)))
        b_gap = F.abs(F.col(STOCK_B) - (F.col("_prev_b") + F.col(TRANSFER) - F.col(DISCHARGE)))
        for code, gap, columns in (
            ("STOCK_A_FLOW_RESIDUAL", a_gap, (STOCK_A, INTAKE, TRANSFER)),
            ("STOCK_B_FLOW_RESIDUAL", b_gap, (STOCK_B, TRANSFER, DISCHARGE)),
        ):
            checks.append(
                _Check("warning", "reconciliation", code,
                       f"{columns[0]}: off yesterday plus flows by over {config.stock_flow_tolerance:g}", columns,
                       F.coalesce(gap > config.stock_flow_tolerance, F.lit(False)))
            )
    return checks


def _first_examples(rows: DataFrame, keys: list[str], order: Column, text: Column) -> DataFrame:
    """Three first examples per series; the rank limit is applied before the shuffle."""
    return (
        rows.select(*keys, order.alias("_o"), text.alias("_t"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("_o")))
        .where("_rn <= 3")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_t"))).alias("_e"))
        .select(*keys, F.transform("_e", lambda e: e["_t"]).alias("_ex"))
    )


def calendar_facts(days: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Span, gaps, repeats and order of each series from its day counts."""
    keys = list(spec.keys)
    w = spec.ordered()
    nxt = F.lead(spec.date).over(w)
    stepped = days.withColumns({"_next": nxt, "_late": out_of_order(days, spec)})
    gap = F.datediff("_next", spec.date) > 1
    ranked = stepped.withColumn(
        "_gap_rank", F.when(gap, F.count(F.when(gap, 1)).over(spec.running()))
    )
    repeat_rank = F.when(
        F.col("_rows") > 1, F.count(F.when(F.col("_rows") > 1, 1)).over(spec.running())
    )
    first_missing = F.when(
        F.col("_gap_rank") <= 3,
        F.sequence(
            F.date_add(spec.date, 1), F.least(F.date_sub("_next", 1), F.date_add(spec.date, 3))
        ),
    )
    text = lambda dates: F.transform(dates, lambda d: d.cast("string"))
    return (
        ranked.withColumn("_repeat_rank", repeat_rank)
        .groupBy(*keys)
        .agg(
            F.sum("_rows").alias("valid_date_rows"),
            F.min(spec.date).alias("reporting_start"),
            F.max(spec.date).alias("reporting_end"),
            (F.datediff(F.max(spec.date), F.min(spec.date)) + 1).cast("long").alias(
                "expected_daily_rows"
            ),
            (F.datediff(F.max(spec.date), F.min(spec.date)) + 1 - F.count(F.lit(1)))
            .cast("long")
            .alias("missing_calendar_dates"),
            F.bool_or("_late").alias("_unordered"),
            text(
                F.slice(F.array_sort(F.flatten(F.collect_list(first_missing))), 1, 3)
            ).alias("_missing_examples"),
            text(
                F.array_sort(
                    F.collect_list(F.when(F.col("_repeat_rank") <= 3, F.col(spec.date)))
                )
            ).alias("_repeat_examples"),
        )
    )


def audit(
    df: DataFrame, spec: SeriesSpec = SeriesSpec(), config: AuditConfig = AuditConfig()
) -> Audit:
    """Run every applicable check per series.

    The source is read once: its typed rows are written, and every pass reads the columns it
    needs of them. Then lazy: a wide conditional aggregate for the findings, chunked windows
    for what depends on order, and the evidence of every row.
    """
    spark = df.sparkSession
    keys = list(spec.keys)
    structural = schema_findings(df)
    if structural:
        return _structural(spark, structural, spec)
    typed = cut_lineage(_typed(df, spec))
    if typed.isEmpty():
        return _structural(spark, [EMPTY], spec)
    rows = typed.withColumn("_no_date", F.col(spec.date).isNull())
    days = (
        rows.where(~F.col("_no_date") & ~F.col("_blank"))
        .groupBy(*spec.index)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min(SRC_ROW).alias("_first_row"),
            F.max(SRC_ROW).alias("_last_row"),
        )
    )
    repeated = days.where("_rows > 1").select(*spec.index, F.col("_rows").alias("_same_day"))
    rows = rows.join(repeated, list(spec.index), "left")
    if config.outlier_threshold is not None:
        rows = attach(rows, robust_limits(typed, spec), keys)
    ordered_metrics = {f"_given_{c}" for c in (GROWTH, ROLL7, ROLL14, STREAK)}
    if config.check_stock_flow or (
        config.check_derived and ordered_metrics & set(typed.columns)
    ):
        rows = expected_metrics(
            rows, spec, F.col(STOCK_A) + F.col(STOCK_B),
            F.col(TRANSFER) - F.col(DISCHARGE),
        )
    checks = _checks(rows, config)
    flagged = rows.withColumns({f"_f{i}": c.flag for i, c in enumerate(checks)})
    counts = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_rows"),
        *[F.count_if(f"_f{i}").alias(f"_n{i}") for i in range(len(checks))],
        F.count_if(_any_flag(len(checks))).alias("flagged_row_count"),
    )
    facts = calendar_facts(days, spec)
    bad_dates = _first_examples(
        rows.where(F.col("_no_date") & ~F.col("_blank")), keys, F.col(SRC_ROW),
        F.col(f"_source.{DATE}"),
    )
    joined = attach(
        attach(counts, facts, keys), bad_dates.withColumnRenamed("_ex", "_bad_dates"), keys
    )
    findings = joined.select(*keys, F.inline(_finding_array(checks, config)))
    summary = _summary(joined, findings, spec, config)
    codes = F.concat_ws(
        "; ",
        F.array_sort(
            F.array_compact(
                F.array(*[F.when(F.col(f"_f{i}"), F.lit(c.code)) for i, c in enumerate(checks)])
            )
        ),
    )
    evidence = flagged.withColumn("issue_codes", codes).where(F.length("issue_codes") > 0)
    if config.maximum_flagged_rows is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(SRC_ROW))
        evidence = evidence.withColumn("_rank", rank).where(F.col("_rank") <= config.maximum_flagged_rows)
    evidence = evidence.select(*keys, SRC_ROW, "_source.*", "issue_codes")
    return Audit(findings, summary, evidence, spec)


def _any_flag(count: int) -> Column:
    """True when any check fired. An array test: a long OR is costly to push down."""
    return F.exists(F.array(*[F.col(f"_f{i}") for i in range(count)]), lambda hit: hit)


def _finding(severity, category, code, message, affected, columns, examples) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        F.lit(code).alias("code"),
        F.lit(message).alias("message"),
        affected.cast("long").alias("affected_rows"),
        F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("columns"),
        F.coalesce(examples, F.array().cast("array<string>")).alias("examples"),
    )


def _finding_array(checks: list[_Check], config: AuditConfig) -> Column:
    none = F.lit(None).cast("array<string>")
    examples = {"INVALID_DATES": F.col("_bad_dates"), "DUPLICATE_DATES": F.col("_repeat_examples")}
    entries = [
        F.when(
            F.col(f"_n{i}") > 0,
            _finding(c.severity, c.category, c.code, c.message, F.col(f"_n{i}"), c.columns,
                     examples.get(c.code, none)),
        )
        for i, c in enumerate(checks)
    ]
    entries.append(
        F.when(
            F.col("_unordered"),
            _finding("warning", "temporal", "NON_CHRONOLOGICAL_ORDER",
                     "date: source rows run backwards in time", F.lit(0), (), none),
        )
    )
    gaps = "error" if config.require_complete_series else "warning"
    entries.append(
        F.when(
            F.col("missing_calendar_dates") > 0,
            _finding(gaps, "temporal", "MISSING_CALENDAR_DATES",
                     "date: days are missing between the first and the last",
                     F.col("missing_calendar_dates"), (DATE,), F.col("_missing_examples")),
        )
    )
    return F.array_compact(F.array(*entries))


def _summary(joined: DataFrame, findings: DataFrame, spec: SeriesSpec, config: AuditConfig) -> DataFrame:
    keys = list(spec.keys)
    graded = findings.groupBy(*keys).agg(*_grade_aggregates())
    base = joined.select(
        *keys,
        "source_rows",
        F.coalesce("valid_date_rows", F.lit(0)).alias("valid_date_rows"),
        "reporting_start",
        "reporting_end",
        F.coalesce("expected_daily_rows", F.lit(0)).alias("expected_daily_rows"),
        F.coalesce("missing_calendar_dates", F.lit(0)).alias("missing_calendar_dates"),
        "flagged_row_count",
        F.coalesce(
            F.col("flagged_row_count") > F.lit(config.maximum_flagged_rows), F.lit(False)
        ).alias("flagged_rows_truncated"),
    )
    return _graded(attach(base, graded, keys))


def _grade_aggregates() -> list[Column]:
    severity = F.col("severity")
    cost = F.lit(0)
    for name, points in DEDUCTIONS.items():
        cost = cost + F.count_if(severity == name) * points
    return [
        F.count_if(severity.isin("error", "critical")).alias("error_count"),
        F.count_if(severity == "warning").alias("warning_count"),
        F.greatest(F.lit(0).cast("long"), F.lit(100) - cost).alias("quality_score"),
    ]


def _graded(df: DataFrame) -> DataFrame:
    out = df.withColumns(
        {
            "error_count": F.coalesce("error_count", F.lit(0).cast("long")),
            "warning_count": F.coalesce("warning_count", F.lit(0).cast("long")),
            "quality_score": F.coalesce("quality_score", F.lit(100).cast("long")),
        }
    )
    return out.withColumn(
        "status",
        F.when(F.col("error_count") > 0, "Failed")
        .when(F.col("warning_count") > 0, "Passed with warnings")
        .otherwise("Passed"),
    )


def _structural(spark, rows: list[tuple], spec: SeriesSpec) -> Audit:
    findings = spark.createDataFrame(rows, FINDING_TYPE)
    summary = _graded(findings.agg(*_grade_aggregates()))
    evidence = spark.createDataFrame([], f"{SRC_ROW} bigint, issue_codes string")
    return Audit(findings, summary, evidence, spec)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def findings_table(result: Audit) -> DataFrame:
    """Findings in display order, or one informational row when there are none."""
    empty = (
        result.summary.where("error_count = 0 AND warning_count = 0")
        .select(
            *result.spec.keys,
            F.inline(
                F.array(
                    _finding("info", "summary", "OK", "No issues found.", F.lit(0), (),
                             F.lit(None).cast("array<string>"))
                )
            ),
        )
    )
    return result.findings.unionByName(empty).orderBy(
        *result.spec.keys, F.desc(severity_rank(F.col("severity"))), "code"
    )


def findings_by_severity(findings: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Finding and row counts for each of the four severities, zero where none."""
    severity = F.col("severity")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("severity"),
                F.col(f"_c_{name}").alias("findings"),
                F.coalesce(F.col(f"_r_{name}"), F.lit(0)).cast("long").alias("affected_rows"),
            )
            for name in SEVERITIES
        ]
    )
    return (
        findings.groupBy(*spec.keys)
        .agg(
            *[F.count_if(severity == s).alias(f"_c_{s}") for s in SEVERITIES],
            *[F.sum(F.when(severity == s, F.col("affected_rows"))).alias(f"_r_{s}") for s in SEVERITIES],
        )
        .select(*spec.keys, F.inline(rows))
    )


def raise_for_findings(result: Audit, config: AuditConfig = AuditConfig()) -> Audit:
    """Raise on errors, and on warnings too under ``strict_warnings``."""
    worst = result.summary.agg(
        F.sum("error_count").alias("e"), F.sum("warning_count").alias("w")
    ).first()
    if worst.e:
        raise DataQualityError(f"Audit found {worst.e} error finding(s).")
    if config.strict_warnings and worst.w:
        raise DataQualityError(f"Strict audit found {worst.w} warning finding(s).")
    return result


def check_prepared(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Invariants of a prepared table: not empty, dated, unique days, numeric counts."""
    kinds = dict(df.dtypes)
    missing = [c for c in (*spec.index, *COUNTS) if c not in kinds]
    if missing:
        raise CapacityError("Prepared data lacks column(s): " + ", ".join(missing))
    if kinds[spec.date] != "date":
        raise CapacityError(f"{spec.date} must be a date column.")
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    wrong = [c for c in COUNTS if kinds[c] not in numeric and not kinds[c].startswith("decimal")]
    if wrong:
        raise CapacityError("Prepared count columns must be numeric: " + ", ".join(wrong))
    state = (
        df.groupBy(*spec.index)
        .count()
        .agg(F.count(F.lit(1)).alias("days"), F.max("count").alias("most"))
        .first()
    )
    if not state.days:
        raise CapacityError("Prepared data is empty.")
    if state.most > 1:
        raise CapacityError("Prepared data repeats a reporting date.")
    return df
