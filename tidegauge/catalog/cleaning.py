"""Queries over the dirtied fixture: cleaning, repair report and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.fixtures import daily_sql, dirty, dirty_sql, metrics, with_metrics
from tidegauge.catalog.registry import register
from tidegauge.operators import audit as A
from tidegauge.operators import clean as C
from tidegauge.spec import COUNTS, SRC_ROW

BY = "flag"
NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF](inity)?)$"


def fractional(c):
    return f"coalesce(CASE WHEN {c} % 1 < 0 THEN {c} % 1 + 1 ELSE {c} % 1 END > 1e-9, false)"


def plain(c, accounting):
    text = f"trim(replace({c}, ',', ''))"
    if accounting:
        text = rf"regexp_replace({text}, '^\((.*)\)$', '-\1')"
    return f"nullif({text}, '')"


def parsed(c, accounting):
    text = plain(c, accounting)
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') THEN CAST({text} AS DOUBLE) END"


BLANK = " AND ".join(f"coalesce(trim({c}), '') = ''" for c in ("date", *COUNTS))
DATE = "CAST(coalesce(try_strptime(trim(date), '%Y-%m-%d'), try_strptime(trim(date), '%m/%d/%Y')) AS DATE)"


def typed_sql(accounting=True):
    values = ", ".join(f"{parsed(c, accounting)} AS {c}" for c in COUNTS)
    bad = ", ".join(
        f"({plain(c, accounting)} IS NOT NULL AND NOT regexp_matches({plain(c, accounting)}, '{NUMBER}')) AS bad_{c}"
        for c in COUNTS
    )
    return f"SELECT series, src_row, ({BLANK}) AS blank, {DATE} AS date, {values}, {bad} FROM raw"


def prefix(accounting=True):
    """``WITH`` list up to ``days``: one row per series and valid date, last row wins."""
    return f"""WITH daily AS ({daily_sql(BY)}), raw AS ({dirty_sql(BY)}), typed AS ({typed_sql(accounting)}),
    days AS (SELECT series, date, {', '.join(f"arg_max_null({c}, src_row) AS {c}" for c in COUNTS)}, count(*) AS n,
      min(src_row) AS first_row, max(src_row) AS last_row, {', '.join(f"count(*) FILTER (WHERE bad_{c}) AS bad_{c}" for c in COUNTS)}
      FROM typed WHERE date IS NOT NULL AND NOT blank GROUP BY series, date)"""


def interpolated(c):
    return f"""coalesce({c}, (n_{c} - p_{c}) / nullif(date_diff('day', pd_{c}, nd_{c}) * CAST(86400e9 AS DOUBLE), 0)
      * (date_diff('day', pd_{c}, date) * CAST(86400e9 AS DOUBLE)) + p_{c}, p_{c}, n_{c})"""


def filled_either(c):
    return f"coalesce({c}, p_{c}, n_{c})"


def repaired_sql(stock=interpolated, flow=lambda c: f"coalesce({c}, 0)"):
    """``spine``, ``looked`` and ``filled`` relations, still unrounded."""
    looks = ", ".join(
        f"""last_value({c} IGNORE NULLS) OVER b AS p_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN date END IGNORE NULLS) OVER b AS pd_{c},
        first_value({c} IGNORE NULLS) OVER a AS n_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN date END IGNORE NULLS) OVER a AS nd_{c}"""
        for c in COUNTS
    )
    new = {c: stock(c) if c.startswith("stock") else flow(c) for c in COUNTS}
    return f""", spine AS (SELECT s.series, s.date, {', '.join(f'd.{c}' for c in COUNTS)}, d.date IS NULL AS is_imputed_date
      FROM (SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM days GROUP BY series) s
      LEFT JOIN days d ON d.series = s.series AND d.date = s.date),
    looked AS (SELECT *, {looks} FROM spine WINDOW b AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      a AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT series, date, is_imputed_date, {', '.join(f'{x} AS {c}' for c, x in new.items())},
      {', '.join(f'{c} AS was_{c}' for c in COUNTS)} FROM looked)"""


def final_sql(label_values=True, zero=False, clip=False):
    value = {c: f"round_even({f'coalesce({c}, 0)' if zero else c}, 0)" for c in COUNTS}
    shown = {c: f"greatest({v}, 0)" if clip else v for c, v in value.items()}
    changed = " + ".join(f"CAST(was_{c} IS NULL AND {c} IS NOT NULL AS INTEGER)" for c in COUNTS)
    negative = " OR ".join(f"coalesce({v} < 0, false)" for v in value.values())
    labels = ["CASE WHEN is_imputed_date THEN 'Imputed date' END"]
    if label_values:
        labels.append("CASE WHEN has_imputed_values THEN 'Imputed values' END")
    labels += [
        "CASE WHEN anomaly_transfer THEN 'Transfer > stock A' END",
        "CASE WHEN anomaly_discharge THEN 'Discharge > stock B' END",
        "CASE WHEN anomaly_negative THEN 'Negative count' END",
    ]
    return f"""SELECT *, anomaly_transfer OR anomaly_discharge OR anomaly_negative AS anomaly_any,
      coalesce(nullif(concat_ws('; ', {', '.join(labels)}), ''), 'OK') AS quality_flag FROM (
      SELECT *, coalesce(transfer > stock_a, false) AS anomaly_transfer, coalesce(discharge > stock_b, false) AS anomaly_discharge FROM (
        SELECT series, date, {', '.join(f'CAST({v} AS BIGINT) AS {c}' for c, v in shown.items())}, is_imputed_date,
          CAST({changed} AS SMALLINT) AS imputed_value_count, ({changed}) > 0 AS has_imputed_values, ({negative}) AS anomaly_negative FROM filled))"""


def _clean(policy):
    def build(spark, sf):
        raw, spec = dirty(spark, sf, BY)
        return C.clean(raw, spec, policy).data

    return build


register("q05_clean_default", prefix() + repaired_sql() + final_sql())(_clean(C.CleanPolicy()))
register(
    "q05_clean_conservative", prefix(False) + repaired_sql() + final_sql(False, True)
)(_clean(C.CONSERVATIVE))
register(
    "win08_clean_forward_fill_clip",
    prefix() + repaired_sql(filled_either, filled_either) + final_sql(clip=True),
)(_clean(C.CleanPolicy(stocks="forward_fill", flows="forward_fill", clip_negatives=True)))
register(
    "win09_clean_zero_and_none",
    prefix() + repaired_sql(lambda c: f"coalesce({c}, 0)", lambda c: c) + final_sql(),
)(_clean(C.CleanPolicy(stocks="zero", flows="none")))
register(
    "win07_clean_interpolate_flows", prefix() + repaired_sql(interpolated, interpolated) + final_sql()
)(_clean(C.CleanPolicy(flows="interpolate")))


@register(
    "win06_keep_last_per_day",
    prefix() + f" SELECT series, date, {', '.join(COUNTS)} FROM days", COUNTS,
)
def _(spark, sf):
    raw, spec = dirty(spark, sf, BY)
    rows = C.typed_rows(raw, spec).where("date is not null and not _blank")
    return C.keep_one_per_day(rows, spec)


@register(
    "win06_keep_first_per_day",
    prefix() + f""" SELECT series, date, {', '.join(COUNTS)} FROM (
      SELECT *, row_number() OVER (PARTITION BY series, date ORDER BY src_row) AS k FROM typed WHERE date IS NOT NULL AND NOT blank) WHERE k = 1""",
    COUNTS,
)
def _(spark, sf):
    raw, spec = dirty(spark, sf, BY)
    rows = C.typed_rows(raw, spec).where("date is not null and not _blank")
    return C.keep_one_per_day(rows, spec, keep="first")


@register(
    "prj04_typed_rows",
    prefix() + f""" SELECT series, src_row, blank, date, {', '.join(COUNTS)}, {', '.join(f'coalesce(bad_{c}, false) AS bad_{c}' for c in COUNTS)} FROM typed""",
    COUNTS,
)
def _(spark, sf):
    raw, spec = dirty(spark, sf, BY)
    typed = C.typed_rows(raw, spec)
    return typed.select(
        "series", SRC_ROW, F.col("_blank").alias("blank"), "date", *COUNTS,
        *[F.coalesce(F.col(f"_bad_{c}"), F.lit(False)).alias(f"bad_{c}") for c in COUNTS],
    )


REPORT = prefix() + repaired_sql() + f""", fin AS ({final_sql()}),
  frac AS (SELECT series, CAST(sum({' + '.join(f"CAST({fractional(c)} AS INTEGER)" for c in COUNTS)}) AS BIGINT) AS fractional_values,
    CAST(sum({' + '.join(f"CAST(was_{c} IS NULL AND NOT is_imputed_date AS INTEGER)" for c in COUNTS)}) AS BIGINT) AS missing_reported_values,
    CAST(sum({' + '.join(f"CAST(coalesce(round_even({c}, 0) < 0, false) AS INTEGER)" for c in COUNTS)}) AS BIGINT) AS negative_values_found FROM filled GROUP BY series),
  src AS (SELECT series, count(*) AS source_rows, count(*) FILTER (WHERE blank) AS empty_rows_removed,
    count(*) FILTER (WHERE date IS NULL AND NOT blank) AS invalid_date_rows_removed FROM typed GROUP BY series),
  dup AS (SELECT series, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows_removed, {', '.join(f'CAST(sum(bad_{c}) AS BIGINT) AS invalid_{c}' for c in COUNTS)} FROM days GROUP BY series),
  ord AS (SELECT series, bool_or(coalesce(date < before, false)) AS chronology_repaired FROM (
    SELECT series, date, lag(date) OVER (PARTITION BY series ORDER BY src_row) AS before FROM typed WHERE date IS NOT NULL AND NOT blank) GROUP BY series),
  res AS (SELECT series, count(*) AS output_rows, min(date) AS reporting_start, max(date) AS reporting_end,
    count(*) FILTER (WHERE is_imputed_date) AS missing_dates_inserted, CAST(sum(imputed_value_count) AS BIGINT) AS numeric_values_imputed,
    count(*) FILTER (WHERE has_imputed_values) AS rows_with_imputed_values,
    count(*) FILTER (WHERE anomaly_negative) AS negative_rows, count(*) FILTER (WHERE anomaly_transfer) AS transfer_anomalies,
    count(*) FILTER (WHERE anomaly_discharge) AS discharge_anomalies,
    count(*) FILTER (WHERE anomaly_transfer OR anomaly_discharge) AS logical_anomaly_rows FROM fin GROUP BY series)"""


@register(
    "agg28_repair_report",
    REPORT + """ SELECT *, CAST(0 AS BIGINT) AS unresolved_values FROM src JOIN dup USING (series) JOIN ord USING (series) JOIN res USING (series) JOIN frac USING (series)""",
)
def _(spark, sf):
    raw, spec = dirty(spark, sf, BY)
    return C.clean(raw, spec).report


@register(
    "agg28_repair_issues",
    REPORT + """, x AS (SELECT * FROM src JOIN dup USING (series) JOIN ord USING (series) JOIN res USING (series) JOIN frac USING (series))
    SELECT * FROM (""" + " UNION ALL ".join(
        f"""SELECT series, '{sev}' AS severity, '{code}' AS code, {f"'{col}'" if col else 'CAST(NULL AS VARCHAR)'} AS "column", CAST({field} AS BIGINT) AS affected_rows FROM x"""
        for sev, code, col, field in [
            ("warning", "EMPTY_ROWS_REMOVED", None, "empty_rows_removed"),
            ("error", "INVALID_DATES_REMOVED", "date", "invalid_date_rows_removed"),
            ("warning", "CHRONOLOGY_SORTED", None, "chronology_repaired"),
            *[("error", "INVALID_NUMERIC_VALUES", c, f"invalid_{c}") for c in COUNTS],
            ("error", "DUPLICATE_DATES_RESOLVED", "date", "duplicate_rows_removed"),
            ("warning", "MISSING_DATES_INSERTED", None, "missing_dates_inserted"),
            ("warning", "NUMERIC_VALUES_IMPUTED", None, "rows_with_imputed_values"),
            ("warning", "FRACTIONAL_COUNTS", None, "fractional_values"),
            ("error", "NEGATIVE_COUNTS", None, "negative_rows"),
            ("error", "TRANSFER_EXCEEDS_STOCK_A", "transfer", "transfer_anomalies"),
            ("error", "DISCHARGE_EXCEEDS_STOCK_B", "discharge", "discharge_anomalies"),
        ]
    ) + ") WHERE affected_rows > 0",
)
def _(spark, sf):
    raw, spec = dirty(spark, sf, BY)
    return C.clean(raw, spec).issues


# ---- audit ----------------------------------------------------------------------
def checks_sql():
    """(severity, category, code, flag) of every row check on the raw rows ``r``."""
    out = [
        ("warning", "completeness", "EMPTY_ROWS", "blank"),
        ("error", "temporal", "INVALID_DATES", "date IS NULL AND NOT blank"),
        ("error", "temporal", "DUPLICATE_DATES", "coalesce(same_day > 1, false)"),
    ]
    for c in COUNTS:
        out += [
            ("error", "numeric", f"INVALID_NUMERIC_VALUES:{c}", f"coalesce(bad_{c}, false) AND NOT blank"),
            ("error", "numeric", f"MISSING_NUMERIC_VALUES:{c}", f"{c} IS NULL AND NOT coalesce(bad_{c}, false) AND NOT blank"),
            ("error", "numeric", f"NONFINITE_VALUES:{c}", f"coalesce(isinf({c}), false)"),
            ("error", "numeric", f"FRACTIONAL_COUNTS:{c}", fractional(c)),
            ("error", "numeric", f"NEGATIVE_COUNTS:{c}", f"coalesce({c} < 0, false)"),
            ("warning", "plausibility", f"ROBUST_OUTLIERS:{c}",
             f"coalesce(fin_{c} >= 10 AND mad_{c} > 0 AND 0.6745 * abs({c} - med_{c}) / nullif(mad_{c}, 0) > 8, false)"),
        ]
    out += [
        ("error", "logical", "TRANSFER_EXCEEDS_STOCK_A", "coalesce(transfer > stock_a, false)"),
        ("error", "logical", "DISCHARGE_EXCEEDS_STOCK_B", "coalesce(discharge > stock_b, false)"),
    ]
    return out


AUDIT = prefix() + f""", med AS (SELECT series, {', '.join(f'median({c}) AS med_{c}, count({c}) AS fin_{c}' for c in COUNTS)} FROM typed GROUP BY series),
  mad AS (SELECT typed.series, {', '.join(f'median(abs({c} - med_{c})) AS mad_{c}' for c in COUNTS)} FROM typed JOIN med USING (series) GROUP BY 1),
  r AS (SELECT typed.*, n AS same_day, {', '.join(f'med_{c}, fin_{c}, mad_{c}' for c in COUNTS)} FROM typed JOIN med USING (series) JOIN mad USING (series)
    LEFT JOIN (SELECT series, date, n FROM days WHERE n > 1) d ON d.series = typed.series AND d.date = typed.date),
  cal AS (SELECT series, date_diff('day', min(date), max(date)) + 1 - count(*) AS gaps, CAST(sum(n) AS BIGINT) AS valid_rows, min(date) AS s, max(date) AS e FROM days GROUP BY series),
  ord AS (SELECT series, bool_or(coalesce(date < before, false)) AS unordered FROM (
    SELECT series, date, lag(date) OVER (PARTITION BY series ORDER BY src_row) AS before FROM typed WHERE date IS NOT NULL AND NOT blank) GROUP BY series),
  found AS (SELECT * FROM (
    {' UNION ALL '.join(f"SELECT series, '{s}' AS severity, '{g}' AS category, '{code}' AS code, count(*) FILTER (WHERE {flag}) AS affected_rows FROM r GROUP BY series" for s, g, code, flag in checks_sql())}
    UNION ALL SELECT series, 'error', 'temporal', 'MISSING_CALENDAR_DATES', gaps FROM cal) WHERE affected_rows > 0
    UNION ALL SELECT series, 'warning', 'temporal', 'NON_CHRONOLOGICAL_ORDER', 0 FROM ord WHERE unordered)"""


def _audited(spark, sf):
    raw, spec = dirty(spark, sf, BY)
    return A.audit(raw, spec)


@register("q06_audit_findings", AUDIT + " SELECT series, severity, category, code, affected_rows FROM found")
def _(spark, sf):
    return _audited(spark, sf).findings.select("series", "severity", "category", "code", "affected_rows")


@register(
    "aud09_audit_summary",
    AUDIT + """ SELECT g.series, source_rows, valid_rows AS valid_date_rows, s AS reporting_start, e AS reporting_end,
    CAST(date_diff('day', s, e) + 1 AS BIGINT) AS expected_daily_rows, CAST(gaps AS BIGINT) AS missing_calendar_dates, error_count, warning_count,
    greatest(0, 100 - 12 * error_count - 4 * warning_count) AS quality_score, 'Failed' AS status FROM
    (SELECT series, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count FROM found GROUP BY series) g
    JOIN (SELECT series, count(*) AS source_rows FROM typed GROUP BY series) t USING (series) JOIN cal USING (series)""",
)
def _(spark, sf):
    return _audited(spark, sf).summary.drop("flagged_row_count", "flagged_rows_truncated")


@register(
    "aud10_row_evidence",
    AUDIT + " SELECT series, src_row, string_agg(code, '; ' ORDER BY code) AS issue_codes FROM ("
    + " UNION ALL ".join(
        f"SELECT series, src_row, '{code}' AS code FROM r WHERE {flag}" for _, _, code, flag in checks_sql()
    )
    + ") GROUP BY 1, 2",
)
def _(spark, sf):
    return _audited(spark, sf).evidence.select("series", SRC_ROW, "issue_codes")


@register(
    "agg30_findings_by_severity",
    AUDIT + """ SELECT k.series, sev AS severity, count(found.code) AS findings, CAST(coalesce(sum(affected_rows), 0) AS BIGINT) AS affected_rows
    FROM (SELECT DISTINCT series FROM typed) k CROSS JOIN (VALUES ('info'), ('warning'), ('error'), ('critical')) t(sev)
    LEFT JOIN found ON found.series = k.series AND found.severity = sev GROUP BY 1, 2""",
)
def _(spark, sf):
    found = _audited(spark, sf)
    return A.findings_by_severity(found.findings, found.spec)


@register(
    "aud07_enriched_table_findings",
    with_metrics("nation") + """, b AS (SELECT *, lag(stock_a) OVER w AS pa, lag(stock_b) OVER w AS pb,
      (day(date) = 5) AS x1, (day(date) = 6) AS x2, (day(date) = 7) AS x3 FROM m WINDOW w AS (PARTITION BY series ORDER BY date))
    SELECT * FROM (
      SELECT series, 'error' AS severity, 'TRANSFER_EXCEEDS_STOCK_A' AS code, count(*) FILTER (WHERE anomaly_transfer) AS affected_rows FROM b GROUP BY 1
      UNION ALL SELECT series, 'error', 'DISCHARGE_EXCEEDS_STOCK_B', count(*) FILTER (WHERE anomaly_discharge) FROM b GROUP BY 1
      UNION ALL SELECT series, 'error', 'INCONSISTENT_FLAG:anomaly_transfer', count(*) FILTER (WHERE x3) FROM b GROUP BY 1
      UNION ALL SELECT series, 'error', 'DERIVED_METRIC_MISMATCH:roll7', count(*) FILTER (WHERE x1) FROM b GROUP BY 1
      UNION ALL SELECT series, 'error', 'DERIVED_METRIC_MISMATCH:streak', count(*) FILTER (WHERE x2) FROM b GROUP BY 1
      UNION ALL SELECT series, 'warning', 'STOCK_A_FLOW_RESIDUAL', count(*) FILTER (WHERE abs(stock_a - (pa + intake - transfer)) > 1) FROM b GROUP BY 1
      UNION ALL SELECT series, 'warning', 'STOCK_B_FLOW_RESIDUAL', count(*) FILTER (WHERE abs(stock_b - (pb + transfer - discharge)) > 1) FROM b GROUP BY 1
    ) WHERE affected_rows > 0""",
)
def _(spark, sf):
    df, spec = metrics(spark, sf, "nation")
    day = F.dayofmonth("date")
    spoiled = df.withColumns(
        {
            "roll7": F.when(day == 5, F.col("roll7") + 1).otherwise(F.col("roll7")),
            "streak": F.when(day == 6, F.col("streak") + 1).otherwise(F.col("streak")),
            "anomaly_transfer": F.when(day == 7, ~F.col("anomaly_transfer")).otherwise(
                F.col("anomaly_transfer")
            ),
        }
    )
    found = A.audit(spoiled, spec, A.AuditConfig(check_stock_flow=True, outlier_threshold=None))
    return found.findings.select("series", "severity", "code", "affected_rows")
