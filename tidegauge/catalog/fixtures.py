"""Daily and dirtied fixtures from the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.clean import flag_anomalies
from tidegauge.operators.metrics import daily_metrics
from tidegauge.sources.rollup import lineitem_daily, lineitem_days
from tidegauge.spec import COUNTS, IMPUTED_DATE, SRC_ROW, SeriesSpec
from tidegauge.operators.clean import calendar_tasks, densify, fill

_KEY_SQL = {"flag": "l_returnflag", "supplier": "l_suppkey", "nation": "CAST(s_nationkey AS BIGINT)"}


def daily_sql(by: str | None) -> str:
    """Body of the ``daily`` relation."""
    key = f"{_KEY_SQL[by]} AS series, " if by else ""
    source = "lineitem JOIN supplier ON l_suppkey = s_suppkey" if by == "nation" else "lineitem"
    return f"""
SELECT {key}CAST(l_shipdate AS DATE) AS date,
       count(*) AS intake,
       count(*) FILTER (WHERE l_discount <= 0.06) AS stock_a,
       count(*) FILTER (WHERE l_linestatus = 'F') AS transfer,
       CAST(sum(l_quantity) AS BIGINT) AS stock_b,
       count(*) FILTER (WHERE l_quantity <= 25) AS discharge
FROM {source} GROUP BY {'1, 2' if by else '1'}"""


def part(by: str | None) -> str:
    """``PARTITION BY`` clause of the series key."""
    return "PARTITION BY series" if by else ""


def key(by: str | None, prefix: str = "") -> str:
    return f"{prefix}series, " if by else ""


def dense_sql(by: str | None) -> str:
    """Body of ``dense`` over ``daily``: every calendar day, stocks interpolated, flows 0."""
    k = key(by)
    on = "d.date = s.date" + (" AND d.series = s.series" if by else "")
    group = " GROUP BY series" if by else ""

    def interpolated(c: str) -> str:
        return f"""CAST(round_even(coalesce({c},
            (n_{c} - p_{c}) / nullif(date_diff('day', pd_{c}, nd_{c}) * CAST(86400e9 AS DOUBLE), 0)
                    * (date_diff('day', pd_{c}, date) * CAST(86400e9 AS DOUBLE)) + p_{c},
            p_{c}, n_{c}), 0) AS BIGINT) AS {c}"""

    looks = ", ".join(
        f"""last_value({c} IGNORE NULLS) OVER b AS p_{c},
        last_value(CASE WHEN {c} IS NOT NULL THEN date END IGNORE NULLS) OVER b AS pd_{c},
        first_value({c} IGNORE NULLS) OVER a AS n_{c},
        first_value(CASE WHEN {c} IS NOT NULL THEN date END IGNORE NULLS) OVER a AS nd_{c}"""
        for c in ("stock_a", "stock_b")
    )
    return f"""
SELECT {k}date, coalesce(intake, 0) AS intake, {interpolated('stock_a')},
       coalesce(transfer, 0) AS transfer, {interpolated('stock_b')},
       coalesce(discharge, 0) AS discharge, is_imputed_date
FROM (SELECT *, {looks} FROM (
        SELECT {key(by, 's.')}s.date, d.intake, d.stock_a, d.transfer, d.stock_b, d.discharge,
               d.date IS NULL AS is_imputed_date
        FROM (SELECT {k}CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE)
                     AS date FROM daily{group}) s
        LEFT JOIN daily d ON {on})
      WINDOW b AS ({part(by)} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS ({part(by)} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def metrics_sql(by: str | None, source: str = "dense") -> str:
    """Body of ``m``: the seven derived metrics over ``source``."""
    p = part(by)
    return f"""
SELECT * EXCLUDE (rn, nonpos), CAST(rn - coalesce(max(nonpos) OVER ({p} ORDER BY date), 0) AS INTEGER) AS streak
FROM (SELECT *, CASE WHEN net_intake > 0 THEN NULL ELSE rn END AS nonpos FROM (
  SELECT *, row_number() OVER w AS rn,
         100.0 * (total_load - lag(total_load) OVER w) / nullif(CAST(lag(total_load) OVER w AS DOUBLE), 0) AS growth_pct,
         avg(total_load) OVER ({p} ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll7,
         avg(total_load) OVER ({p} ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS roll14
  FROM (SELECT *, stock_a + stock_b AS total_load, transfer - discharge AS net_intake,
               discharge / CAST(transfer + 1 AS DOUBLE) AS offset_ratio,
               transfer > stock_a AS anomaly_transfer, discharge > stock_b AS anomaly_discharge,
               (intake < 0 OR stock_a < 0 OR transfer < 0 OR stock_b < 0 OR discharge < 0) AS anomaly_negative
        FROM {source})
  WINDOW w AS ({p} ORDER BY date)))"""


def with_metrics(by: str | None) -> str:
    """``WITH`` prefix that defines daily, dense and m."""
    return f"WITH daily AS ({daily_sql(by)}), dense AS ({dense_sql(by)}), m AS ({metrics_sql(by)})"


def dense_daily(spark: SparkSession, sf_dir: str, by: str | None = None) -> tuple[DataFrame, SeriesSpec]:
    """Daily fixture with the calendar filled: stocks interpolated, flows zero."""
    days, spec = lineitem_daily(spark, sf_dir, by)
    # only a panel by supplier grows with the data; the others have few series of one calendar
    tasks = calendar_tasks(lineitem_days(spark, sf_dir, by), spec) if by == "supplier" else None
    dense = densify(days, spec, tasks=tasks)
    dense = dense.withColumns(
        {c: F.rint(fill(c, spec, "interpolate")).cast("long") for c in ("stock_a", "stock_b")}
        | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("intake", "transfer", "discharge")}
    )
    return dense.select(*spec.index, *COUNTS, IMPUTED_DATE), spec


def metrics(spark: SparkSession, sf_dir: str, by: str | None = None) -> tuple[DataFrame, SeriesSpec]:
    """Dense daily fixture with flags and derived metrics."""
    dense, spec = dense_daily(spark, sf_dir, by)
    flagged = flag_anomalies(dense).drop("anomaly_any")
    return daily_metrics(flagged, spec, trusted=True), spec


def dirty(spark: SparkSession, sf_dir: str, by: str | None = None) -> tuple[DataFrame, SeriesSpec]:
    """Daily fixture turned back into messy text rows, newest first in source order."""
    days, spec = lineitem_daily(spark, sf_dir, by)
    day = F.dayofmonth("date")
    base = F.datediff(F.lit("2002-01-01").cast("date"), F.col("date")) * 4
    january = F.month("date") == 1
    variants = F.flatten(
        F.array(
            F.when(day % 9 != 4, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
            F.when(day == 2, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
            F.when(january & (day == 1), F.array(F.lit(2))).otherwise(F.array().cast("array<int>")),
            F.when(january & (day == 3), F.array(F.lit(3))).otherwise(F.array().cast("array<int>")),
        )
    )
    rows = days.withColumn("_v", F.explode(variants))
    filled = F.col("_v") < 2
    return (
        rows.select(
            *spec.keys,
            (base + F.col("_v")).cast("long").alias(SRC_ROW),
            F.when(F.col("_v") == 3, F.lit("not a date"))
            .when(F.col("_v") == 2, F.lit("  "))
            .when(day == 17, F.date_format("date", "MM/dd/yyyy"))
            .otherwise(F.date_format("date", "yyyy-MM-dd"))
            .alias("date"),
            F.when(filled, F.format_number(F.col("intake") * 1000 + F.col("_v"), 0)).alias("intake"),
            F.when(filled, F.col("stock_a").cast("string")).alias("stock_a"),
            F.when(filled, F.when(day == 23, "n/a").otherwise(F.col("transfer").cast("string")))
            .alias("transfer"),
            F.when(filled & (day != 11), F.col("stock_b").cast("string")).alias("stock_b"),
            F.when(
                filled,
                F.when(day == 29, F.concat(F.lit("("), F.col("discharge").cast("string"), F.lit(")")))
                .otherwise(F.col("discharge").cast("string")),
            ).alias("discharge"),
        ),
        spec,
    )


def dirty_sql(by: str | None) -> str:
    """Body of ``raw`` over ``daily``: the same messy rows as :func:`dirty`."""
    return f"""
SELECT {key(by)}CAST(date_diff('day', date, DATE '2002-01-01') * 4 + v AS BIGINT) AS src_row,
       CASE WHEN v = 3 THEN 'not a date' WHEN v = 2 THEN '  '
            WHEN day(date) = 17 THEN strftime(date, '%m/%d/%Y')
            ELSE strftime(date, '%Y-%m-%d') END AS date,
       CASE WHEN v < 2 THEN format('{{:,}}', intake * 1000 + v) END AS intake,
       CASE WHEN v < 2 THEN CAST(stock_a AS VARCHAR) END AS stock_a,
       CASE WHEN v < 2 THEN CASE WHEN day(date) = 23 THEN 'n/a' ELSE CAST(transfer AS VARCHAR) END END AS transfer,
       CASE WHEN v < 2 AND day(date) <> 11 THEN CAST(stock_b AS VARCHAR) END AS stock_b,
       CASE WHEN v < 2 THEN CASE WHEN day(date) = 29 THEN '(' || discharge || ')' ELSE CAST(discharge AS VARCHAR) END END AS discharge
FROM daily, (VALUES (0), (1), (2), (3)) AS t(v)
WHERE (v = 0 AND day(date) % 9 <> 4) OR (v = 1 AND day(date) = 2)
   OR (v = 2 AND month(date) = 1 AND day(date) = 1) OR (v = 3 AND month(date) = 1 AND day(date) = 3)"""
