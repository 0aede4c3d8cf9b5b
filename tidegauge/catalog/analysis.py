"""Queries over roll-ups, daily metrics, episodes, resampling, KPIs, scenarios and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.fixtures import (
    daily_sql,
    dense_daily,
    dense_sql,
    metrics,
    metrics_sql,
    part,
    with_metrics,
)
from tidegauge.catalog.registry import register
from tidegauge.operators import compare as C
from tidegauge.operators import episodes as E
from tidegauge.operators import kpis as K
from tidegauge.operators import metrics as D
from tidegauge.operators import scenario as S
from tidegauge.operators import trends as T
from tidegauge.operators.clean import missing_days
from tidegauge.operators.resample import annual_pressure, monthly_profile, resample
from tidegauge.plans import analysis as A
from tidegauge.sources.rollup import lineitem_daily
from tidegauge.spec import SeriesSpec

FLAG, NATION, SUPPLIER = "flag", "nation", "supplier"
M_DOUBLES = ("growth_pct", "roll7", "roll14", "offset_ratio")
W = "PARTITION BY series ORDER BY date"


def m(by, body, tail=""):
    return f"{with_metrics(by)}{tail} {body}"


for _by in (None, NATION, SUPPLIER):

    @register(f"src_daily_rollup_{_by or 'single'}", daily_sql(_by))
    def _(spark, sf, by=_by):
        return lineitem_daily(spark, sf, by)[0]


@register(
    "slice_longest_run_and_latest_load",
    f"""WITH d AS ({daily_sql(None)}),
     x AS (SELECT *, row_number() OVER (ORDER BY date) AS rn, CASE WHEN transfer > discharge THEN 1 ELSE 0 END AS pos FROM d),
     r AS (SELECT *, rn - row_number() OVER (PARTITION BY pos ORDER BY date) AS isl FROM x),
     e AS (SELECT isl, count(*) AS days FROM r WHERE pos = 1 GROUP BY isl)
SELECT (SELECT max(days) FROM e) AS longest_run, max_by(stock_a + stock_b, date) AS latest_load FROM d""",
)
def longest_run(spark, sf):
    days, spec = lineitem_daily(spark, sf)
    daily = D.daily_metrics(days, spec, trusted=True)
    return daily.agg(
        F.max("streak").cast("long").alias("longest_run"),
        F.max_by("total_load", "date").alias("latest_load"),
    )


@register("jn01_densify_nation", f"WITH daily AS ({daily_sql(NATION)}) {dense_sql(NATION)}")
def _(spark, sf):
    return dense_daily(spark, sf, NATION)[0]


@register(
    "jn02_missing_days_supplier",
    f"""WITH daily AS ({daily_sql(SUPPLIER)})
SELECT s.series, s.date FROM (SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM daily GROUP BY series) s ANTI JOIN daily d ON d.series = s.series AND d.date = s.date""",
)
def _(spark, sf):
    days, spec = lineitem_daily(spark, sf, SUPPLIER)
    return missing_days(days, spec)


for _by in (None, NATION, SUPPLIER):

    @register(f"win01_daily_metrics_{_by or 'single'}", m(_by, "SELECT * FROM m"), M_DOUBLES)
    def _(spark, sf, by=_by):
        return metrics(spark, sf, by)[0]


def _on(by=FLAG):
    """Decorator: hand the metrics panel and its spec to the builder."""

    def wrap(build):
        return lambda spark, sf: build(*metrics(spark, sf, by))

    return wrap


def query(name, body, doubles=(), by=FLAG, tail=""):
    def wrap(build):
        register(name, m(by, body, tail), doubles)(_on(by)(build))
        return build

    return wrap


# ---- resampling -----------------------------------------------------------------
def last(c):
    return f"max_by({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}"


def total(c):
    return f"CAST(sum({c}) AS BIGINT) AS {c}"


PERIOD = {
    "weekly": "CAST(date_trunc('week', date) AS DATE) + 6",
    "monthly": "last_day(date)",
}
_FULL_LAST = ("stock_a", "stock_b", "roll7", "roll14", "streak")
_FLOW = ("intake", "transfer", "discharge")


def resampled(level, lasts, totals, flags=()):
    parts = [last(c) for c in lasts] + [total(c) for c in totals] + [f"bool_or({c}) AS {c}" for c in flags]
    return f"SELECT series, {PERIOD[level]} AS period, {', '.join(parts)} FROM m GROUP BY 1, 2"


for _level in ("weekly", "monthly"):
    _inner = resampled(_level, _FULL_LAST, _FLOW, ("anomaly_transfer", "anomaly_discharge", "is_imputed_date"))

    @query(
        f"agg01_resample_{_level}",
        f"""SELECT * EXCLUDE (period), period AS date,
        100.0 * (total_load - lag(total_load) OVER (PARTITION BY series ORDER BY period))
          / nullif(CAST(lag(total_load) OVER (PARTITION BY series ORDER BY period) AS DOUBLE), 0) AS growth_pct,
        discharge / CAST(transfer + 1 AS DOUBLE) AS offset_ratio
        FROM (SELECT *, stock_a + stock_b AS total_load, transfer - discharge AS net_intake FROM ({_inner}))""",
        M_DOUBLES, NATION,
    )
    def _(df, spec, level=_level):
        return resample(df, spec, level)


@query(
    "agg02_overview_monthly",
    f"""SELECT * EXCLUDE (period), period AS date, discharge / CAST(transfer + 1 AS DOUBLE) AS offset_ratio FROM (
    {resampled('monthly', ('stock_a', 'stock_b', 'total_load', 'roll7', 'roll14', 'growth_pct', 'streak'), (*_FLOW, 'net_intake'))})""",
    M_DOUBLES,
)
def _(df, spec):
    return resample(df, spec, "monthly", "overview")


@query(
    "agg02_trends_weekly",
    f"""SELECT * EXCLUDE (period), period AS date,
        100.0 * (total_load - lag(total_load) OVER (PARTITION BY series ORDER BY period))
          / nullif(CAST(lag(total_load) OVER (PARTITION BY series ORDER BY period) AS DOUBLE), 0) AS growth_pct
    FROM ({resampled('weekly', ('stock_a', 'stock_b', 'total_load', 'roll7', 'roll14', 'custom_trend'), (*_FLOW, 'net_intake')).replace('FROM m', 'FROM t')})""",
    ("roll7", "roll14", "custom_trend", "growth_pct"),
    tail=f", t AS (SELECT *, avg(total_load) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS custom_trend FROM m)",
)
def _(df, spec):
    return resample(D.rolling_load(df, spec, 21), spec, "weekly", "trends")


@query(
    "agg02_insights_monthly",
    f"""SELECT * EXCLUDE (period), period AS date FROM (
    {resampled('monthly', ('stock_a', 'stock_b', 'total_load', 'roll7', 'roll14', 'growth_pct'), (*_FLOW, 'net_intake'))})""",
    ("roll7", "roll14", "growth_pct"),
)
def _(df, spec):
    return resample(df, spec, "monthly", "insights")


@query(
    "agg02_backlog_weekly",
    f"""SELECT * EXCLUDE (period), period AS date FROM (
    {resampled('weekly', ('total_load', 'stock_a', 'stock_b', 'streak'), ('transfer', 'discharge', 'net_intake'))})""",
)
def _(df, spec):
    return resample(df, spec, "weekly", "backlog")


VOL = f"""CASE WHEN count(growth_pct) OVER v >= 2 THEN stddev_pop(growth_pct) OVER v END AS rolling_volatility"""
VOL_TAIL = f", v AS (SELECT *, {VOL} FROM m WINDOW v AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"


@query(
    "agg02_kpis_weekly",
    f"""SELECT * EXCLUDE (period), period AS date, discharge / CAST(transfer + 1 AS DOUBLE) AS offset_ratio FROM (
    {resampled('weekly', ('stock_a', 'stock_b', 'total_load', 'growth_pct', 'roll7', 'roll14', 'streak', 'rolling_volatility'), ('transfer', 'discharge', 'net_intake')).replace('FROM m', 'FROM v')})""",
    (*M_DOUBLES, "rolling_volatility"), tail=VOL_TAIL,
)
def _(df, spec):
    return resample(D.rolling_volatility(df, spec), spec, "weekly", "kpis")


@query(
    "agg22_monthly_profile",
    f"""SELECT series, last_day(date) AS date, avg(total_load) AS load_mean, max(total_load) AS load_max,
    max_by(total_load, date) AS load_last, {total('intake')}, {total('transfer')}, {total('discharge')}, {total('net_intake')}
    FROM m GROUP BY 1, 2""",
    ("load_mean",), NATION,
)
def _(df, spec):
    return monthly_profile(df, spec)


@query(
    "agg21_annual_pressure",
    """SELECT series, CAST(year(date) AS INTEGER) AS year, CAST(sum(net_intake) AS BIGINT) AS net_total, avg(net_intake) AS net_mean,
    count(*) FILTER (WHERE net_intake > 0) AS positive_days, max(net_intake) AS net_peak FROM m GROUP BY 1, 2""",
    ("net_mean",), NATION,
)
def _(df, spec):
    return annual_pressure(df, spec)


# ---- headline figures and episodes ----------------------------------------------
HEAD = """SELECT series, max_by(total_load, date) AS total_load, max_by(net_intake, date) AS net_intake_pressure,
    coalesce(stddev_pop(growth_pct), 0) AS load_volatility_index, CAST(max(streak) AS BIGINT) AS backlog_accumulation_rate,
    max_by(discharge, date) / CAST(max_by(transfer, date) + 1 AS DOUBLE) AS discharge_offset_ratio FROM m GROUP BY series"""


@query("agg03_headline", HEAD, ("load_volatility_index", "discharge_offset_ratio"), SUPPLIER)
def _(df, spec):
    return K.headline(df, spec)


SUMMARY = """SELECT series, min(date) AS period_start, max(date) AS period_end, count(*) AS daily_observations,
    max_by(total_load, date) AS latest_system_load, avg(total_load) AS average_system_load, max(total_load) AS peak_system_load,
    arg_min(date, (-total_load, date)) AS peak_system_load_date, max_by(net_intake, date) AS latest_net_intake,
    CAST(sum(net_intake) AS BIGINT) AS cumulative_net_intake, count(*) FILTER (WHERE net_intake > 0) AS positive_pressure_days,
    coalesce(stddev_pop(growth_pct), 0) AS load_volatility_index, CAST(max(streak) AS BIGINT) AS longest_backlog_streak,
    CAST(max_by(streak, date) AS BIGINT) AS current_backlog_streak, CAST(3 AS BIGINT) AS backlog_threshold_days,
    count(*) FILTER (WHERE streak = 3) AS elevated_backlog_episodes, max_by(offset_ratio, date) AS latest_discharge_offset_ratio,
    CAST(sum(transfer) AS BIGINT) AS total_transfers, CAST(sum(discharge) AS BIGINT) AS total_discharges,
    count(*) FILTER (WHERE anomaly_transfer OR anomaly_discharge) AS logical_anomaly_rows,
    count(*) FILTER (WHERE is_imputed_date) AS imputed_dates FROM m GROUP BY series"""
SUMMARY = SUMMARY.replace(
    "arg_min(date, (-total_load, date))",
    "min(date) FILTER (WHERE total_load = peak)",
).replace("FROM m GROUP", "FROM (SELECT *, max(total_load) OVER (PARTITION BY series) AS peak FROM m) GROUP")
SUMMARY_DOUBLES = ("average_system_load", "load_volatility_index", "latest_discharge_offset_ratio")


@query("agg04_operational_summary", SUMMARY, SUMMARY_DOUBLES, NATION)
def _(df, spec):
    return K.operational_summary(df, spec)


def islands(flag, columns, source="m"):
    return f"""SELECT series, min(date) AS episode_start, max(date) AS episode_end, count(*) AS duration_days, {columns},
      CASE WHEN max(date) = any_value(last_day_) THEN 'Active' ELSE 'Closed' END AS status
      FROM (SELECT *, rn - row_number() OVER (PARTITION BY series, hit ORDER BY date) AS isl FROM (
        SELECT *, row_number() OVER ({W}) AS rn, {flag} AS hit, max(date) OVER (PARTITION BY series) AS last_day_ FROM {source}))
      WHERE hit GROUP BY series, isl"""


EPISODES = islands(
    "net_intake > 0",
    """CAST(sum(net_intake) AS BIGINT) AS cumulative_net, max(net_intake) AS peak_pressure,
    avg(net_intake) AS average_pressure, count(*) >= 3 AS elevated""",
)


@query("agg05_backlog_episodes", EPISODES, ("average_pressure",), SUPPLIER)
def _(df, spec):
    return E.backlog_episodes(df, spec)


def scen(a, b):
    return f"""SELECT *, stock_a / CAST({a} AS DOUBLE) * 100 AS utilisation_a, stock_b / CAST({b} AS DOUBLE) * 100 AS utilisation_b,
    total_load / CAST({a} + {b} AS DOUBLE) * 100 AS utilisation_total, {a} - stock_a AS headroom_a, {b} - stock_b AS headroom_b,
    {a} + {b} - total_load AS headroom_total,
    CASE WHEN total_load / CAST({a} + {b} AS DOUBLE) * 100 >= 95 THEN 'Critical'
         WHEN total_load / CAST({a} + {b} AS DOUBLE) * 100 >= 80 THEN 'Warning' ELSE 'Within planning range' END AS capacity_status FROM m"""


SC = S.Scenario(12, 280)
SC_TAIL = f", s AS ({scen(12, 280)})"
SC_DOUBLES = ("utilisation_a", "utilisation_b", "utilisation_total")


@query("fn11_capacity_scenario", "SELECT * FROM s", (*M_DOUBLES, *SC_DOUBLES), NATION, SC_TAIL)
def _(df, spec):
    return S.capacity_scenario(df, SC)


@query(
    "q02_scenario_grid",
    """SELECT series, name AS scenario, count(*) FILTER (WHERE u >= w) AS warning_days, count(*) FILTER (WHERE u >= c) AS critical_days, max(u) AS peak_utilisation
    FROM (SELECT series, name, w, c, total_load / CAST(a + b AS DOUBLE) * 100 AS u FROM m, (VALUES ('tight', 8, 200, 80, 95), ('base', 12, 280, 80, 95), ('wide', 20, 400, 70, 90)) AS t(name, a, b, w, c))
    GROUP BY 1, 2""",
    ("peak_utilisation",), NATION,
)
def _(df, spec):
    grid = [S.Scenario(8, 200, name="tight"), S.Scenario(12, 280, name="base"),
            S.Scenario(20, 400, 70.0, 90.0, "wide")]
    limits = {s.name: s for s in grid}
    days = S.capacity_scenarios(df.select("series", "date", "stock_a", "stock_b", "total_load"), grid)
    low = F.when(F.col("scenario") == "wide", limits["wide"].warning).otherwise(80.0)
    high = F.when(F.col("scenario") == "wide", limits["wide"].critical).otherwise(95.0)
    used = F.col("utilisation_total")
    return days.groupBy("series", "scenario").agg(
        F.count_if(used >= low).alias("warning_days"),
        F.count_if(used >= high).alias("critical_days"),
        F.max(used).alias("peak_utilisation"),
    )


STRESS = islands(
    "utilisation_total >= 80",
    """max(utilisation_total) AS peak_utilisation, min(headroom_total) AS minimum_headroom, max(total_load) AS peak_load""",
    "s",
)


@query("agg06_stress_episodes", STRESS, ("peak_utilisation",), NATION, SC_TAIL)
def _(df, spec):
    return E.stress_episodes(S.capacity_scenario(df, SC), spec)


@query(
    "agg08_scenario_summary",
    f"""SELECT series, CAST(12 AS BIGINT) AS planning_capacity_a, CAST(280 AS BIGINT) AS planning_capacity_b, CAST(292 AS BIGINT) AS planning_capacity,
    CAST(80 AS DOUBLE) AS warning_threshold_percent, CAST(95 AS DOUBLE) AS critical_threshold_percent,
    max_by(utilisation_total, date) AS latest_utilisation, max_by(headroom_total, date) AS latest_headroom,
    max_by(capacity_status, date) AS latest_status, max(utilisation_total) AS peak_utilisation,
    min(date) FILTER (WHERE utilisation_total = peak) AS peak_date,
    count(*) FILTER (WHERE utilisation_total >= 80) AS warning_days, count(*) FILTER (WHERE utilisation_total >= 95) AS critical_days,
    count(*) FILTER (WHERE utilisation_total >= 80 AND (before IS NULL OR before < 80)) AS stress_episodes
    FROM (SELECT *, max(utilisation_total) OVER (PARTITION BY series) AS peak, lag(utilisation_total) OVER ({W}) AS before FROM s) GROUP BY series""",
    ("latest_utilisation", "peak_utilisation", "warning_threshold_percent", "critical_threshold_percent"), NATION, SC_TAIL,
)
def _(df, spec):
    return S.scenario_summary(S.capacity_scenario(df, SC), spec, SC)


@query(
    "agg07_high_backlog_periods",
    f"""SELECT series, min(date) AS interval_start, max(date) AS interval_end FROM (
    SELECT series, date, date - CAST(row_number() OVER ({W}) AS INTEGER) AS anchor FROM m WHERE streak >= 3) GROUP BY series, anchor""",
    (), NATION,
)
def _(df, spec):
    return E.high_backlog_periods(df, spec)


@query(
    "agg07_high_pressure_intervals",
    f"""SELECT series, episode_start + 2 AS interval_start, episode_end AS interval_end FROM ({EPISODES}) WHERE duration_days >= 3""",
)
def _(df, spec):
    return E.high_pressure_intervals(E.backlog_episodes(df, spec), spec)


@query("win05_current_streak", "SELECT series, CAST(max_by(streak, date) AS BIGINT) AS current_streak FROM m GROUP BY 1", (), SUPPLIER)
def _(df, spec):
    return E.current_streak(df, spec)


@query("prj13_anomaly_rows", "SELECT series, date, stock_a, transfer, stock_b, discharge, anomaly_transfer, anomaly_discharge FROM m WHERE anomaly_transfer OR anomaly_discharge", (), NATION)
def _(df, spec):
    return K.anomaly_rows(df, spec)


@query("agg20_snapshot", """SELECT series, CAST(sum(transfer) AS BIGINT) AS total_transfers, CAST(sum(discharge) AS BIGINT) AS total_discharges,
    CAST(sum(net_intake) AS BIGINT) AS cumulative_net_intake, CAST(sum(discharge) AS DOUBLE) / (sum(transfer) + 1) AS flow_ratio,
    count(*) FILTER (WHERE anomaly_transfer OR anomaly_discharge) AS anomaly_days, count(*) FILTER (WHERE is_imputed_date) AS imputed_days
    FROM m GROUP BY series""", ("flow_ratio",), NATION)
def _(df, spec):
    return K.snapshot(df, spec)


# ---- comparisons and KPIs -------------------------------------------------------
BLOCKS = f""", n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS back FROM m),
 b AS (SELECT *, least(30, greatest(1, n // 2)) AS w FROM n),
 k AS (SELECT *, back <= w AS cur FROM b WHERE back <= 2 * w),
 kr AS (SELECT *, row_number() OVER (PARTITION BY series, cur ORDER BY date) AS p,
        row_number() OVER (PARTITION BY series, cur ORDER BY date)
          - coalesce(max(CASE WHEN net_intake > 0 THEN NULL ELSE q END) OVER (PARTITION BY series, cur ORDER BY date), 0) AS run
        FROM (SELECT *, row_number() OVER (PARTITION BY series, cur ORDER BY date) AS q FROM k))"""


def side(flag):
    return f"FILTER (WHERE {flag})"


BASELINES = """SELECT series, avg(total_load) AS total_load, avg(net_intake) AS net_intake_pressure,
    coalesce(stddev_pop(growth_pct), 0) AS load_volatility_index, CAST(max(run) AS DOUBLE) AS backlog_accumulation_rate,
    CAST(sum(discharge) AS DOUBLE) / (sum(transfer) + 1) AS discharge_offset_ratio FROM kr WHERE NOT cur GROUP BY series"""
KPI_COLS = ("total_load", "net_intake_pressure", "load_volatility_index", "backlog_accumulation_rate", "discharge_offset_ratio")


@query("agg09_comparison_baselines", BASELINES, KPI_COLS, NATION, BLOCKS)
def _(df, spec):
    return K.comparison_baselines(df, spec)


@query(
    "agg10_window_deltas",
    f"""SELECT series, CAST(max_by(total_load, date) {side('cur')} - max_by(total_load, date) {side('NOT cur')} AS DOUBLE) AS load_delta,
    avg(net_intake) {side('cur')} - avg(net_intake) {side('NOT cur')} AS net_delta,
    coalesce(stddev_pop(growth_pct) {side('cur')} - stddev_pop(growth_pct) {side('NOT cur')}, 0) AS volatility_delta,
    CAST(max(run) {side('cur')} - max(run) {side('NOT cur')} AS DOUBLE) AS backlog_delta,
    CAST(sum(discharge) {side('cur')} AS DOUBLE) / (sum(transfer) {side('cur')} + 1)
      - CAST(sum(discharge) {side('NOT cur')} AS DOUBLE) / (sum(transfer) {side('NOT cur')} + 1) AS offset_delta FROM kr GROUP BY series""",
    ("load_delta", "net_delta", "volatility_delta", "backlog_delta", "offset_delta"), NATION, BLOCKS,
)
def _(df, spec):
    return K.window_deltas(df, spec)


@query(
    "agg12_recent_change",
    f"""SELECT series, coalesce((avg(total_load) {side('cur')} - avg(total_load) {side('NOT cur')})
      / nullif(abs(avg(total_load) {side('NOT cur')}), 0) * 100, 0) AS recent_change_percent FROM kr GROUP BY series""",
    ("recent_change_percent",), NATION, BLOCKS,
)
def _(df, spec):
    return T.recent_change(df, spec)


STATUS = """CASE kpi WHEN 'total_load' THEN CASE WHEN delta_percent IS NULL THEN 'stable' WHEN delta_percent >= 5 THEN 'critical'
      WHEN delta_percent >= 1 THEN 'watch' WHEN delta_percent <= -1 THEN 'favorable' ELSE 'stable' END
    WHEN 'net_intake_pressure' THEN CASE WHEN value >= 75 THEN 'critical' WHEN value >= 25 THEN 'watch' WHEN value <= 0 THEN 'favorable' ELSE 'stable' END
    WHEN 'load_volatility_index' THEN CASE WHEN value >= 2 THEN 'critical' WHEN value >= 1 THEN 'watch' ELSE 'stable' END
    WHEN 'backlog_accumulation_rate' THEN CASE WHEN value >= 7 THEN 'critical' WHEN value >= 3 THEN 'watch' WHEN value = 0 THEN 'favorable' ELSE 'stable' END
    ELSE CASE WHEN value < 0.75 THEN 'critical' WHEN value < 0.9 THEN 'watch' WHEN value >= 1 THEN 'favorable' ELSE 'stable' END END"""
FORMATTED = """CASE kpi WHEN 'total_load' THEN format('{:,}', CAST(value AS BIGINT))
    WHEN 'net_intake_pressure' THEN CASE WHEN value >= 0 THEN '+' ELSE '' END || format('{:,}', CAST(value AS BIGINT))
    WHEN 'load_volatility_index' THEN printf('%.2f', value) || '%'
    WHEN 'backlog_accumulation_rate' THEN format('{:,}', CAST(value AS BIGINT)) || ' day(s)'
    ELSE printf('%.1f', value * 100) || '%' END"""
KPI_TAIL = BLOCKS + f""", h AS ({HEAD}), base AS ({BASELINES}), ends AS (SELECT series, max(date) AS as_of FROM m GROUP BY 1),
 long AS (SELECT series, as_of, kpi, ordinal, value, comparison_value FROM (
   {' UNION ALL '.join(f"SELECT h.series, '{c}' AS kpi, {i} AS ordinal, CAST(h.{c} AS DOUBLE) AS value, CAST(base.{c} AS DOUBLE) AS comparison_value FROM h LEFT JOIN base USING (series)" for i, c in enumerate(KPI_COLS))}) JOIN ends USING (series)),
 rated AS (SELECT *, value - comparison_value AS delta, (value - comparison_value) / nullif(abs(comparison_value), 0) * 100 AS delta_percent FROM long)"""
KPI_VALUES = ("value", "comparison_value", "delta", "delta_percent")


def _names(column, index):
    return f"CASE kpi " + " ".join(
        f"WHEN '{k}' THEN '{str(K.KPI_TEXT[k][index]).replace(chr(39), chr(39) * 2)}'" for k in K.KPI_KEYS
    ) + f" END AS {column}"


@query(
    "fn10_kpi_table",
    f"""SELECT series, as_of, ordinal, kpi, value, comparison_value, delta, delta_percent, {_names('name', 0)}, {_names('unit', 1)},
    {STATUS} AS status, CASE WHEN delta IS NULL THEN 'unavailable' WHEN delta > 1e-12 THEN 'increase' WHEN delta < -1e-12 THEN 'decrease' ELSE 'unchanged' END AS direction
    FROM rated""",
    KPI_VALUES, NATION, KPI_TAIL,
)
def _(df, spec):
    table = K.kpi_table(df, spec)
    return table.select("series", "as_of", "ordinal", "kpi", *KPI_VALUES, "name", "unit", "status", "direction")


@query(
    "fn08_kpi_formatted_values",
    f"SELECT series, kpi, {FORMATTED} AS formatted_value FROM rated WHERE kpi <> 'load_volatility_index' AND kpi <> 'discharge_offset_ratio'",
    (), NATION, KPI_TAIL,
)
def _(df, spec):
    table = K.kpi_table(df, spec)
    return table.where("kpi not in ('load_volatility_index', 'discharge_offset_ratio')").select(
        "series", "kpi", "formatted_value"
    )


@query(
    "fn09_alerts",
    f"""SELECT series, kpi, severity, upper(severity[1]) || severity[2:] || ': ' || name AS title, as_of FROM (
    SELECT series, as_of, kpi, {_names('name', 0)}, {STATUS} AS severity FROM rated) WHERE severity IN ('watch', 'critical')""",
    (), NATION, KPI_TAIL,
)
def _(df, spec):
    return K.alerts(K.kpi_table(df, spec), spec).select("series", "kpi", "severity", "title", "as_of")


@query(
    "q03_kpi_dashboard_as_of",
    f"SELECT series, as_of, kpi, value, comparison_value, {STATUS} AS status FROM rated",
    ("value", "comparison_value"), FLAG,
    ", m0 AS (SELECT * FROM m WHERE date <= DATE '1999-06-30')" + KPI_TAIL.replace("FROM m)", "FROM m0)").replace("FROM m GROUP", "FROM m0 GROUP"),
)
def _(df, spec):
    board = A.kpi_dashboard(df, spec, as_of="1999-06-30")
    return board.table.select("series", "as_of", "kpi", "value", "comparison_value", "status")


@query(
    "agg11_period_summary",
    """SELECT series, ordinal, coalesce(latest, 0) AS latest, coalesce(period_average, 0) AS period_average,
    coalesce(period_minimum, 0) AS period_minimum, coalesce(period_maximum, 0) AS period_maximum FROM (
    """ + " UNION ALL ".join(
        f"""SELECT series, {i} AS ordinal, CAST({latest} AS DOUBLE) AS latest, avg({c}) AS period_average,
        CAST(min({c}) AS DOUBLE) AS period_minimum, CAST(max({c}) AS DOUBLE) AS period_maximum FROM v GROUP BY series"""
        for i, (c, latest) in enumerate(
            [("total_load", "max_by(total_load, date)"), ("net_intake", "max_by(net_intake, date)"),
             ("rolling_volatility", "stddev_pop(growth_pct)"), ("streak", "max_by(streak, date)"),
             ("offset_ratio", "max_by(offset_ratio, date)")]
        )
    ) + ")",
    ("latest", "period_average", "period_minimum", "period_maximum"), NATION, VOL_TAIL,
)
def _(df, spec):
    return K.period_summary(df, spec).drop("name", "unit")


@query(
    "win18_kpi_trends",
    """SELECT series, date, total_load, net_intake AS net_intake_pressure, rolling_volatility AS load_volatility_index,
    streak AS backlog_accumulation_rate, offset_ratio AS discharge_offset_ratio FROM v""",
    ("load_volatility_index", "discharge_offset_ratio"), NATION, VOL_TAIL,
)
def _(df, spec):
    return K.kpi_trends(df, spec)


@query("win03_rolling_volatility", "SELECT series, date, rolling_volatility FROM v", ("rolling_volatility",), SUPPLIER, VOL_TAIL)
def _(df, spec):
    return D.rolling_volatility(df, spec).select("series", "date", "rolling_volatility")


@query("win02_rolling_load", f"SELECT series, date, avg(total_load) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS custom_trend FROM m", ("custom_trend",), SUPPLIER)
def _(df, spec):
    return D.rolling_load(df, spec, 21).select("series", "date", "custom_trend")


@query("win17_cumulative_net", f"SELECT series, date, CAST(sum(net_intake) OVER ({W}) AS BIGINT) AS cumulative_net FROM m", (), SUPPLIER)
def _(df, spec):
    return D.cumulative_net(df, spec).select("series", "date", "cumulative_net")


# ---- trends ---------------------------------------------------------------------
@query(
    "agg13_endpoint_change",
    """SELECT series, coalesce(CASE WHEN count(*) >= 2 THEN (max_by(total_load, date) - min_by(total_load, date))
    / nullif(abs(CAST(min_by(total_load, date) AS DOUBLE)), 0) * 100 END, 0) AS endpoint_change_percent FROM m GROUP BY series""",
    ("endpoint_change_percent",), SUPPLIER,
)
def _(df, spec):
    return T.endpoint_change(df, spec)


@query(
    "agg14_trend_slope",
    f"""SELECT series, coalesce(regr_slope(total_load, x), 0) AS trend_slope FROM (
    SELECT *, CAST(row_number() OVER ({W}) AS DOUBLE) AS x FROM m) GROUP BY series""",
    ("trend_slope",), NATION,
)
def _(df, spec):
    return T.trend_slope(df, spec)


@query(
    "agg15_weekday_profile",
    """SELECT k.series, CAST(d AS INTEGER) AS weekday_number, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][d + 1] AS weekday,
    coalesce(avg(intake), 0) AS intake, coalesce(avg(transfer), 0) AS transfer, coalesce(avg(discharge), 0) AS discharge, coalesce(avg(net_intake), 0) AS net_intake
    FROM (SELECT DISTINCT series FROM m) k CROSS JOIN range(7) AS r(d) LEFT JOIN m ON m.series = k.series AND isodow(m.date) - 1 = d GROUP BY 1, d""",
    ("intake", "transfer", "discharge", "net_intake"), NATION,
)
def _(df, spec):
    return T.weekday_profile(df, spec)


MONTHS = [f"m{i:02d}" for i in range(1, 13)]


@query(
    "agg16_monthly_heatmap",
    "SELECT series, CAST(year(date) AS INTEGER) AS year, "
    + ", ".join(f"avg(total_load) FILTER (WHERE month(date) = {i}) AS m{i:02d}" for i in range(1, 13))
    + " FROM m GROUP BY 1, 2",
    MONTHS, NATION,
)
def _(df, spec):
    return T.monthly_heatmap(df, spec)


@query(
    "agg17_correlation_matrix",
    " UNION ALL ".join(
        f"""SELECT series, '{a}' AS measure, '{b}' AS other, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b})
        THEN corr({a}, {b}) ELSE 0 END AS correlation FROM m GROUP BY series"""
        for a in T.MEASURES for b in T.MEASURES
    ),
    ("correlation",), FLAG,
)
def _(df, spec):
    return T.correlation_matrix(df, spec)


RISK = """SELECT series, date, CASE WHEN h4 OR h5 OR hits >= 3 THEN 'Critical' ELSE 'Watch' END AS severity,
    CASE WHEN h4 OR h5 OR hits >= 3 THEN 0 ELSE 1 END AS severity_rank,
    concat_ws('; ', CASE WHEN h1 THEN 'High system load' END, CASE WHEN h2 THEN 'Elevated net intake' END,
      CASE WHEN h3 THEN 'Unusual load change' END, CASE WHEN h4 THEN 'Transfer constraint anomaly' END,
      CASE WHEN h5 THEN 'Discharge constraint anomaly' END) AS signals,
    total_load, net_intake, coalesce(growth_pct, 0) AS growth_pct FROM (
    SELECT *, CAST(h1 AS INT) + CAST(h2 AS INT) + CAST(h3 AS INT) + CAST(h4 AS INT) + CAST(h5 AS INT) AS hits FROM (
      SELECT m.*, total_load >= ql AS h1, net_intake > 0 AND net_intake >= qn AS h2,
        abs(coalesce(growth_pct, 0)) >= qg AND qg > 0 AS h3, anomaly_transfer AS h4, anomaly_discharge AS h5
      FROM m JOIN (SELECT series, quantile_cont(total_load, 0.95) AS ql, quantile_cont(net_intake, 0.9) AS qn,
        coalesce(quantile_cont(abs(growth_pct), 0.95), 0) AS qg FROM m GROUP BY series) q USING (series))) WHERE hits > 0"""


@query("agg18_risk_signals", RISK, ("growth_pct",), NATION)
def _(df, spec):
    return T.risk_signals(df, spec)


@query(
    "agg19_suggested_capacity",
    """SELECT series, CASE WHEN peak <= 0 THEN 100 ELSE CAST(ceil(peak * CAST(1.15 AS DOUBLE) / ord) * ord AS BIGINT) END AS suggested_capacity FROM (
    SELECT series, peak, pow(10, greatest(1, floor(log10(nullif(peak, 0))) - 1)) AS ord FROM (SELECT series, max(total_load) AS peak FROM m GROUP BY series))""",
    (), SUPPLIER,
)
def _(df, spec):
    return S.suggested_capacity(df, spec)


@query(
    "agg23_describe",
    " UNION ALL ".join(
        f"""SELECT series, '{c}' AS measure, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
        quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM m GROUP BY series"""
        for c in ("total_load", "net_intake", "growth_pct", "roll7")
    ),
    ("mean", "std", "min", "p25", "p50", "p75", "max"), NATION,
)
def _(df, spec):
    return T.describe(df, spec, ["total_load", "net_intake", "growth_pct", "roll7"])


@query(
    "agg23_error_quantiles",
    """SELECT series, avg(roll7 - total_load) AS mean_residual, quantile_cont(abs(roll7 - total_load), 0.5) AS median_absolute_error,
    quantile_cont(abs(roll7 - total_load), 0.9) AS p90_absolute_error, max(abs(roll7 - total_load)) AS max_absolute_error FROM m GROUP BY series""",
    ("mean_residual", "median_absolute_error", "p90_absolute_error", "max_absolute_error"), NATION,
)
def _(df, spec):
    return T.error_quantiles(df, spec, "roll7", "total_load")


@query(
    "agg24_histogram",
    """SELECT series, bin, count(*) AS rows, min(lo + bin * width) AS lower_edge FROM (
    SELECT *, least(29, CAST(coalesce(floor((net_intake - lo) / nullif(width, 0)), 0) AS BIGINT)) AS bin FROM (
      SELECT *, (hi - lo) / 30 AS width FROM (SELECT series, CAST(net_intake AS DOUBLE) AS net_intake, CAST(min(net_intake) OVER (PARTITION BY series) AS DOUBLE) AS lo,
        CAST(max(net_intake) OVER (PARTITION BY series) AS DOUBLE) AS hi FROM m))) GROUP BY 1, 2""",
    ("lower_edge",), NATION,
)
def _(df, spec):
    return T.histogram(df, spec, "net_intake")


@query(
    "srt02_top_movements",
    f"""SELECT series, date, total_load, net_intake, growth_pct, CASE WHEN growth_pct > 0 THEN 'Increase' ELSE 'Decrease' END AS direction, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(growth_pct) DESC, date) AS rank FROM m WHERE growth_pct IS NOT NULL) WHERE rank <= 10""",
    ("growth_pct",), SUPPLIER,
)
def _(df, spec):
    return T.top_movements(df, spec)


@query(
    "srt03_newest_first_appendix",
    """SELECT series, date, total_load, net_intake, growth_pct, offset_ratio, streak, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS rank FROM m) WHERE rank <= 60""",
    ("growth_pct", "offset_ratio"), NATION,
)
def _(df, spec):
    return T.newest_first(df, spec, A.APPENDIX, 60)


@query("prj15_pagination", "SELECT * FROM m ORDER BY series, date LIMIT 100 OFFSET 250", M_DOUBLES, NATION)
def _(df, spec):
    return T.paginate(df, spec.index, 250, 100)[0]


@query(
    "q04_chart_data_period",
    f"""SELECT * EXCLUDE (period), period AS date FROM (
    {resampled('weekly', ('total_load', 'stock_a', 'stock_b', 'streak'), ('transfer', 'discharge', 'net_intake')).replace('FROM m', "FROM m WHERE date BETWEEN DATE '1997-03-05' AND DATE '2000-08-20'")})""",
    (), NATION,
)
def _(df, spec):
    return A.chart_data(df, spec, "1997-03-05", "2000-08-20", "weekly", "backlog")


# ---- period filter before metrics ------------------------------------------------
@register(
    "q01_analysis_summary_period",
    f"""WITH daily AS ({daily_sql(NATION)}), dense0 AS ({dense_sql(NATION)}),
    dense AS (SELECT * FROM dense0 WHERE date BETWEEN DATE '1997-03-05' AND DATE '2000-08-20'), m AS ({metrics_sql(NATION)}) {SUMMARY}""",
    SUMMARY_DOUBLES,
)
def _(spark, sf):
    days, spec = dense_daily(spark, sf, NATION)
    from tidegauge.operators.clean import flag_anomalies

    found = A.analyse_clean(flag_anomalies(days), spec, A.AnalysisConfig("1997-03-05", "2000-08-20"))
    return found.summary


@register(
    "agg26_dataset_profile",
    f"""WITH daily AS ({daily_sql(SUPPLIER)}) SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns, min(date) AS date_min, max(date) AS date_max,
    CAST(0 AS BIGINT) AS missing_cells, count(*) - count(DISTINCT date) AS duplicate_dates FROM daily""",
)
def _(spark, sf):
    return C.dataset_profile(lineitem_daily(spark, sf, SUPPLIER)[0])


@register("agg27_fingerprint")
def _(spark, sf):
    return C.fingerprint(metrics(spark, sf, NATION)[0])


@query(
    "agg29_provenance_audit",
    f"""SELECT series, min(date) AS range_start, max(date) AS range_end, count(*) AS rows,
    CAST(date_diff('day', min(date), max(date)) + 1 - count(*) AS BIGINT) AS missing_dates, count(*) FILTER (WHERE is_imputed_date) AS imputed_dates,
    quantile_cont(abs(gap), 0.5) AS median_absolute_residual, coalesce(avg(CASE WHEN abs(gap) <= 10 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) * 100, 0) AS percent_within_10,
    coalesce(avg(CASE WHEN abs(gap) <= 10 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) * 100, 0) >= 80 AS approximately_satisfied
    FROM (SELECT *, total_load - lag(total_load) OVER ({W}) - (intake - discharge) AS gap FROM m) GROUP BY series""",
    ("median_absolute_residual", "percent_within_10"), NATION,
)
def _(df, spec):
    return C.provenance_audit(df, spec)


@query(
    "jn09_table_equivalence",
    """SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(0 AS BIGINT) AS nulls_total_load,
    count(*) FILTER (WHERE day(date) = 7) AS values_total_load, count(*) FILTER (WHERE day(date) = 9 AND roll7 IS NOT NULL) AS nulls_roll7,
    CAST(0 AS BIGINT) AS values_roll7 FROM m""",
    (), NATION,
)
def _(df, spec):
    left = df.select(*spec.index, "total_load", "roll7")
    changed = left.withColumns(
        {
            "total_load": F.when(F.dayofmonth("date") == 7, F.col("total_load") + 1).otherwise(F.col("total_load")),
            "roll7": F.when(F.dayofmonth("date") != 9, F.col("roll7") + 1e-12),
        }
    )
    return C.difference_counts(left, changed, spec.index)


@query(
    "fn12_operational_table",
    f"""SELECT series, ordinal, measure, value FROM (
      SELECT series, 2 AS ordinal, 'Daily observations' AS measure, format('{{:,}}', daily_observations) AS value FROM s0
      UNION ALL SELECT series, 4, 'Peak system load', format('{{:,}}', peak_system_load) FROM s0
      UNION ALL SELECT series, 5, 'Peak system load date', CAST(peak_system_load_date AS VARCHAR) FROM s0
      UNION ALL SELECT series, 10, 'Total transfers', format('{{:,}}', total_transfers) FROM s0)""",
    (), NATION, f", s0 AS ({SUMMARY})",
)
def _(df, spec):
    table = A.operational_table(K.operational_summary(df, spec), spec)
    return table.where("ordinal in (2, 4, 5, 10)")


def _reported(spark, sf):
    df, spec = metrics(spark, sf, FLAG)
    days = df.select(*spec.index, "intake", "stock_a", "transfer", "stock_b", "discharge", "is_imputed_date", "anomaly_transfer", "anomaly_discharge")
    return A.report(A.analyse_clean(days, spec), A.ReportConfig(backlog_rows=3, anomaly_rows=5, appendix_rows=7))


@register("q07_report_insights")
def _(spark, sf):
    return _reported(spark, sf)["insights"]


@register(
    "srt04_report_anomalies",
    with_metrics(FLAG) + """ SELECT * FROM (SELECT series, date, stock_a, transfer, stock_b, discharge, anomaly_transfer, anomaly_discharge,
    CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS rank FROM m WHERE anomaly_transfer OR anomaly_discharge) WHERE rank <= 5""",
)
def _(spark, sf):
    return _reported(spark, sf)["anomalies"]


@register(
    "srt04_report_appendix",
    with_metrics(FLAG) + """ SELECT series, date, total_load, net_intake, growth_pct, offset_ratio, streak, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS rank FROM m) WHERE rank <= 7""",
    ("growth_pct", "offset_ratio"),
)
def _(spark, sf):
    return _reported(spark, sf)["appendix"]


for _table in ("metadata", "executive_summary", "kpis", "operations", "validation", "backlog"):
    register(f"fn13_report_{_table}")(lambda spark, sf, t=_table: _reported(spark, sf)[t])


__all__ = ["SeriesSpec", "part", "query"]
