"""Queries over features, targets and their manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.fixtures import metrics, with_metrics
from tidegauge.catalog.registry import register
from tidegauge.functions.calendar import calendar_cycles, calendar_parts
from tidegauge.operators import features as X
from tidegauge.operators.forecast import prepare as P
from tidegauge.spec import add_sql

BY = "nation"
W = "PARTITION BY series ORDER BY date"


def _panel(build, by=BY):
    return lambda spark, sf: build(*metrics(spark, sf, by))


def query(name, body, doubles=(), by=BY, tail=""):
    return lambda build: register(name, f"{with_metrics(by)}{tail} {body}", doubles)(_panel(build, by))


def pick(df, spec, columns):
    return add_sql(df.select(*df.columns), columns).select(*spec.index, *columns)


LAGS = {f"lag_{k}d_{s}": f"lag({s}, {k}) OVER ({W})" for k in (1, 7, 14, 28) for s in X.BASE_SIGNALS}


@query(
    "win11_lags",
    f"SELECT series, date, {', '.join(f'{t} AS {n}' for n, t in LAGS.items())} FROM m",
    [n for n in LAGS if n.endswith("growth_pct")],
)
def _(df, spec):
    return pick(df, spec, X.lags(spec, (1, 7, 14, 28)))


def _rolling_sql():
    out = {}
    for s in X.ROLLING_SIGNALS:
        for k in (7, 14, 30):
            w = f"OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
            for name, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")):
                out[f"rolling_{k}d_{s}_{name}"] = f"CASE WHEN count({s}) {w} = {k} THEN {f}({s}) {w} END"
    return out


ROLLING = _rolling_sql()


@query(
    "win12_rolling_stats",
    f"SELECT series, date, {', '.join(f'{t} AS {n}' for n, t in ROLLING.items())} FROM m",
    [n for n in ROLLING if n.endswith(("mean", "std"))], "flag",
)
def _(df, spec):
    return pick(df, spec, X.rolling_stats(spec, (7, 14, 30)))


def _slope_sql(k):
    w = f"OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(total_load) {w} = {k} THEN regr_slope(total_load, rn) {w} END AS slope_{k}"


@query(
    "win13_rolling_slope",
    f"SELECT series, date, {', '.join(_slope_sql(k) for k in (7, 14, 30))} FROM (SELECT *, row_number() OVER ({W}) AS rn FROM m)",
    ("slope_7", "slope_14", "slope_30"),
)
def _(df, spec):
    placed = add_sql(df, {"_pos": f"row_number() {spec.over()}"})
    return pick(placed, spec, {f"slope_{k}": X.rolling_slope(spec, "total_load", k, "_pos") for k in (7, 14, 30)})


def _ema_sql(span, c):
    a = f"CAST({2 / (span + 1)!r} AS DOUBLE)"
    return f"{a} * CAST(h.{c} AS DOUBLE) + (1 - {a}) * e.{c}_{span}"


_EMAS = [(c, k, f"ema_{k}d_{c}") for c in ("total_load", "net_intake") for k in (7, 14, 30)]


@query(
    "win14_exponential_means",
    "SELECT series, date, " + ", ".join(
        f"CASE WHEN rn - 1 >= {k} THEN {c}_{k} END AS {n}" for c, k, n in _EMAS
    ) + " FROM (SELECT h.series, h.date, h.rn, " + ", ".join(f"e.{c}_{k}" for c, k, _ in _EMAS)
    + " FROM h LEFT JOIN e ON e.series = h.series AND e.rn = h.rn)",
    [n for _, _, n in _EMAS], "flag",
    f""", h AS (SELECT series, date, row_number() OVER ({W}) AS rn, lag(total_load) OVER ({W}) AS total_load, lag(net_intake) OVER ({W}) AS net_intake FROM m),
    g AS (SELECT series, list(total_load ORDER BY rn) AS tl, list(net_intake ORDER BY rn) AS ni FROM h GROUP BY series),
    e AS (WITH RECURSIVE r AS (
      SELECT series, rn, {', '.join(f'CAST({c} AS DOUBLE) AS {c}_{k}' for c, k, _ in _EMAS)} FROM h WHERE rn = 2
      UNION ALL SELECT h.series, h.rn, {', '.join(_ema_sql(k, c) for c, k, _ in _EMAS)} FROM r e JOIN h ON h.series = e.series AND h.rn = e.rn + 1)
      SELECT * FROM r)""",
)
def _(df, spec):
    return X.exponential_means(df, spec, _EMAS).select("series", "date", *[n for _, _, n in _EMAS])


def _step(c, k):
    return f"({c} - lag({c}, {k}) OVER ({W}))"


MOMENTUM = {
    **{f"momentum_total_load_change_{k}d": _step("total_load", k) for k in (1, 7, 14)},
    **{
        f"momentum_total_load_pct_change_{k}d":
        f"{_step('total_load', k)} / nullif(CAST(lag(total_load, {k}) OVER ({W}) AS DOUBLE), 0)"
        for k in (7, 14)
    },
    **{f"momentum_net_intake_change_{k}d": _step("net_intake", k) for k in (1, 7)},
    "momentum_load_acceleration": f"total_load - 2 * lag(total_load) OVER ({W}) + lag(total_load, 2) OVER ({W})",
    "momentum_net_intake_acceleration": f"net_intake - 2 * lag(net_intake) OVER ({W}) + lag(net_intake, 2) OVER ({W})",
}


@query(
    "win15_momentum",
    f"SELECT series, date, {', '.join(f'{t} AS {n}' for n, t in MOMENTUM.items())} FROM m",
    [n for n in MOMENTUM if "pct" in n],
)
def _(df, spec):
    return pick(df, spec, X.momentum(spec))


AHEAD = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)"
LATER = f"lead(total_load, 7) OVER ({W})"


@query(
    "win16_targets",
    f"""SELECT series, date, {LATER} AS target_total_load_t_plus_7d, {LATER} - total_load AS target_load_change_t_plus_7d,
    ({LATER} - total_load) / nullif(CAST(total_load AS DOUBLE), 0) AS target_load_growth_t_plus_7d,
    lead(net_intake, 7) OVER ({W}) AS target_net_intake_t_plus_7d,
    CAST(lead(net_intake, 7) OVER ({W}) > 0 AS DOUBLE) AS target_positive_pressure_t_plus_7d,
    CASE WHEN count(net_intake) {AHEAD} = 7 THEN CAST(sum(net_intake) {AHEAD} AS BIGINT) END AS target_cumulative_net_intake_next_7d,
    CASE WHEN count(net_intake) {AHEAD} = 7 THEN min(CASE WHEN net_intake > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) {AHEAD} END AS target_sustained_pressure_next_7d
    FROM m""",
    ("target_load_growth_t_plus_7d", "target_positive_pressure_t_plus_7d", "target_sustained_pressure_next_7d"),
)
def _(df, spec):
    return pick(df, spec, X.targets(spec, 7))


@query(
    "fn03_fn04_calendar",
    """SELECT series, date, CAST(isodow(date) - 1 AS INTEGER) AS calendar_day_of_week, CAST(month(date) AS INTEGER) AS calendar_month,
    CAST(quarter(date) AS INTEGER) AS calendar_quarter, CAST(day(date) AS INTEGER) AS calendar_day_of_month,
    CAST(dayofyear(date) AS INTEGER) AS calendar_day_of_year, CAST(weekofyear(date) AS INTEGER) AS calendar_week_of_year,
    CAST(isodow(date) >= 6 AS TINYINT) AS calendar_is_weekend, CAST(day(date) = 1 AS TINYINT) AS calendar_is_month_start,
    CAST(last_day(date) = date AS TINYINT) AS calendar_is_month_end,
    sin(2 * pi() * (isodow(date) - 1) / 7) AS calendar_dow_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS calendar_dow_cos,
    sin(2 * pi() * (month(date) - 1) / 12) AS calendar_month_sin, cos(2 * pi() * (month(date) - 1) / 12) AS calendar_month_cos,
    sin(2 * pi() * (dayofyear(date) - 1) / 365.25) AS calendar_doy_sin, cos(2 * pi() * (dayofyear(date) - 1) / 365.25) AS calendar_doy_cos FROM m""",
    tuple(calendar_cycles("date")),
)
def _(df, spec):
    return pick(df, spec, {**calendar_parts("date"), **calendar_cycles("date")})


def _div(a, b):
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


RATIOS = {
    "operational_transfer_to_intake_ratio": _div("transfer", "intake + 1"),
    "operational_discharge_to_transfer_ratio": _div("discharge", "transfer + 1"),
    "operational_stock_a_share": _div("stock_a", "total_load"),
    "operational_stock_b_share": _div("stock_b", "total_load"),
    "operational_intake_transfer_gap": "intake - transfer",
    "operational_transfer_discharge_gap": "transfer - discharge",
    "operational_load_per_intake": _div("total_load", "intake + 1"),
    "operational_stock_ratio": _div("stock_a", "stock_b + 1"),
}


@query(
    "fn02_operational_ratios",
    f"SELECT series, date, {', '.join(f'{t} AS {n}' for n, t in RATIOS.items())} FROM m",
    [n for n, t in RATIOS.items() if "/" in t],
)
def _(df, spec):
    return pick(df, spec, X.operational_ratios())


@query(
    "fn05_quality_flags",
    """SELECT series, date, CAST(anomaly_transfer AS TINYINT) AS quality_transfer_anomaly, CAST(anomaly_discharge AS TINYINT) AS quality_discharge_anomaly,
    CAST(anomaly_transfer OR anomaly_discharge AS TINYINT) AS quality_any_logical_anomaly, CAST(is_imputed_date AS TINYINT) AS quality_is_imputed_date FROM m""",
)
def _(df, spec):
    return pick(df, spec, X.quality_flags(df.columns))


@register("fc05_feature_matrix")
def _(spark, sf):
    df, spec = metrics(spark, sf, "flag")
    return X.split_features(X.build_features(df, spec))


@register("agg25_feature_manifest")
def _(spark, sf):
    df, spec = metrics(spark, sf, "flag")
    return X.feature_manifest(X.build_features(df, spec))


LAGGED = {f"lag_{k}d_{c}": f"lag({c}, {k}) OVER ({W})" for c in ("total_load", "net_intake") for k in (1, 7)}


@register(
    "agg25_manifest_of_lags",
    with_metrics("flag") + ", l AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in LAGGED.items()) + " FROM m) " + " UNION ALL ".join(
        f"SELECT '{n}' AS column, CAST({i} AS INTEGER) AS ordinal, 'feature' AS role, 'lag' AS category, count(*) - count({n}) AS missing_values, "
        f"(count(*) - count({n})) / CAST(count(*) AS DOUBLE) AS missing_rate, count(DISTINCT {n}) AS unique_values FROM l"
        for i, n in enumerate(LAGGED)
    ),
    ("missing_rate",),
)
def _(spark, sf):
    df, spec = metrics(spark, sf, "flag")
    built = X.build_features(df, spec, X.FeatureConfig(drop_incomplete=False))
    lags = X.FeatureSet(built.frame, tuple(LAGGED), (), spec)
    return X.feature_manifest(lags).select("column", "ordinal", "role", "category", "missing_values", "missing_rate", "unique_values")


@register("prj16_feature_selection_reasons")
def _(spark, sf):
    df, spec = metrics(spark, sf, "flag")
    built = X.build_features(df, spec)
    kept, reasons = X.select_safe_features(built.frame)
    present = built.frame.agg(*[F.count(c).alias(c) for c in kept])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("kept").alias("reason"), F.col(c).alias("known_rows")) for c in kept])
    dropped = reasons.withColumn("known_rows", F.lit(None).cast("long"))
    return present.select(F.inline(cells)).unionByName(dropped)


_CORE = ("current_total_load", "load_lag_28", "load_rolling_mean_28", "load_rolling_std_14", "net_rolling_std_7",
         "cumulative_net_intake_14", "load_momentum_7", "load_acceleration", "backlog_streak_at_origin",
         "capacity_utilization", "capacity_headroom", P.TARGET, P.CHANGE)


def _full(f, c, k):
    w = f"OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) {w} = {k} THEN {f}({c}) {w} END"


@query(
    "win19_forecast_origin_frame",
    f"""SELECT * FROM (SELECT series, date, CAST(total_load AS DOUBLE) AS current_total_load, CAST(lag(total_load, 28) OVER ({W}) AS DOUBLE) AS load_lag_28,
    {_full('avg', 'total_load', 28)} AS load_rolling_mean_28, {_full('stddev_pop', 'total_load', 14)} AS load_rolling_std_14,
    {_full('stddev_pop', 'net_intake', 7)} AS net_rolling_std_7, CAST({_full('sum', 'net_intake', 14)} AS DOUBLE) AS cumulative_net_intake_14,
    CAST({_step('total_load', 7)} AS DOUBLE) AS load_momentum_7,
    CAST(total_load - 2 * lag(total_load) OVER ({W}) + lag(total_load, 2) OVER ({W}) AS DOUBLE) AS load_acceleration,
    CAST(streak AS DOUBLE) AS backlog_streak_at_origin, total_load / CAST(12000 AS DOUBLE) AS capacity_utilization,
    CAST(12000 - total_load AS DOUBLE) AS capacity_headroom, CAST({LATER} AS DOUBLE) AS target_total_load_t_plus_7d,
    CAST({LATER} - total_load AS DOUBLE) AS target_change_7d, date + 7 AS target_date, is_imputed_date,
    anomaly_transfer OR anomaly_discharge OR anomaly_negative AS has_anomaly, net_intake AS net_intake_at_origin, streak > 0 AS backlog_state,
    total_load / CAST(12000 AS DOUBLE) >= 0.8 AS capacity_stress FROM m) WHERE target_change_7d IS NOT NULL""",
    _CORE, "flag",
)
def _(df, spec):
    frame = P.prepare_forecast(df, spec).frame
    return frame.select(*spec.index, *_CORE, *P.CONTEXT)


@register("win19_availability_manifest")
def _(spark, sf):
    df, spec = metrics(spark, sf, "flag")
    prepared = P.prepare_forecast(df, spec)
    manifest = P.availability_manifest(prepared)
    names = list(prepared.expanded)
    known = prepared.frame.agg(*[F.count(c).alias(c) for c in names]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("known_rows")) for c in names]))
    )
    return manifest.join(known, "feature", "left")
