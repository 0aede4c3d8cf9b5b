"""Forecast-origin features, targets, chronological partitions and walk-forward folds."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.calendar import calendar_cycles, calendar_parts
from tidegauge.operators.features import availability_of, complete, exponential_means, rolling_slope
from tidegauge.spec import (
    DISCHARGE,
    IMPUTED_DATE,
    INTAKE,
    NET_INTAKE,
    STOCK_A,
    STOCK_B,
    STREAK,
    TOTAL_LOAD,
    TRANSFER,
    CapacityError,
    SeriesSpec,
    add_sql,
    ensure_daily,
    require_columns,
)

CURRENT = "current_total_load"
TARGET = "target_total_load_t_plus_7d"
CHANGE = "target_change_7d"
CONTEXT = (
    "target_date", "is_imputed_date", "has_anomaly", "net_intake_at_origin",
    "backlog_state", "capacity_stress",
)


@dataclass(frozen=True)
class ForecastConfig:
    horizon: int = 7
    holdout_fraction: float = 0.20
    folds: int = 5
    fold_days: int = 56
    gap: int = 7
    seed: int = 42
    capacity_reference: float = 12_000.0
    correlation_limit: float = 0.98
    missing_limit: float = 0.30
    worst_fold_ratio: float = 1.50
    minimum_rows: int = 400
    minimum_development: int = 300

    def __post_init__(self) -> None:
        for name, (allowed, meets) in _SETTINGS.items():
            if not meets(self):
                raise ValueError(f"{name} = {getattr(self, name)!r}, but it must be {allowed}")


# Setting, what it may be, and the test of it.
_SETTINGS = {
    "horizon": ("7 days, which the feature lags are built for", lambda c: c.horizon == 7),
    "gap": ("no shorter than the horizon", lambda c: c.gap >= c.horizon),
    "folds": ("4 or more", lambda c: c.folds >= 4),
    "fold_days": ("a week or longer", lambda c: c.fold_days >= 7),
    "holdout_fraction": ("above 0 and below 1", lambda c: 0 < c.holdout_fraction < 1),
    "correlation_limit": ("from 0.8 up to, not including, 1", lambda c: 0.8 <= c.correlation_limit < 1),
    "capacity_reference": ("above 0", lambda c: c.capacity_reference > 0),
}


@dataclass(frozen=True)
class Prepared:
    frame: DataFrame
    compact: tuple[str, ...]
    expanded: tuple[str, ...]
    spec: SeriesSpec
    config: ForecastConfig


def require_complete(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Raise unless every series has one row for each day between its ends."""
    ensure_daily(df, spec)
    span = F.datediff(F.max(spec.date), F.min(spec.date)) + 1
    gaps = df.groupBy(*spec.keys).agg((span - F.count(F.lit(1))).alias("gaps"))
    if not gaps.where("gaps <> 0").isEmpty():
        raise CapacityError("Modelling data must be complete daily data.")
    return df


def _candidates(spec: SeriesSpec, reference: float) -> dict[str, tuple[str, str]]:
    """Name to (group, SQL text) for every candidate but the exponential means."""
    w = spec.over()
    load, net = TOTAL_LOAD, NET_INTAKE
    out: dict[str, tuple[str, str]] = {CURRENT: ("compact", load)}
    for k in (1, 2, 3, 7, 14, 28):
        out[f"load_lag_{k}"] = ("compact", f"lag({load}, {k}) {w}")
    signals = {
        "stock_a": STOCK_A, "stock_b": STOCK_B, "intake": INTAKE, "transfer": TRANSFER,
        "discharge": DISCHARGE, "net_intake": NET_INTAKE,
    }
    for name, column in signals.items():
        for k in (1, 7, 14, 28):
            out[f"{name}_lag_{k}"] = ("compact", f"lag({column}, {k}) {w}")
    for k in (7, 14, 28):
        group = "compact" if k < 28 else "expanded"
        past = spec.over_history(k)
        out[f"load_rolling_mean_{k}"] = (group, complete(f"avg({load})", load, past, k))
        out[f"load_rolling_std_{k}"] = (group, complete(f"stddev_pop({load})", load, past, k))
        out[f"load_rolling_slope_{k}"] = (group, rolling_slope(spec, load, k, "_pos"))
        out[f"net_rolling_mean_{k}"] = ("expanded", complete(f"avg({net})", net, past, k))
        out[f"net_rolling_std_{k}"] = ("expanded", complete(f"stddev_pop({net})", net, past, k))
    for k in (7, 14):
        out[f"cumulative_net_intake_{k}"] = (
            "compact", complete(f"sum({net})", net, spec.over_history(k), k)
        )
    out["load_momentum_1"] = ("compact", f"{load} - lag({load}, 1) {w}")
    out["load_momentum_7"] = ("compact", f"{load} - lag({load}, 7) {w}")
    out["load_acceleration"] = (
        "expanded", f"{load} - 2 * lag({load}, 1) {w} + lag({load}, 2) {w}"
    )
    out["backlog_streak_at_origin"] = ("compact", STREAK)
    out["capacity_utilization"] = ("compact", f"{load} / {float(reference)!r}D")
    out["capacity_headroom"] = ("compact", f"{float(reference)!r}D - {load}")
    parts = calendar_parts(spec.date)
    for name in ("calendar_day_of_week", "calendar_is_weekend"):
        out[name] = ("compact", parts[name])
    for name, text in calendar_cycles(spec.date).items():
        out[name] = ("compact", text)
    out["quality_is_imputed_date"] = ("compact", "is_imputed_date")
    out["quality_has_anomaly"] = ("compact", "has_anomaly")
    return out


EMAS = tuple((TOTAL_LOAD, k, f"load_ema_{k}") for k in (7, 14, 28))


def prepare_forecast(
    df: DataFrame, spec: SeriesSpec, config: ForecastConfig = ForecastConfig(), *, verify: bool = True
) -> Prepared:
    """Features known at the forecast origin, the seven-day target and context columns.

    Flows enter only through lags and histories that end at t-1; the current load is
    the one same-day stock. Rows without a target are dropped.
    """
    require_columns(
        df, [*spec.index, TOTAL_LOAD, STOCK_A, STOCK_B, INTAKE, TRANSFER, DISCHARGE, NET_INTAKE, STREAK]
    )
    if verify:
        require_complete(df, spec)
    imputed = IMPUTED_DATE if IMPUTED_DATE in df.columns else "false"
    names = [c for c in ("anomaly_transfer", "anomaly_discharge", "anomaly_negative") if c in df.columns]
    anomaly = "anomaly_any" if "anomaly_any" in df.columns else (" OR ".join(names) or "false")
    base = df.selectExpr(
        *spec.index, STOCK_A, STOCK_B, INTAKE, TRANSFER, DISCHARGE, TOTAL_LOAD, NET_INTAKE, STREAK,
        f"coalesce({imputed}, false) AS is_imputed_date",
        f"coalesce({anomaly}, false) AS has_anomaly",
        f"row_number() {spec.over()} AS _pos",
    )
    smooth = exponential_means(base, spec, EMAS, full_span=False)
    candidates = _candidates(spec, config.capacity_reference)
    candidates |= {name: ("expanded", name) for _, _, name in EMAS}
    h = config.horizon
    future = f"lead({TOTAL_LOAD}, {h}) {spec.over()}"
    goals = {
        TARGET: f"CAST({future} AS DOUBLE)",
        CHANGE: f"CAST({future} - {TOTAL_LOAD} AS DOUBLE)",
        "target_date": f"date_add({spec.date}, {h})",
        "net_intake_at_origin": NET_INTAKE,
        "backlog_state": f"{STREAK} > 0",
        "capacity_stress": f"{TOTAL_LOAD} / {float(config.capacity_reference)!r}D >= 0.8D",
    }
    doubles = {
        name: f"CAST({text} AS DOUBLE)"
        if name not in ("quality_is_imputed_date", "quality_has_anomaly")
        else f"CAST(CAST({text} AS INT) AS DOUBLE)"
        for name, (_, text) in candidates.items()
        if name not in {n for _, _, n in EMAS}
    }
    frame = add_sql(smooth, doubles | goals)
    expanded = tuple(candidates)
    compact = tuple(n for n, (group, _) in candidates.items() if group == "compact")
    forbidden = [n for n in expanded if "target" in n or "future" in n]
    if forbidden:
        raise CapacityError(f"{len(forbidden)} feature(s) carry a name of the future: {forbidden}")
    frame = frame.where(F.col(TARGET).isNotNull()).select(
        *spec.index, *expanded, TARGET, CHANGE, *CONTEXT
    )
    if verify:
        fewest = frame.groupBy(*spec.keys).count().agg(F.min("count")).first()[0] or 0
        if fewest < config.minimum_rows:
            raise CapacityError(f"A series has {fewest} days with a target; {config.minimum_rows} are needed.")
    return Prepared(frame, compact, expanded, spec, config)


def availability_manifest(prepared: Prepared) -> DataFrame:
    """When each feature becomes known, and why the targets are excluded."""
    spark = prepared.frame.sparkSession

    def when(name: str) -> str:
        tail = name.rsplit("_", 1)[-1]
        if name == CURRENT or name.startswith("load_momentum"):
            return "day t, at its end"
        if "_lag_" in name:
            return f"{tail} days before t"
        if "_ema_" in name:
            return "days before t"
        if "rolling" in name or name.startswith("cumulative"):
            return f"the {tail} days before t"
        if name.startswith("calendar_"):
            return "any time, from the calendar"
        return "day t"

    rows = [
        (n, "compact" if n in prepared.compact else "expanded", when(n), True,
         "known on day t")
        for n in prepared.expanded
    ]
    rows += [
        (TARGET, "excluded", "day t+7", False, "it is what is forecast"),
        (CHANGE, "excluded", "day t+7", False, "it follows from what is forecast"),
    ]
    return spark.createDataFrame(
        rows, "feature string, feature_group string, available_when string, included boolean, reason string"
    )


def exclusion_manifest(prepared: Prepared, source_columns: Sequence[str]) -> DataFrame:
    """Columns kept out of the matrix, with the code of the availability rule that keeps each out.

    The flows and stocks of the origin day come first, then what the names of ``source_columns`` say.
    """
    spark = prepared.frame.sparkSession
    own = [(c, 0, "same_day") for c in (INTAKE, TRANSFER, DISCHARGE, NET_INTAKE, STOCK_A, STOCK_B)]
    named = [(c, 1, availability_of(c)[0]) for c in source_columns]
    rows = own + [row for row in named if row[2] != "known"]
    return first_reasons(spark.createDataFrame(rows, "feature string, priority int, reason string"))


def first_reasons(*parts: DataFrame) -> DataFrame:
    """Union of (feature, priority, reason) lists, keeping the first reason per feature."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("feature").agg(F.min_by("reason", F.struct("priority", "reason")).alias("reason"))


def reconstruct(current: Column, change: Column) -> Column:
    return current + change


def partition_labels(
    df: DataFrame, spec: SeriesSpec, fraction: float = 0.2, gap: int = 7
) -> DataFrame:
    """Label each row development, embargo or holdout by its position in its series."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1.")
    if gap < 0:
        raise ValueError("gap must be non-negative.")
    n = F.count(F.lit(1)).over(spec.partition())
    placed = df.withColumns({"_n": n, "position": F.row_number().over(spec.ordered()) - 1})
    start = F.col("_n") - F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(fraction)))
    return placed.withColumn(
        "part",
        F.when(F.col("position") >= start, "holdout")
        .when(F.col("position") >= start - gap, "embargo")
        .otherwise("development"),
    ).drop("_n")


@dataclass(frozen=True)
class Fold:
    """Half-open row ranges: train [0, train_end), validation [start, end)."""

    number: int
    train_end: int
    start: int
    end: int


def expanding_folds(rows: int, config: ForecastConfig = ForecastConfig()) -> list[Fold]:
    """Equal validation blocks at the end of ``rows``, each a gap after its training rows."""
    size = config.fold_days
    if rows < config.folds * size + config.gap + 60:
        size = max(14, (rows - config.gap - 60) // config.folds)
    starts = [rows - (config.folds - i) * size for i in range(config.folds)]
    if starts[0] - config.gap < 1:
        raise CapacityError(f"{rows} days leave none to train on before {config.folds} folds of {size} days.")
    return [Fold(i + 1, s - config.gap, s, s + size) for i, s in enumerate(starts)]


@dataclass(frozen=True)
class DatedFold:
    """A fold as calendar dates, all inclusive. Number 0 is the final holdout split."""

    number: int
    train_last: dt.date
    first: dt.date
    last: dt.date


@dataclass(frozen=True)
class Calendar:
    """Partition and fold boundaries as dates: the same for every series of a panel."""

    first: dt.date
    development_last: dt.date
    holdout_first: dt.date
    last: dt.date
    folds: tuple[DatedFold, ...]

    @property
    def holdout(self) -> DatedFold:
        return DatedFold(0, self.development_last, self.holdout_first, self.last)


def plan_calendar(frame: DataFrame, spec: SeriesSpec, config: ForecastConfig) -> Calendar:
    """Turn row ranges into dates with one min/max aggregate.

    Rows are complete daily, so position and date carry the same information. Dates
    need no window, prune partitions, and keep a pooled panel free of time leakage.
    """
    first, last = frame.agg(F.min(spec.date), F.max(spec.date)).first()
    if first is None:
        raise CapacityError("No day has a target.")
    days = (last - first).days + 1
    holdout = max(1, math.ceil(days * config.holdout_fraction))
    start = days - holdout
    development = start - config.gap
    if development < config.minimum_development:
        raise CapacityError(f"{development} days lie before the gap; {config.minimum_development} are needed.")
    day = lambda i: first + dt.timedelta(days=i)
    folds = tuple(
        DatedFold(f.number, day(f.train_end - 1), day(f.start), day(f.end - 1))
        for f in expanding_folds(development, config)
    )
    return Calendar(first, day(development - 1), day(start), last, folds)


def assign_folds(frame: DataFrame, spec: SeriesSpec, folds: Sequence[DatedFold]) -> DataFrame:
    """One copy of a row per fold that uses it, with ``fold`` and ``role``.

    The fold table is a short literal array, so the range join is a filter inside the row.
    """
    entries = ", ".join(
        f"named_struct('fold', {f.number}, 't', DATE'{f.train_last}', "
        f"'a', DATE'{f.first}', 'b', DATE'{f.last}')"
        for f in folds
    )
    d = spec.date
    used = f"filter(array({entries}), f -> {d} <= f.t OR {d} BETWEEN f.a AND f.b)"
    roles = (
        f"transform({used}, f -> named_struct('fold', f.fold, 'role', "
        f"CASE WHEN {d} <= f.t THEN 'train' ELSE 'validation' END))"
    )
    return frame.selectExpr("*", f"inline({roles})")


def leakage_facts(frame: DataFrame, spec: SeriesSpec, folds: Sequence[DatedFold], horizon: int = 7) -> DataFrame:
    """Per fold, from the rows themselves: training and validation rows, their border days, the days
    between, whether the last training label was known before validation began, and how many labels
    aren't the load ``horizon`` days later."""
    later = F.lead(CURRENT, horizon).over(Window.partitionBy(*spec.keys).orderBy(spec.date))
    rows = assign_folds(frame.withColumn("_later", later), spec, folds)
    train, held = F.col("role") == "train", F.col("role") == "validation"
    facts = rows.groupBy("fold").agg(
        F.count_if(train).alias("training_rows"),
        F.count_if(held).alias("validation_rows"),
        F.max(F.when(train, F.col(spec.date))).alias("last_training_day"),
        F.min(F.when(held, F.col(spec.date))).alias("first_validation_day"),
        F.count_if(F.coalesce(F.col("_later") != F.col(TARGET), F.lit(False))).alias("label_faults"),
    )
    between = F.datediff("first_validation_day", "last_training_day")
    return facts.withColumns({"gap_days": between - 1, "labels_known": between > horizon})


def leakage_audit(prepared: Prepared, calendar: Calendar) -> dict[str, bool]:
    """What must hold before models are fitted, from feature names and from the rows of every fold."""
    names, config = set(prepared.expanded), prepared.config
    folds = [calendar.holdout, *calendar.folds]
    facts = {f.fold: f for f in leakage_facts(prepared.frame, prepared.spec, folds, config.horizon).collect()}
    return {
        "no_feature_is_named_after_the_future": not any(w in n for n in names for w in ("target", "future", "lead")),
        "flows_of_the_origin_day_are_no_features": names.isdisjoint((INTAKE, TRANSFER, DISCHARGE, NET_INTAKE)),
        "labels_are_the_load_of_the_horizon": all(f.label_faults == 0 for f in facts.values()),
        "labels_were_known_before_validation": all(f.labels_known for f in facts.values()),
        "gaps_are_kept": all(f.gap_days >= config.gap for f in facts.values()),
        "folds_end_before_the_holdout": all(f.last < facts[0].first_validation_day for f in calendar.folds),
        "every_fold_has_both_parts": all(f.training_rows and f.validation_rows for f in facts.values()),
    }
