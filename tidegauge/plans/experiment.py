"""Walk-forward experiment, single-model run, smoke pipeline, verification and monitoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.compare import Tolerance, fingerprint, first_difference, located_differences
from tidegauge.operators.forecast import boosted as B
from tidegauge.operators.forecast import ensemble as N
from tidegauge.operators.forecast import evaluate as V
from tidegauge.operators.forecast import gate as G
from tidegauge.operators.forecast import hybrid as H
from tidegauge.operators.forecast import importance as M
from tidegauge.operators.forecast import intervals as I
from tidegauge.operators.forecast import ledger as K
from tidegauge.operators.forecast import linear as L
from tidegauge.operators.forecast import monitor as O
from tidegauge.operators.forecast import prepare as P
from tidegauge.operators.forecast.smoothing import smoothing_forecasts, too_short
from tidegauge.session import cut_lineage
from tidegauge.spec import CapacityError, SeriesSpec

RIDGE_ALPHAS = (10.0, 100.0)
NET_GRID = ((0.01, 0.2), (0.01, 0.5), (0.1, 0.2), (0.1, 0.5))


@dataclass
class Experiment:
    """Everything a run produced; tables are lazy over checkpointed predictions."""

    prepared: P.Prepared
    calendar: P.Calendar
    predictions: DataFrame
    scores: DataFrame
    decision: G.Decision
    weights: dict[str, float]
    interval_metrics: DataFrame
    importance: DataFrame
    importance_model: str
    boosted_importance: DataFrame | None = None
    leakage: dict[str, bool] = field(default_factory=dict)
    ledger: DataFrame | None = None
    unsmoothed: DataFrame | None = None  # series and folds too short for smoothing, with the reason

    @property
    def oof(self) -> DataFrame:
        return self.predictions.where("fold <> 'holdout'")

    @property
    def holdout(self) -> DataFrame:
        return self.predictions.where("fold = 'holdout'")


def linear_candidates(
    sums: dict[int, L.FoldSums], groups: dict[str, Sequence[str]], config: P.ForecastConfig,
    ridge_alphas: Sequence[float] = RIDGE_ALPHAS, net_grid: Sequence[tuple[float, float]] = NET_GRID,
) -> dict[tuple[str, str], dict[int, L.LinearModel]]:
    """Every ridge and elastic-net candidate for every fold, from the same sums."""
    found: dict[tuple[str, str], dict[int, L.LinearModel]] = {}
    for group, columns in groups.items():
        fitted = {
            f: L.fit_processor(s, columns, config.missing_limit, config.correlation_limit)
            for f, s in sums.items()
        }
        for alpha in ridge_alphas:
            found["ridge", f"{group}_a{alpha:g}"] = {
                f: L.ridge(s, fitted[f], alpha) for f, s in sums.items()
            }
        for alpha, ratio in net_grid:
            found["elastic_net", f"{group}_a{alpha:g}_r{ratio:g}"] = {
                f: L.elastic_net(s, fitted[f], alpha, ratio) for f, s in sums.items()
            }
    return found


def _label(fold_zero: str = "final_holdout"):
    return F.when(F.col("fold") == "holdout", fold_zero).otherwise("development_oof")


def baseline_predictions(held: DataFrame, spec: SeriesSpec) -> DataFrame:
    forecasts = {"persistence": V.persistence(), "seven_day_drift": V.drift()}
    return V.stacked_predictions(held, spec, forecasts, "")


def _context(spec: SeriesSpec) -> list[str]:
    return [*spec.index, "fold", P.TARGET, P.CURRENT, *P.CONTEXT]


def linear_predictions(
    held: DataFrame, spec: SeriesSpec, candidates: dict[tuple[str, str], dict[int, L.LinearModel]]
) -> DataFrame:
    """Long predictions of all linear candidates in one pass over the held rows."""
    scored = L.predict_candidates(held, list(candidates.values()), _context(spec))
    long = scored.select("*", F.posexplode("_changes").alias("_i", "_change"))
    names, settings = (F.array(*[F.lit(k[j]) for k in candidates]) for j in (0, 1))
    return V.prediction_rows(
        long, spec, P.reconstruct(F.col(P.CURRENT), F.col("_change")),
        F.element_at(names, F.col("_i") + 1), "", F.element_at(settings, F.col("_i") + 1),
    )


def boosted_predictions(
    rows: DataFrame, spec: SeriesSpec, processors: dict[int, L.Processor], config: B.BoostConfig,
    model: str = "boosted_trees", target: str = P.CHANGE,
) -> tuple[DataFrame, dict]:
    models = B.boost_folds(rows, processors, target, config)
    keep = [c for c in rows.columns if c not in ("role", "prediction")]
    held = B.predict_boosted(rows, processors, models, keep)
    out = V.prediction_rows(
        held, spec, P.reconstruct(F.col(P.CURRENT), F.col("prediction")), model, "", config.name
    )
    return out, models


def run_experiment(
    metrics: DataFrame, spec: SeriesSpec, config: P.ForecastConfig = P.ForecastConfig(), *,
    boosters: Sequence[B.BoostConfig] = (), smoothing: bool = True, hybrid: bool = True,
    verify: bool = True,
) -> Experiment:
    """All candidates, a residual hybrid, selection on out-of-fold rows, blend, intervals and the gate.

    Models are pooled over the panel; with one series that is one model per series.
    Fold 0 trains on all development days and predicts the holdout, so the final refit
    shares every pass with the folds. Selection never reads fold 0.
    """
    prepared = P.prepare_forecast(metrics, spec, config, verify=verify)
    frame = cut_lineage(prepared.frame)
    prepared = P.Prepared(frame, prepared.compact, prepared.expanded, spec, config)
    calendar = P.plan_calendar(frame, spec, config)
    leakage = P.leakage_audit(prepared, calendar)
    if not all(leakage.values()):
        raise CapacityError("Leakage audit failed before any model was fitted.")
    folds = [calendar.holdout, *calendar.folds]
    rows = P.assign_folds(frame, spec, folds)
    train, held = rows.where("role = 'train'"), rows.where("role = 'validation'")
    sums = L.fold_sums(train, prepared.expanded, P.CHANGE, spec.date)
    groups = {"compact": prepared.compact, "expanded": prepared.expanded}
    candidates = linear_candidates(sums, groups, config)
    parts = [baseline_predictions(held, spec), linear_predictions(held, spec, candidates)]
    if smoothing:
        smooth = smoothing_forecasts(rows, spec, folds)
        parts.append(
            V.prediction_rows(
                smooth, spec, P.reconstruct(F.col(P.CURRENT), F.col("predicted_change")),
                "exponential_smoothing", "", "damped_weekly_grid",
            )
        )
    processors = {
        f: L.fit_processor(s, prepared.compact, config.missing_limit, config.correlation_limit)
        for f, s in sums.items()
    }
    boosted_importance = None
    for booster in boosters:
        out, models = boosted_predictions(rows, spec, processors, booster)
        parts.append(out)
        boosted_importance = B.gain_importance(models[0], processors[0], frame.sparkSession)
    every = cut_lineage(V.union_predictions(parts).withColumn("evaluation_label", _label()))

    common = V.shared_origins(every.where("fold <> 'holdout'"), spec)
    scores = V.candidate_scores(V.fold_table(common, calendar))
    best = V.select_best(scores).collect()
    chosen = every.where(
        F.concat_ws("|", "model_name", "configuration").isin(
            [f"{b.model_name}|{b.configuration}" for b in best]
        )
    )
    mixed = None
    if hybrid:
        base = "exponential_smoothing" if smoothing else "seven_day_drift"
        mixed = H.residual_hybrid(
            chosen.where(F.col("model_name") == base), frame, spec, calendar, config,
            H.correctors(groups, RIDGE_ALPHAS), f"{base}_hybrid",
        )
        chosen = cut_lineage(chosen.unionByName(mixed.predictions))
    oof = chosen.where("fold <> 'holdout'")
    ranks = V.candidate_scores(V.fold_table(V.shared_origins(oof, spec), calendar))
    ranked = [r.model_name for r in ranks.orderBy("mean_mae", "std_mae", "model_name").collect()]
    members = N.choose_members(oof, spec, ranked)
    weights = N.best_weights(V.align_models(oof, spec, members), members)
    parts = [chosen, N.blend(chosen, spec, weights)]
    if mixed is not None:
        parts.append(mixed.inner)
    final = cut_lineage(V.union_predictions(parts))

    outer = final.where(F.col("evaluation_label") != H.INNER_LABEL)
    table = V.candidate_scores(V.fold_table(outer.where("fold <> 'holdout'"), calendar))
    challenger = (
        table.where("model_name <> 'persistence'").orderBy("mean_mae", "model_name").first().model_name
    )
    late = outer.where("fold = 'holdout'")
    linear_best = min(
        (b for b in best if b.model_name in ("ridge", "elastic_net")),
        key=lambda b: (b.mean_mae, b.model_name),
    )
    models = candidates[linear_best.model_name, linear_best.configuration]
    labels = [str(f.number) for f in calendar.folds] + ["holdout"]
    own = outer.where(F.col("model_name") == challenger)
    entries = [
        K.fitted_statistics(frame.sparkSession, "linear", sums, processors, models),
        K.interval_residuals(I.earlier_residuals(own.where("fold <> 'holdout'"), own, spec, labels), labels),
    ]
    if mixed is not None:
        entries.append(K.fitted_statistics(frame.sparkSession, "hybrid", mixed.sums, mixed.processors, mixed.models))
    if boosters:
        entries.append(K.trained_rows(train, spec, "boosted_trees", "trees", "all"))
    ledger = cut_lineage(K.audited(V.union_predictions(entries), folds, config.horizon))
    leakage["fitted_statistics_end_before_their_fold"] = ledger.where("late").isEmpty()
    decision = G.promotion_decision(
        outer.where("fold <> 'holdout'"), late, spec, challenger, all(leakage.values()),
        config.worst_fold_ratio,
    )
    banded = I.residual_intervals(own.where("fold <> 'holdout'"), own, spec, labels)
    delta = I.conformal_adjustment(banded.where("fold <> 'holdout'"), spec)
    widened = I.widen(banded, delta, spec)
    interval_metrics = I.coverage_metrics(widened, ["evaluation_label"])
    with_bounds = I.attach_intervals(own, widened, spec).select(*final.columns)
    predictions = final.where(F.col("model_name") != challenger).unionByName(with_bounds)

    importance = M.permutation_importance(
        held.where("fold > 0"), spec, {f: m for f, m in models.items() if f > 0}, P.CHANGE, config.seed
    )
    return Experiment(
        prepared, calendar, cut_lineage(predictions), table, decision, weights, interval_metrics,
        importance, linear_best.model_name, boosted_importance, leakage, ledger,
        too_short(rows, spec) if smoothing else None,
    )


def comparison(experiment: Experiment) -> DataFrame:
    """Walk-forward scores and holdout metrics per model."""
    late = V.regression_metrics(experiment.holdout, ["model_name"])
    return V.comparison_table(experiment.scores, late)


def single_model_run(
    metrics: DataFrame, spec: SeriesSpec, config: P.ForecastConfig = P.ForecastConfig(),
    grid: Sequence[B.BoostConfig] = (B.BoostConfig("absolute"), B.BoostConfig("squared")),
) -> tuple[DataFrame, dict, DataFrame]:
    """Boosted trees alone: small grid, final fit, importance and the two-part rule."""
    prepared = P.prepare_forecast(metrics, spec, config)
    frame = cut_lineage(prepared.frame)
    calendar = P.plan_calendar(frame, spec, config)
    rows = P.assign_folds(frame, spec, [calendar.holdout, *calendar.folds])
    sums = L.fold_sums(rows.where("role = 'train'"), prepared.compact, P.CHANGE)
    processors = {
        f: L.fit_processor(s, prepared.compact, config.missing_limit, config.correlation_limit)
        for f, s in sums.items()
    }
    held = rows.where("role = 'validation'")
    parts, fitted = [baseline_predictions(held, spec)], {}
    for booster in grid:
        out, fitted[booster.name] = boosted_predictions(rows, spec, processors, booster)
        parts.append(out)
    predictions = cut_lineage(V.union_predictions(parts))
    scores = V.candidate_scores(V.fold_table(predictions.where("fold <> 'holdout'"), calendar))
    best = {b.model_name: b for b in V.select_best(scores).collect()}
    late = {
        (r.model_name, r.configuration): r.mae
        for r in V.regression_metrics(
            predictions.where("fold = 'holdout'"), ["model_name", "configuration"]
        ).collect()
    }
    own, base = best["boosted_trees"], best["persistence"]
    decision = G.two_part_decision(
        own.mean_mae, base.mean_mae, late["boosted_trees", own.configuration],
        late["persistence", base.configuration], "boosted_trees",
    )
    importance = B.gain_importance(
        fitted[own.configuration][0], processors[0], frame.sparkSession
    )
    return predictions, decision, importance


def smoke_pipeline(metrics: DataFrame, spec: SeriesSpec = SeriesSpec(), alpha: float = 100.0) -> dict:
    """Four folds of 28 days, ridge on the last fold, interval of one persistence error."""
    config = P.ForecastConfig(folds=4, fold_days=28)
    prepared = P.prepare_forecast(metrics, spec, config)
    frame = prepared.frame.persist()
    try:
        calendar = P.plan_calendar(frame, spec, config)
        last = calendar.folds[-1]
        rows = P.assign_folds(frame, spec, [last])
        sums = L.fold_sums(rows.where("role = 'train'"), prepared.compact, P.CHANGE)[last.number]
        processor = L.fit_processor(sums, prepared.compact)
        model = L.ridge(sums, processor, alpha)
        held = rows.where("role = 'validation'").withColumn(
            "_forecast", P.reconstruct(F.col(P.CURRENT), F.expr(model.sql()))
        )
        found = V.error_aggregates(F.col(P.TARGET), F.col("_forecast"), F.col(P.CURRENT))
        metrics_row = held.agg(*[c.alias(n) for n, c in found.items()]).first().asDict()
        base = metrics_row["persistence_mae"]
        inside = (F.abs(F.col(P.TARGET) - F.col("_forecast")) <= base).cast("double")
        coverage = held.agg((F.avg(inside) * 100).alias("c")).first().c
    finally:
        frame.unpersist()
    return {
        "metrics": metrics_row,
        "interval_coverage_percent": coverage,
        "selected_features": processor.selected,
        "leakage_passed": all(P.leakage_audit(prepared, calendar).values()),
    }


def verify_pipeline(
    regenerated: dict[str, DataFrame], stored: dict[str, DataFrame], spec: SeriesSpec,
    exact: dict[str, Sequence[str]] | None = None, tolerance: dict[str, Tolerance] | None = None,
) -> dict[str, str | None]:
    """First difference per layer between rebuilt and stored tables; None means equal."""
    out: dict[str, str | None] = {}
    for name, table in stored.items():
        if name not in regenerated:
            out[name] = "layer was not regenerated"
            continue
        out[name] = first_difference(
            regenerated[name], table, spec.index, (tolerance or {}).get(name, Tolerance()),
            (exact or {}).get(name, ()),
        )
    return out


def locate_layers(
    regenerated: Mapping[str, DataFrame], stored: Mapping[str, DataFrame], spec: SeriesSpec,
    tolerance: Tolerance = Tolerance(),
) -> DataFrame:
    """Years, months and columns in which stored layers differ from rebuilt ones; equal layers give no row."""
    ranges = {"in_year": F.year(spec.date), "in_month": F.date_format(spec.date, "yyyy-MM")}
    parts = [
        located_differences(regenerated[name], table, spec.index, ranges, tolerance).withColumn("layer", F.lit(name))
        for name, table in stored.items()
    ]
    return V.union_predictions(parts)


def verify_predictions(predictions: DataFrame, champion: str, promoted: str) -> dict[str, bool]:
    """Schema, finiteness and champion agreement of stored predictions."""
    V.check_predictions(predictions)
    return {
        "champion_agrees": champion == promoted,
        "champion_present": not predictions.where(F.col("model_name") == champion).isEmpty(),
    }


def monitor(
    predictions: DataFrame, spec: SeriesSpec, registry: O.Registry, config: O.MonitorConfig = O.MonitorConfig()
) -> DataFrame:
    """Rolling metrics, drift flags and the fallback decision per series."""
    found = O.monitoring_metrics(predictions, spec, registry.champion, config)
    return O.fallback_decision(found, registry, config)


__all__ = [
    "Experiment", "comparison", "fingerprint", "locate_layers", "monitor", "run_experiment", "single_model_run",
    "smoke_pipeline", "verify_pipeline", "verify_predictions",
]
