import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.compare import fingerprint, first_difference
from tidegauge.operators.forecast import ensemble as N
from tidegauge.operators.forecast import evaluate as V
from tidegauge.operators.forecast import gate as G
from tidegauge.operators.forecast import intervals as I
from tidegauge.operators.forecast import linear as L
from tidegauge.operators.forecast import monitor as O
from tidegauge.operators.forecast import prepare as P
from tidegauge.operators.forecast.importance import partner, row_numbers
from tidegauge.plans import experiment as X
from tidegauge.spec import CapacityError, SeriesSpec

SPEC = SeriesSpec()


@pytest.fixture(scope="module")
def prepared(source):
    return P.prepare_forecast(source, SPEC)


def test_change_target_and_baselines(spark):
    df = spark.createDataFrame([(100.0, 90.0, 108.0), (120.0, 125.0, 105.0)], ["current_total_load", "load_lag_7", "future"])
    rows = df.select(V.persistence(), V.drift(), F.col("future") - F.col("current_total_load")).collect()
    assert [tuple(r) for r in rows] == [(100.0, 110.0, 8.0), (120.0, 115.0, -15.0)]


def test_partitions_and_folds(prepared):
    calendar = P.plan_calendar(prepared.frame, SPEC, P.ForecastConfig(folds=4, fold_days=28))
    assert (calendar.holdout_first - calendar.development_last).days == 8
    assert all((f.first - f.train_last).days == 8 for f in calendar.folds)
    assert all((f.last - f.first).days == 27 for f in calendar.folds)
    assert calendar.folds[-1].last == calendar.development_last
    assert all(P.leakage_audit(prepared, calendar).values())
    labels = P.partition_labels(prepared.frame.select("date"), SPEC).groupBy("part").count()
    found = {r["part"]: r["count"] for r in labels.collect()}
    assert found == {"development": 403, "embargo": 7, "holdout": 103}
    with pytest.raises(CapacityError):
        P.expanding_folds(20)


def test_incomplete_or_short_series_are_refused(source):
    with pytest.raises(CapacityError, match="complete"):
        P.prepare_forecast(source.where("date <> '2023-03-03'"), SPEC)
    with pytest.raises(CapacityError, match="days with a target|No day has a target"):
        P.prepare_forecast(source.where("date < '2023-06-01'"), SPEC)


def test_processor_drops_copies_and_fills(spark):
    rows = [(1, float(i), 2.0 * i, float(i % 5) if i % 2 else None, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, y double").where("a < 15")
    sums = L.fold_sums(df, ["a", "b", "c"], "y")[1]
    fitted = L.fit_processor(sums, ["a", "b", "c"], 0.6, 0.95)
    assert fitted.selected == ["a", "c"] and "with a" in fitted.reasons["b"]
    assert fitted.medians["c"] == 2.0


def _problem(spark, n=200):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [5, 0, 100]
    y = x @ [1.0, -0.3, 4.0] + rng.normal(size=n)
    rows = [(1, *map(float, r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, y double"), x, y


def test_ridge_and_elastic_net_match_their_objectives(spark):
    df, x, y = _problem(spark)
    names = ["a", "b", "c"]
    sums = L.fold_sums(df, names, "y")[1]
    fitted = L.fit_processor(sums, names)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    model = L.ridge(sums, fitted, 10.0)
    np.testing.assert_allclose([model.weights[c] for c in names], w / x.std(0), rtol=1e-8)
    want = y.mean() + z @ w
    got = df.select(F.expr(model.sql()).alias("p")).toPandas().p
    np.testing.assert_allclose(np.sort(got), np.sort(want), rtol=1e-9)
    scored = L.predict_candidates(df, [{1: model}], ["y"]).toPandas()
    np.testing.assert_allclose(np.sort([p[0] for p in scored._changes]), np.sort(want), rtol=1e-9)
    net = L.elastic_net(sums, fitted, 0.1, 0.5)
    v = np.array([net.weights[c] for c in names]) * x.std(0)
    slope = z.T @ (y - y.mean() - z @ v) / len(y) - 0.1 * 0.5 * v
    active = v != 0
    np.testing.assert_allclose(slope[active], 0.05 * np.sign(v[active]), atol=1e-6)
    assert (np.abs(slope[~active]) <= 0.05 + 1e-9).all()


def _predictions(spark, columns):
    """Prediction rows of several models: {model: forecasts}, actual given once."""
    day = dt.date(2024, 1, 1)
    actual = columns.pop("actual")
    rows = []
    for model, values in columns.items():
        for i, (a, f) in enumerate(zip(actual, values)):
            d = day + dt.timedelta(days=i)
            rows.append((d, d + dt.timedelta(days=7), float(a), 0.0, model, 0.0, float(f), float(a) + 4,
                         float(f) - 1.0, float(f), float(f) + 1.0, "x", str(1 + i % 2), False, False, False, False, "default"))
    names = [*V.PREDICTION_COLUMNS, "configuration"]
    kinds = "date,date,double,double,string,double,double,double,double,double,double,string,string,boolean,boolean,boolean,boolean,string"
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split(",")))
    return spark.createDataFrame(rows, schema)


def test_metrics_micro_values(spark):
    df = _predictions(spark, {"actual": [10, 20, 30], "m": [11, 18, 33]})
    row = V.regression_metrics(df, ["model_name"]).first()
    assert row.mae == 2 and row.mase_vs_persistence == 0.5
    assert row.mae_improvement_vs_persistence_percent == 50
    V.check_predictions(df)
    with pytest.raises(CapacityError, match="non-finite"):
        V.check_predictions(df.withColumn("actual_value", F.lit(float("nan"))))
    with pytest.raises(CapacityError, match="crossing"):
        V.check_predictions(df.withColumn("lower_interval", F.lit(1e9)))


def test_interval_order_and_residuals(spark):
    df = spark.createDataFrame([(120.0, 100.0, 110.0), (70.0, 90.0, 80.0)], ["l", "m", "u"])
    rows = df.select(I.ordered_interval(F.col("l"), F.col("m"), F.col("u")).alias("i")).select("i.*").collect()
    assert [tuple(r) for r in rows] == [(100.0, 110.0, 120.0), (70.0, 80.0, 90.0)]
    a = spark.createDataFrame([(1, 10.0), (2, 12.0), (3, 15.0), (4, 14.0)], ["date", "actual"])
    p = spark.createDataFrame([(1, 9.0), (2, 13.0), (3, 13.0)], ["date", "prediction"])
    assert [r.residual for r in V.oof_residuals(a, p, ["date"]).orderBy("date").collect()] == [1, -1, 2]
    with pytest.raises(CapacityError):
        V.oof_residuals(a.union(a), p, ["date"])
    held = a.withColumnRenamed("actual", "actual_value")
    theirs = p.withColumn("actual", F.col("prediction"))
    with pytest.raises(CapacityError, match="miss 1"):
        V.coverage_checked(held, theirs, ["date"])


def test_conformal_rank_is_the_higher_order_statistic(spark):
    scores = np.array([0, 3, 1, 7, 2, 9, 4, 4, 0, 5], float)
    df = _predictions(spark, {"actual": scores, "m": np.zeros(10)}).withColumns(
        {"lower_interval": F.lit(-1.0), "upper_interval": F.lit(0.0)}
    )
    cut = scores[:8]
    level = min(1.0, np.ceil(9 * 0.8) / 8)
    want = np.quantile(cut, level, method="higher")
    assert I.conformal_adjustment(df, SPEC).first().conformal_adjustment == want


def test_weights_are_convex_and_pick_the_perfect_model(spark):
    actual = np.arange(1.0, 5.0)
    df = _predictions(spark, {"actual": actual, "a": actual, "b": np.full(4, 2.0), "c": actual + 0.5})
    aligned = V.align_models(df, SPEC, ["a", "b", "c"])
    weights = N.best_weights(aligned, ["a", "b", "c"])
    assert sum(weights.values()) == pytest.approx(1) and min(weights.values()) >= 0
    assert weights["a"] == 1 and weights == N.best_weights(aligned, ["a", "b", "c"])
    assert len(N.weight_grid(2)) == 21 and len(N.weight_grid(3)) == 231


def test_gate(spark):
    good = _predictions(spark, {"actual": range(40), "persistence": np.arange(40) + 3.0, "m": np.arange(40) + 1.0})
    decision = G.promotion_decision(good, good, SPEC, "m", True)
    assert decision.passed and decision.champion == "m" and decision.fold_wins == 2
    assert not G.promotion_decision(good, good, SPEC, "m", False).passed
    assert G.two_part_decision(1, 2, 3, 2, "m")["champion_model"] == "persistence"


def test_monitor_paths(spark):
    rng = np.random.default_rng(1)
    actual = 100 + rng.normal(size=60)
    df = _predictions(spark, {"actual": actual, "persistence": actual + 2, "m": actual + 1})
    ok = X.monitor(df, SPEC, O.Registry("m", True, "m", available=("m",))).first()
    assert ok.model_status == "approved" and ok.active_model == "m" and ok.rolling_mase == pytest.approx(0.5)
    status = lambda *a, **k: X.monitor(df, SPEC, O.Registry(*a, **k)).first()
    assert status("m", False, "m", available=("m",)).active_model == "persistence"
    assert status("m", True, "x", available=("m",)).reason.startswith("registry_mismatch")
    assert status("m", True, "m").reason == "missing_artifact: m"
    worse = _predictions(spark, {"actual": actual, "persistence": actual + 1, "m": actual + 2})
    row = X.monitor(worse, SPEC, O.Registry("m", True, "m", available=("m",)))
    assert row.first().model_status == "degraded"
    assert O.fallback_events(row, SPEC).first().event_type == "degradation_and_fallback"


def test_stability_index_matches_a_histogram(spark):
    rng = np.random.default_rng(5)
    old, new = rng.normal(size=100), rng.normal(0.5, size=80)
    rows = [(float(v), True) for v in old] + [(float(v), False) for v in new]
    df = spark.createDataFrame(rows, ["v", "early"])
    edges = np.unique(np.quantile(old, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r, q = (np.maximum(np.histogram(x, edges)[0] / len(x), 1e-6) for x in (old, new))
    got = O.stability_index(df, SPEC, F.col("v"), F.col("early")).first().input_psi
    assert got == pytest.approx(float(np.sum((q - r) * np.log(q / r))))
    few = df.limit(15)
    assert O.stability_index(few, SPEC, F.col("v"), F.col("early")).first().input_psi == 0


def test_monitor_state_in_parts_equals_one_run(spark):
    rng = np.random.default_rng(11)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(90)]
    cells = [
        ("k", d, float(v), float(v + e), 90.0, 110.0, bool(k % 5 == 0), float(v), float(v + 2))
        for k, (d, v, e) in enumerate(zip(days, rng.normal(100, 9, 90), rng.normal(0, 4, 90)))
    ]
    schema = "series string, forecast_origin_date date, current_load double, actual_value double, lower_interval double, upper_interval double, is_imputed_date boolean, champion double, persistence double"
    rows, spec = spark.createDataFrame(cells, schema), SeriesSpec.of("series")
    early = rows.where("forecast_origin_date < '2024-02-15'")
    later = rows.where("forecast_origin_date >= '2024-02-15'")
    opened = O.open_state(early, spec)
    once = O.state_metrics(O.updated_state(opened, later, spec), spec).first().asDict()
    state = O.updated_state(opened, later.where("forecast_origin_date < '2024-03-01'"), spec)
    state = O.updated_state(state, later.where("forecast_origin_date < '2024-03-05'"), spec)  # days of the first batch again
    state = O.updated_state(state, later.limit(0), spec)
    state = O.updated_state(state, later, spec)
    parts = O.state_metrics(state, spec).first().asDict()
    assert {k: round(v, 9) if isinstance(v, float) else v for k, v in parts.items()} == {k: round(v, 9) if isinstance(v, float) else v for k, v in once.items()}
    assert state.first().recent_rows == 45 and len(state.first().ring) == 30 and once["rolling_window"] == 30
    last = rows.orderBy(F.col("forecast_origin_date").desc()).limit(30).toPandas()
    assert abs(once["rolling_mae"] - (last.actual_value - last.champion).abs().mean()) < 1e-9
    assert once["input_psi"] > 0 and O.state_metrics(O.open_state(early.limit(5), spec), spec).first().input_psi == 0
    assert O.open_state(rows.limit(0), spec).isEmpty()
    plain = O.state_metrics(O.updated_state(O.open_state(early.drop("series"), SPEC), later.drop("series"), SPEC), SPEC).first().asDict()
    assert round(plain["residual_shift"], 9) == round(once["residual_shift"], 9)


def test_partners_are_a_keyed_bijection(spark):
    """Every row has one partner, whatever the count; another key pairs otherwise."""
    for n in (1, 2, 3, 7, 64, 1000, 4099):
        rows = spark.range(n).selectExpr("id", f"{n}L AS n").select("id", partner("id", "n", "17").alias("a"), partner("id", "n", "18").alias("b")).collect()
        assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
    assert sum(r.a == r.b for r in rows) < 20 and sum(r.a == r.id for r in rows) < 20
    # neighbours are torn apart
    near = sum(abs(x.a - y.a) < 40 for x, y in zip(rows, rows[1:]))
    assert near < 200


def test_row_numbers_count_on_over_buckets(spark):
    df = spark.range(500).selectExpr("id % 2 AS g", "id DIV 90 AS b", "499 - id AS k", "id")
    got = row_numbers(df, ["g"], ["b"], ["k"], "at", "n").collect()
    for g in (0, 1):
        want = sorted((r for r in got if r.g == g), key=lambda r: (r.b, r.k))
        assert [r.at for r in want] == list(range(250)) and {r.n for r in want} == {250}
    assert row_numbers(df.limit(0), ["g"], ["b"], ["k"], "at", "n").isEmpty()


def test_smoothing_grid_equals_the_plain_recursion():
    import numpy as np

    from tidegauge.operators.forecast.smoothing import GRID, smooth

    def plain(values, alpha, beta, gamma, steps):
        level, trend, sse = sum(values[:7]) / 7, 0.0, 0.0
        season = [v - level for v in values[:7]]
        for i, y in enumerate(values):
            s, ahead = season[i % 7], level + 0.9 * trend
            sse += (y - ahead - s) ** 2
            season[i % 7] = gamma * (y - ahead) + (1 - gamma) * s
            new = alpha * (y - s) + (1 - alpha) * ahead
            level, trend = new, beta * (new - level) + (1 - beta) * 0.9 * trend
        out = []
        for h in range(steps):
            out.append(level + trend * sum(0.9**k for k in range(1, h + 2)) + season[(len(values) + h) % 7])
        return sse, out

    values = np.random.default_rng(3).normal(50, 9, 131).round(2)
    errors, paths = smooth(values, np.array(GRID), 20)
    for i, point in enumerate(GRID):
        sse, path = plain(values.tolist(), *point, 20)
        assert abs(errors[i] - sse) < 1e-7 * sse and np.allclose(paths[:, i], path, rtol=1e-10)


def test_differences_are_located_by_range(spark):
    from tidegauge.operators.compare import located_differences

    df = spark.range(400).selectExpr("id", "id * 0.5 AS v", "if(id % 7 = 0, null, 'x') AS s")
    ranges = {"hundred": F.expr("id DIV 100"), "ten": F.expr("id DIV 10")}
    find = lambda other: sorted(map(tuple, located_differences(df, other, ["id"], ranges).collect()))
    assert find(df.repartition(5)) == [] and find(df.withColumn("v", F.col("v") + 1e-12)) == []
    off = df.withColumn("v", F.when(F.col("id") == 123, 0.0).otherwise(F.col("v"))).where("id <> 399")
    off = off.withColumn("s", F.when(F.col("id") == 21, "x").otherwise(F.col("s"))).unionByName(off.limit(1).withColumn("id", F.lit(1000)))
    assert find(off) == [
        ("0", "2", "s", 0, 0, 1, 0), ("1", "12", "v", 0, 0, 0, 1), ("10", "100", "(rows)", 0, 1, 0, 0), ("3", "39", "(rows)", 1, 0, 0, 0),
    ]
    none = df.limit(0)
    assert located_differences(none, none, ["id"], ranges).isEmpty()
    assert find(none) == sorted((str(k // 10), str(k), "(rows)", 10, 0, 0, 0) for k in range(40))
    with pytest.raises(CapacityError):
        located_differences(df, df.drop("s"), ["id"], ranges)


def test_fingerprint_properties(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 0.0, "x")], "k int, v double, s string")
    same = lambda other: fingerprint(df).first() == fingerprint(other).first()
    assert same(df.repartition(5)) and same(df.withColumn("v", F.col("v") + 1e-12))
    assert same(df.withColumn("v", F.when(F.col("v") == 0, F.lit(-0.0)).otherwise(F.col("v"))))
    assert not same(df.withColumn("v", F.col("v") + 1e-4)) and not same(df.select("v", "k", "s"))
    assert not same(df.withColumnRenamed("v", "w")) and not same(df.withColumn("s", F.lit("x")))


def test_equivalence_reports_the_first_difference(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, None, False)], "k int, v double, b boolean")
    diff = lambda other, **kw: first_difference(other, df, ["k"], **kw)
    assert diff(df.withColumn("v", F.col("v") + 1e-12)) is None
    assert "values changed in column 'v'" in diff(df.withColumn("v", F.col("v") + 1e-4))
    assert "values" in diff(df.withColumn("v", F.col("v") + 1e-12), exact=["v"])
    assert "missing-value" in diff(df.withColumn("v", F.lit(1.0)))
    assert diff(df.select("v", "k", "b")).startswith("column order")
    assert diff(df.withColumn("b", F.col("b").cast("string"))).startswith("schema")
    assert diff(df.limit(1)) == "row count changed"
    assert diff(df.withColumn("k", F.col("k") + 5)) == "row keys changed"


def test_smoke_pipeline_repeats(source):
    a, b = X.smoke_pipeline(source), X.smoke_pipeline(source)
    assert a == b and a["leakage_passed"] and a["metrics"]["rows"] == 28


def test_experiment_selects_without_the_holdout(source):
    config = P.ForecastConfig(folds=4, fold_days=28)
    run = X.run_experiment(source, SPEC, config, hybrid=True)
    V.check_predictions(run.predictions.where("lower_interval is not null"))
    assert all(run.leakage.values())
    models = {r.model_name for r in run.scores.collect()}
    assert {"persistence", "seven_day_drift", "ridge", "elastic_net", "exponential_smoothing", N.ENSEMBLE} <= models
    assert run.decision.challenger in models and sum(run.weights.values()) == pytest.approx(1)
    assert run.oof.agg(F.max("forecast_origin_date")).first()[0] <= run.calendar.development_last
    assert X.comparison(run).where("holdout_mae is null").isEmpty()
    assert X.verify_predictions(run.predictions.select(*V.PREDICTION_COLUMNS), "persistence", "persistence")["champion_present"]


def test_trees_stop_at_the_best_prefix_and_never_see_the_holdout(spark, source):
    from tidegauge.operators.forecast import boosted as B
    from tidegauge.operators.forecast import linear as L
    from tidegauge.spec import SeriesSpec

    prepared = P.prepare_forecast(source, SeriesSpec())
    calendar = P.plan_calendar(prepared.frame, SeriesSpec(), prepared.config)
    rows = P.assign_folds(prepared.frame, SeriesSpec(), [calendar.holdout, calendar.folds[-1]]).persist()
    sums = L.fold_sums(rows.where("role = 'train'"), prepared.compact, P.CHANGE)
    processors = {f: L.fit_processor(s, prepared.compact) for f, s in sums.items()}
    config = B.BoostConfig(iterations=12, floor=6)
    models = B.boost_folds(rows, processors, P.CHANGE, config)
    walked = next(f for f in models if f)
    assert 1 < B.trees_used(models[walked]) <= 12
    assert B.trees_used(models[0]) >= 6
    spoiled = rows.withColumn(P.CHANGE, F.when((F.col("fold") == 0) & (F.col("role") == "validation"), 1e6).otherwise(F.col(P.CHANGE)))
    again = B.boost_folds(spoiled, processors, P.CHANGE, config)
    assert again[0].stages[-1].toDebugString.split("\n", 1)[1] == models[0].stages[-1].toDebugString.split("\n", 1)[1]


def test_only_shared_origins_are_ranked_and_short_series_are_named(spark):
    from tidegauge.operators.forecast.smoothing import too_short
    from tidegauge.spec import SeriesSpec

    cells = [("a", "1", d, m, "") for d in range(3) for m in ("x", "y") if (d, m) != (2, "y")]
    table = spark.createDataFrame(cells, "k string, fold string, forecast_origin_date int, model_name string, configuration string")
    got = V.shared_origins(table, SeriesSpec.of("k"))
    assert {(r.forecast_origin_date, r.model_name) for r in got.collect()} == {(d, m) for d in (0, 1) for m in ("x", "y")}
    rows = spark.range(33).selectExpr("if(id < 20, 'long', 'short') AS k", "1 AS fold", "'train' AS role")
    (short,) = too_short(rows, SeriesSpec.of("k")).collect()
    assert (short.k, short.training_days) == ("short", 13)


def test_wide_quantiles_are_those_of_sorting(spark):
    import numpy as np

    from tidegauge.operators.orderstats import column_facts, sortable, wide_quantiles

    rng = np.random.default_rng(4)
    columns = {
        "small": rng.integers(-5, 5, 900).astype(float), "close": 1.0 + rng.integers(0, 50, 900) * 2.0**-50, "wide": rng.normal(0, 1e200, 900),
        "signs": rng.choice([-0.0, 0.0, -1e-310, 1e-310], 900), "none": np.full(900, np.nan), "one": np.full(900, 7.25),
    }
    fold = rng.choice([0, 1, 1, 1, 2], 900)
    cells = [(int(f), *[None if np.isnan(x) or k % 11 == 0 else float(x) for x in row]) for k, (f, row) in enumerate(zip(fold, zip(*columns.values())))]
    df = spark.createDataFrame(cells, "fold int, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    points = {"low": 0.0, "q": 0.237, "median": 0.5, "high": 1.0}
    got = wide_quantiles(df, "fold", list(columns), points)
    for f in (0, 1, 2):
        for k, c in enumerate(columns):
            mine = np.array([r[k + 1] for r in cells if r[0] == f and r[k + 1] is not None], float)
            if not len(mine):
                assert (f, c) not in got
            else:
                assert got[f, c] == pytest.approx({n: float(np.quantile(mine, p)) for n, p in points.items()}, rel=1e-15, abs=0)
    facts = {r["column"]: r for r in column_facts(df, list(columns)).collect()}
    for k, c in enumerate(columns):
        mine = [r[k + 1] for r in cells]
        assert facts[c].missing_values == mine.count(None) and facts[c].rows == 900
        assert facts[c].unique_values == len({x + 0.0 for x in mine if x is not None})
    values = np.array([-np.inf, -2.0, -1e-320, -0.0, 0.0, 1e-320, 3.0, np.inf])
    assert (np.diff(sortable(values).astype(object)) >= 0).all() and sortable(values)[3] == sortable(values)[4]
    assert wide_quantiles(df.where("false"), "fold", ["small"], points) == {}


def test_hybrid_learns_only_from_known_residuals(spark, source):
    from tidegauge.operators.forecast import hybrid as H
    from tidegauge.operators.forecast import ledger as K

    config = P.ForecastConfig()
    prepared = P.prepare_forecast(source, SPEC, config)
    calendar = P.plan_calendar(prepared.frame, SPEC, config)
    folds = [calendar.holdout, *calendar.folds]
    rows = P.assign_folds(prepared.frame, SPEC, folds)
    base = X.baseline_predictions(rows.where("role = 'validation'"), SPEC).where("model_name = 'seven_day_drift'").persist()
    grid = H.correctors({"compact": prepared.compact}, (10.0, 100.0))
    found = H.residual_hybrid(base, prepared.frame, SPEC, calendar, config, grid, "mixed")
    assert {r.configuration for r in found.inner_scores.collect()} == {"compact_a10", "compact_a100"}
    best = found.inner_scores.orderBy("mean_mae", "configuration").first().configuration
    assert found.corrector.name == best
    assert found.predictions.count() == base.count()
    first = found.predictions.where("fold = '1'").join(base.withColumnRenamed(V.FORECAST, "told"), "forecast_origin_date")
    assert first.where(f"{V.FORECAST} <> told").isEmpty()
    # outcomes of the holdout change nothing that was forecast
    spoilt = base.withColumn("actual_value", F.when(F.col("fold") == "holdout", 1e9).otherwise(F.col("actual_value")))
    again = H.residual_hybrid(spoilt, prepared.frame, SPEC, calendar, config, grid, "mixed")
    told = lambda h: sorted((r[0], r[1]) for r in h.predictions.select("forecast_origin_date", V.FORECAST).collect())
    assert told(again) == told(found) and again.corrector == found.corrector
    ledger = K.audited(K.fitted_statistics(spark, "hybrid", found.sums, found.processors, found.models), folds)
    assert ledger.where("late").isEmpty() and not ledger.isEmpty()
    with pytest.raises(CapacityError):
        H.inner_folds(calendar.first, calendar.first, 7)


def test_leading_trees_are_those_of_a_shorter_fit(spark, source):
    from tidegauge.operators.forecast import boosted as B
    from tidegauge.operators.forecast import linear as L

    prepared = P.prepare_forecast(source, SPEC)
    calendar = P.plan_calendar(prepared.frame, SPEC, prepared.config)
    rows = P.assign_folds(prepared.frame, SPEC, [calendar.folds[-1]]).persist()
    (sums,) = L.fold_sums(rows.where("role = 'train'"), prepared.compact, P.CHANGE).values()
    processor = L.fit_processor(sums, prepared.compact)
    whole = B.fit_boosted(rows, processor, P.CHANGE, B.BoostConfig(iterations=8))
    short = B.fit_boosted(rows, processor, P.CHANGE, B.BoostConfig(iterations=8), 3)
    held = B.filled(rows.where("role = 'validation'"), processor)
    told = lambda m: [r.prediction for r in m.transform(held).orderBy("date").select("prediction").collect()]
    assert told(B.leading_trees(whole, 3)) == pytest.approx(told(short))
    assert B.trees_used(B.leading_trees(whole, 3)) == 3 and B.leading_trees(whole, 8) is whole
