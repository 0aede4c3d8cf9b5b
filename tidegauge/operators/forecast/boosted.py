"""Gradient-boosted trees per fold with the library's distributed trainer."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import median

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.forecast.linear import Processor


@dataclass(frozen=True)
class BoostConfig:
    loss: str = "squared"
    #: Trees grown per fold before the best prefix is chosen.
    iterations: int = 40
    #: Fewest trees of the final fit.
    floor: int = 20
    depth: int = 3
    step: float = 0.1
    seed: int = 42

    @property
    def name(self) -> str:
        return f"{self.loss}_d{self.depth}_n{self.iterations}"


def filled(df: DataFrame, processor: Processor) -> DataFrame:
    """Selected features with training medians in place of nulls."""
    others = [c for c in df.columns if c not in processor.selected]
    return df.selectExpr(
        *others,
        *[f"coalesce({c}, {float(processor.medians[c])!r}D) AS {c}" for c in processor.selected],
    )


def fit_boosted(
    rows: DataFrame, processor: Processor, target: str, config: BoostConfig, trees: int | None = None
) -> PipelineModel:
    """Fit on the training rows of one fold; other rows take no part."""
    booster = GBTRegressor(
        featuresCol="_x", labelCol=target, predictionCol="prediction", lossType=config.loss,
        maxIter=trees or config.iterations, maxDepth=config.depth, stepSize=config.step, seed=config.seed,
        maxBins=32, cacheNodeIds=False,
    )
    assembler = VectorAssembler(inputCols=processor.selected, outputCol="_x")
    return Pipeline(stages=[assembler, booster]).fit(filled(rows.where("role = 'train'"), processor))


def best_prefix(
    model: PipelineModel, held: DataFrame, processor: Processor, target: str, config: BoostConfig
) -> int:
    """Number of leading trees with the least loss on ``held``; the smallest of ties."""
    assembler, trees = model.stages
    errors = trees.evaluateEachIteration(assembler.transform(filled(held, processor)), config.loss)
    return min(range(len(errors)), key=lambda k: (errors[k], k)) + 1


def leading_trees(model: PipelineModel, trees: int) -> PipelineModel:
    """The model of the first ``trees`` trees: what a shorter fit would have given, without another fit."""
    assembler, boosted = model.stages
    if trees == boosted.getNumTrees:
        return model
    whole, gateway = boosted._java_obj, SparkContext._active_spark_context._gateway
    package = gateway.jvm.org.apache.spark.ml.regression
    kept, weights = gateway.new_array(package.DecisionTreeRegressionModel, trees), gateway.new_array(gateway.jvm.double, trees)
    for k in range(trees):
        kept[k], weights[k] = whole.trees()[k], boosted.treeWeights[k]
    short = GBTRegressionModel(package.GBTRegressionModel(f"{whole.uid()}_{trees}", kept, weights))
    short.setFeaturesCol(boosted.getFeaturesCol()).setPredictionCol(boosted.getPredictionCol())
    return PipelineModel([assembler, short])


def boost_folds(
    rows: DataFrame, processors: Mapping[int, Processor], target: str, config: BoostConfig,
    parallelism: int = 4,
) -> dict[int, PipelineModel]:
    """One model per fold. Fits are independent jobs, so a few run at the same time.

    A walk-forward fold keeps the prefix of its trees that does best on its validation rows. Fold
    0, whose validation rows are the holdout, takes the median of those numbers, ``floor`` at
    least, and never sees its validation rows.
    """

    def walk(fold: int) -> tuple[int, PipelineModel]:
        mine = rows.where(F.col("fold") == fold)
        model = fit_boosted(mine, processors[fold], target, config)
        best = best_prefix(model, mine.where("role = 'validation'"), processors[fold], target, config)
        return fold, leading_trees(model, best)

    with ThreadPoolExecutor(parallelism) as pool:
        models = dict(pool.map(walk, sorted(f for f in processors if f)))
    if 0 in processors:
        best = [trees_used(m) for m in models.values()]
        trees = max(config.floor, int(median(best))) if best else config.iterations
        models[0] = fit_boosted(rows.where("fold = 0"), processors[0], target, config, trees)
    return models


def predict_boosted(
    rows: DataFrame, processors: Mapping[int, Processor], models: Mapping[int, PipelineModel],
    keep: list[str],
) -> DataFrame:
    """Validation predictions of every fold as column ``prediction``."""
    parts = [
        models[f]
        .transform(filled(rows.where((F.col("fold") == f) & (F.col("role") == "validation")), processors[f]))
        .select(*keep, "prediction")
        for f in sorted(models)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trees_used(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def gain_importance(model: PipelineModel, processor: Processor, spark) -> DataFrame:
    """Share of the total gain per feature, ranked."""
    shares = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(s) * 100) for c, s in zip(processor.selected, shares)]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(
        [(c, s, i + 1) for i, (c, s) in enumerate(rows)],
        "feature string, gain_percent double, rank int",
    )
