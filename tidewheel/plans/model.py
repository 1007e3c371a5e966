"""Boosted trees on the dataset: vectors, cross-validated rounds, refit and prediction."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.cv import TimeSeriesCV

#: What stands in for a missing number; trees then split it off.
MISSING = -9999.0
#: Rounds that are trained before the curve is looked at; each further step doubles them.
FIRST_ROUNDS = 32


def assembler(df: DataFrame, keys: tuple[str, ...] = ("store", "date"), target: str = "y") -> Pipeline:
    """Strings to category numbers (null and unseen values get one of their own), all to one vector."""
    kinds = {n: t for n, t in df.dtypes if n not in keys and n != target}
    strings = [n for n, t in kinds.items() if t == "string"]
    indexers = [StringIndexer(inputCol=n, outputCol=f"{n}_idx", handleInvalid="keep") for n in strings]
    numbers = [n for n in kinds if n not in strings]
    return Pipeline(stages=[*indexers, VectorAssembler(inputCols=[*numbers, *(f"{n}_idx" for n in strings)], outputCol="features")])


def numeric(df: DataFrame, keys: tuple[str, ...] = ("store", "date"), target: str = "y") -> DataFrame:
    """Booleans and numbers as doubles, with missing ones marked."""
    return df.select(*(F.col(n) if n in keys or n == target or t == "string" else F.coalesce(F.col(n).cast("double"), F.lit(MISSING)).alias(n) for n, t in df.dtypes))


def regressor(params: dict, rounds: int, seed: int = 42) -> GBTRegressor:
    """GBTRegressor from the search space's names; L1 and L2 penalties have no counterpart there."""
    return GBTRegressor(
        featuresCol="features", labelCol="y", maxIter=rounds, seed=seed, maxBins=64, checkpointInterval=10,
        maxDepth=int(params.get("max_depth", 5)), stepSize=float(params.get("learning_rate", 0.1)),
        subsamplingRate=float(params.get("subsample", 1.0)), minInstancesPerNode=int(params.get("min_child_weight", 1)),
        minInfoGain=float(params.get("gamma", 0.0)) * 1e-4, featureSubsetStrategy=str(float(params.get("colsample_bytree", 1.0))) if params.get("colsample_bytree", 1.0) < 1.0 else "all",
    )


def cv_curve(
    train: DataFrame, cv: TimeSeriesCV, params: dict, rounds: int, patience: int = 50, seed: int = 42, collect: list | None = None,
    report: Callable[[int, float], None] | None = None, first_rounds: int = FIRST_ROUNDS,
) -> list[tuple[int, float, float]]:
    """(round, mean, std) of the folds' RMSE after each round, until ``patience`` rounds bring no gain.

    All folds are trained for some rounds, then for twice as many, and so on: training stops with
    the step in which patience ends or ``report(round, mean)`` raises, and no more than twice the
    rounds needed are trained, four times with those of earlier steps. A step's trees begin with
    those of the step before, for the seed is the same. The last step's models, a fold each, are
    appended to ``collect``, if it is given.
    """
    folds = []
    for fit_rows, test_rows in cv.split(train):
        pipe = assembler(fit_rows).fit(numeric(fit_rows))
        folds.append((pipe, pipe.transform(numeric(fit_rows)).select("features", "y").persist(), pipe.transform(numeric(test_rows)).select("features", "y").persist()))
    out: list[tuple[int, float, float]] = []
    best, at, size = math.inf, 0, min(rounds, first_rounds)
    try:
        while True:
            models = [regressor(params, size, seed).fit(rows) for _, rows, _ in folds]
            curves = [[math.sqrt(v) for v in m.evaluateEachIteration(rows, "squared")] for m, (_, _, rows) in zip(models, folds)]
            stopped = False
            for k, values in list(enumerate(zip(*curves)))[len(out) :]:
                mean = sum(values) / len(values)
                out.append((k, mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))))
                if report is not None:
                    report(k, mean)
                if mean < best:
                    best, at = mean, k
                elif k - at >= patience:
                    stopped = True
                    break
            if stopped or size >= rounds:
                break
            size = min(rounds, 2 * size)
    finally:
        for _, *tables in folds:
            for rows in tables:
                rows.unpersist()
    if collect is not None:
        collect += [PipelineModel([*pipe.stages, model]) for (pipe, _, _), model in zip(folds, models)]
    return out


def fit(train: DataFrame, params: dict, rounds: int, seed: int = 42) -> PipelineModel:
    rows = numeric(train)
    pipe = assembler(train).fit(rows)
    return PipelineModel([*pipe.stages, regressor(params, rounds, seed).fit(pipe.transform(rows))])


def load_or_fit(spark: SparkSession, path: str, train: DataFrame, params: dict, rounds: int, seed: int = 42) -> PipelineModel:
    """The model saved at ``path`` if there is one, else a new one, saved there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return PipelineModel.load(path)
    model = fit(train, params, rounds, seed)
    model.write().overwrite().save(path)
    return model


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Keys, the anchor and the predicted difference."""
    scored = model.transform(numeric(rows))
    return scored.select("store", "date", F.col("lag_days_0").alias("anchor"), F.col("prediction").alias("y"))


def rmse(model: PipelineModel, rows: DataFrame) -> float:
    return RegressionEvaluator(labelCol="y").evaluate(model.transform(numeric(rows)))


def save_trial(spark: SparkSession, folder: str, curve: list[tuple[int, float, float]], models: list[PipelineModel]) -> None:
    """A trial's curve as CSV, and its folds' models, all on the filesystem that ``folder`` names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder, "cv_history.csv")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(("round,mean,std\n" + "".join(f"{k},{mean},{std}\n" for k, mean, std in curve)).encode()))
    finally:
        out.close()
    for k, fold in enumerate(models):
        fold.write().overwrite().save(f"{folder}/fold_{k}")
