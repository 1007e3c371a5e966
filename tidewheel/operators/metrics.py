"""Forecast errors, by row, entity and day, and summaries of training and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The smallest denominator of a percentage error: the double's epsilon.
EPS = 2.220446049250313e-16


def join_predictions(actual: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("store", "date"), value: str = "sales") -> DataFrame:
    """Inner join on the key, with the values as {value}_actual and {value}_predicted."""
    a = actual.select(*keys, F.col(value).alias(f"{value}_actual"))
    p = predicted.select(*keys, F.col(value).alias(f"{value}_predicted"))
    return a.join(p, list(keys), "inner")


def mask_closed(results: DataFrame, value: str = "sales") -> DataFrame:
    """Predictions on days without actual sales become 0."""
    p = F.col(f"{value}_predicted")
    return results.withColumn(f"{value}_predicted", F.when(F.col(f"{value}_actual") == 0, F.lit(0).cast(results.schema[f"{value}_predicted"].dataType)).otherwise(p))


def union_folds(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def error(value: str = "sales") -> Column:
    return F.col(f"{value}_actual") - F.col(f"{value}_predicted")


def global_metrics(results: DataFrame, value: str = "sales") -> DataFrame:
    """mae, rmse, mape (per cent), and the range of the actual values."""
    e, a = error(value), F.col(f"{value}_actual")
    return results.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(EPS))) * 100).alias("mape"),
        F.min(a).alias("min_actual"), F.max(a).alias("max_actual"),
    )


def mae_by(results: DataFrame, *keys: str, value: str = "sales") -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(F.abs(error(value))).alias("mae"))


def macro_mae(results: DataFrame, *keys: str, value: str = "sales") -> DataFrame:
    return mae_by(results, *keys, value=value).agg(F.avg("mae").alias("macro_mae"))


def extreme_stores(results: DataFrame, k: int, best: bool = False, key: str = "store", value: str = "sales") -> DataFrame:
    """The k entities with the largest (or smallest) error; ties go to the smaller key."""
    mae = mae_by(results, key, value=value)
    return mae.orderBy(F.col("mae").asc() if best else F.col("mae").desc(), key).limit(k)


def series_of(results: DataFrame, keys: DataFrame, key: str = "store") -> DataFrame:
    """The rows of the entities in ``keys``."""
    return results.join(keys.select(key), key, "left_semi")


def daily_band(results: DataFrame, value: str = "sales", date_col: str = "date") -> DataFrame:
    """Mean and 5th and 95th percentile (interpolated) of the absolute error of each day."""
    e = F.abs(error(value))
    return results.groupBy(date_col).agg(F.avg(e).alias("mean_mae"), F.percentile(e, F.lit(0.05)).alias("p05"), F.percentile(e, F.lit(0.95)).alias("p95"))


def worst_days(results: DataFrame, k: int = 10, value: str = "sales", date_col: str = "date") -> DataFrame:
    return daily_band(results, value, date_col).orderBy(F.desc("mean_mae"), date_col).limit(k)


def curve_summary(history: DataFrame) -> DataFrame:
    """From (round from 0, mean, std): the best loss, its number of rounds, and the last loss."""
    return history.agg(
        F.min("mean").alias("best_loss"), (F.min_by("round", F.struct("mean", "round")) + 1).cast("int").alias("best_n_rounds"),
        F.max_by("mean", "round").alias("final_mean"), F.max_by("std", "round").alias("final_std"),
    )


def study_summary(trials: DataFrame) -> DataFrame:
    """From (trial, state, value, seconds): counts, pruned share, durations and values; safe without complete trials."""
    done = F.col("state") == "COMPLETE"
    value = F.when(done, F.col("value"))
    n = F.count("*")
    pruned = F.sum(F.when(F.col("state") == "PRUNED", 1).otherwise(0))
    return trials.agg(
        n.alias("n_trials"), F.sum(F.when(done, 1).otherwise(0)).alias("n_complete"), pruned.alias("n_pruned"),
        F.round(F.try_divide(pruned * 100.0, n), 1).alias("pct_pruned"), F.round(F.sum("seconds"), 1).alias("total_seconds"),
        F.round(F.avg("seconds"), 2).alias("mean_seconds"), F.round(F.max("seconds"), 2).alias("max_seconds"),
        F.round(F.min(value), 6).alias("best_value"), F.round(F.max(value), 6).alias("worst_value"), F.round(F.median(value), 6).alias("median_value"),
        F.min_by(F.when(done, F.col("trial")), F.when(done, F.struct("value", "trial"))).alias("best_trial"),
    )
