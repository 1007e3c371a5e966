"""The whole run: panel, dataset, nested search, refit, forecasts, errors."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import cv as CV
from tidewheel.operators import metrics as M
from tidewheel.operators.target import TargetTransformer
from tidewheel.plans import features as P
from tidewheel.plans import model as T
from tidewheel.plans.search import Journal, Study
from tidewheel.plans.settings import Settings
from tidewheel.sources import panel as S


@dataclass
class Outcome:
    results: DataFrame
    metrics: Row


def forecast(spark: SparkSession, raw: DataFrame, cfg: Settings, work_dir: str) -> Outcome:
    """Forecasts of the outer folds' test windows, each by the best model of an inner search.

    ``work_dir`` is on the driver and holds the journals of the searches; a search that was cut
    off goes on where it stopped, and a model that was saved is loaded. Trees train on the whole
    cluster, so trials run one after another unless ``num_jobs`` says otherwise.
    """
    data = P.dataset(raw, cfg.features, cfg.horizon).persist()
    n_dates = data.select(F.count_distinct("date")).first()[0]
    split = cfg.cross_validation
    sizes = CV.cv_sizes(n_dates, cfg.horizon, split.n_outer_splits, split.n_inner_splits)
    outer = CV.TimeSeriesCV(split.n_outer_splits, sizes.outer_train, sizes.outer_test, cfg.horizon)
    inner = CV.TimeSeriesCV(split.n_inner_splits, sizes.inner_train, sizes.inner_test, cfg.horizon)
    target = TargetTransformer(cfg.horizon)
    target.anchor_col = "anchor"
    parts = []
    for k, (train, test) in enumerate(outer.split(data)):
        name = f"fold_{k:02d}"

        def objective(params, report, train=train, name=name):
            models = [] if cfg.path.store_trial_artifacts else None
            curve = T.cv_curve(train, inner, params, cfg.tuning.num_boost_rounds, cfg.tuning.early_stopping_rounds, cfg.tuning.seed, models, report)
            if models is not None:
                T.save_trial(spark, os.path.join(work_dir, name, f"trial_{report.trial:04d}"), curve, models)
            step, loss, _ = min(curve, key=lambda c: c[1])
            return loss, {"best_n_rounds": step + 1}

        best = Study(Journal(work_dir, name), cfg.space, cfg.tuning).optimize(objective)
        if best is None:
            raise RuntimeError(f"no trial of {name} was completed")
        fitted = T.load_or_fit(spark, os.path.join(work_dir, f"{name}_best_model"), train, best["params"], best["best_n_rounds"], cfg.tuning.seed)
        parts.append(target.inverse_transform(T.predict(fitted, test), out="sales").select("store", "date", "sales"))
    actual = P.positive(P.preprocess(raw, cfg.features))
    results = M.mask_closed(M.join_predictions(actual, M.union_folds(parts))).orderBy("store", "date")
    return Outcome(results, M.global_metrics(results).first())


def run_files(spark: SparkSession, cfg: Settings) -> Outcome:
    """The same from the CSV tables that the settings name, with the results written as CSV."""
    raw = S.store_join(S.read_sales_csv(spark, cfg.path.train), S.read_stores_csv(spark, cfg.path.stores))
    out = forecast(spark, raw, cfg, cfg.path.output_dir)
    S.write_predictions(out.results, cfg.path.predictions)
    return out
