"""Folds, metrics, settings, search, sources and models."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import cv as CV
from tidewheel.operators import metrics as M
from tidewheel.plans import search, settings
from tidewheel.sources import panel

D = dt.date.fromisoformat


@pytest.mark.parametrize(
    ("n", "h", "ko", "ki", "trains", "outer", "inner"),
    [
        (942, 30, 3, 3, (822, 702), [(0, 821, 852, 881), (30, 851, 882, 911), (60, 881, 912, 941)], [(0, 701, 732, 761), (30, 731, 762, 791), (60, 761, 792, 821)]),
        (100, 10, 2, 2, (70, 40), [(0, 69, 80, 89), (10, 79, 90, 99)], [(0, 39, 50, 59), (10, 49, 60, 69)]),
        (30, 3, 3, 3, (18, 6), [(0, 17, 21, 23), (3, 20, 24, 26), (6, 23, 27, 29)], [(0, 5, 9, 11), (3, 8, 12, 14), (6, 11, 15, 17)]),
    ],
)
def test_fold_positions(n, h, ko, ki, trains, outer, inner):
    s = CV.cv_sizes(n, h, ko, ki)
    assert (s.outer_train, s.inner_train) == trains
    assert [p[1:] for p in CV.TimeSeriesCV(ko, s.outer_train, s.outer_test, h).positions(n)] == outer
    assert [p[1:] for p in CV.TimeSeriesCV(ki, s.inner_train, s.inner_test, h).positions(s.outer_train)] == inner


def test_too_few_dates():
    with pytest.raises(ValueError):
        CV.cv_sizes(240, 30, 3, 3)
    with pytest.raises(ValueError):
        CV.TimeSeriesCV(3, 50, 10, 10).positions(60)


def test_fold_rows(spark):
    rows = [(s, D("2020-01-01") + dt.timedelta(days=2 * k)) for s in (1, 2) for k in range(30) if not (s == 2 and k % 3 == 0)]
    df = spark.createDataFrame(rows, "store int, date date")
    cut = CV.TimeSeriesCV(2, 10, 5, 3)
    assert cut.get_n_splits() == 2
    edges = {r.fold: r for r in cut.folds(df).collect()}
    assert str(edges[2].test_end) == "2020-02-28" and (edges[2].test_start - edges[2].train_end).days == 2 * 4
    counts = {(r.fold, r.part): r.n for r in cut.fold_rows(df).groupBy("fold", "part").agg(F.count_distinct("date").alias("n")).collect()}
    assert counts == {(1, "train"): 10, (1, "test"): 5, (2, "train"): 10, (2, "test"): 5}
    for train, test in cut.split(df):
        assert train.agg(F.max("date")).first()[0] < test.agg(F.min("date")).first()[0]


def test_metrics(spark):
    rows = [(1, D("2020-01-01"), 100.0, 101), (1, D("2020-01-02"), 50.0, 52), (2, D("2020-01-01"), 10.0, 13), (3, D("2020-01-01"), 20.0, 30), (2, D("2020-01-02"), 0.0, 7)]
    df = M.mask_closed(spark.createDataFrame(rows, "store int, date date, sales_actual double, sales_predicted long"))
    assert df.where("sales_actual = 0").first().sales_predicted == 0
    df = df.where("sales_actual > 0")
    g = M.global_metrics(df).first()
    assert (g.mae, g.min_actual, g.max_actual) == (4.0, 10, 100) and g.rmse == pytest.approx((114 / 4) ** 0.5) and g.mape == pytest.approx((1 + 4 + 30 + 50) / 4)
    assert M.macro_mae(df, "store").first()[0] == pytest.approx((1.5 + 3 + 10) / 3)
    assert [r.store for r in M.extreme_stores(df, 2).collect()] == [3, 2] and [r.store for r in M.extreme_stores(df, 1, best=True).collect()] == [1]
    values = spark.createDataFrame([(D("2020-01-01"), 0.0, float(v)) for v in (1, 2, 3, 10)], "date date, sales_actual double, sales_predicted double")
    assert M.daily_band(values).first().p05 == pytest.approx(1.15)
    assert M.worst_days(values, 1).count() == 1


def test_study_without_complete_trials(spark):
    df = spark.createDataFrame([(1, "PRUNED", None, 2.0)], search.TRIAL_SCHEMA)
    r = M.study_summary(df).first()
    assert (r.n_trials, r.n_complete, r.pct_pruned, r.best_value, r.best_trial) == (1, 0, 100.0, None, None)
    assert M.study_summary(df.where("false")).first().n_trials == 0


def test_curve_summary(spark):
    r = M.curve_summary(spark.createDataFrame([(0, 3.0, 0.1), (1, 1.0, 0.2), (2, 1.0, 0.3), (3, 2.0, 0.4)], "round int, mean double, std double")).first()
    assert tuple(r) == (1.0, 2, 2.0, 0.4)


YAML = """
path:
  stores: store.csv   # a comment
  store_trial_artifacts: false
horizon: 14
feature_engineering:
  windows:
    - "7D"
    - '30D'
  diffs:
    days: [1, 2]
  lags:
    years: [1]
    days: [0, 1]
  holidays:
    sigma: 1.5
    country: DE
cross_validation:
  n_outer_splits: 2
  n_inner_splits: 2
hyperparameters:
  learning_rate:
    method: suggest_float
    low: 5.0e-3
    high: 2.0e-1
    log: true
"""


def test_settings_from_yaml(tmp_path):
    (tmp_path / "c.yaml").write_text(YAML)
    s = settings.Settings.from_yaml(str(tmp_path / "c.yaml"), "in", "out")
    assert s.horizon == 14 and s.features.windows == ("7D", "30D") and s.features.lags == (("days", 0), ("days", 1), ("years", 1))
    assert s.path.stores.endswith("/in/store.csv") and s.path.predictions.endswith("/out/predictions.csv")
    assert s.space["learning_rate"].log and s.cross_validation.n_outer_splits == 2 and s.features.sigma == 1.5
    assert len(settings.Features().lags) == 23


@pytest.mark.parametrize(
    "make",
    [
        lambda: settings.offsets({"decades": [1]}), lambda: settings.offsets({"days": [-1]}), lambda: settings.CrossValidation(0, 3), lambda: settings.Tuning(num_jobs=0),
        lambda: settings.Tuning(refit_val_fraction=1.0), lambda: settings.Model(verbosity=4), lambda: settings.Range("suggest_categorical", 0, 1), lambda: settings.Range("suggest_int", 0, 1, choices=(1,)), lambda: settings.Range("suggest_int", 2, 2),
        lambda: settings.Settings(settings.Paths("a", "b"), horizon=-1),
    ],
)
def test_settings_are_validated(make):
    with pytest.raises(ValueError):
        make()


def test_search_resumes_and_prunes(tmp_path):
    journal = search.Journal(str(tmp_path), "s")
    tuning = settings.Tuning(num_trials=4, num_startup_trials=2, num_jobs=1)
    ran = []

    def objective(params, report):
        ran.append(params)
        assert 3 <= params["max_depth"] <= 10 and 0.005 <= params["learning_rate"] <= 0.2
        report(0, float(len(ran)))
        return float(len(ran)), {"best_n_rounds": 1}

    study = search.Study(journal, settings.SPACE, tuning)
    assert study.optimize(objective)["trial"] == 0 and len(ran) == 4
    assert [t["state"] for t in journal.read()] == ["COMPLETE", "COMPLETE", "PRUNED", "PRUNED"]
    with open(journal.path, "a") as lines:
        lines.write('{"trial": 9, "sta')  # a crash while writing
    again = search.Study(journal, settings.SPACE, settings.Tuning(num_trials=5, num_startup_trials=2, num_jobs=1))
    assert again.remaining() == 1
    again.optimize(objective)
    assert len(ran) == 5 and search.Study(journal, settings.SPACE, tuning).remaining() == 0


def test_a_failed_trial_is_journalled_and_not_run_again(tmp_path):
    journal, ran = search.Journal(str(tmp_path), "s"), []

    def objective(params, report):
        ran.append(report.trial)
        if report.trial == 1:
            raise OSError("a lost executor")
        return 1.0, {}

    study = search.Study(journal, settings.SPACE, settings.Tuning(num_trials=3, num_jobs=1))
    with pytest.raises(OSError):
        study.optimize(objective)
    assert [t["state"] for t in journal.read()][:2] == ["COMPLETE", "FAIL"] and "lost executor" in journal.read()[1]["error"]
    study.optimize(objective)
    assert study.remaining() == 0 and ran.count(1) == 1 and len(study.finished()) == 3


def test_journal_lines_of_several_processes_are_whole(tmp_path):
    import subprocess
    import sys

    write = "import sys; from tidewheel.plans.search import Journal; j = Journal(sys.argv[1], 's'); [j.append({'trial': k, 'state': 'COMPLETE', 'x': 'y' * 5000}) for k in range(50)]"
    running = [subprocess.Popen([sys.executable, "-c", write, str(tmp_path)], env={"PYTHONPATH": ":".join(sys.path)}) for _ in range(3)]
    assert all(p.wait() == 0 for p in running)
    assert len(search.Journal(str(tmp_path), "s").read()) == 150


def test_later_trials_gather_where_the_loss_is_low(tmp_path):
    space = {"x": settings.Range("suggest_float", -10.0, 10.0), "n": settings.Range("suggest_int", 1, 9), "lr": settings.Range("suggest_float", 1e-4, 1.0, True), "kind": settings.Range("suggest_categorical", choices=("a", "b", "c"))}
    study = search.Study(search.Journal(str(tmp_path), "s"), space, settings.Tuning(num_trials=60, num_jobs=1))
    best = study.optimize(lambda p, report: ((p["x"] - 3) ** 2 + (p["n"] - 4) ** 2 + (p["kind"] != "b") * 5 + abs(p["lr"] - 0.01), {}))
    trials = [t["params"] for t in study.finished()]
    early, late = trials[:10], trials[30:]
    miss = lambda part: sum(abs(p["x"] - 3) for p in part) / len(part)
    assert miss(late) < 0.6 * miss(early) and sum(p["kind"] == "b" for p in late) > 15 and best["params"]["kind"] == "b"
    assert all(1 <= p["n"] <= 9 and isinstance(p["n"], int) and 1e-4 <= p["lr"] <= 1 and -10 <= p["x"] <= 10 for p in trials)


def test_training_stops_with_the_curve(spark, monkeypatch):
    """Patience and pruning end the training itself: no model has many more rounds than were looked at."""
    import random

    from tidewheel.plans import model

    draw, trained = random.Random(2), []
    rows = [(k % 3, D("2020-01-01") + dt.timedelta(days=k // 3), float(k % 7), draw.gauss(0, 1)) for k in range(180)]
    data = spark.createDataFrame(rows, "store int, date date, x double, y double").persist()
    real = model.regressor
    monkeypatch.setattr(model, "regressor", lambda params, rounds, seed: trained.append(rounds) or real(params, rounds, seed))
    cut = CV.TimeSeriesCV(1, 40, 10, 3)
    curve = model.cv_curve(data, cut, {"max_depth": 3}, 10_000, patience=3, first_rounds=4)
    assert len(curve) <= 32 and max(trained) < 2 * max(4, len(curve)) + 1 and trained[:2] == [4, 8][: len(trained)]
    whole = model.cv_curve(data, cut, {"max_depth": 3}, len(curve), patience=10_000, first_rounds=1000)
    assert [m for _, m, _ in whole] == pytest.approx([m for _, m, _ in curve])  # as if trained at once
    trained.clear()

    def report(k, mean):
        if k == 2:
            raise search.Pruned

    with pytest.raises(search.Pruned):
        model.cv_curve(data, cut, {"max_depth": 3}, 10_000, report=report, first_rounds=4)
    assert trained == [4]


def test_registered_forecast_and_study(spark):
    """What SQL cannot express of them: which rows there are, closed days, and errors below those of a constant."""
    from tables import DATA

    from tidewheel import catalog

    rows = catalog.QUERIES["boosted_trees_forecast"](spark, f"{DATA}/sf0.01").collect()
    want = {(r.store, r.date) for r in catalog.QUERIES["fold_union"](spark, f"{DATA}/sf0.01").select("store", "date").collect()}
    assert {(r.store, r.date) for r in rows} == want and len(rows) == len(want)
    actual = [r.sales_actual for r in rows]
    mean = sum(actual) / len(actual)
    assert all(r.sales_predicted >= 0 for r in rows)
    assert sum(abs(r.sales_predicted - r.sales_actual) for r in rows) < 2 * sum(abs(a - mean) for a in actual)
    trials = catalog.QUERIES["random_search_study"](spark, f"{DATA}/sf0.01").collect()
    assert sorted(t.trial for t in trials) == [0, 1, 2] and {t.state for t in trials} <= {"COMPLETE", "PRUNED"} and all(t.value > 0 for t in trials if t.state == "COMPLETE")


def test_csv_sources_and_sink(spark, tmp_path):
    (tmp_path / "train.csv").write_text("Store,DayOfWeek,Date,Sales,Customers,Open,Promo,StateHoliday,SchoolHoliday\n1,5,2015-07-31,5263,555,1,1,0,1\n2,5,2015-07-31,6064,625,1,1,a,0\n")
    (tmp_path / "store.csv").write_text("Store,StoreType,Assortment,CompetitionDistance,CompetitionOpenSinceMonth,CompetitionOpenSinceYear,Promo2,Promo2SinceWeek,Promo2SinceYear,PromoInterval\n1,c,a,1270,9,2008,0,,,\n")
    joined = panel.store_join(panel.read_sales_csv(spark, str(tmp_path / "train.csv")), panel.read_stores_csv(spark, str(tmp_path / "store.csv")))
    r = joined.first()
    assert joined.count() == 1 and (r.store, r.sales, r.state_holiday, r.competition_month, r.promo2_year) == (1, 5263.0, "0", 9, None)
    out = spark.createDataFrame([(1, D("2020-01-01"), 2.0, 3)], panel.PREDICTION_SCHEMA)
    panel.write_predictions(out, str(tmp_path / "p"))
    assert panel.read_predictions(spark, str(tmp_path / "p")).collect() == out.collect()


def test_boosted_trees_train_save_and_predict(spark, tmp_path):
    from tidewheel.plans import features, model

    rows = [(s, D("2020-01-01") + dt.timedelta(days=k), 100.0 + 20 * s + 30 * (k % 7), k % 2, "0", 0, "a", "b", 0, None, None, None, None) for s in (1, 2, 3) for k in range(90)]
    schema = "store int, date date, sales double, promo int, state_holiday string, school_holiday int, store_type string, assortment string, promo2 int, competition_year int, competition_month int, promo2_year int, promo2_week int"
    cfg = settings.Features(lags=(("days", 0), ("days", 7)), diffs=(("days", 1),), windows=("7D",))
    data = features.dataset(spark.createDataFrame(rows, schema), cfg, 3).persist()
    curve = model.cv_curve(data, CV.TimeSeriesCV(2, 50, 10, 3), {"max_depth": 3}, 4)
    assert [k for k, _, _ in curve] == [0, 1, 2, 3] and curve[-1][1] < 0.5
    fitted = model.load_or_fit(spark, str(tmp_path / "m"), data, {"max_depth": 3}, 4)
    again = model.load_or_fit(spark, str(tmp_path / "m"), data, {"max_depth": 9}, 1)
    assert model.predict(fitted, data).exceptAll(model.predict(again, data)).count() == 0
    assert model.rmse(fitted, data) < 0.3


def test_the_whole_run_from_files(spark, tmp_path):
    import random

    from tidewheel.__main__ import main

    draw = random.Random(1)
    lines = ["Store,DayOfWeek,Date,Sales,Customers,Open,Promo,StateHoliday,SchoolHoliday"]
    for store in (1, 2):
        for k in range(60):
            day = D("2015-01-01") + dt.timedelta(days=k)
            lines.append(f"{store},{day.isoweekday()},{day},{100 * store + 10 * (k % 7) + draw.randint(0, 5)},1,1,{k % 2},{'a' if k == 0 else 0},0")
    (tmp_path / "train.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "store.csv").write_text("Store,StoreType,Assortment,CompetitionDistance,CompetitionOpenSinceMonth,CompetitionOpenSinceYear,Promo2,Promo2SinceWeek,Promo2SinceYear,PromoInterval\n1,a,b,1,1,2014,0,,,\n2,b,b,1,,,1,3,2014,x\n")
    (tmp_path / "c.yaml").write_text(
        "path:\n  store_trial_artifacts: true\nhorizon: 3\nfeature_engineering:\n  windows:\n    - '7D'\n  diffs:\n    days: [1]\n  lags:\n    days: [0, 7]\ncross_validation:\n  n_outer_splits: 1\n  n_inner_splits: 1\n"
        "hypertuning:\n  num_trials: 2\n  num_jobs: 1\n  num_boost_rounds: 2\nhyperparameters:\n  max_depth:\n    method: suggest_int\n    low: 2\n    high: 3\n    log: false\n"
    )
    args = ["--config", str(tmp_path / "c.yaml"), "--input_dir", str(tmp_path), "--output_dir", str(tmp_path / "out")]
    main(args)
    first = (tmp_path / "out" / "fold_00.journal").read_text()
    main(args)  # nothing is left to search
    assert (tmp_path / "out" / "fold_00.journal").read_text() == first and len(first.splitlines()) == 2
    assert (tmp_path / "out" / "fold_00" / "trial_0001" / "cv_history.csv").read_text().startswith("round,mean,std\n0,") and (tmp_path / "out" / "fold_00" / "trial_0001" / "fold_0").is_dir()
    rows = panel.read_predictions(spark, str(tmp_path / "out" / "predictions.csv")).collect()
    assert len(rows) == 6 and all(abs(r.sales_predicted - r.sales_actual) < 0.5 * r.sales_actual for r in rows)
