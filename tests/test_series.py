"""Calendar operators against answers worked out by hand and by pandas."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import series as W
from tidewheel.operators.target import TargetTransformer

D = dt.date.fromisoformat


def frame(spark, rows, schema):
    return W.with_day(spark.createDataFrame(rows, schema))


def test_lags_differences_and_rolling(spark):
    days = ["2015-08-30", "2015-08-31", "2015-09-01", "2015-09-30", "2015-10-01"]
    df = frame(spark, [(1, D(d), float(v)) for d, v in zip(days, (10, 20, 40, 80, 160))], "store int, date date, v double")
    df = W.with_month_lags(df, "v", [("months", 1)], ("store",))
    w = W.series("store")
    columns = W.lag_columns(F.col("v"), [("days", 1)], w) | W.diff_columns(F.col("v"), [("days", 1)], w) | W.rolling_columns(F.col("v"), ["7D", "30D"], w)
    rows = [tuple(r) for r in df.select("lag_months_1", *(c.alias(n) for n, c in columns.items())).orderBy("date").collect()]
    assert rows == [
        (None, None, None, 10, 10),
        (None, 10, 10, 15, 15),
        (None, 20, 20, pytest.approx(70 / 3), pytest.approx(70 / 3)),
        (20, None, None, 80, 60),
        (40, 80, 80, 120, 120),
    ]


def test_month_ends_clip_and_collide(spark):
    days = ["2015-01-31", "2015-02-28", "2015-03-28", "2016-02-28", "2016-02-29", "2017-02-28"]
    df = frame(spark, [(1, D(d), float(k)) for k, d in enumerate(days)], "store int, date date, v double")
    rows = {str(r.date): (r.lag_months_1, r.lag_years_1) for r in W.with_month_lags(df, "v", [("months", 1), ("years", 1)], ("store",)).collect()}
    assert rows["2015-02-28"] == (0, None) and rows["2015-03-28"] == (1, None)
    assert rows["2016-02-28"] == (None, 1) and rows["2017-02-28"] == (None, 4)


def test_row_windows_need_all_their_rows(spark):
    df = frame(spark, [(1, D(f"2020-01-0{k}"), float(k)) for k in (1, 2, 5)], "store int, date date, v double")
    c = W.rolling_columns(F.col("v"), [2], W.series("store"))["rolling_mean_2"]
    assert [r[0] for r in df.select(c).orderBy("date").collect()] == [None, 1.5, 3.5]


def test_differences_over_months_are_refused():
    with pytest.raises(ValueError):
        W.diff_columns(None, [("months", 1)], None)


def test_run_length_at_t_and_ahead(spark):
    rows = [(1, D(f"2020-01-0{d}"), p) for d, p in zip((1, 2, 3, 4, 6, 7, 8), (1, 1, 0, 1, 1, 1, 0))]
    w = W.series("store")
    df = W.run_length(frame(spark, rows, "store int, date date, promo int"), "promo", "run", w)
    got = [tuple(r) for r in df.select("run", W.at_offset(F.col("run"), 2, w)).orderBy("date").collect()]
    assert got == [(1, 0), (2, 1), (0, None), (1, 2), (2, 0), (3, None), (0, None)]


def test_event_distances_waves_and_names(spark):
    rows = [(s, D(f"2020-01-0{d}"), s == 1 and d in (3, 7)) for s in (1, 2) for d in range(1, 8)]
    w = W.series("store")
    df = frame(spark, rows, "store int, date date, hol boolean")
    df = df.select("store", "date", W.next_event_days(F.col("hol"), 1, W.series_backwards("store")).alias("n"), W.since_event_days(F.col("hol"), 1, w).alias("s"))
    got = [tuple(r) for r in df.select("n", "s", F.round(W.wave(F.col("n"), 1.3), 6), F.round(W.wave(F.col("s"), 1.3), 6)).orderBy("store", "date").collect()]
    assert got[:7] == [
        (1, None, 0.743893, None), (0, 0, 1, 1), (3, 1, 0.069758, 0.743893), (2, 2, 0.306226, 0.306226),
        (1, 3, 0.743893, 0.069758), (0, 0, 1, 1), (None, 1, None, 0.743893),
    ]
    assert got[7:] == [(None, None, None, None)] * 7
    far = spark.range(1).select(W.wave(F.lit(8), 1.3), W.wave(F.lit(7), 1.3)).first()
    assert far[0] == 0 and far[1] == pytest.approx(5.05842e-07, rel=1e-5)


def test_extended_names(spark):
    rows = [(1, D(f"2020-01-0{d}"), n, pre, post) for d, n, pre, post in ((1, None, 0.5, 0.1), (2, "X", 1.0, 1.0), (3, None, 0.1, 0.5), (4, None, 0.0, 0.0), (5, None, None, 0.5))]
    df = frame(spark, rows, "store int, date date, name string, pre double, post double")
    c = W.extended_name(F.col("name"), F.col("pre"), F.col("post"), 3.0, W.series("store"), W.series_backwards("store"))
    assert [r[0] for r in df.select(c).orderBy("date").collect()] == ["X", "X", "X", None, "X"]


def test_target_round_trip_and_rounding(spark):
    rows = [(s, D("2020-01-01") + dt.timedelta(days=k), float(10 * s + k * k)) for s in (1, 2) for k in range(12) if k % 5 != 3]
    df = frame(spark, rows, "store int, date date, sales double")
    t = TargetTransformer(3).fit(df)
    ahead = t.inverse_transform(t.transform(df)).select("store", "date", "predicted")
    joined = ahead.join(df, ["store", "date"]).where("predicted <> sales")
    assert ahead.count() > 5 and joined.count() == 0
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.4,)], "x double").select(F.bround("x", 0).cast("long")).collect()
    assert [r[0] for r in halves] == [0, 2, 2, 0]
    with pytest.raises(ValueError):
        TargetTransformer(3).inverse_transform(df)
    with pytest.raises(ValueError):
        TargetTransformer(3).fit(df, "nothing")
    with pytest.raises(ValueError):
        TargetTransformer(3, date_col="store").fit(df)


def test_against_pandas_on_random_panels(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(s, D("2021-01-01") + dt.timedelta(days=int(d)), float(rng.normal())) for s in range(4) for d in sorted(rng.choice(120, 60, replace=False))]
    df = frame(spark, rows, "store int, date date, v double")
    w = W.series("store")
    columns = W.lag_columns(F.col("v"), [("days", 0), ("days", 3), ("weeks", 2)], w) | W.rolling_columns(F.col("v"), ["14D"], w) | W.diff_columns(F.col("v"), [("days", 2)], w)
    mine = df.select("store", "date", "v", *(c.alias(n) for n, c in columns.items())).toPandas()
    for _, g in mine.groupby("store"):
        g = g.sort_values("date").set_index(pd.to_datetime(g["date"]))
        for name, days in (("lag_days_0", 0), ("lag_days_3", 3), ("lag_weeks_2", 14)):
            want = g["v"].reindex(g.index - pd.Timedelta(days=days)).to_numpy()
            np.testing.assert_allclose(g[name].to_numpy(float), want)
        np.testing.assert_allclose(g["rolling_mean_14D"], g["v"].rolling("14D").mean())
        np.testing.assert_allclose(g["diff_days_2"].to_numpy(float), g["v"].to_numpy() - g["v"].reindex(g.index - pd.Timedelta(days=2)).to_numpy())


def test_one_long_series(spark):
    """Frames grow from row to row: a hundred years of one entity take seconds."""
    import time

    df = spark.range(36_500).select(F.lit(1).alias("store"), F.col("id").cast("int").alias("day_no"), (F.col("id") % 36_000 == 0).alias("hol"), F.when(F.col("id") % 9000 == 0, "X").alias("name"))
    w, back = W.series("store"), W.series_backwards("store")
    began = time.time()
    out = df.select("day_no", W.next_event_days(F.col("hol"), 30, back).alias("n"), W.since_event_days(F.col("hol"), 30, w).alias("s"), W.extended_name(F.col("name"), F.lit(1.0), F.lit(0.0), 3.0, w, back).alias("x"))
    rows = {r.day_no: (r.n, r.s, r.x) for r in out.collect()}
    assert time.time() - began < 15
    assert rows[0] == (35_970, 30, "X") and rows[35_970] == (0, 0, "X") and rows[35_971] == (None, 1, "X") and rows[36_499] == (None, 529, None)
