"""Dates, flags, holidays and subdivisions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators.geo import holiday_matrix, infer_subdivision
from tidewheel.sources import holidays as H

D = dt.date.fromisoformat


def test_iso_weeks(spark):
    rows = [(2015, 53), (2014, 53), (2015, 9), (2008, 12), (1900, 1), (None, 3), (2015, None)]
    got = [str(r[0]) for r in spark.createDataFrame(rows, "y int, w int").select(S.iso_week_date(F.col("y"), F.col("w"))).collect()]
    assert got == ["2015-12-28", "2014-12-29", "2015-02-23", "2008-03-17", "1900-01-01", "None", "None"]


def test_calendar_parts(spark):
    days = ["2020-02-29", "2020-03-07", "2020-03-01", "2019-12-31"]
    df = spark.createDataFrame([(D(d),) for d in days], "d date").select(*(c.alias(n) for n, c in S.calendar_columns(F.col("d")).items()))
    rows = df.collect()
    assert [(r.week_of_month, r.day_of_week, r.is_month_end) for r in rows] == [(5, 5, True), (2, 5, False), (1, 6, False), (5, 1, True)]
    assert rows[2].is_month_start and rows[3].quarter == 4 and rows[0].is_weekend and not rows[0].is_weekday


def test_flags_and_competition(spark):
    df = spark.createDataFrame([("0", 0), (None, None), ("a", 1)], "h string, s int")
    assert [tuple(r) for r in df.select(S.state_holiday(F.col("h")), S.is_state_holiday(F.col("h")), S.is_school_holiday(F.col("s"))).collect()] == [("NoHoliday", False, False), ("NoHoliday", False, True), ("a", True, True)]
    df = spark.createDataFrame([(D("2020-01-01"),), (D("2020-03-01"),), (None,)], "since date")
    assert [r[0] for r in df.select(S.competition_days(F.col("since"), F.lit(D("2020-01-05")), 2)).collect()] == [6, None, None]


def test_known_holidays():
    rows = {(str(d), s): n for d, n, s in H.holiday_rows(2014, 2019)}
    assert [str(H.easter(y)) for y in (2000, 2014, 2015, 2018, 2019, 2038)] == ["2000-04-23", "2014-04-20", "2015-04-05", "2018-04-01", "2019-04-21", "2038-04-25"]
    assert rows["2014-04-18", "BE"] == "Good Friday" and rows["2015-05-25", "HH"] == "Whit Monday"
    assert rows["2015-06-04", "BY"] == "Corpus Christi" and ("2015-06-04", "BE") not in rows
    assert rows["2015-11-18", "SN"] == "Repentance and Prayer Day" and ("2015-11-18", "BY") not in rows
    assert ("2016-10-31", "BE") not in rows and ("2017-10-31", "BE") in rows and ("2018-10-31", "BE") not in rows and ("2018-10-31", "HH") in rows
    assert ("2018-03-08", "BE") not in rows and rows["2019-03-08", "BE"] == "International Women's Day"
    with pytest.raises(ValueError):
        H.subdivisions("XX")


def test_subdivision_by_brute_force(spark):
    import random

    random.seed(3)
    calendar = list(H.holiday_rows(2015, 2015))
    kept = {s: {d for d, _, x in calendar if x == s} for s in H.STATES}
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=k) for k in range(365)]
    rows = []
    for store in range(20):
        state = random.choice(H.STATES)
        rows += [(store, d, d in kept[state] if random.random() > 0.01 else random.random() < 0.5) for d in random.sample(days, 250)]
    rows += [(99, d, False) for d in days[5:9]]  # no holiday: every state agrees alike
    df = spark.createDataFrame(rows, "store int, date date, is_holiday boolean")
    got = dict(tuple(r) for r in infer_subdivision(df, H.holiday_calendar(spark, 2015, 2015)).collect())
    for store in {r[0] for r in rows}:
        own = [(d, h) for s, d, h in rows if s == store]
        scores = [sum(h == (d in kept[s]) for d, h in own) for s in H.STATES]
        assert got[store] == H.STATES[scores.index(max(scores))]
    assert got[99] == H.STATES[[sum(d not in kept[s] for d in days[5:9]) for s in H.STATES].index(4)]


def test_holiday_matrix(spark):
    rows = {str(r["date"]): r for r in holiday_matrix(H.holiday_calendar(spark, 2015, 2015)).collect()}
    assert rows["2015-01-06"]["BY"] and not rows["2015-01-06"]["BE"]
