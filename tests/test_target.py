"""Forecasts that end on a half, which is rounded to the even whole number."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel import catalog
from tidewheel.functions.scalars import libm

#: Sales that end on a half, and whose logs' exponentials in doubles do not all.
HALVES = [12093.5, 57769.5, 1516.5, 10226.5, 23186.5, 70552.5, 20212.5, 32252.5, 59156.5, 23669.5]
#: Sales, and sales ``H`` days on that end on a half, where the last bits of StrictMath's logs round the other way than those of the SQL (of 41 such pairs tried, java.lang.Math's still do for one, 108851 and 93164.5, which is left out).
CHANGES = [
    (23815.0, 12138.5), (105747.0, 26311.5), (5915.0, 13117.5), (66123.0, 112441.5), (17284.0, 49713.5), (62970.0, 98324.5), (110600.0, 53741.5), (29124.0, 99547.5),
    (36789.0, 84965.5), (76975.0, 119492.5), (31005.0, 11839.5), (26767.0, 83612.5), (110034.0, 46850.5), (58152.0, 92786.5), (110407.0, 23432.5),
]


@pytest.fixture
def panel(spark, tmp_path):
    """Writes the tables for lines of (store, days since 1994-08-23, sales); gives their folder, and DuckDB with the tables."""

    def write(lines):
        lines = [(store, 9000 + day, float(sales)) for store, day, sales in lines]
        made = spark.createDataFrame(lines, "l_suppkey bigint, d int, l_extendedprice double").coalesce(1)
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("d"))
        made.select("l_suppkey", day.alias("l_shipdate"), "l_extendedprice", F.lit(0.0).alias("l_discount"), F.lit("F").alias("l_linestatus"), F.lit("A").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
        spark.range(1, max(lines)[0] + 1).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
        con = duckdb.connect()
        for t in ("lineitem", "supplier"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        return str(tmp_path), con

    return write


def rows(found) -> list[tuple]:
    return sorted(tuple(r) for r in found)


def test_a_forecast_of_no_change_rounds_halves_to_even(spark, panel):
    folder, con = panel([(k + 1, 40 * k + days, sales) for k, x in enumerate(HALVES) for days, sales in ((0, x), (catalog.H, 100.0))])
    mine = rows(catalog.forecast_join_closed_mask(spark, folder).collect())
    assert [r[3] for r in mine] == [round(x) for x in HALVES]
    assert mine == rows(con.execute(catalog.ORACLES["forecast_join_closed_mask"]).fetchall())


def test_a_union_of_folds_rounds_halves_to_even(spark, panel):
    days = range(330)
    folder, con = panel([(1, k, HALVES[k % 10] + k // 10) for k in days])
    mine = rows(catalog.fold_union(spark, folder).collect())
    tested = days[-catalog.SPLITS * catalog.H - catalog.H : -catalog.H]
    assert [r[2] for r in mine] == [round(HALVES[k % 10] + k // 10) for k in tested]
    assert mine == rows(con.execute(catalog.ORACLES["fold_union"]).fetchall())


def test_the_inverse_of_a_target_rounds_halves_as_the_sql(spark, panel):
    folder, con = panel([(k + 1, 40 * k + days, sales) for k, pair in enumerate(CHANGES) for days, sales in zip((0, catalog.H), pair)])
    mine = rows(catalog.target_inverse(spark, folder).collect())
    assert len(mine) == len(CHANGES)
    assert mine == rows(con.execute(catalog.ORACLES["target_inverse"]).fetchall())


def test_logs_and_exponentials_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(k, x) for k, x in enumerate([None, -1.0, 0.0, 1.0, inf, nan])], "k int, x double")
    logs, exps = zip(*((r[0], r[1]) for r in df.select("k", libm("log", F.col("x")).alias("l"), libm("exp", F.col("x")).alias("e")).orderBy("k").select("l", "e").collect()))
    assert logs[:5] == (None, None, None, 0.0, inf) and math.isnan(logs[5])
    assert exps[0] is None and exps[2] == 1.0 and exps[4] == inf and math.isnan(exps[5])
