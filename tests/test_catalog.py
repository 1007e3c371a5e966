"""Every registered query with SQL agrees with DuckDB."""

import pytest
from tables import DATA, duck, table

from tidewheel import catalog

#: Nested folds of 30 days need the longer panel.
LONG = {"cv_outer_folds", "cv_inner_folds", "cv_fold_rows", "fold_union"}


@pytest.fixture(scope="module")
def sql():
    return {sf: duck(sf) for sf in ("sf0.001", "sf0.01")}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, sql, name):
    sf = "sf0.01" if name in LONG else "sf0.001"
    mine = table(catalog.QUERIES[name](spark, f"{DATA}/{sf}").toArrow())
    theirs = table(sql[sf].execute(catalog.ORACLES[name]).to_arrow_table())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]


def test_entry_points(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(catalog.QUERIES) <= names and set(entry.oracle_sql()) <= names
    out = entry.entry(spark)
    assert len(out.columns) == 2 + 53
    assert out.count() == 2834


def test_one_exchange_by_entity_for_the_window_family(spark):
    from pyspark.sql import functions as F

    from tidewheel.operators import series as W

    df = catalog.pos(spark, f"{DATA}/sf0.001").select("store", "date", "day_no", "v", "promo")
    w = W.series("store")
    columns = W.lag_columns(F.col("v"), catalog.short(catalog.CFG.lags, "days", "weeks"), w) | W.diff_columns(F.col("v"), catalog.CFG.diffs, w) | W.rolling_columns(F.col("v"), catalog.CFG.windows, w)
    out = W.run_length(df, "promo", "run", w).select("store", "date", *(c.alias(n) for n, c in columns.items()), W.at_offset(F.col("run"), 30, w).alias("ahead"))
    physical = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert physical.count("Exchange hashpartitioning(store") == 1, physical
    # nothing but the windows stands above it; the panel's own join and aggregation lie below
    above = physical[: physical.index("Exchange hashpartitioning(store")]
    assert "Window" in above and "Exchange" not in above and "Join" not in above and "Aggregate" not in above, physical


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.daily_panel(spark, f"{DATA}/sf0.001").select("store", "sales")._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_orderkey" not in plan
