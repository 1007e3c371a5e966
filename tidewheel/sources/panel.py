"""Sources and sinks: CSV and Parquet tables, and the daily panel over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALES_SCHEMA = "Store int, DayOfWeek int, Date date, Sales double, Customers int, Open int, Promo int, StateHoliday string, SchoolHoliday int"
STORE_SCHEMA = "Store int, StoreType string, Assortment string, CompetitionDistance double, CompetitionOpenSinceMonth int, CompetitionOpenSinceYear int, Promo2 int, Promo2SinceWeek int, Promo2SinceYear int, PromoInterval string"
PREDICTION_SCHEMA = "store bigint, date date, sales_actual double, sales_predicted bigint"

#: Column names of the CSV tables and those of the panel.
RENAMED = {
    "Store": "store", "Date": "date", "Sales": "sales", "Promo": "promo", "StateHoliday": "state_holiday", "SchoolHoliday": "school_holiday",
    "StoreType": "store_type", "Assortment": "assortment", "Promo2": "promo2", "Promo2SinceYear": "promo2_year", "Promo2SinceWeek": "promo2_week",
    "CompetitionOpenSinceYear": "competition_year", "CompetitionOpenSinceMonth": "competition_month",
}

#: The panel of suppliers and ship days; runs unchanged in Spark SQL and DuckDB.
PANEL_SQL = """
SELECT f.store, f.day AS date, f.sales, f.promo,
       CASE WHEN (month(f.day)=1 AND day(f.day)=1) OR (month(f.day)=5 AND day(f.day)=1)
              OR (month(f.day)=10 AND day(f.day)=3) OR (month(f.day)=12 AND day(f.day) IN (25,26)) THEN 'a'
            WHEN f.store % 2 = 0 AND ((month(f.day)=1 AND day(f.day)=6) OR (month(f.day)=11 AND day(f.day)=1)) THEN 'a'
            ELSE '0' END AS state_holiday,
       CASE WHEN month(f.day) IN (7,8) THEN 1 ELSE 0 END AS school_holiday,
       CASE d.s_nationkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS store_type,
       CASE d.s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS assortment,
       CAST(d.s_suppkey % 2 AS INT) AS promo2,
       CASE WHEN d.s_suppkey % 7 = 0 THEN NULL ELSE CAST(1995 + d.s_suppkey % 5 AS INT) END AS competition_year,
       CASE WHEN d.s_suppkey % 7 = 0 THEN NULL ELSE CAST(1 + d.s_suppkey % 12 AS INT) END AS competition_month,
       CASE WHEN d.s_suppkey % 2 = 0 THEN NULL ELSE CAST(1995 + d.s_suppkey % 4 AS INT) END AS promo2_year,
       CASE WHEN d.s_suppkey % 2 = 0 THEN NULL ELSE CAST(1 + (d.s_suppkey * 3) % 52 AS INT) END AS promo2_week
FROM (SELECT l_suppkey AS store, CAST(l_shipdate AS DATE) AS day,
             SUM(CASE WHEN l_linestatus='F' THEN l_extendedprice*(1-l_discount) ELSE 0.0 END) AS sales,
             MAX(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS promo
      FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) f
JOIN {supplier} d ON d.s_suppkey = f.store
"""


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and ship day."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier")}
    return spark.sql(PANEL_SQL.format(lineitem="{lineitem}", supplier="{supplier}"), **tables)


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SALES_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)


def read_stores_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)


def store_join(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Inner join of the fact table with its store dimension, in the panel's column names.

    The dimension has a row per store; whether it is broadcast is left to its measured size.
    """
    joined = sales.join(stores, "Store", "inner")
    return joined.withColumnsRenamed(RENAMED).drop("Customers", "Open", "DayOfWeek", "CompetitionDistance", "PromoInterval")


def write_predictions(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).option("header", True).csv(path)
