"""From a raw panel to the forecasting dataset: one exchange by entity for all window features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import series as W
from tidewheel.operators.geo import infer_subdivision
from tidewheel.plans.settings import Features
from tidewheel.sources.holidays import holiday_calendar

ENTITY = ("store",)


def preprocess(panel: DataFrame, cfg: Features = Features()) -> DataFrame:
    """Adds promo2_since, competition_start, is_state_holiday and is_school_holiday; drops their sources."""
    opening = S.iso_week_date if cfg.competition_month_as_week else S.month_start
    return (
        panel.withColumn("date", F.to_date("date"))
        .withColumn("promo2_since", S.iso_week_date(F.col("promo2_year"), F.col("promo2_week")))
        .withColumn("competition_start", opening(F.col("competition_year"), F.col("competition_month")))
        .withColumn("is_state_holiday", S.is_state_holiday(F.col("state_holiday")))
        .withColumn("is_school_holiday", S.is_school_holiday(F.col("school_holiday")))
        .drop("promo2_year", "promo2_week", "competition_year", "competition_month", "state_holiday", "school_holiday")
    )


def positive(panel: DataFrame) -> DataFrame:
    """Rows with sales, with the log of sales and the day's number."""
    return W.with_day(panel.where("sales > 0")).withColumn("v", S.log_sales(F.col("sales")))


def calendar_for(df: DataFrame, horizon: int, country: str = "DE") -> DataFrame:
    """The holiday calendar of the years that the panel's days, and those days + horizon, fall in.

    A job finds the first and the last day while the query is planned; give ``feature_matrix`` a
    calendar to spare it.
    """
    first, last = df.agg(F.min("date"), F.max(F.date_add("date", horizon))).first()
    if first is None:
        return holiday_calendar(df.sparkSession, 2000, 2000, country)
    return holiday_calendar(df.sparkSession, first.year, last.year, country)


def with_holiday_name(df: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """Adds ``name``: the holiday at day + horizon in the row's subdivision."""
    cal = calendar.select(F.col("date").alias("_on"), F.col("subdiv").alias("_in"), "name")
    at = (F.date_add("date", horizon) == F.col("_on")) & (F.col("subdivision") == F.col("_in"))
    return df.join(F.broadcast(cal), at, "left").drop("_on", "_in")


def feature_matrix(panel: DataFrame, cfg: Features = Features(), horizon: int = 30, with_target: bool = False, calendar: DataFrame | None = None) -> DataFrame:
    """Key columns and the 53 features of every row with sales; with ``y`` where it is asked for."""
    pos = positive(preprocess(panel, cfg))
    calendar = calendar if calendar is not None else calendar_for(pos, horizon, cfg.country)
    states = infer_subdivision(pos, calendar, "is_state_holiday")
    short = [(u, n) for u, n in cfg.lags if u in W.UNIT_DAYS]
    long = [(u, n) for u, n in cfg.lags if u in W.UNIT_MONTHS]
    w, back = W.series(*ENTITY), W.series_backwards(*ENTITY)
    rows = W.with_month_lags(pos, "v", long, ENTITY)
    rows = W.run_length(rows, "promo", "_promo", w)
    rows = W.run_length(rows, "promo2", "_promo2", w)
    event = F.col("is_state_holiday")
    made: dict[str, Column] = {}
    made |= W.lag_columns(F.col("v"), short, w) | W.diff_columns(F.col("v"), cfg.diffs, w) | W.rolling_columns(F.col("v"), cfg.windows, w)
    made |= {"_next": W.next_event_days(event, horizon, back), "_since": W.since_event_days(event, horizon, w)}
    made |= {"Promo": W.at_offset(F.col("_promo"), horizon, w), "Promo2": W.at_offset(F.col("_promo2"), horizon, w)}
    if with_target:
        made["y"] = W.at_offset(F.col("v"), horizon, w) - F.col("v")
    raw = [c for c in rows.columns if c.lower() not in ("promo", "promo2")]
    rows = rows.select(*raw, *(c.alias(n) for n, c in made.items()))
    rows = rows.withColumn("pre_holiday_wave", W.wave(F.col("_next"), cfg.sigma)).withColumn("post_holiday_wave", W.wave(F.col("_since"), cfg.sigma))
    rows = with_holiday_name(rows.join(_maybe_broadcast(states), list(ENTITY)), calendar, horizon)
    rows = rows.withColumn("holiday_name", W.extended_name(F.col("name"), F.col("pre_holiday_wave"), F.col("post_holiday_wave"), cfg.extension_devs, w, back))
    parts = S.calendar_columns(F.date_add("date", horizon))
    columns = [f"lag_{u}_{n}" for u, n in cfg.lags] + [f"diff_{u}_{n}" for u, n in cfg.diffs] + [f"rolling_mean_{k}" for k in cfg.windows]
    out = rows.select(
        *ENTITY, "date", *columns, *(c.alias(n) for n, c in parts.items()), "pre_holiday_wave", "post_holiday_wave", "holiday_name",
        S.competition_days(F.col("competition_start"), F.col("date"), horizon).alias("competition_days_since_start"),
        "Promo", "Promo2", F.col("store_type").alias("StoreType"), F.col("assortment").alias("Assortment"), "subdivision", *(["y"] if with_target else []),
    )
    return out


def _maybe_broadcast(states: DataFrame) -> DataFrame:
    """One row per entity; Spark broadcasts it only if it turns out small at run time."""
    return states


def dataset(panel: DataFrame, cfg: Features = Features(), horizon: int = 30, calendar: DataFrame | None = None) -> DataFrame:
    """Features and target of the rows that have a target."""
    return feature_matrix(panel, cfg, horizon, True, calendar).where(F.col("y").isNotNull())


def category_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each string column's values as 0, 1, ... in the order of the values; null stays null.

    The distinct values of a column are few by nature; they are ranked on their own and joined
    back, so the table itself is never sorted in one task.
    """
    from pyspark.sql import Window

    for c in columns:
        codes = df.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"{c}_index", (F.row_number().over(Window.orderBy(c)) - 1).cast("int"))
        df = df.join(codes, c, "left")
    return df
