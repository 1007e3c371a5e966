"""Calendar-indexed operators on a panel of daily series.

All of them use one window, partitioned by the entity and ordered by the day's number, so that
a query of many features has one exchange and one sort; what lies ahead is looked up in the same
partitions from the last day to the first, so that every frame only grows from row to row. Lags
are by calendar, not by row.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY = "day_no"
UNIT_DAYS = {"days": 1, "weeks": 7}
UNIT_MONTHS = {"months": 1, "years": 12}
AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp}


def with_day(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumn(DAY, F.unix_date(date_col))


def series(*entity: str) -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(DAY)


def series_backwards(*entity: str) -> WindowSpec:
    """The same rows from the last day to the first."""
    return Window.partitionBy(*entity).orderBy(F.col(DAY).desc())


def at_offset(value: Column, days: int, w: WindowSpec) -> Column:
    """The value exactly so many days later (earlier if negative); null if that day is absent."""
    return F.max(value).over(w.rangeBetween(days, days))


def lag_columns(value: Column, offsets: Iterable[tuple[str, int]], w: WindowSpec) -> dict[str, Column]:
    """lag_{unit}_{n} for days and weeks."""
    return {f"lag_{unit}_{n}": at_offset(value, -n * UNIT_DAYS[unit], w) for unit, n in offsets}


def diff_columns(value: Column, offsets: Iterable[tuple[str, int]], w: WindowSpec) -> dict[str, Column]:
    """diff_{unit}_{n} for days and weeks; month and year ends collide, so they have no difference."""
    offsets = list(offsets)
    if bad := [unit for unit, _ in offsets if unit not in UNIT_DAYS]:
        raise ValueError(f"differences over {bad[0]} are not defined")
    return {f"diff_{unit}_{n}": value - at_offset(value, -n * UNIT_DAYS[unit], w) for unit, n in offsets}


def rolling_columns(value: Column, windows: Iterable[str | int], w: WindowSpec, agg: str = "mean") -> dict[str, Column]:
    """rolling_{agg}_{window}: '7D' covers 7 calendar days, an int so many rows (null until full)."""
    out = {}
    for window in windows:
        if isinstance(window, str):
            frame = w.rangeBetween(1 - int(window.removesuffix("D")), 0)
            out[f"rolling_{agg}_{window}"] = AGGREGATES[agg](value).over(frame)
        else:
            frame = w.rowsBetween(1 - window, 0)
            out[f"rolling_{agg}_{window}"] = F.when(F.count(value).over(frame) == window, AGGREGATES[agg](value).over(frame))
    return out


def with_month_lags(df: DataFrame, value: str, offsets: Iterable[tuple[str, int]], entity: tuple[str, ...], date_col: str = "date") -> DataFrame:
    """Adds lag_{unit}_{n} for months and years.

    Sources move forward by whole months, clipped to the month's end; of sources that meet on
    one day the latest counts. Moved sources and rows are grouped by entity and day in one
    aggregation, dealt by entity alone so that windows over the series need no further
    exchange. (entity, date) is the table's key.
    """
    offsets = list(offsets)
    if not offsets:
        return df
    months = [n * UNIT_MONTHS[unit] for unit, n in offsets]
    moves = F.array(*(F.struct(F.lit(k).alias("k"), F.add_months(F.col(date_col), m).alias("to")) for k, m in enumerate(months)))
    moved = df.select(*entity, F.explode(moves).alias("x"), F.col(date_col).alias("s"), F.col(value).alias("v"))
    moved = moved.select(*entity, F.col("x.to").alias(date_col), F.col("x.k").alias("k"), "s", "v", F.lit(None).cast(df.select(F.struct("*").alias("r")).schema["r"].dataType).alias("row"))
    own = df.select(*entity, date_col, F.lit(-1).alias("k"), F.lit(None).cast("date").alias("s"), F.lit(None).cast("double").alias("v"), F.struct(*df.columns).alias("row"))
    both = own.unionByName(moved).repartition(*entity)
    lags = [F.max_by("v", F.when(F.col("k") == k, F.col("s"))).alias(f"lag_{unit}_{n}") for k, (unit, n) in enumerate(offsets)]
    grouped = both.groupBy(*entity, date_col).agg(F.first("row", ignorenulls=True).alias("row"), *lags)
    return grouped.where(F.col("row").isNotNull()).select("row.*", *(f"lag_{unit}_{n}" for unit, n in offsets))


def run_length(df: DataFrame, active: str, out: str, w: WindowSpec) -> DataFrame:
    """Adds the number of rows since the last inactive one; 0 on an inactive row."""
    rn = F.row_number().over(w)
    df = df.withColumn("_rn", rn)
    off = F.last(F.when(~F.coalesce(F.col(active).cast("boolean"), F.lit(False)), F.col("_rn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, (F.col("_rn") - F.coalesce(off, F.lit(0))).cast("int")).drop("_rn")


def next_event_days(event: Column, horizon: int, back: WindowSpec) -> Column:
    """Days from day + horizon to the first event on or after it; ``back`` is the series backwards."""
    at = F.col(DAY) + horizon
    return (F.min(F.when(event, F.col(DAY))).over(back.rangeBetween(Window.unboundedPreceding, -horizon)) - at).cast("int")


def since_event_days(event: Column, horizon: int, w: WindowSpec) -> Column:
    """Days from the last event on or before day + horizon to it."""
    at = F.col(DAY) + horizon
    return (at - F.max(F.when(event, F.col(DAY))).over(w.rangeBetween(Window.unboundedPreceding, horizon))).cast("int")


#: Waves below the square root of the double's epsilon count as 0.
WAVE_EPS = 1.4901161193847656e-08


def wave(days: Column, sigma: float) -> Column:
    """exp(-days^2 / (2 sigma^2)), 0 if tiny, null without an event."""
    value = F.exp(-(days.cast("double") * days.cast("double")) / (2.0 * sigma * sigma))
    return F.when(F.abs(value) < WAVE_EPS, 0.0).otherwise(value)


def extended_name(name: Column, pre: Column, post: Column, devs: float, w: WindowSpec, back: WindowSpec) -> Column:
    """Within the waves' reach the nearer holiday's name: the next one's if pre >= post, else the last one's."""
    import math

    threshold = math.exp(-devs * devs / 2.0)
    following = F.last(name, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    previous = F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when((pre >= threshold) | (post >= threshold), F.when(pre >= post, following).otherwise(previous))


def all_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
