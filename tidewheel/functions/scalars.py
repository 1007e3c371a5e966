"""Scalar expressions on dates, flags and targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_HOLIDAY = "NoHoliday"


def iso_week_date(year: Column, week: Column, weekday: int = 1) -> Column:
    """The date of an ISO year, week and weekday (Monday is 1); null if year or week is."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    return F.date_add(fourth, (week - 1) * 7 + F.lit(weekday - 1) - F.weekday(fourth))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def state_holiday(value: Column) -> Column:
    """The code, or NoHoliday for null and '0'."""
    return F.when(value.isNull() | (F.trim(value) == "0"), F.lit(NO_HOLIDAY)).otherwise(value)


def is_state_holiday(value: Column) -> Column:
    return state_holiday(value) != NO_HOLIDAY


def is_school_holiday(value: Column) -> Column:
    """Any value but 0 is true, null too."""
    return F.coalesce(value.cast("boolean"), F.lit(True))


def log_sales(value: Column) -> Column:
    return F.log1p(value)


def libm(name: str, x: Column) -> Column:
    """``log`` or ``exp`` as ``java.lang.Math`` has it; null for null, and for the log of what is not positive.

    Spark's own are StrictMath's, whose last bit is off in about one log of a hundred and one
    exponential of ten. Where a result that ends on a half is rounded, that bit decides. To
    Spark a reflected call may change between runs, so this is a column before it is aggregated.
    """
    own = F.call_function("reflect", F.lit("java.lang.Math"), F.lit(name), x.cast("double")).cast("double")
    return F.when(x > 0 if name == "log" else x.isNotNull(), own)


def calendar_columns(day: Column, prefix: str = "") -> dict[str, Column]:
    """Date parts; weeks of the month count from day 0, weekdays from Monday = 0."""
    weekday, of_month = F.weekday(day), F.dayofmonth(day)
    return {
        f"{prefix}year": F.year(day),
        f"{prefix}quarter": F.quarter(day),
        f"{prefix}month": F.month(day),
        f"{prefix}week_of_month": (F.floor(of_month / 7) + 1).cast("int"),
        f"{prefix}day_of_week": weekday,
        f"{prefix}is_month_start": of_month == 1,
        f"{prefix}is_weekend": weekday >= 5,
        f"{prefix}is_weekday": weekday < 5,
        f"{prefix}is_month_end": day == F.last_day(day),
    }


def competition_days(since: Column, day: Column, horizon: int) -> Column:
    """Days since the competitor's start at day + horizon; null before it."""
    days = F.datediff(F.date_add(day, horizon), since)
    return F.when(days >= 0, days)
