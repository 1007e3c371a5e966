"""Public holidays of Germany's states, generated from their rules."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

# State codes in order, holiday names, dates and the states that keep them.
STATES = ("BB", "BE", "BW", "BY", "HB", "HE", "HH", "MV", "NI", "NW", "RP", "SH", "SL", "SN", "ST", "TH")
#: name, month, day, states (None: all), first year, last year
FIXED = (
    ("New Year's Day", 1, 1, None, 0, 9999),
    ("Epiphany", 1, 6, ("BW", "BY", "ST"), 0, 9999),
    ("International Women's Day", 3, 8, ("BE",), 2019, 9999),
    ("International Women's Day", 3, 8, ("MV",), 2023, 9999),
    ("Labor Day", 5, 1, None, 0, 9999),
    ("Assumption Day", 8, 15, ("SL",), 0, 9999),
    ("World Children's Day", 9, 20, ("TH",), 2019, 9999),
    ("German Unity Day", 10, 3, None, 1990, 9999),
    ("Reformation Day", 10, 31, ("BB", "MV", "SN", "ST", "TH"), 1991, 9999),
    ("Reformation Day", 10, 31, ("BE", "BW", "BY", "HB", "HE", "HH", "NI", "NW", "RP", "SH", "SL"), 2017, 2017),
    ("Reformation Day", 10, 31, ("HB", "HH", "NI", "SH"), 2018, 9999),
    ("All Saints' Day", 11, 1, ("BW", "BY", "NW", "RP", "SL"), 0, 9999),
    ("Christmas Day", 12, 25, None, 0, 9999),
    ("Second Day of Christmas", 12, 26, None, 0, 9999),
)
#: name, days after Easter Sunday, states (None: all)
MOVABLE = (
    ("Good Friday", -2, None),
    ("Easter Sunday", 0, ("BB",)),
    ("Easter Monday", 1, None),
    ("Ascension Day", 39, None),
    ("Whit Sunday", 49, ("BB",)),
    ("Whit Monday", 50, None),
    ("Corpus Christi", 60, ("BW", "BY", "HE", "NW", "RP", "SL")),
)


def easter(year: int) -> date:
    """Easter Sunday by the Gregorian computus."""
    golden, century = year % 19, year // 100
    moon = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon -= moon // 28 * (1 - moon // 28 * (29 // (moon + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    return date(year, 3, 28) + timedelta(days=moon - weekday)


def repentance_day(year: int) -> date:
    """The Wednesday before 23 November."""
    last = date(year, 11, 22)
    return last - timedelta(days=(last.weekday() - 2) % 7)


def subdivisions(country: str = "DE") -> tuple[str, ...]:
    if country != "DE":
        raise ValueError(f"no holiday rules for {country}")
    return STATES


def holiday_rows(first_year: int, last_year: int, country: str = "DE") -> Iterator[tuple[date, str, str]]:
    """(date, name, subdiv) for each state's holidays; names of one day are joined by '; '."""
    subdivisions(country)
    found: dict[tuple[date, str], list[str]] = {}
    for year in range(first_year, last_year + 1):
        days = [(date(year, m, d), name, states) for name, m, d, states, a, b in FIXED if a <= year <= b]
        days += [(easter(year) + timedelta(days=k), name, states) for name, k, states in MOVABLE]
        days.append((repentance_day(year), "Repentance and Prayer Day", None if year < 1995 else ("SN",)))
        for day, name, states in days:
            for state in states or STATES:
                found.setdefault((day, state), []).append(name)
    for (day, state), names in sorted(found.items()):
        yield day, "; ".join(names), state


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int, country: str = "DE") -> DataFrame:
    """Calendar table; at most about 200 rows a year, so it is broadcast in joins."""
    return spark.createDataFrame(list(holiday_rows(first_year, last_year, country)), "date date, name string, subdiv string")
