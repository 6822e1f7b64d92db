"""ISO week columns."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column | str) -> Column:
    """Monday of the ISO week, as a date (no time zone involved)."""
    return F.trunc(day, "week")


def iso_week(monday: Column | str) -> list[Column]:
    """week_start, iso_year (the year of the week's Thursday) and iso_week of a Monday."""
    start = F.col(monday) if isinstance(monday, str) else monday
    return [
        start.alias("week_start"),
        F.year(F.date_add(start, 3)).alias("iso_year"),
        F.weekofyear(start).alias("iso_week"),
    ]


def week_label(year: Column | str, week: Column | str) -> Column:
    """Readable week label, for example 2026-S14."""
    return F.format_string("%d-S%02d", year, week)


def monday_of(day: date) -> date:
    return day - timedelta(days=day.weekday())
