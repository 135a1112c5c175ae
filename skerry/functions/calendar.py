"""Model days and calendar dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of model year: 360 or 366 days from January 16, 366 days from January 1, the calendar since 1901.
MONTHS_360, LEAP_16, LEAP_1, CALENDAR = range(4)


def model_day(kind: int, time: Column) -> Column:
    """A time as a model day; fractions are hours."""
    year, day, hour = F.year(time), F.dayofyear(time), F.hour(time) / 24
    if kind == MONTHS_360:
        return (year - 1) * 360.0 + day + hour - 16
    if kind == LEAP_16:
        return (year - 1) * 366.0 + day + hour - 16
    if kind == LEAP_1:
        return (year - 1) * 366.0 + day - hour - 1
    if kind == CALENDAR:
        return F.datediff(time, F.lit("1900-12-31").cast("date")) + hour
    raise ValueError(f"unknown kind of model year {kind}")


def date_of(day: Column) -> Column:
    """The date of a calendar model day."""
    return F.date_add(F.lit("1900-12-31").cast("date"), F.floor(day).cast("int"))


def days_since_1950(time: Column) -> Column:
    return F.datediff(time, F.lit("1950-01-01").cast("date"))


def file_dates(start: Column, end: Column, step_days: int) -> Column:
    """Dates of the forcing files that cover a time range, a file every so many days."""
    return F.sequence(F.to_date(start), F.to_date(end), F.expr(f"interval {int(step_days)} days"))
