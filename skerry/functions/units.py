"""Unit conversion, numeric times and text notation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# base = value * scale + offset, by group of units.
UNITS = {
    "speed": {"m/s": (1.0, 0.0), "km/h": (1 / 3.6, 0.0), "km/day": (1 / 86.4, 0.0), "cm/s": (0.01, 0.0)},
    "length": {"m": (1.0, 0.0), "mm": (0.001, 0.0), "cm": (0.01, 0.0), "dm": (0.1, 0.0), "km": (1000.0, 0.0)},
    "time": {"s": (1.0, 0.0), "min": (60.0, 0.0), "h": (3600.0, 0.0), "day": (86400.0, 0.0)},
    "weight": {"g": (1.0, 0.0), "kg": (1000.0, 0.0)},
    "temperature": {"K": (1.0, 0.0), "C": (1.0, 273.15), "F": (5 / 9, 273.15 - 32 * 5 / 9)},
    "pressure": {"Pa": (1.0, 0.0), "hPa": (100.0, 0.0), "bar": (100000.0, 0.0), "mbar": (100.0, 0.0)},
    "energy_flux": {"W/m2": (1.0, 0.0), "J/m2/d": (1 / 86400.0, 0.0)},
}
#: Hours from 1900-01-01 to 1970-01-01, UTC.
EPOCH_HOURS = 613_608


def convert(value: Column, units_from: str | float, units_to: str | float) -> Column:
    """``value`` in other units; numbers are plain scale factors, unknown or unlike units an error."""
    if isinstance(units_from, (int, float)) and isinstance(units_to, (int, float)):
        return value * units_to / units_from
    if units_from == units_to:
        return value
    for group in UNITS.values():
        if units_from in group and units_to in group:
            (scale, offset), (to_scale, to_offset) = group[units_from], group[units_to]
            return (value * scale + (offset - to_offset)) / to_scale
    raise ValueError(f"can't convert {units_from!r} to {units_to!r}")


def hours_since_1900(time: Column) -> Column:
    return F.unix_micros(time) / 3.6e9 + EPOCH_HOURS


def from_hours_since_1900(hours: Column) -> Column:
    return F.timestamp_micros(F.round((hours - EPOCH_HOURS) * 3.6e9).cast("long"))


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def cycle_before(time: Column, period_hours: float, start: Column | None = None) -> Column:
    """The analysis time one cycle earlier, not before the start."""
    before = F.timestamp_micros(F.unix_micros(time) - int(period_hours * 3.6e9))
    return before if start is None else F.greatest(before, start)


def cycle_after(time: Column, period_hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(time) + int(period_hours * 3.6e9))


def member_name(member: Column) -> Column:
    """``_mem001`` for member 0."""
    return F.format_string("_mem%03d", member + 1)


_NUMBER = r"\A-?[0-9]+(\.[0-9]*)?[eE]-?[0-9]+\z"
_TRUE, _FALSE = ("y", "yes", "on", "t", "true", ".true."), ("n", "no", "off", "f", "false", ".false.")


def notation_number(text: Column) -> Column:
    """Numbers in scientific notation, and infinities; null for other texts, also for those with blanks around."""
    low = F.lower(text)
    return F.when(text.rlike(_NUMBER), text.cast("double")).when(low == "inf", float("inf")).when(low == "-inf", float("-inf"))


def notation_bool(text: Column) -> Column:
    """Truth values as configurations write them; null for other texts, also for those with blanks around."""
    low = F.lower(text)
    return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False)
