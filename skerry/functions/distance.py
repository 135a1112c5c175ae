"""Distances and localization factors as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0


def axis_gap(a: Column, b: Column, length: float | None = None) -> Column:
    """Distance along one axis; with a length, around a ring."""
    gap = F.abs(a - b)
    return gap if length is None else F.least(gap, length - gap)


def planar(ax: Column, bx: Column, ay: Column, by: Column, p: int = 2, lx: float | None = None, ly: float | None = None) -> Column:
    """L1 or L2 distance, around the ring in the cyclic dimensions."""
    dx, dy = axis_gap(ax, bx, lx), axis_gap(ay, by, ly)
    return dx + dy if p == 1 else F.sqrt(dx * dx + dy * dy)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Spherical law of cosines, in the unit of the radius."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return radius * F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def gaspari_cohn(distance: Column, radius: Column) -> Column:
    """Fifth-order compactly supported taper: 1 at 0, 0 from the radius on; an infinite radius gives 1."""
    r = F.greatest(2 * distance / radius, F.lit(1e-10))
    near = 1 + r * r * (-5 / 3 + r * (5 / 8 + r * (1 / 2 - r / 4)))
    far = 4 - 5 * r + r * r * (5 / 3 + r * (5 / 8 + r * (-1 / 2 + r / 12))) - 2 / (3 * r)
    return F.when(radius == float("inf"), 1.0).when(r < 1, near).when(r < 2, far).otherwise(0.0)


def step(distance: Column, radius: Column) -> Column:
    return F.when(distance <= radius, 1.0).otherwise(0.0)


def exponential(distance: Column, radius: Column) -> Column:
    return F.when(radius == float("inf"), 1.0).otherwise(F.exp(-distance / radius))


TAPERS: dict[str, Callable[[Column, Column], Column]] = {"gaspari_cohn": gaspari_cohn, "step": step, "exponential": exponential}
#: Those that are 0 beyond the radius.
COMPACT = ("gaspari_cohn", "step")


def taper(kind: str) -> Callable[[Column, Column], Column]:
    """A registered localization function; others are an error."""
    if kind.lower() not in TAPERS:
        raise NotImplementedError(f"localization {kind!r}")
    return TAPERS[kind.lower()]


def stereographic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Unit-sphere north polar stereographic x and y."""
    r = F.tan(F.radians(90 - lat) / 2)
    return r * F.sin(F.radians(lon)), r * F.cos(F.radians(lon))


def stereographic_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(x, y)), 90 - 2 * F.degrees(F.atan(F.sqrt(x * x + y * y)))
