"""Air, sea and ice relations as column expressions, after the formulas the literature names."""

from __future__ import annotations

import math
from itertools import accumulate, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stefan-Boltzmann, solar constant, absorption by water and ozone, density of air.
STEFAN_BOLTZMANN = 5.67e-8
SOLAR = 1365.0
ABSORBED = 0.09
AIR_DENSITY = 1.2
EMISSIVITY = 0.97


def saturation_vapour(t: Column) -> Column:
    """Pa over ice below 273.16 K, over water above; 0 far below."""
    cold = t < 273.16
    exponent = F.when(cold, 22.587).otherwise(17.502) * (t - 273.16) / (t - F.when(cold, -0.7).otherwise(32.19))
    return F.when(exponent < -20, 0.0).otherwise(610.78 * F.exp(exponent))


def mixing_ratio(e: Column, p: Column) -> Column:
    return 0.622 * e / (p - e)


def relative_humidity(e_air: Column, e_dew: Column, p: Column) -> Column:
    """Percent."""
    return 100 * (e_dew / (p - e_dew)) * ((p - e_air) / e_air)


def longwave_down(kind: str, t: Column, e: Column, cloud: Column, lat: Column | None = None) -> Column:
    """Downwelling longwave flux by one of five formulas; ``e`` in Pa, cloud cover 0 to 1."""
    black, mbar = STEFAN_BOLTZMANN * t**4, e * 0.01
    if kind == "berliand":
        return EMISSIVITY * black * (0.39 - 0.05 * F.sqrt(mbar)) * (1 - 0.6823 * cloud * cloud)
    if kind == "bignami":
        return black * (0.653 + 0.00535 * mbar) * (1 + 0.1762 * cloud * cloud)
    if kind == "budyko":
        saturated = 611 * F.pow(F.lit(10.0), 7.5 * (t - 273.16) / (t - 35.86))
        chi = 0.5 + 0.246 * F.abs(F.radians(lat))
        return EMISSIVITY * black * (0.254 - 4.95e-5 * saturated) * (1 - chi * F.pow(F.least(F.lit(1.0), F.greatest(cloud, F.lit(0.0))), F.lit(1.2)))
    if kind == "efimova_jacobs":
        return black * (0.746 + 0.0066 * mbar) * (1 + 0.26 * cloud)
    if kind == "maykut_jacobs":
        return black * 0.7855 * (1 + 0.26 * cloud)
    raise NotImplementedError(f"longwave formula {kind!r}")


def wind_stress(u: Column, v: Column) -> tuple[Column, Column]:
    """Stress components with a drag that depends on speed, clamped to 2.5 to 32.5 m/s."""
    speed = F.sqrt(u * u + v * v)
    bound = F.greatest(F.lit(2.5), F.least(F.lit(32.5), speed))
    drag = 1e-3 * (0.692 + 0.0710 * bound - 0.0007 * bound * bound)
    return u * speed * AIR_DENSITY * drag, v * speed * AIR_DENSITY * drag


def shortwave_all_sky(top: Column, cos_zenith: Column, cos_noon: Column, cloud: Column) -> Column:
    """Surface shortwave from the flux at cloud top."""
    direct = top * F.pow(F.lit(0.7), 1 / (cos_zenith + 1e-2))
    diffuse = ((1 - ABSORBED) * top - direct) * 0.5
    noon = F.degrees(F.greatest(F.lit(0.0), F.asin(cos_noon)))
    return (direct + diffuse) * (1 - 0.62 * cloud + 0.0019 * noon)


def daily_insolation(day: Column, days_in_year: float, cloud: Column, lat: Column) -> Column:
    """Mean surface shortwave of a day, from 24 parts of its first half."""
    angle = 2 * math.pi * F.floor(F.pmod(day, F.lit(float(days_in_year)))) / days_in_year
    # Series of the declination and of the sun's distance.
    declination = (
        0.006918 + 0.070257 * F.sin(angle) - 0.399912 * F.cos(angle) + 0.000907 * F.sin(2 * angle)
        - 0.006758 * F.cos(2 * angle) + 0.001480 * F.sin(3 * angle) - 0.002697 * F.cos(3 * angle)
    )
    distance = 1.00011 + 0.001280 * F.sin(angle) + 0.034221 * F.cos(angle) + 0.000077 * F.sin(2 * angle) + 0.000719 * F.cos(2 * angle)
    s, c = F.sin(F.radians(lat)) * F.sin(declination), F.cos(F.radians(lat)) * F.cos(declination)
    noon = F.degrees(F.greatest(F.lit(0.0), F.asin(F.least(F.lit(1.0), s + c))))
    factor = 1 - 0.62 * cloud + 0.0019 * noon

    def part(k: int) -> Column:
        hour = 2 * math.pi * (((k - 0.5) / 48 + 0.5) % 1.0)  # angle from noon
        zenith = F.greatest(F.lit(0.0), s + c * math.cos(hour))
        top = SOLAR * distance * zenith
        direct = top * F.pow(F.lit(0.7), F.least(F.lit(100.0), 1 / (zenith + 1e-9)))
        return direct + ((1 - ABSORBED) * top - direct) * 0.5

    return sum((part(k) for k in range(2, 25)), part(1)) * factor / 24


# Polynomial coefficients of sigma-0, sigma-2 and sigma-4, and their reference pressures.
SIGMA = {
    0: ((-1.36471e-01, 4.68181e-02, 8.07004e-01, -7.45353e-03, -2.94418e-03, 3.43570e-05, 3.48658e-05), 0.0),
    2: ((9.77093e00, -2.26493e-02, 7.89879e-01, -6.43205e-03, -2.62983e-03, 2.75835e-05, 3.15235e-05), 2000e4),
    4: ((1.92362e01, -8.82080e-02, 7.73552e-01, -5.46858e-03, -2.31866e-03, 2.11306e-05, 2.82474e-05), 4000e4),
}


def sea_density(level: int, temp: Column, saln: Column) -> Column:
    """Potential density anomaly sigma at a reference level (0, 2 or 4)."""
    (c1, c2, c3, c4, c5, c6, c7), _ = SIGMA[level]
    return c1 + c3 * saln + temp * (c2 + c5 * saln + temp * (c4 + c7 * saln + c6 * temp))


def thermobaricity(level: int, temp: Column, saln: Column, pressure: Column, reference: float = 1e-3) -> Column:
    """Correction of specific volume with pressure."""
    offset = 2000e4
    base = SIGMA[level][1] - offset
    t = F.greatest(F.lit(-2.0), F.least(F.lit(32.0), temp)) - 3.0
    s = F.greatest(F.lit(30.0), F.least(F.lit(38.0), saln)) - 35.0
    p = pressure - offset
    # Coefficients in t, s and p.
    qt, qs, qtt, qst, qttt, qpt, qpst, qptt = -2.41701e-01, -1.05131e-01, 4.03001e-03, 1.06829e-03, -3.03869e-05, 1.00638e-09, 1.48599e-11, -1.31384e-11
    inner = s * (qs + t * qst) + t * (qt + t * (qtt + t * qttt) + 0.5 * (p + base) * (qpt + s * qpst + t * qptt))
    return 1e-11 / reference * (p - base) * inner


def ice_limit(conc: Column, kind: str = "seaice") -> Column:
    """Largest thickness of ice or snow that a concentration allows; 9999 where it sets none."""
    # Bounds of the two bands and their coefficients.
    a, b, c, d, e = {"seaice": (1.3, 8.0, 0.76, 0.09, 2.5), "snow": (0.2, 2.0, 1.3, 0.03, 0.7)}[kind]
    return F.when((conc > 0.55) & (conc < 0.8), a + F.exp(b * (conc - c))).when((conc > 0) & (conc < 0.55), d + e * conc).otherwise(9999.0)


#: Upper bounds of the standard thickness categories, by their number.
STANDARD_CATEGORIES = {5: (0.3, 0.7, 1.2, 2.0, 999.0), 6: (0.15, 0.3, 0.7, 1.2, 2.0, 999.0), 7: (0.1, 0.15, 0.3, 0.7, 1.2, 2.0, 999.0)}


def _widening(n: int, narrow: float, factor: float, steepness: float) -> list[float]:
    """Category widths that grow from ``narrow`` along a hyperbolic tangent, whose middle is the last category but one."""
    return [narrow * (1 + factor * (1 + math.tanh(steepness * (place / n - 1)))) for place in range(-1, n - 1)]


def category_bounds(n: int, scheme: int = 0, remap: int = 1) -> list[float]:
    """Bounds of ``n`` ice thickness categories, the running sums of their widths.

    Schemes: 0 widths along a hyperbolic tangent (for linear remapping or, with ``remap`` 0, for delta
    functions), 1 widths that grow by a constant, 2 the standard categories, -1 one category.
    """
    tangent = {1: (0.0, 3.0 / n, 15.0, 3.0)}.get(remap, (0.1, max(1.1 / n, 0.1), 25.0, 2.25))
    widths = {
        0: lambda: (tangent[0], _widening(n, *tangent[1:])),
        1: lambda: (0.0, [(0.0 if k == 0 else 3.0 + k - 1) / n for k in range(n)]),
        2: lambda: (0.0, [b - a for a, b in pairwise((0.0, *STANDARD_CATEGORIES[n]))]),
        -1: lambda: (0.0, [100.0]),
    }
    if scheme not in widths:
        raise ValueError(f"category scheme {scheme}")
    first, each = widths[scheme]()
    return [float(x) for x in accumulate(each, initial=first)]
