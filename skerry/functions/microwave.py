"""Microwave brightness temperatures over sea and ice, with coefficients joined by channel.

Water vapour and cloud liquid water are columns in mm, wind is in m/s, temperatures in K and the incidence
angle in degrees. A channel is a frequency and a polarisation, ``19v``. ``with_channel`` joins what depends
on it, so rows of different channels go through one expression. Complex numbers are pairs of columns.

Functions take rows with columns ``vapour, liquid, wind, surface, ice, angle`` as far as they need them and
add a column. What several later steps use is a column of its own on the way (``mw_...``), so that it is
computed once and expressions stay small.
"""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published regression coefficients of the ocean algorithm, by frequency.
FREQUENCIES = {"06": 6.93, "10": 10.65, "19": 18.70, "22": 23.80, "37": 36.50, "50": 50.30, "52": 52.80, "90": 89.00}
ATMOSPHERE = {
    "b0": (239.50, 239.51, 240.24, 241.69, 239.45, 242.10, 245.87, 242.58),
    "b1": (213.92e-2, 225.19e-2, 298.88e-2, 310.32e-2, 254.41e-2, 229.17e-2, 250.61e-2, 302.33e-2),
    "b2": (-460.60e-4, -446.86e-4, -725.93e-4, -814.29e-4, -512.84e-4, -508.05e-4, -627.89e-4, -749.76e-4),
    "b3": (457.11e-6, 391.82e-6, 814.50e-6, 998.93e-6, 452.02e-6, 536.90e-6, 759.62e-6, 880.66e-6),
    "b4": (-16.84e-7, -12.20e-7, -36.07e-7, -48.37e-7, -14.36e-7, -22.07e-7, -36.06e-7, -40.88e-7),
    "b5": (0.50, 0.54, 0.61, 0.20, 0.58, 0.52, 0.53, 0.62),
    "b6": (-0.11, -0.12, -0.16, -0.20, -0.57, -4.59, -12.52, -0.57),
    "b7": (-0.21e-2, -0.34e-2, -1.69e-2, -5.21e-2, -2.38e-2, -8.78e-2, -23.26e-2, -8.07e-2),
    "oxygen1": (8.34e-3, 9.08e-3, 12.15e-3, 15.75e-3, 40.06e-3, 353.72e-3, 1131.76e-3, 53.35e-3),
    "oxygen2": (-0.48e-4, -0.47e-4, -0.61e-4, -0.87e-4, -2.00e-4, -13.79e-4, -2.26e-4, -1.18e-4),
    "vapour1": (0.07e-3, 0.18e-3, 1.73e-3, 5.14e-3, 1.88e-3, 2.91e-3, 3.17e-3, 8.78e-3),
    "vapour2": (0.00, 0.00, -0.05e-5, 0.19e-5, 0.09e-5, 0.24e-5, 0.27e-5, 0.80e-5),
    "liquid1": (0.0078, 0.0183, 0.0556, 0.0891, 0.2027, 0.3682, 0.4021, 0.9693),
    "liquid2": (0.0303, 0.0298, 0.0288, 0.0281, 0.0261, 0.0236, 0.0231, 0.0146),
}
# Roughness and foam, by polarisation and frequency.
SURFACE = {
    "v": {
        "r0": (-0.27e-3, -0.32e-3, -0.49e-3, -0.63e-3, -1.01e-3, -1.20e-3, -1.23e-3, -1.53e-3),
        "r1": (-0.21e-4, -0.29e-4, -0.53e-4, -0.70e-4, -1.05e-4, -1.12e-4, -1.13e-4, -1.16e-4),
        "r2": (-2.10e-5,) * 8,
        "r3": (0.00, 0.08e-6, 0.31e-6, 0.41e-6, 0.45e-6, 0.35e-6, 0.32e-6, -0.09e-6),
        "foam1": (0.00020, 0.00020, 0.00140, 0.00178, 0.00257, 0.00260, 0.00260, 0.00260),
        "foam2": (0.00690, 0.00690, 0.00736, 0.00730, 0.00701, 0.00700, 0.00700, 0.00700),
    },
    "h": {
        "r0": (0.54e-3, 0.72e-3, 1.13e-3, 1.39e-3, 1.91e-3, 1.97e-3, 1.97e-3, 2.02e-3),
        "r1": (0.32e-4, 0.44e-4, 0.70e-4, 0.85e-4, 1.12e-4, 1.18e-4, 1.19e-4, 1.30e-4),
        "r2": (-25.26e-6, -28.94e-6, -36.90e-6, -41.95e-6, -54.51e-6, -5.50e-5, -5.50e-5, -5.50e-5),
        "r3": (0.00, -0.02e-6, -0.12e-6, -0.20e-6, -0.36e-6, -0.43e-6, -0.44e-6, -0.46e-6),
        "foam1": (0.00200, 0.00200, 0.00293, 0.00308, 0.00329, 0.00330, 0.00330, 0.00330),
        "foam2": (0.00600, 0.00600, 0.00656, 0.00660, 0.00660, 0.00660, 0.00660, 0.00660),
    },
}
# Emissivity of ice and the share of the surface's temperature in that of the ice.
ICE = {
    "v": {"ice": (0.96, 0.9, 0.95, 0.95, 0.93, 0.9, 0.9, 0.90), "mix": (0.45, 0.4, 0.75, 0.90, 0.95, 0.4, 0.4, 0.97)},
    "h": {"ice": (0.88, 0.9, 0.90, 0.90, 0.88, 0.9, 0.9, 0.83), "mix": (0.40, 0.4, 0.47, 0.60, 0.70, 0.4, 0.4, 0.97)},
}
#: Emissivity of water where a constant one is asked for.
WATER = {"19v": 0.65, "37v": 0.75, "19h": 0.33, "37h": 0.41}
COSMIC, SALINITY, SPREAD, LIGHT_CM, HIGH_FREQUENCY = 2.726, 35.0, 0.012, 3.0e10, 4.44
Complex = tuple[Column, Column]


def channels() -> list[dict[str, float | str | bool | None]]:
    """What depends on the channel, a row each."""
    rows = []
    for pol in "vh":
        for k, (name, freq) in enumerate(FREQUENCIES.items()):
            fixed = {c: v[k] for table in (ATMOSPHERE, SURFACE[pol], ICE[pol]) for c, v in table.items()}
            rows.append({"channel": name + pol, "vertical": pol == "v", "freq": freq, **fixed, "water": WATER.get(name + pol)})
    return rows


def with_channel(rows: DataFrame, channel: str = "channel") -> DataFrame:
    """The rows with their channel's coefficients in a struct ``mw``; an unknown channel is an error when it is met."""
    table = channels()
    names = [c for c in table[0] if c != "channel"]
    kinds = ", ".join(f"{c} {'boolean' if c == 'vertical' else 'double'}" for c in names)
    known = rows.sparkSession.createDataFrame([tuple(r.values()) for r in table], f"mw_channel string, {kinds}")
    known = known.select("mw_channel", F.struct(*names).alias("mw"))
    joined = rows.join(F.broadcast(known), F.lower(F.col(channel)) == F.col("mw_channel"), "left").drop("mw_channel")  # 16 rows
    return joined.withColumn("mw", F.when(F.col("mw").isNull(), F.raise_error(F.concat(F.lit("no coefficients for channel "), F.coalesce(F.col(channel), F.lit("null"))))).otherwise(F.col("mw")))


def _c(name: str) -> Column:
    return F.col("mw")[name]


class _Steps:
    """Columns one after another, those on the way dropped at the end."""

    def __init__(self, rows: DataFrame):
        self.rows, self.given = rows, set(rows.columns)

    def let(self, name: str, value: Column) -> Column:
        if f"mw_{name}" not in self.rows.columns:
            self.rows = self.rows.withColumn(f"mw_{name}", value)
        return F.col(f"mw_{name}")

    def pair(self, name: str, value: Complex) -> Complex:
        return self.let(f"{name}_re", value[0]), self.let(f"{name}_im", value[1])

    def done(self, out: str, value: Column) -> DataFrame:
        rows = self.rows.withColumn(out, value)
        return rows.drop(*[c for c in rows.columns if c.startswith("mw_") and c not in self.given])


def _over(a: Complex, b: Complex) -> Complex:
    size = b[0] * b[0] + b[1] * b[1]
    return (a[0] * b[0] + a[1] * b[1]) / size, (a[1] * b[0] - a[0] * b[1]) / size


def _root(z: Complex) -> Complex:
    """The root with a real part of zero or more."""
    size = F.sqrt(z[0] * z[0] + z[1] * z[1])
    low = F.sqrt(F.greatest((size - z[0]) / 2, F.lit(0.0)))
    return F.sqrt(F.greatest((size + z[0]) / 2, F.lit(0.0))), F.when(z[1] < 0, -low).otherwise(low)


def _permittivity(steps: _Steps) -> Complex:
    """Relative permittivity of sea water."""
    t, s = steps.let("celsius", F.col("surface") - 273.15), SALINITY
    static = steps.let("static", 87.90 * F.exp(-0.004585 * t) * F.exp(-3.45e-3 * s + 4.69e-6 * s * s + 1.36e-5 * s * t))
    wavelength = steps.let("wavelength", LIGHT_CM / (_c("freq") * 1e9))
    relaxation = steps.let("relaxation", (3.30 * F.exp(-0.0346 * t + 0.00017 * t * t) - 6.54e-3 * (1 - 3.06e-2 * t + 2.0e-4 * t * t) * s) / wavelength)
    chlorinity, cold = 0.5536 * s, 25.0 - t
    decay = 2.03e-2 + 1.27e-4 * cold + 2.46e-6 * cold * cold - chlorinity * (3.34e-5 - 4.60e-7 * cold + 4.60e-8 * cold * cold)
    conductivity = 3.39e9 * chlorinity**0.892 * F.exp(-cold * decay)
    power = 1 - SPREAD
    size = steps.let("size", F.pow(F.abs(relaxation), F.lit(power)))
    turned = F.signum(relaxation) * size * sin(power * pi / 2)
    dispersion = _over((static - HIGH_FREQUENCY, F.lit(0.0)), steps.pair("slowed", (1 + size * cos(power * pi / 2), turned)))
    return steps.pair("eps", (dispersion[0] + HIGH_FREQUENCY, dispersion[1] - 2 * conductivity * wavelength / LIGHT_CM))


def _sea(steps: _Steps) -> Column:
    """Emissivity of the sea: Fresnel reflection, roughness and foam."""
    wind, surface, angle = F.col("wind"), F.col("surface"), F.col("angle")
    eps = _permittivity(steps)
    across, along = steps.let("across", F.cos(F.radians(angle))), F.sin(F.radians(angle))
    inner = steps.pair("inner", _root(steps.pair("under", (eps[0] - along * along, eps[1]))))
    vertical = _c("vertical")
    front = steps.pair("front", (F.when(vertical, eps[0] * across).otherwise(across), F.when(vertical, eps[1] * across).otherwise(F.lit(0.0))))
    rho = steps.pair("rho", _over((front[0] - inner[0], front[1] - inner[1]), (front[0] + inner[0], front[1] + inner[1])))
    smooth = rho[0] * rho[0] + rho[1] * rho[1] + F.when(vertical, 4.887e-8 - 6.108e-8 * F.pow(surface - 273.0, F.lit(3.0))).otherwise(0.0)
    tilt, warm = angle - 53.0, surface - 288.0
    rough = smooth - (_c("r0") + _c("r1") * tilt + _c("r2") * warm + _c("r3") * tilt * warm) * wind
    low, high = F.when(vertical, 3.0).otherwise(7.0), F.lit(12.0)
    f1, f2 = _c("foam1"), _c("foam2")
    foam = F.when(wind <= low, f1 * wind).when(wind < high, f1 * wind + 0.5 * (f2 - f1) * (wind - low) * (wind - low) / (high - low)).otherwise(f2 * wind - 0.5 * (f2 - f1) * (high + low))
    return steps.let("sea", 1 - (1 - foam) * rough)


def _air(steps: _Steps) -> dict[str, Column]:
    """``down``: effective temperature of the sky; ``down_tb, up_tb``: brightness temperatures; ``through``: transmittance."""
    vapour, liquid, surface, angle = (F.col(c) for c in ("vapour", "liquid", "surface", "angle"))
    typical = F.when(vapour <= 48, 273.16 + 0.8337 * vapour - 3.029e-5 * F.pow(vapour, F.lit(3.33))).otherwise(301.16)
    gap = steps.let("gap", surface - typical)
    excess = F.when(F.abs(gap) <= 20, 1.05 * gap * (1 - gap * gap / 1200.0)).otherwise(14 * F.signum(gap))
    down = steps.let("down", _c("b0") + vapour * (_c("b1") + vapour * (_c("b2") + vapour * (_c("b3") + vapour * _c("b4")))) + _c("b5") * excess)
    up = down + _c("b6") + _c("b7") * vapour
    cloud = (surface + 273.0) / 2
    depth = _c("oxygen1") + _c("oxygen2") * (down - 270.0) + vapour * (_c("vapour1") + _c("vapour2") * vapour) + _c("liquid1") * (1 - _c("liquid2") * (cloud - 283.0)) * liquid
    through = steps.let("through", F.exp(-depth / F.cos(F.radians(angle))))
    return {"down": down, "through": through, "down_tb": steps.let("down_tb", down * (1 - through)), "up_tb": up * (1 - through)}


def _roughness(steps: _Steps, through: Column) -> Column:
    """By how much a rough sea reflects more of the sky."""
    gap = 37.0 - _c("freq")
    damped = F.when(_c("freq") >= 36.0, 1.0).otherwise(1 - 0.00748 * F.pow(F.greatest(gap, F.lit(0.0)), F.lit(1.3)))
    variance = steps.let("variance", F.least(5.22e-3 * damped * F.col("wind"), F.lit(0.069)))
    term = variance - 70.0 * variance * variance * variance
    return F.when(_c("vertical"), (2.5 + 0.018 * gap) * term * F.pow(through, F.lit(3.4))).otherwise((6.2 - 0.001 * gap * gap) * term * through * through)


def _share(steps: _Steps) -> Column:
    return steps.let("share", F.least(F.greatest(F.col("ice"), F.lit(0.0)), F.lit(1.0)))


def sea_emissivity(rows: DataFrame, out: str = "emissivity") -> DataFrame:
    """Emissivity of the sea from ``wind, surface, angle``."""
    steps = _Steps(rows)
    return steps.done(out, _sea(steps))


def transmittance(rows: DataFrame, out: str = "through") -> DataFrame:
    """Transmittance of the atmosphere from ``vapour, liquid, surface, angle``."""
    steps = _Steps(rows)
    return steps.done(out, _air(steps)["through"])


def sensor_brightness(rows: DataFrame, out: str = "tb") -> DataFrame:
    """Brightness temperature that the sensor sees, with reflected sky and ice of its own temperature."""
    steps = _Steps(rows)
    surface, frozen = F.col("surface"), _c("ice")
    ice, air, water = _share(steps), _air(steps), _sea(steps)
    ice_kelvin = F.least(F.greatest(_c("mix") * surface + (1 - _c("mix")) * 272, F.lit(0.0)), F.lit(272.0))
    sky = (1 + _roughness(steps, air["through"])) * (1 - air["through"]) * (air["down"] - COSMIC) + COSMIC
    open_sea = (1 - ice) * (water * surface + (1 - water) * sky)
    return steps.done(out, air["up_tb"] + air["through"] * (open_sea + ice * (frozen * ice_kelvin + (1 - frozen) * (air["down_tb"] + air["through"] * COSMIC))))


def simulated_brightness(rows: DataFrame, out: str = "tb", water: str = "computed", ice_emissivity: Column | None = None, bias: Column | None = None) -> DataFrame:
    """Brightness temperature of a surface of water and ice.

    ``water``: ``constant`` (known for 19 and 37 GHz, null elsewhere) or ``computed``. ``ice_emissivity`` is the
    channel's fixed one unless given, e.g. ``plane_emissivity``. ``bias`` is subtracted over less than 15 % of ice.
    """
    steps = _Steps(rows)
    ice, air = _share(steps), _air(steps)
    sea = _c("water") if water == "constant" else _sea(steps)
    emissivity = steps.let("emissivity", (1 - ice) * sea + ice * (_c("ice") if ice_emissivity is None else ice_emissivity))
    tb = air["up_tb"] + air["through"] * (emissivity * F.col("surface") + air["down_tb"] * (1 - emissivity))
    return steps.done(out, tb if bias is None else F.when(ice >= 0.15, tb).otherwise(tb - bias))


def plane_emissivity(surface: Column, along_line: Column, a1: Column, a2: Column, c: Column) -> Column:
    """Emissivity of ice as a plane over the temperature and the distance along the ice line."""
    return a1 * surface + a2 * along_line + c


def effective_emissivity(rows: DataFrame, brightness: Column, out: str = "emissivity") -> DataFrame:
    """Surface emissivity behind an observed brightness temperature."""
    steps = _Steps(rows)
    air = _air(steps)
    return steps.done(out, (brightness - air["up_tb"] - air["through"] * air["down_tb"]) / (air["through"] * (F.col("surface") - air["down_tb"])))


def observed_channels(rows: DataFrame, planes: DataFrame, biases: DataFrame) -> DataFrame:
    """``rows(channel, date, vapour, wind, liquid, surface, ice, angle, along_line)`` with ``tb``, the simulated brightness temperature.

    ``planes(channel, date, a1, a2, c)`` hold the ice emissivity of a day, ``biases(channel, month, bias)`` that
    of open water; a row without its plane, or over open water without its bias, has a null temperature.
    """
    met = rows.join(planes.select("channel", "date", "a1", "a2", "c"), ["channel", "date"], "left").withColumn("month", F.month("date")).join(biases.select("channel", "month", "bias"), ["channel", "month"], "left")
    ice = plane_emissivity(F.col("surface"), F.col("along_line"), F.col("a1"), F.col("a2"), F.col("c"))
    return simulated_brightness(with_channel(met), ice_emissivity=ice, bias=F.col("bias")).drop("mw", "a1", "a2", "c", "bias", "month")
