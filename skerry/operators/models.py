"""The vortex model: an idealised flow, its initial state and its pseudo-spectral forecast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scale of the vorticity source and its width, in wavenumbers, and the wind beyond which there is none.
SOURCE_SCALE, SOURCE_WIDTH, WIND_LIMIT = 8.0, 3.0, 75.0


def rankine_vortex(points: DataFrame, wind: float, radius: float, cx: Column, cy: Column) -> DataFrame:
    """Adds winds ``u, v``: growing to ``wind`` at ``radius``, then falling with its power 1.5."""
    dx, dy = F.col("x") - cx, F.col("y") - cy
    r = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-10))
    speed = F.when(r <= radius, wind * r / radius).otherwise(wind * F.pow(radius / r, F.lit(1.5)))
    return points.withColumns({"u": -speed * dy / r, "v": speed * dx / r})


def vorticity(field: DataFrame, by: list[str], step: float) -> DataFrame:
    """Adds ``vort`` of ``u, v`` by centred differences around the ring."""
    from skerry.operators.grid import gradient

    slope = lambda c, axis, name: gradient(field.withColumn("value", F.col(c)), by, axis, step, cyclic=True).select(*by, "i", "j", F.col("slope").alias(name))
    met = field.join(slope("v", "x", "vx"), [*by, "i", "j"]).join(slope("u", "y", "uy"), [*by, "i", "j"])
    return met.withColumn("vort", F.col("vx") - F.col("uy")).drop("vx", "uy")


class SpectralFlow:
    """Vorticity dynamics on a square, doubly periodic grid."""

    def __init__(self, n: int, dx: float, source: float, dissipation: float):
        k = np.fft.fftfreq(n) * n
        scale = 2 * np.pi / (n * dx)
        self.kx, self.ky = k[None, :] * scale, k[:, None] * scale
        self.k2 = self.kx**2 + self.ky**2
        self.inverse = np.divide(1.0, self.k2, out=np.zeros_like(self.k2), where=self.k2 > 0)
        self.growth = source * np.exp(-0.5 * ((np.sqrt(self.k2) / scale - SOURCE_SCALE) / SOURCE_WIDTH) ** 2)
        self.decay = dissipation * self.k2

    def winds(self, zeta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        psi = -zeta * self.inverse
        return np.fft.ifft2(-1j * self.ky * psi).real, np.fft.ifft2(1j * self.kx * psi).real

    def tendency(self, zeta: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        back = lambda k: np.fft.ifft2(1j * k * zeta).real
        growth = self.growth if np.hypot(u, v).max() <= WIND_LIMIT else 0.0
        return -np.fft.fft2(u * back(self.kx) + v * back(self.ky)) + (growth - self.decay) * zeta

    def run(self, u: np.ndarray, v: np.ndarray, seconds: float, dt: float) -> tuple[np.ndarray, np.ndarray]:
        """Runge-Kutta steps of the vorticity, carried by the winds at a step's start."""
        zeta = 1j * (self.kx * np.fft.fft2(v) - self.ky * np.fft.fft2(u))
        for _ in range(int(seconds / dt)):
            slopes, at = [], zeta
            for part in (0.5, 0.5, 1.0, None):
                slopes.append(self.tendency(at, u, v))
                at = at if part is None else zeta + part * dt * slopes[-1]
            zeta = zeta + dt * (slopes[0] + 2 * slopes[1] + 2 * slopes[2] + slopes[3]) / 6
            u, v = self.winds(zeta)
        return u, v


def vortex_run(state: DataFrame, n: int, dx: float, hours: float, dt: float, source: float, dissipation: float) -> DataFrame:
    """``mem, i, j, u, v`` after some hours, a member in a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["j", "i"])
        u, v = (rows[c].to_numpy(dtype=float).reshape(n, n) for c in ("u", "v"))
        u, v = SpectralFlow(n, dx, source, dissipation).run(u, v, hours * 3600, dt)
        return rows[["mem", "i", "j"]].assign(u=u.ravel(), v=v.ravel())

    return state.select("mem", "i", "j", "u", "v").groupBy("mem").applyInPandas(run, "mem int, i int, j int, u double, v double")


def two_pole_mapping(lon: Column, lat: Column, a: tuple[float, float], b: tuple[float, float]) -> tuple[Column, Column]:
    """New longitude and latitude on a sphere whose poles are moved to ``a`` (north) and ``b`` (south), as (lon, lat).

    A Moebius map of the stereographic plane; the midpoint of the poles' arc goes to longitude 0 on the equator.
    """
    plane = lambda p: np.tan(np.radians(90 - p[1]) / 2) * np.exp(1j * np.radians(p[0]))
    unit = lambda p: np.array([np.cos(np.radians(p[1])) * np.cos(np.radians(p[0])), np.cos(np.radians(p[1])) * np.sin(np.radians(p[0])), np.sin(np.radians(p[1]))])
    za, zb = plane(a), plane(b)
    mid = unit(a) + unit(b)
    mid = mid / np.linalg.norm(mid)
    zc = plane((np.degrees(np.arctan2(mid[1], mid[0])), np.degrees(np.arcsin(mid[2]))))
    factor = (zc - zb) / (zc - za)
    r = F.tan(F.radians(90 - lat) / 2)
    x, y = r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon))
    up_x, up_y, low_x, low_y = x - float(za.real), y - float(za.imag), x - float(zb.real), y - float(zb.imag)
    size = low_x * low_x + low_y * low_y
    q_x, q_y = (up_x * low_x + up_y * low_y) / size, (up_y * low_x - up_x * low_y) / size
    w_x = q_x * float(factor.real) - q_y * float(factor.imag)
    w_y = q_x * float(factor.imag) + q_y * float(factor.real)
    return F.degrees(F.atan2(w_y, w_x)), 90 - 2 * F.degrees(F.atan(F.sqrt(w_x * w_x + w_y * w_y)))
