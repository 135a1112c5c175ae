"""Displacements against a plain version on whole arrays, and updates that move a field."""

import numpy as np
import pandas as pd
import pytest

from skerry.operators import alignment
from skerry.operators.grid import Grid
from skerry.sources.tables import StateStore


def _roll_mean(d):
    out = np.zeros_like(d)
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            if (a, b) != (0, 0):
                out += np.roll(d, (a, b), (0, 1)) / (6 if a == 0 or b == 0 else 12)
    return out


def _at(x, fi, fj):
    n = len(x)
    i0, j0 = np.floor(fi).astype(int), np.floor(fj).astype(int)
    u, v = fi - i0, fj - j0
    return sum(wi * wj * x[(j0 + b) % n, (i0 + a) % n] for a, wi in ((0, 1 - u), (1, u)) for b, wj in ((0, 1 - v), (1, v)))


def _plain(before, after, levels=5, sweeps=100, tolerance=1e-3):
    ny, nx = before.shape
    n = 1 << max(1, int(np.ceil(np.log2(max(nx, ny)))))
    x1, x2 = np.full((n, n), np.nan), np.full((n, n), np.nan)
    x1[:ny, :nx], x2[:ny, :nx] = before, after
    mask = np.isnan(x1) | np.isnan(x2) | (np.abs(x2 - x1) < 1e-5)
    x1[mask] = x2[mask] = 0
    low, high = x1.min(), x1.max()
    if high > low:
        x1, x2 = (x1 - low) / (high - low), (x2 - low) / (high - low)
    j, i = np.mgrid[:n, :n].astype(float)
    u, v = np.zeros((n, n)), np.zeros((n, n))
    for level in range(min(levels, int(np.log2(n))), -1, -1):
        f = 1 << max(level - 1, 0)
        m = n // f
        a, b = (x.reshape(m, f, m, f).mean((1, 3)) for x in (_at(x1, i - u, j - v), x2))
        fixed = mask[::f, ::f].copy()
        fixed[[0, -1]] = fixed[:, [0, -1]] = True
        mean = (a + b) / 2
        sx, sy, st = (np.roll(mean, -1, 1) - np.roll(mean, 1, 1)) / 2, (np.roll(mean, -1, 0) - np.roll(mean, 1, 0)) / 2, b - a
        du, dv = np.zeros((m, m)), np.zeros((m, m))
        for _ in range(sweeps):
            du[fixed] = dv[fixed] = 0
            ub, vb = _roll_mean(du), _roll_mean(dv)
            part = (sx * ub + sy * vb + st) / (1 + sx**2 + sy**2)
            nu, nv = ub - sx * part, vb - sy * part
            change = (np.abs(nu - du) + np.abs(nv - dv)).max()
            du, dv = nu, nv
            if change <= tolerance:
                break
        u += 2.0 ** (level - 1) * _at(du, i / f, j / f)
        v += 2.0 ** (level - 1) * _at(dv, i / f, j / f)
    return u[:ny, :nx], v[:ny, :nx]


def _blob(nx, ny, x, y, size=4.0):
    j, i = np.mgrid[:ny, :nx]
    return np.exp(-((i - x) ** 2 + (j - y) ** 2) / (2 * size**2))


def _table(spark, arrays, **more):
    parts = []
    for key, named in arrays.items():
        ny, nx = next(iter(named.values())).shape
        j, i = np.mgrid[:ny, :nx]
        parts.append(pd.DataFrame({"mem": key, "i": i.ravel(), "j": j.ravel(), **{c: a.ravel() for c, a in named.items()}}))
    return spark.createDataFrame(pd.concat(parts))


def _array(rows, column, nx, ny):
    out = np.full((ny, nx), np.nan)
    for r in rows:
        out[r["j"], r["i"]] = np.nan if r[column] is None else r[column]
    return out


@pytest.mark.parametrize("tile, halo, tolerance", [(256, 20, 1e-3), (8, 5, 1e-3), (16, 7, 0.02)])
def test_displacement_against_plain_version(spark, tile, halo, tolerance):
    nx, ny = 30, 22
    hole = _blob(nx, ny, 10, 9).copy()
    hole[3:5, 3:6] = np.nan
    fields = {0: {"before": _blob(nx, ny, 12, 10), "after": _blob(nx, ny, 14, 11)}, 1: {"before": hole, "after": _blob(nx, ny, 9, 9)}}
    got = alignment.displacement(_table(spark, fields), ["mem"], nx, ny, tile=tile, halo=halo, tolerance=tolerance, sweeps=24).collect()
    for key, named in fields.items():
        rows = [r for r in got if r["mem"] == key]
        u, v = _plain(named["before"], named["after"], sweeps=24, tolerance=tolerance)
        assert np.allclose(_array(rows, "u", nx, ny), u, atol=1e-9) and np.allclose(_array(rows, "v", nx, ny), v, atol=1e-9)


@pytest.mark.parametrize("levels, tile", [(5, 256), (2, 32)])
def test_long_and_narrow_field_keeps_its_own_cells_only(spark, tmp_path, levels, tile):
    """The square has 65,536 cells; those that no value reaches, and their tiles, are not there, and the result is the square's."""
    nx, ny = 6, 150
    before, after = _blob(nx, ny, 2, 60, 9.0) - 0.3 * _blob(nx, ny, 4, 140), _blob(nx, ny, 3, 64, 9.0) - 0.3 * _blob(nx, ny, 4, 143)
    store = StateStore(spark, str(tmp_path))
    got = alignment.displacement(_table(spark, {0: {"before": before, "after": after}}), ["mem"], nx, ny, store, levels=levels, tile=tile, halo=7, sweeps=12).collect()
    u, v = _plain(before, after, levels=levels, sweeps=12)
    assert np.allclose(_array(got, "u", nx, ny), u, atol=1e-9) and np.allclose(_array(got, "v", nx, ny), v, atol=1e-9)
    assert store.read(0, "base").count() == {5: 208 * 256, 2: 30 * 176}[levels]


def test_planted_shift_is_found_and_the_state_follows(spark):
    nx = ny = 32
    before, after = _blob(nx, ny, 14, 16), _blob(nx, ny, 17, 15)
    fields = _table(spark, {0: {"before": before, "after": after}})
    moved = alignment.displacement(fields, ["mem"], nx, ny)
    moved = moved.sparkSession.createDataFrame(moved.collect(), moved.schema)
    u, v = (_array(moved.collect(), c, nx, ny) for c in "uv")
    heavy = after > 0.5
    assert abs(u[heavy].mean() - 3) < 0.8 and abs(v[heavy].mean() + 1) < 0.5
    warped = _array(alignment.warp(fields.select("mem", "i", "j", fields.before.alias("value")), moved, ["mem"], nx, ny).collect(), "value", nx, ny)
    assert np.abs(warped - after).max() < 0.35 * np.abs(before - after).max()
    as_value = lambda c: fields.select("mem", "i", "j", fields[c].alias("value"))
    same = alignment.aligned(as_value("before"), as_value("before"), as_value("after"), moved, ["mem"], Grid(nx, ny))
    assert np.allclose(_array(same.collect(), "value", nx, ny), after)  # the observed variable gets its posterior
    other = alignment.aligned(fields.select("mem", "i", "j", (2 * fields.before).alias("value")), as_value("before"), as_value("before"), moved, ["mem"], Grid(nx, ny))
    assert np.allclose(_array(other.collect(), "value", nx, ny), 2 * warped + before - warped)


def test_no_change_no_displacement(spark):
    flat = _table(spark, {0: {"before": np.ones((5, 6)), "after": np.ones((5, 6))}})
    assert all(r.u == r.v == 0 for r in alignment.displacement(flat, ["mem"], 6, 5).collect())


def test_cells_are_not_broadcast(spark):
    """A table of cells whose file is small may have many rows: no join with it goes through the driver."""
    from skerry.operators import curvilinear

    cells = spark.range(16).selectExpr("0 AS level", "id % 4 AS i", "id DIV 4 AS j", "0.5D AS x1", "0.5D AS fi", "0.5D AS fj")
    grid = spark.range(16).selectExpr("id AS loc", "id % 4 AS i", "id DIV 4 AS j", "1D * id AS lon", "1D * id AS lat")
    for table in (alignment._sampled(cells, cells, ["level"], 4, ["x1"]), curvilinear.neighbours(grid, 4, 4)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
