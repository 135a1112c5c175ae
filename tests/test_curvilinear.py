"""Pivots of long grids in few steps, and places within triangles, some of them without area."""

import os
from math import acos, cos, radians, sin

import pytest

from skerry.operators import curvilinear
from skerry.sources.tables import StateStore

NX, NY = 12, 91


def _gap(a, b):
    (lon1, lat1), (lon2, lat2) = a, b
    return acos(max(-1, min(1, sin(radians(lat1)) * sin(radians(lat2)) + cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))))


def _descent(spot, points):
    """The steps of one position, one after the other."""
    at, gap = 0, lambda loc: _gap(spot, points[loc][3:])
    for stride in (64, 32, 16, 8, 4, 2, 1):
        while True:
            j, i = divmod(at, NX)
            near = [(j + dj * stride) * NX + (i + di * stride) % NX for di, dj in ((1, 0), (0, 1), (-1, 0), (0, -1)) if 0 <= j + dj * stride < NY]
            best = min(near, key=lambda loc: (gap(loc), loc))
            if gap(best) >= gap(at):
                break
            at = best
    return at


@pytest.mark.parametrize("coarse, most", [(65_536, 2), (100, 24)])
def test_wide_strides_take_one_pass(spark, tmp_path, monkeypatch, coarse, most):
    """Seven strides were a join a step, so seven steps or more; the last row of the grid lies on the one before."""
    monkeypatch.setattr(curvilinear, "COARSE", coarse)
    points = [(j * NX + i, i, j, i * 30.0 - 165, min(j, NY - 2) * 1.25 - 55) for j in range(NY) for i in range(NX)]
    grid = spark.createDataFrame(points, "loc bigint, i int, j int, lon double, lat double")
    spots = [(k, (k * 77.7) % 360 - 180, (k * 13.3) % 110 - 54.7) for k in range(40)]
    at = spark.createDataFrame(spots + [(40, None, 3.0)], "obs_id bigint, lon double, lat double")
    placed = curvilinear.pivots(at, grid, "obs_id", NX, NY, StateStore(spark, str(tmp_path)))
    got = {r.obs_id: (r.pivot, r.gap) for r in placed.collect()}
    for k, *spot in spots:
        want = _descent(spot, points)
        assert got[k] == (want, pytest.approx(6_371_000 * _gap(spot, points[want][3:]), abs=1))
    assert 40 in got and len([d for d in os.listdir(tmp_path) if d.startswith("cycle=")]) <= most
    index = {r.obs_id: (r.fi, r.fj) for r in curvilinear.grid_index(placed, grid, "obs_id", NX, NY).collect()}
    assert len(index) == 41 and index[40] == (None, None)
    near = [(k, lon, lat) for k, lon, lat in spots if abs(lat) < 30 and index[k][0] is not None]
    assert near and all(index[k][1] == pytest.approx((lat + 55) / 1.25, abs=3) for k, _, lat in near)
