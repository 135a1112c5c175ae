"""Positions on curvilinear grids: nearest grid point by descent over a neighbour table, then the place within the triangles around it.

Grid points ``loc, i, j, lon, lat`` need no formula behind them. A descent moves every position's pivot
to the nearest of the pivot's neighbours until it stands, all positions at once. Wide strides come first,
so the number of steps grows with the logarithm of the grid's size. Wide strides stay on every so many
rows: these points, of bounded number, are sent to all tasks, which do all such steps in one pass. Narrower
strides are a join a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.distance import EARTH_RADIUS, great_circle
from skerry.functions.expr import let
from skerry.sources.tables import StateStore

#: Eight triangles around a pivot, as the steps in i and j to their two other corners.
AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
OUTSIDE = 1e-3
#: Most grid points that are sent to all tasks, for the wide strides of a descent.
COARSE = 65_536


def stepped(i: Column, j: Column, di: int, dj: int, nx: int, ny: int, cyclic_x: bool = True, folded: bool = False) -> Column:
    """Number of the point some steps away, null beyond the grid.

    ``cyclic_x`` joins the first and last column; ``folded`` grids (with two northern poles) continue
    beyond the last row on the same row, seen from the other side.
    """
    i, j = i + di, j + dj
    over = j >= ny
    if folded:
        i, j = F.when(over, nx - 1 - i).otherwise(i), F.when(over, 2 * ny - 1 - j).otherwise(j)
    if cyclic_x:
        i = F.pmod(i, F.lit(nx))
    inside = (i >= 0) & (i < nx) & (j >= 0) & (j < ny)
    return F.when(inside, (j * nx + i).cast("long"))


def neighbours(grid: DataFrame, nx: int, ny: int, stride: int = 1, **shape) -> DataFrame:
    """``loc, next, lon, lat``: the points ``stride`` to the east, north, west and south, and where they are."""
    sides = [stepped(F.col("i"), F.col("j"), di * stride, dj * stride, nx, ny, **shape) for di, dj in AROUND[::2]]
    at = grid.select(F.col("loc").alias("next"), F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat"))
    return grid.select("loc", F.explode(F.array(*sides)).alias("next")).where("next is not null and next <> loc").join(at.hint("merge"), "next")


def _descended(points: DataFrame, grid: DataFrame, key: str, nx: int, ny: int, every: int, widest: int, cyclic_x: bool = True) -> DataFrame:
    """``key, lon, lat, pivot, p_lon, p_lat`` after all strides from ``2^widest`` to ``every``, which only meet rows divisible by ``every``."""
    some = grid.where(F.col("j") % every == 0).select("i", (F.col("j") / every).cast("long").alias("j"), F.col("lon").cast("double"), F.col("lat").cast("double")).toPandas()
    at = np.full((2, -(-ny // every) * nx), np.nan)
    at[:, some["j"] * nx + some["i"]] = some[["lon", "lat"]].to_numpy().T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sin, cos = np.sin(np.radians(at[1])), np.cos(np.radians(at[1]))

        def gap(lon: np.ndarray, lat: np.ndarray, loc: np.ndarray) -> np.ndarray:
            cosine = np.sin(lat) * sin[loc] + np.cos(lat) * cos[loc] * np.cos(np.radians(at[0][loc] - lon))
            return EARTH_RADIUS * np.arccos(np.clip(cosine, -1.0, 1.0))

        for batch in batches:
            lon, lat = batch["lon"].to_numpy(float, na_value=np.nan), np.radians(batch["lat"].to_numpy(float, na_value=np.nan))
            pivot = np.zeros(len(batch), np.int64)
            best = gap(lon, lat, pivot)
            for k in range(widest, int(log2(every)) - 1, -1):
                todo, stride = np.arange(len(batch)), 1 << k
                while len(todo):
                    j, i = np.divmod(pivot[todo], nx)
                    near, found = best[todo].copy(), pivot[todo].copy()
                    for di, dj in AROUND[::2]:
                        ni, nj = i + di * stride, j + dj * (stride // every)
                        ni = ni % nx if cyclic_x else ni
                        inside = (ni >= 0) & (ni < nx) & (nj >= 0) & (nj * every < ny)
                        loc = np.where(inside, nj * nx + ni, pivot[todo])
                        d = np.where(inside, gap(lon[todo], lat[todo], loc), np.inf)
                        nearer = (d < near) | ((d == near) & (near < best[todo]) & (loc < found))
                        near, found = np.where(nearer, d, near), np.where(nearer, loc, found)
                    moved = near < best[todo]
                    todo, near, found = todo[moved], near[moved], found[moved]
                    best[todo], pivot[todo] = near, found
            j, i = np.divmod(pivot, nx)
            yield batch.assign(pivot=j * every * nx + i, p_lon=at[0][pivot], p_lat=at[1][pivot])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, F.col("lon").cast("double"), F.col("lat").cast("double")).mapInPandas(run, f"`{key}` {kind}, lon double, lat double, pivot bigint, p_lon double, p_lat double")


def pivots(points: DataFrame, grid: DataFrame, key: str, nx: int, ny: int, store: StateStore | None = None, most_steps: int = 10_000, **shape) -> DataFrame:
    """``points(key, lon, lat)`` with ``pivot``, the grid point that none of its neighbours is nearer than, and its ``gap`` in metres.

    Of neighbours equally near the one of the smaller number is taken. Every step's table is stored, and
    positions whose pivot stands at all strides leave the steps. Neighbours meet positions by a shuffle, as a
    broadcast at every step would send their table through the driver each time.
    """
    store = store or StateStore.temporary(points.sparkSession)
    widest = ceil(log2(max(nx, ny, 2))) - 1
    narrow = ceil(log2(max(nx * ny / COARSE, 1)))
    if narrow > widest or nx > COARSE or shape.get("folded"):  # a fold leads off the rows that are sent
        first = grid.where("loc = 0").select(F.lit(0).cast("long").alias("pivot"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
        start = points.select(key, "lon", "lat").join(F.broadcast(first))  # one row
    else:
        start = _descended(points, grid, key, nx, ny, 1 << narrow, widest, shape.get("cyclic_x", True))
        widest = max(narrow - 1, 0)  # at last the steps of one point again, by this module's own distances
    now = store.write(start.select(key, "lon", "lat", "pivot", great_circle(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat")).alias("gap")), 0, "pivots")
    step = 0
    for k in range(widest, -1, -1):
        around = neighbours(grid, nx, ny, 1 << k, **shape).groupBy("loc").agg(F.collect_list(F.struct("next", "n_lon", "n_lat")).alias("around"))
        around = store.write(around.withColumnRenamed("loc", "pivot"), step, "around")
        moving, settled = now, []
        while True:
            step += 1
            if step > most_steps:
                raise RuntimeError("pivots did not settle")
            best = F.array_min(F.transform("around", lambda n: F.struct(great_circle(F.col("lon"), F.col("lat"), n["n_lon"], n["n_lat"]).alias("gap"), n["next"].alias("next"))))
            met = moving.join(around.hint("merge"), "pivot", "left").withColumn("best", best)
            nearer = F.coalesce(F.col("best.gap") < F.col("gap"), F.lit(False))
            met = store.write(met.select(key, "lon", "lat", nearer.alias("moved"), F.when(nearer, F.col("best.next")).otherwise(F.col("pivot")).alias("pivot"), F.when(nearer, F.col("best.gap")).otherwise(F.col("gap")).alias("gap")), step, "pivots")
            settled.append(met.where("not moved").drop("moved"))
            moving = met.where("moved").drop("moved")
            if moving.isEmpty():
                break
        now = settled[0]
        for more in settled[1:]:
            now = now.unionByName(more)
    return now


def _heron(a: Column, b: Column, c: Column) -> Column:
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))


def grid_index(placed: DataFrame, grid: DataFrame, key: str, nx: int, ny: int, **shape) -> DataFrame:
    """``key, fi, fj``: fractional column and row of ``placed(key, lon, lat, pivot)`` by weights within the triangles around the pivot.

    Weights are areas of triangles with great-circle sides. The first triangle whose weights add up to
    one counts; a position in none, outside the grid, has nulls.
    """
    at = grid.select("loc", "i", "j", "lon", "lat")
    corner = lambda n: at.select(F.col("loc").alias(f"loc{n}"), F.col("lon").alias(f"lon{n}"), F.col("lat").alias(f"lat{n}"))
    sides = [(k, AROUND[k], AROUND[(k + 1) % 8]) for k in range(8)]
    options = F.array(*[
        F.struct(F.lit(k).alias("k"), *[F.lit(x).alias(n) for n, x in (("di2", a[0]), ("dj2", a[1]), ("di3", b[0]), ("dj3", b[1]))], stepped(F.col("i"), F.col("j"), *a, nx, ny, **shape).alias("loc2"), stepped(F.col("i"), F.col("j"), *b, nx, ny, **shape).alias("loc3"))
        for k, a, b in sides
    ])
    pivot = at.select(F.col("loc").alias("pivot"), "i", "j", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.explode(options).alias("o")).select("pivot", "i", "j", "lon1", "lat1", "o.*").where("loc2 is not null and loc3 is not null")
    pivot = pivot.join(corner(2).hint("merge"), "loc2").join(corner(3).hint("merge"), "loc3")
    gap = lambda a, b: great_circle(F.col(f"lon{a}"), F.col(f"lat{a}"), F.col(f"lon{b}"), F.col(f"lat{b}"))
    whole = let(F.array(gap(2, 3), gap(3, 1), gap(1, 2)), lambda s: F.struct(s.alias("s"), _heron(s[0], s[1], s[2]).alias("whole")))
    triangles = pivot.withColumn("size", whole).groupBy("pivot").agg(F.collect_list(F.struct("k", "i", "j", *[f"{c}{n}" for n in (2, 3) for c in ("di", "dj", "lon", "lat")], "lon1", "lat1", "size")).alias("around"))

    def place(t: Column) -> Column:
        """Where a position lies by one triangle, null if outside; each distance is worked out once."""
        s, whole = t["size"]["s"], F.nullif(t["size"]["whole"], F.lit(0.0))
        far = F.array(*[great_circle(F.col("lon"), F.col("lat"), t[f"lon{n}"], t[f"lat{n}"]) for n in (1, 2, 3)])
        areas = let(far, lambda d: F.array(_heron(s[0], d[1], d[2]) / whole, _heron(s[1], d[0], d[2]) / whole, _heron(s[2], d[0], d[1]) / whole))
        index = lambda b, total, n: t[n] * total + t[f"d{n}2"] * b[1] + t[f"d{n}3"] * b[2]
        inside = lambda b, total: F.when(F.abs(total - 1) <= OUTSIDE, F.struct(t["k"].alias("k"), index(b, total, "i").alias("fi"), index(b, total, "j").alias("fj")))
        return let(areas, lambda b: inside(b, b[0] + b[1] + b[2]))

    met = placed.select(key, "lon", "lat", "pivot").join(triangles.hint("merge"), "pivot", "left")
    return met.select(key, F.array_min(F.transform("around", place)).alias("p")).select(key, "p.fi", "p.fj")


def position_of(indexed: DataFrame, grid: DataFrame, key: str, nx: int, ny: int, **shape) -> DataFrame:
    """``key, lon, lat`` of fractional columns and rows ``indexed(key, fi, fj)``: bilinear between the cell's corners as points in space."""
    i0, j0 = F.floor("fi").cast("long"), F.floor("fj").cast("long")
    u, v = F.col("fi") - i0, F.col("fj") - j0
    corners = F.array(*[F.struct(stepped(i0, j0, a, b, nx, ny, **shape).alias("loc"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w")) for a in (0, 1) for b in (0, 1)])
    lon, lat = F.radians("lon"), F.radians("lat")
    space = grid.select("loc", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    met = indexed.select(key, F.explode(corners).alias("c")).select(key, "c.*").where("w > 0").join(space, "loc", "left")
    mean = met.groupBy(key).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in "xyz"], F.count(F.when(F.col("x").isNull(), 1)).alias("missing")).where("missing = 0")
    return mean.select(key, F.degrees(F.atan2("y", "x")).alias("lon"), F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("lat"))
