"""Synthetic observing networks and observations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import grid as grids


def _unit(seed: int, *cols: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + 0.5) / float(1 << 53)


def network(spark: SparkSession, count: int, grid: grids.Grid, masked: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``obs_id, x, y``: uniform positions; one whose nearest grid point is masked is drawn anew until it is placed.

    Each round draws twice as often as the one before for those that are left; a grid without any open
    point is an error.
    """
    if masked is not None and grid.points(spark).select("loc").join(masked.select("loc"), "loc", "left_anti").isEmpty():
        raise ValueError("every point of the grid is masked")
    rest, found, first, tries = spark.range(count).select(F.col("id").alias("obs_id")), [], 0, 8
    while True:
        rows = rest.select("obs_id", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1 if masked is not None else first))).alias("k"))
        x = grid.x0 + (grid.nx - 1) * grid.dx * _unit(seed, F.col("obs_id"), 2 * F.col("k"))
        y = grid.y0 + (grid.ny - 1) * grid.dy * _unit(seed, F.col("obs_id"), 2 * F.col("k") + 1)
        drawn = grids.find_cell(rows.withColumns({"x": x, "y": y}), grid)
        good = drawn if masked is None else drawn.join(masked.select(F.col("loc").alias("nearest")), "nearest", "left_anti")
        found.append(good.groupBy("obs_id").agg(F.min_by(F.struct("x", "y"), "k").alias("p")).select("obs_id", "p.x", "p.y"))
        rest, first, tries = rest.join(found[-1], "obs_id", "left_anti"), first + tries, 2 * tries
        if masked is None or rest.isEmpty():
            return reduce(DataFrame.unionAll, found)


def around(obs: DataFrame, x: float, y: float, reach: float) -> DataFrame:
    """Positions within reach of a moving centre."""
    return obs.where((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 <= reach * reach)


def observe(positions: DataFrame, truth: DataFrame, grid: grids.Grid, std: float, seed: int = 0) -> DataFrame:
    """``obs_id, x, y, obs, err_std``: the true field at each position with Gaussian noise drawn from its id."""
    at = grids.interpolate(grids.weights(grids.find_cell(positions, grid), "obs_id"), truth, "obs_id", [])
    noise = F.sqrt(-2 * F.log(_unit(seed, F.col("obs_id"), F.lit(-1)))) * F.cos(2 * math.pi * _unit(seed, F.col("obs_id"), F.lit(-2)))
    return positions.join(at, "obs_id").select("obs_id", "x", "y", (F.col("value") + std * noise).alias("obs"), F.lit(std).alias("err_std"))
