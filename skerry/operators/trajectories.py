"""Drift from trajectories and moving nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import grid as grids


def pairs(records: DataFrame, start: Column, end: Column, tolerance_hours: float, least: int = 3) -> DataFrame:
    """``traj, x0, y0, t0, x1, y1, t1``: each trajectory's records nearest to a window's start and end.

    Both must be within the tolerance and different. Pairs are grouped by start and end rounded to
    hours; groups of fewer than ``least`` are dropped. Ties go to the earlier record.
    """

    def near(at: Column, k: int) -> DataFrame:
        gap = F.abs(F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(at.cast("timestamp")))
        close = records.withColumn("gap", gap).where(F.col("gap") <= int(tolerance_hours * 3.6e9))
        first = close.groupBy("traj").agg(F.min_by(F.struct("x", "y", "t"), F.struct("gap", "t")).alias("r"))
        return first.select("traj", *[F.col(f"r.{c}").alias(f"{c}{k}") for c in ("x", "y", "t")])

    met = near(start, 0).join(near(end, 1), "traj").where("t0 < t1")
    hour = lambda c: F.round(F.unix_micros(F.col(c).cast("timestamp")) / 3.6e9).cast("long")
    met = met.withColumn("h0", hour("t0")).withColumn("h1", hour("t1"))
    return met.withColumn("n", F.count("*").over(Window.partitionBy("h0", "h1"))).where(F.col("n") >= least).drop("n")


def node_drift(before: DataFrame, after: DataFrame, days: float) -> DataFrame:
    """Velocity a day of nodes ``(node, x, y)`` that both times have."""
    moved = before.join(after.select("node", F.col("x").alias("x1"), F.col("y").alias("y1")), "node")
    return moved.select("node", "x", "y", ((F.col("x1") - F.col("x")) / days).alias("u"), ((F.col("y1") - F.col("y")) / days).alias("v"))


def advect(points: DataFrame, flow: DataFrame, grid: grids.Grid, key: str, steps: int, dt: float) -> DataFrame:
    """Points moved for some steps by a flow ``(loc, u, v)`` interpolated where they are; outside it they are dropped."""
    for _ in range(steps):
        table = grids.weights(grids.find_cell(points, grid), key).join(flow, "loc").groupBy(key)
        wind = table.agg(F.count("u").alias("n"), F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v")).where("n = 4")
        points = points.join(wind, key).select(key, (F.col("x") + dt * F.col("u")).alias("x"), (F.col("y") + dt * F.col("v")).alias("y"))
    return points


def advect_daily(points: DataFrame, flows: DataFrame, grid: grids.Grid, key: str, first: Column, days: int, scale: float = 1.0) -> DataFrame:
    """``key, x, y, dx, dy`` of ``points(key, x, y)`` after some daily steps, and how far they have come.

    Each day's step takes ``scale`` times that day's ``flows(day, loc, u, v)`` where the point is then; ``first``
    gives a point's first day. Points that leave the grid, or a day without a flow, are dropped.
    """
    now = points.select(key, first.cast("long").alias("day"), "x", "y", F.col("x").alias("x0"), F.col("y").alias("y0"))
    for _ in range(days):
        corner = grids.weights(grids.find_cell(now, grid), key).join(now.select(key, "day"), key)
        wind = corner.join(flows.select(F.col("day").cast("long").alias("day"), "loc", "u", "v"), ["day", "loc"]).groupBy(key)
        wind = wind.agg(F.count("u").alias("n"), F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v")).where("n = 4")
        now = now.join(wind, key).select(key, (F.col("day") + 1).alias("day"), (F.col("x") + scale * F.col("u")).alias("x"), (F.col("y") + scale * F.col("v")).alias("y"), "x0", "y0")
    return now.select(key, "x", "y", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"))


def warp(field: DataFrame, shift: DataFrame, grid: grids.Grid, by: list[str]) -> DataFrame:
    """A field sampled at ``(x - u, y - v)`` of each point; where that has no value the point keeps its own."""
    at = grid.points(field.sparkSession).join(shift, "loc")
    at = at.select(F.col("loc").alias("target"), (F.col("x") - F.col("u")).alias("x"), (F.col("y") - F.col("v")).alias("y"))
    moved = grids.interpolate(grids.weights(grids.find_cell(at, grid, beyond=True), "target"), field, "target", by)
    own = field.select(F.col("loc").alias("target"), *by, F.col("value").alias("own"))
    return own.join(moved, ["target", *by], "left").select(F.col("target").alias("loc"), *by, F.coalesce("value", "own").alias("value"))
