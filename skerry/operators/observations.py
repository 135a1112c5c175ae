"""Observation selection, quality control, thinning and matching in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(obs: DataFrame, centre: Column, low_hours: float, high_hours: float, t: str = "t") -> DataFrame:
    """Observations from ``low`` on, before ``high``, in hours from the analysis time."""
    shift = lambda h: centre + F.expr(f"make_dt_interval(0, 0, 0, {h * 3600})")
    return obs.where((F.col(t) >= shift(low_hours)) & (F.col(t) < shift(high_hours)))


def flags(obs: DataFrame, flag: str, low: int, high: int, err: str) -> DataFrame:
    """Rows with a status within bounds and a positive error."""
    return obs.where(F.col(flag).between(low, high) & (F.col(err) > 0))


def profiles(rows: DataFrame, key: str, good_level: Column, in_range: Column, good_profile: Column | None = None) -> DataFrame:
    """Good levels of profiles of which every good level is in range: one bad value drops the profile."""
    good = rows.where(good_level if good_profile is None else good_level & good_profile)
    bad = F.max(F.when(in_range, 0).otherwise(1)).over(Window.partitionBy(key))
    return good.withColumn("bad", bad).where("bad = 0").drop("bad")


def valid_members(prior: DataFrame, members: int, key: str = "obs_id") -> DataFrame:
    """Observations whose prior every member has."""
    return prior.groupBy(key).agg(F.count("value").alias("n")).where(F.col("n") == members).select(key)


def thin_vertical(rows: DataFrame, targets: DataFrame, key: str, level: str = "lev", depth: str = "depth") -> DataFrame:
    """The first level of each bin between a profile's sorted target depths ``targets(key, zs)``."""
    met = rows.join(targets, key).withColumn("bin", F.size(F.filter("zs", lambda z: z < F.col(depth))))
    first = F.row_number().over(Window.partitionBy(key, "bin").orderBy(level))
    return met.withColumn("rn", first).where("rn = 1").drop("rn", "zs")


def deaccumulate(rows: DataFrame, by: list[str], lead: str, value: str, seconds: float) -> DataFrame:
    """Rates from sums that grow with lead time; the first step is taken from zero, negatives are cut."""
    before = F.lag(value, 1).over(Window.partitionBy(*by).orderBy(lead))
    return rows.withColumn("rate", F.greatest(F.lit(0.0), (F.col(value) - F.coalesce(before, F.lit(0.0))) / seconds))


def nearest_node(points: DataFrame, nodes: DataFrame, key: str, radius: float) -> DataFrame:
    """Nearest of ``nodes(node, nx, ny)`` within a radius, through buckets of that size; ties to the smaller node."""
    b = lambda c: F.floor(F.col(c) / radius)
    near = lambda c: F.explode(F.sequence(b(c) - 1, b(c) + 1))
    spread = points.withColumn("bx", near("x")).withColumn("by", near("y"))
    met = spread.join(nodes.withColumns({"bx": b("nx"), "by": b("ny")}), ["bx", "by"])
    gap = F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2)
    met = met.withColumn("gap", gap).where(F.col("gap") <= radius)
    return met.groupBy(key).agg(F.min_by(F.struct("node", "gap"), F.struct("gap", "node")).alias("f")).select(key, "f.*")


def super_observe(obs: DataFrame, nx_bin: float, ny_bin: float, by: list[str]) -> DataFrame:
    """Means of observations by box; boxes with one observation are dropped, the rest keep the first's error."""
    box = obs.groupBy(*by, F.floor(F.col("x") / nx_bin).cast("int").alias("bx"), F.floor(F.col("y") / ny_bin).cast("int").alias("by"))
    return box.agg(F.avg("obs").alias("obs"), F.count("*").alias("n"), F.min_by("err_std", "obs_id").alias("err_std")).where("n > 1")


def velocity(x0: Column, x1: Column, days: Column) -> Column:
    """Displacement a day; null without time between."""
    return F.when(days > 0, (x1 - x0) / days)


def deformation(cornered: DataFrame) -> DataFrame:
    """Adds ``shear, div, vort`` of triangles with corners ``x, y`` and velocities ``u, v`` numbered 1 to 3."""

    def integral(f: str, along: str, sign: int) -> Column:
        parts = [(F.col(f"{f}{a}") + F.col(f"{f}{b}")) * (F.col(f"{along}{b}") - F.col(f"{along}{a}")) for a, b in ((1, 2), (2, 3), (3, 1))]
        return sign * (parts[0] + parts[1] + parts[2]) / (2 * F.col("signed"))

    x1, y1, x2, y2, x3, y3 = (F.col(c) for c in ("x1", "y1", "x2", "y2", "x3", "y3"))
    out = cornered.withColumn("signed", ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2)
    ux, uy, vx, vy = integral("u", "y", 1), integral("u", "x", -1), integral("v", "y", 1), integral("v", "x", -1)
    return out.withColumns({"shear": F.sqrt((ux - vy) ** 2 + (uy + vx) ** 2), "div": ux + vy, "vort": vx - uy}).drop("signed")
