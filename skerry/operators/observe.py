"""Observation operators by name: model fields at observations, as the observations measure them.

An operator takes ``fields(loc, mem, value_1, ...)`` and ``obs(obs_id, x, y)`` on one grid and gives
``obs_id, mem, value``. Others register theirs with ``OPERATORS.register``; derived variables of models
are registered likewise in ``DERIVED``, as functions from fields to fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators import grid as grids
from skerry.operators import vertical
from skerry.sources.config import Registry

OPERATORS = Registry("observation operator")
DERIVED = Registry("derived variable")


def at(fields: DataFrame, obs: DataFrame, grid: grids.Grid, names: list[str]) -> DataFrame:
    """``obs_id, mem`` and the named fields interpolated to the observations in one pass; outside points have no row."""
    return grids.at_points(grids.find_cell(obs, grid), fields, "obs_id", ["mem"], names)


@OPERATORS.register("identity")
def identity(fields: DataFrame, obs: DataFrame, grid: grids.Grid, name: str = "value") -> DataFrame:
    return at(fields, obs, grid, [name]).select("obs_id", "mem", F.col(name).alias("value"))


@OPERATORS.register("speed")
def speed(fields: DataFrame, obs: DataFrame, grid: grids.Grid, u: str = "u", v: str = "v") -> DataFrame:
    """Magnitude of a vector, from its components at the observation."""
    return at(fields, obs, grid, [u, v]).select("obs_id", "mem", F.sqrt(F.col(u) ** 2 + F.col(v) ** 2).alias("value"))


@OPERATORS.register("total")
def total(fields: DataFrame, obs: DataFrame, grid: grids.Grid, names: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """Sum over categories; below ``least`` it counts as none."""
    found = at(fields, obs, grid, list(names)).withColumn("sum", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return found.select("obs_id", "mem", F.when(F.col("sum") < least, 0.0).otherwise(F.col("sum")).alias("value"))


@OPERATORS.register("displacement")
def displacement(fields: DataFrame, obs: DataFrame, grid: grids.Grid, u: str = "u", v: str = "v", days: float = 1.0, component: str = "u") -> DataFrame:
    """Way of a drifting point along one axis over some days of steady flow."""
    return at(fields, obs, grid, [u, v]).select("obs_id", "mem", (F.col(u if component == "u" else v) * days).alias("value"))


@DERIVED.register("speed")
def derived_speed(fields: DataFrame) -> DataFrame:
    return fields.withColumn("speed", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2))


@DERIVED.register("anomaly")
def derived_anomaly(fields: DataFrame) -> DataFrame:
    """``value`` less its mean over all points of a member."""
    means = fields.groupBy("mem").agg(F.avg("value").alias("mean"))  # a row a member
    return fields.join(F.broadcast(means), "mem").withColumn("anomaly", F.col("value") - F.col("mean")).drop("mean")


def at_levels(fields: DataFrame, obs: DataFrame, grid: grids.Grid, name: str = "value") -> DataFrame:
    """``obs_id, mem, value`` at ``obs(obs_id, x, y, z)`` of a variable on levels, ``fields(loc, mem, lev, z, name)``.

    Each level and the depth of its far side are interpolated to the observation's place, then the column
    there to its depth. An observation outside the grid or below the last level has no row, nor has one of
    whose column a level is missing.
    """
    levels = fields.select("lev").distinct().count()  # some tens
    named = fields.select("loc", "mem", "lev", F.col(name).alias("f"), F.col("z").alias("depth"))
    at = grids.at_cells(grids.find_cell(obs.select("obs_id", "x", "y", "z"), grid), named, "obs_id", ["mem", "lev"], ["f", "depth"], ["z"])
    mem = F.explode(F.array_distinct(F.transform("at", lambda a: a["mem"]))).alias("mem")
    column = F.filter("at", lambda a: (a["mem"] == F.col("mem")) & a["f"].isNotNull() & a["depth"].isNotNull())
    layers = at.select("obs_id", "z", "at", mem).select("obs_id", "mem", "z", column.alias("layers")).where(F.size("layers") == levels)
    value = vertical.in_column("layers", F.col("z"), "f", "depth")
    return layers.select("obs_id", "mem", value.alias("value")).where("value is not null")


def state_to_observations(fields: DataFrame, obs: DataFrame, grid: grids.Grid, variable: str, operator: str | None = None, derived: tuple[str, ...] = (), **options) -> DataFrame:
    """``obs_id, mem, value`` of what the state gives for observations of ``variable``.

    A registered ``operator`` comes first. Otherwise the variable must be a column of the fields, or of
    those that the ``derived`` functions add, and is interpolated: in depth too if fields have levels and
    observations a depth. A variable that is neither is an error.
    """
    for name in derived:
        fields = DERIVED[name](fields)
    if operator is not None:
        return OPERATORS[operator](fields, obs, grid, **options)
    if variable not in fields.columns:
        raise NotImplementedError(f"no observation operator and no state variable for {variable!r}")
    if "lev" in fields.columns and "z" in obs.columns:
        return at_levels(fields, obs, grid, variable)
    return identity(fields, obs, grid, variable).where("value is not null")


def observe(fields: DataFrame, obs: DataFrame, grid: grids.Grid, operator: str = "identity", **options) -> DataFrame:
    """Observed members by a registered operator; an unknown name is an error."""
    return OPERATORS[operator](fields, obs, grid, **options)


def complete(observed: DataFrame, members: int) -> DataFrame:
    """The observations whose every member has a value, checked against their number; none at all is an error."""
    whole = observed.groupBy("obs_id").agg(F.count("value").alias("n")).where(F.col("n") == members).select("obs_id")
    if whole.isEmpty():
        raise ValueError(f"no observation has all {members} members")
    return observed.join(whole, "obs_id", "left_semi")
