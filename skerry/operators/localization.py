"""Localization of whole observation records: horizontal, vertical and temporal factors, and impact on variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import distance
from skerry.operators import local

#: What a record without an entry has.
IMPACT = 1.0


def impact_of(obs_records: DataFrame, variables: DataFrame) -> DataFrame:
    """``obs_rec, name, impact`` of ``obs_records(obs_rec, impact MAP)`` on each of ``variables(name)``; 1 where none is given.

    Both tables list an experiment's records, some tens of rows.
    """
    met = obs_records.select("obs_rec", "impact").crossJoin(F.broadcast(variables.select("name")))
    return met.select("obs_rec", "name", F.coalesce(F.element_at("impact", F.col("name")), F.lit(IMPACT)).alias("impact"))


def cross_correlation(obs_records: DataFrame, given: DataFrame) -> DataFrame:
    """``a, b, corr`` of errors for every pair of records: as given in either order, else 1 with itself and 0 with others."""
    left, right = obs_records.select(F.col("obs_rec").alias("a")), obs_records.select(F.col("obs_rec").alias("b"))
    both = given.select("a", "b", "corr").union(given.select("b", "a", "corr")).groupBy("a", "b").agg(F.max("corr").alias("given"))
    met = left.crossJoin(F.broadcast(right)).join(both, ["a", "b"], "left")
    return met.select("a", "b", F.coalesce("given", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("corr"))


def factors(points: DataFrame, state_records: DataFrame, obs: DataFrame, obs_records: DataFrame, kinds: tuple[str, str, str] = ("gaspari_cohn", "gaspari_cohn", "exponential"), lx: float | None = None, ly: float | None = None) -> DataFrame:
    """``rec, loc, obs_id, rho`` of all pairs with a positive product of factors.

    ``points(loc, x, y)`` is the grid, ``state_records(rec, name, z, t)`` its fields with depth and hours,
    ``obs(obs_id, obs_rec, x, y, z, t)`` the observations, ``obs_records(obs_rec, hroi, vroi, troi, impact)``
    their radii. The widest radius sets the buckets of the horizontal join; what is near there meets the
    state records, a table of some tens of rows, once.
    """
    reach = float(obs_records.agg(F.max("hroi")).first()[0] or 1.0)
    impact = impact_of(obs_records, state_records.select("name").distinct())
    placed = obs.join(F.broadcast(obs_records.select("obs_rec", F.col("hroi").alias("roi"))), "obs_rec")
    near = local.localize(points, placed, reach, kinds[0], lx, ly, own_radius=True)
    heights = obs.join(F.broadcast(obs_records.select("obs_rec", "vroi", "troi")), "obs_rec").select("obs_id", "obs_rec", F.col("z").alias("oz"), F.col("t").alias("ot"), "vroi", "troi")
    met = near.join(heights, "obs_id").join(F.broadcast(state_records.select("rec", "name", "z", "t")), F.col("rec").isNotNull()).join(F.broadcast(impact), ["obs_rec", "name"])
    up, ago = distance.taper(kinds[1])(F.abs(F.col("z") - F.col("oz")), F.col("vroi")), distance.taper(kinds[2])(F.abs(F.col("t") - F.col("ot")), F.col("troi"))
    return met.select("rec", "loc", "obs_id", (F.col("rho") * up * ago * F.col("impact")).alias("rho")).where("rho > 0")
