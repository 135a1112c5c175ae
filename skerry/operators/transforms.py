"""Transforms of states and observations around a filter's pass, by name: to one scale and back.

A transform has four functions, forward and backward for states and for observations. Backward ones of
scales do nothing, as each pass's increment is added to the whole state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators import grid as grids
from skerry.operators import observations, spectral
from skerry.sources.config import Registry

TRANSFORMS = Registry("transform")


class Transform:
    """The transform that changes nothing."""

    def forward_state(self, state: DataFrame, scale: int) -> DataFrame:
        return state

    def backward_state(self, state: DataFrame, scale: int) -> DataFrame:
        return state

    def forward_obs(self, obs: DataFrame, scale: int) -> DataFrame:
        return obs

    def backward_obs(self, obs: DataFrame, scale: int) -> DataFrame:
        return obs


TRANSFORMS.register("identity")(Transform)


@TRANSFORMS.register("scale_bandpass")
@dataclass(frozen=True)
class ScaleBandpass(Transform):
    """One scale of fields ``mem, i, j, value`` on a grid, and of observations ``obs_id, x, y, obs, err_std``.

    ``cutoffs`` are the wavenumbers between the scales. Observations are laid onto the grid, every point
    taking the nearest within ``reach`` and zero where there is none; that field's scale is read at the
    grid point nearest to each observation, and errors are multiplied by the scale's ``error_factors``.
    Observations outside the grid keep their value. Without ``decompose_obs`` observations stay whole.
    """

    grid: grids.Grid
    cutoffs: list[float]
    error_factors: list[float] | None = None
    reach: float = 2.0
    decompose_obs: bool = True

    def forward_state(self, state: DataFrame, scale: int) -> DataFrame:
        return spectral.scale_component(state, ["mem"], self.grid.ny, self.grid.nx, self.cutoffs, scale) if self.cutoffs else state

    def forward_obs(self, obs: DataFrame, scale: int) -> DataFrame:
        if not self.cutoffs or not self.decompose_obs:
            return obs
        points = self.grid.points(obs.sparkSession)
        nodes = obs.select(F.col("obs_id").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"))
        near = observations.nearest_node(points.select("loc", "x", "y"), nodes, "loc", self.reach).select("loc", F.col("node").alias("obs_id"))
        laid = points.select("loc", "i", "j").join(near.join(obs.select("obs_id", "obs"), "obs_id"), "loc", "left")
        laid = laid.select(F.lit(0).alias("mem"), "i", "j", F.coalesce(F.col("obs").cast("double"), F.lit(0.0)).alias("value"))
        part = self.forward_state(laid, scale).select((F.col("j") * self.grid.nx + F.col("i")).cast("long").alias("loc"), "value")
        found = grids.nearest(grids.find_cell(obs.select("obs_id", "x", "y"), self.grid), part, "obs_id", []).select("obs_id", F.col("value").alias("part"))
        factor = self.error_factors[scale] if self.error_factors else 1.0
        return obs.join(found, "obs_id", "left").withColumns({"obs": F.coalesce("part", "obs"), "err_std": F.col("err_std") * factor}).drop("part")


def smoothed(field: DataFrame, width: float, by: list[str], cut: float = 3.0) -> DataFrame:
    """``by, node, value`` of ``field(by, node, x, y, value)``: means with Gaussian weights of a width, over nodes within ``cut`` widths.

    Nodes meet those of the buckets around theirs. Missing values take no part; a node without any value
    near it is missing.
    """
    reach = cut * width
    b = lambda c: F.floor(F.col(c) / reach)
    at = field.select("node", "x", "y").distinct()
    spread = at.select("node", "x", "y", F.explode(F.sequence(b("x") - 1, b("x") + 1)).alias("bx"), F.sequence(b("y") - 1, b("y") + 1).alias("bys")).select("node", "x", "y", "bx", F.explode("bys").alias("by_"))
    near = spread.join(at.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), b("x").alias("bx"), b("y").alias("by_")), ["bx", "by_"])
    gap2 = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
    weights = near.where(gap2 <= reach * reach).select("node", "other", F.exp(-gap2 / (2 * width * width)).alias("w"))
    known = field.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select(*by, F.col("node").alias("other"), "value")
    met = weights.join(known, "other").groupBy(*by, "node").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return field.select(*by, "node").join(met, [*by, "node"], "left")


def node_component(field: DataFrame, widths: list[float], by: list[str], component: int) -> DataFrame:
    """Part of fields on irregular nodes between two smoothing widths, widest first; the parts over all ``widths`` sum to the field.

    Missing values stay missing.
    """
    fine = field.select(*by, "node", "value") if component == len(widths) else smoothed(field, widths[component], by)
    out = fine
    if component:
        coarse = smoothed(field, widths[component - 1], by).withColumnRenamed("value", "coarse")
        out = fine.join(coarse, [*by, "node"]).select(*by, "node", (F.col("value") - F.col("coarse")).alias("value"))
    given = field.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select(*by, "node")
    return field.select(*by, "node").join(out.join(given, [*by, "node"], "left_semi"), [*by, "node"], "left")
