"""One analysis: inflate, observe, localize, filter, inflate, write back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import grid as grids
from skerry.operators import inflation, kernels, local, localization, serial, spectral, stats
from skerry.sources.tables import StateStore


#: Widest tile, in points.
MOST_TILE = 64


@dataclass(frozen=True)
class Settings:
    """How to analyse: filter, radius, taper, tiles, inflation.

    ``prior`` and ``post`` are inflation specifications such as ``"post,rtpp"``; without a coefficient they
    are adaptive. A transform filter works tile by tile, ``tile`` points wide, unless ``max_obs`` limits the
    observations of a point.
    """

    method: str = "etkf"
    roi: float = 3.0
    taper: str = "gaspari_cohn"
    max_obs: int | None = None
    tile: int | None = None
    prior: str | None = None
    prior_coef: float | None = None
    post: str | None = None
    post_coef: float | None = None


@dataclass(frozen=True)
class Analysis:
    prior: DataFrame
    post: DataFrame
    increment: DataFrame
    statistics: DataFrame


def at_observations(state: DataFrame, obs: DataFrame, grid: grids.Grid) -> DataFrame:
    """``obs_id, mem, value``: members interpolated to observations; those not every member reaches are left out."""
    met = grids.at_points(grids.find_cell(obs, grid), state, "obs_id", ["mem"], ["value"])
    return met.where("value is not null")


def _side(spark: SparkSession, grid: grids.Grid) -> int:
    """Width of tiles of which each task gets some, and none more than fits it well."""
    return min(local.tile_side(grid.nx, grid.ny, spark.sparkContext.defaultParallelism), MOST_TILE)


def _in_steps(obs: DataFrame, grid: grids.Grid) -> DataFrame:
    """Observations with their place counted in grid steps."""
    return obs.withColumns({"x": (F.col("x") - grid.x0) / grid.dx, "y": (F.col("y") - grid.y0) / grid.dy})


def _near_tiles(obs: DataFrame, grid: grids.Grid, side: int, reach: float | Column, **options) -> DataFrame:
    """The observations inside the grid with all that a tile needs of them, once for each tile within ``reach``, a length."""
    inside = grids.find_cell(obs, grid).where("inside").withColumns({"ox": F.col("x"), "oy": F.col("y"), "cell": F.col("p1")})
    keep = ("ox", "oy", *(c for c in ("obs_rec", "oz", "ot", "obs", "err_std") if c in inside.columns), *kernels.IN_CELL)
    return local.halo(_in_steps(inside, grid), grid.nx, grid.ny, side, reach / min(grid.dx, grid.dy), last=grid.last, keep=keep, **options)


def _tile_by_tile(part: DataFrame, whole: DataFrame, obs: DataFrame, grid: grids.Grid, side: int, roi: float, method: str, taper: str = "gaspari_cohn") -> DataFrame:
    """``part(loc, mem, value)`` analysed by the observations of ``whole``, whose members the tiles interpolate."""
    placed = local.with_tiles(grid.points(part.sparkSession), grid.nx, side).select("loc", "x", "y", "par_id")
    cells = grids.cell_members(grids.find_cell(obs, grid), whole)
    return kernels.batch_analysis(part.join(placed, "loc"), None, _near_tiles(obs, grid, side, roi), roi, method, taper, cells)


def _spread(ens: DataFrame, coef: float | None, found: DataFrame) -> DataFrame:
    """Perturbations times a coefficient, or times the one row of ``found(coef)``."""
    if coef is not None:
        return inflation.multiplicative(ens, coef, ["loc"])
    return inflation.multiplicative(ens.crossJoin(F.broadcast(found.select("coef"))), F.col("coef"), ["loc"]).drop("coef")


def analyse(state: DataFrame, obs: DataFrame, grid: grids.Grid, settings: Settings) -> Analysis:
    """The analysis of ``state(loc, mem, value)`` with ``obs(obs_id, x, y, obs, err_std)`` on one grid.

    A specification of the prior stage inflates the prior before it is observed again; one of the post
    stage works on the posterior. A stage given for the other end is an error.
    """
    spark = state.sparkSession
    prior = state.select("loc", "mem", "value")
    observed = at_observations(prior, obs, grid)
    for spec, stage in ((settings.prior, "prior"), (settings.post, "post")):
        if spec and inflation.inflate(spec)[0] != stage:
            raise ValueError(f"{spec!r} is no inflation of the {stage} stage")
    if settings.prior:
        if inflation.inflate(settings.prior)[1] != "multiplicative":
            raise NotImplementedError(f"inflation {settings.prior!r}")
        prior = _spread(prior, settings.prior_coef, inflation.adaptive_prior(stats.observation_space(obs, observed)))
        observed = at_observations(prior, obs, grid)
    points = grid.points(spark).select("loc", "x", "y")
    if settings.method == "eakf":
        post = serial.assimilate(prior, points, observed, obs, settings.roi, settings.taper)
    elif settings.max_obs is None:
        post = _tile_by_tile(prior, prior, obs, grid, settings.tile or _side(spark, grid), settings.roi, settings.method, settings.taper)
    else:
        with_members = obs.select("obs_id", "obs", "err_std").join(stats.packed(observed, "obs_id", "value", "priors"), "obs_id")
        pairs = local.localize(points, obs, settings.roi, settings.taper)
        post = kernels.local_analysis(prior, with_members, pairs, settings.method, settings.max_obs)
    after = at_observations(post, obs, grid)
    sums = stats.observation_space(obs, observed, after)
    if settings.post:
        if inflation.inflate(settings.post)[1] == "multiplicative":
            post = _spread(post, settings.post_coef, inflation.adaptive_post(sums))
        else:
            alpha = F.lit(settings.post_coef).alias("alpha") if settings.post_coef is not None else F.col("alpha")
            alpha = inflation.adaptive_relaxation(sums).select(alpha)  # one row
            blended = inflation.relax_to_prior(prior, post, F.lit(1.0), ["loc"]).withColumnRenamed("value", "full")
            met = post.join(blended, ["loc", "mem"]).crossJoin(F.broadcast(alpha))
            post = met.select("loc", "mem", (F.col("value") + F.col("alpha") * (F.col("full") - F.col("value"))).alias("value"))
    return Analysis(prior, post, stats.increments(prior, post, ["loc", "mem"]), sums)


def analyse_scales(state: DataFrame, obs: DataFrame, grid: grids.Grid, rois: list[float], cutoffs: list[float], method: str = "etkf") -> DataFrame:
    """The posterior ``loc, mem, value`` of a filter that works scale by scale, a radius for each scale.

    In each pass the observations meet the whole state that the pass before left; the weights they give,
    localized by the scale's radius, are applied to that scale's component only, and its increment is
    added to the state. ``cutoffs`` are the wavenumbers between the scales; without any, one pass is the
    usual analysis. The state is written between passes, so lineage stays short.
    """
    if len(rois) != len(cutoffs) + 1:
        raise ValueError(f"{len(rois)} radii for {len(cutoffs) + 1} scales")
    spark = state.sparkSession
    store = StateStore.temporary(spark)
    points = grid.points(spark).select("loc", "i", "j")
    now = state.select("loc", "mem", "value")
    for scale, roi in enumerate(rois):
        part = now
        if cutoffs:
            field = now.join(points.where(F.col("j") < grid.ny), "loc").select("mem", "i", "j", "value")
            part = spectral.scale_component(field, ["mem"], grid.ny, grid.nx, cutoffs, scale)
            part = part.select((F.col("j") * grid.nx + F.col("i")).cast("bigint").alias("loc"), "mem", "value")
        post = _tile_by_tile(part, now, obs, grid, _side(spark, grid), roi, method)
        now = store.write(stats.write_back(now, stats.increments(part, post, ["loc", "mem"]), ["loc", "mem"]), scale, "state")
    return now


def analyse_records(state: DataFrame, state_records: DataFrame, obs: DataFrame, obs_records: DataFrame, observed: DataFrame | None, grid: grids.Grid, method: str = "etkf", max_obs: int | None = None, tile: int | None = None, field: DataFrame | None = None, **options) -> DataFrame:
    """The posterior ``rec, loc, mem, value`` of fields on several levels, times and variables.

    ``state(rec, loc, mem, value)`` has the fields of ``state_records(rec, name, z, t)``, ``obs(obs_id,
    obs_rec, x, y, z, t, obs, err_std)`` the observations of ``obs_records``, ``observed(obs_id, mem,
    value)`` their members. Factors of all three directions and the impact on the variable decide what an
    observation does to a record; a record without any stays unchanged. Tiles and the observations of
    each one's reach meet in tasks; observations that not every member has are left out. Where the members
    are the bilinear values of one ``field(loc, mem, value)``, that is given instead of ``observed``: the
    tiles interpolate it, and no members travel with observations.
    """
    spark = state.sparkSession
    side = tile or _side(spark, grid)
    placed = local.with_tiles(grid.points(spark), grid.nx, side).select("loc", "x", "y", "par_id")
    reach = obs.join(F.broadcast(obs_records.select("obs_rec", "hroi")), "obs_rec")
    rings = {"cyclic_x": grid.cyclic_x, "cyclic_y": grid.cyclic_y}
    if field is not None:
        members, cells = None, grids.cell_members(grids.find_cell(obs, grid), field)
        halo = _near_tiles(reach.withColumnsRenamed({"z": "oz", "t": "ot"}), grid, side, F.col("hroi"), **rings)
    else:
        members, cells = obs.join(stats.packed(observed, "obs_id", "value", "priors"), "obs_id"), None
        halo = local.halo(_in_steps(reach, grid), grid.nx, grid.ny, side, F.col("hroi") / min(grid.dx, grid.dy), last=grid.last, **rings)
    impact = localization.impact_of(obs_records, state_records.select("name").distinct())
    lx, ly = (n * step if cyclic else None for n, step, cyclic in ((grid.nx, grid.dx, grid.cyclic_x), (grid.ny, grid.dy, grid.cyclic_y)))
    return kernels.batch_records(state.join(placed, "loc"), state_records, members, obs_records, impact, halo, method, lx=lx, ly=ly, max_obs=max_obs, cells=cells, **options)


def analyse_records_by_point(state: DataFrame, state_records: DataFrame, obs: DataFrame, obs_records: DataFrame, observed: DataFrame, grid: grids.Grid, method: str = "etkf", max_obs: int | None = None) -> DataFrame:
    """As ``analyse_records``, with every pair of a point and an observation as a row: for few observations, and to compare."""
    points = grid.points(state.sparkSession).select("loc", "x", "y")
    size = grid.size
    placed = lambda df: df.withColumn("loc", F.col("rec") * F.lit(size).cast("bigint") + F.col("loc"))
    pairs = placed(localization.factors(points, state_records, obs, obs_records)).select("loc", "obs_id", "rho")
    members = obs.select("obs_id", "obs", "err_std").join(stats.packed(observed, "obs_id", "value", "priors"), "obs_id")
    post = kernels.local_analysis(placed(state).select("loc", "mem", "value"), members, pairs, method, max_obs)
    return post.select(F.floor(F.col("loc") / size).cast("int").alias("rec"), (F.col("loc") % size).alias("loc"), "mem", "value")
