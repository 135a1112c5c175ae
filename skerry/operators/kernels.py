"""Ensemble filters: serial adjustment by expressions, transforms by point or by tile with small dense algebra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjust(value: Column, mean: Column, variance: Column, obs: Column, err_std: Column) -> Column:
    """Increment of an observed member: the mean moves to the weighted mean, perturbations shrink."""
    ratio = err_std * err_std / (variance + err_std * err_std)
    return ratio * mean + (1 - ratio) * obs + F.sqrt(ratio) * (value - mean) - value


def serial_step(state: DataFrame, prior: DataFrame, obs: DataFrame, rho: DataFrame) -> DataFrame:
    """Assimilates the one observation of ``obs(obs, err_std)`` into ``state(loc, mem, value)``.

    ``prior(mem, prior)`` holds the observed members, ``rho(loc, rho)`` the localization; other points
    and a prior without spread stay unchanged.
    """
    every = Window.partitionBy()  # the members of one observation
    members = prior.crossJoin(F.broadcast(obs.limit(1)))
    members = members.withColumns({"mb": F.avg("prior").over(every), "vb": F.var_samp("prior").over(every)})
    members = members.select("mem", "prior", "vb", adjust(F.col("prior"), F.col("mb"), F.col("vb"), F.col("obs"), F.col("err_std")).alias("step"))
    met = state.join(F.broadcast(members), "mem")  # a row for each member
    cov = F.covar_samp("value", "prior").over(Window.partitionBy("loc"))
    met = met.withColumn("gain", F.when(F.col("vb") > 0, cov / F.col("vb")).otherwise(0.0)).join(rho, "loc", "left")
    return met.select("loc", "mem", (F.col("value") + F.coalesce("rho", F.lit(0.0)) * F.col("gain") * F.col("step")).alias("value"))


def etkf_weights(prior: np.ndarray, obs: np.ndarray, err: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """Members-by-members transform of the symmetric square-root filter; ``prior`` is members by observations.

    Factors multiply perturbations and innovations. If the decomposition fails, no update.
    """
    n = len(prior)
    scale = rho / err / np.sqrt(n - 1)
    s, d = (prior - prior.mean(axis=0)) * scale, (obs - prior.mean(axis=0)) * scale
    try:
        values, vectors = np.linalg.eigh(np.eye(n) + s @ s.T)
    except np.linalg.LinAlgError:
        return np.eye(n)
    shift = (vectors / values) @ vectors.T @ (s @ d)
    return shift[:, None] + (vectors / np.sqrt(values)) @ vectors.T


def denkf_weights(prior: np.ndarray, obs: np.ndarray, err: np.ndarray, rho: np.ndarray, rfactor: float = 1.0, kfactor: float = 2.0) -> np.ndarray:
    """Transform of the deterministic filter, with errors inflated where innovations are large."""
    n, mean, variance = len(prior), prior.mean(axis=0), prior.var(axis=0, ddof=1)
    inflated = np.sqrt((variance + err**2) ** 2 + variance * ((obs - mean) / kfactor) ** 2) - variance
    scale = rho / np.sqrt(inflated) / np.sqrt(n - 1)
    s, d = (prior - mean) * scale, (obs - mean) * scale

    def gain(s: np.ndarray) -> np.ndarray:
        if s.shape[1] < n:
            return np.linalg.solve(np.eye(s.shape[1]) + s.T @ s, s.T).T
        return np.linalg.solve(np.eye(n) + s @ s.T, s)

    try:
        shift = gain(s) @ d
        thin = s / np.sqrt(max(rfactor, 1.0))
        return shift[:, None] + np.eye(n) - 0.5 * gain(thin) @ thin.T
    except np.linalg.LinAlgError:
        return np.eye(n)


WEIGHTS = {"etkf": etkf_weights, "denkf": denkf_weights}


def local_analysis(state: DataFrame, obs: DataFrame, pairs: DataFrame, method: str = "etkf", max_obs: int | None = None, **options) -> DataFrame:
    """Analysed ``loc, mem, value`` of ``state(loc, par_id, mem, value)``.

    ``obs(obs_id, obs, err_std, priors)`` holds each observation with its ordered members,
    ``pairs(loc, par_id, obs_id, rho)`` the localization. Points travel as one row with their members as
    an array and their observations as another, strongest first; each point's small algebra runs in
    Arrow batches of such rows. Points without observations or spread stay unchanged. Observations that
    many points share are better analysed by ``batch_analysis``.
    """
    weights = WEIGHTS[method]
    points = state.groupBy("loc").agg(F.transform(F.sort_array(F.collect_list(F.struct("mem", "value"))), lambda s: s["value"]).alias("ens"))
    local = pairs if max_obs is None else pairs.withColumn("rank", F.row_number().over(Window.partitionBy("loc").orderBy(F.desc("rho"), "obs_id"))).where(F.col("rank") <= max_obs)
    met = local.join(obs, "obs_id").groupBy("loc").agg(F.sort_array(F.collect_list(F.struct((-F.col("rho")).alias("key"), "obs_id", "obs", "err_std", "priors"))).alias("o"))
    rows = points.join(met, "loc", "left").select("loc", "ens", *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("key", "obs", "err_std", "priors")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            after = []
            for ens, key, obs_, err, priors in zip(batch["ens"], batch["o_key"], batch["o_obs"], batch["o_err_std"], batch["o_priors"]):
                x = np.asarray(ens)
                if key is not None and len(key) and x.std() > 0:
                    x = x @ weights(np.stack([np.asarray(p) for p in priors], axis=1), np.asarray(obs_), np.asarray(err), -np.asarray(key), **options)
                after.append(x)
            yield pd.DataFrame({"loc": batch["loc"], "ens": after})

    out = rows.mapInPandas(run, "loc bigint, ens array<double>")
    return out.select("loc", F.posexplode("ens").alias("mem", "value"))


#: Columns that say where an observation lies in its cell, see ``grid.find_cell``.
IN_CELL = ("cell", "u", "v")


def _with_cells(near: DataFrame, cells: DataFrame) -> DataFrame:
    """Observations of tiles, and beside them a row with ``members`` for each of their tile's cells."""
    held = near.select("par_id", "cell").distinct().join(cells, "cell").select("par_id", "cell", "members")
    return near.unionByName(held, allowMissingColumns=True)


def _with_priors(found: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A tile's observations in order of their ids, and their members as members by observations.

    They have them as ``priors``, or as rows of ``_with_cells``, where those without a cell are left out.
    """
    if "members" not in found:
        found = found.sort_values("obs_id").reset_index(drop=True)
        return found, np.stack(found["priors"].to_list(), axis=1) if len(found) else np.empty((0, 0))
    held = found["members"].notna()
    cells, found = found.loc[held, ["cell", "members"]], found[~held].drop(columns="members")
    found = found[found["cell"].isin(cells["cell"])].sort_values("obs_id").reset_index(drop=True)
    if not len(found):
        return found, np.empty((0, 0))
    members = np.stack(cells["members"].to_list()).reshape(len(cells), 4, -1)
    at = pd.Index(cells["cell"]).get_indexer(found["cell"])
    u, v = found["u"].to_numpy(), found["v"].to_numpy()
    shares = ((1 - u) * (1 - v), u * (1 - v), u * v, (1 - u) * v)
    priors = np.empty((members.shape[2], len(found)))
    for k in range(len(priors)):
        corner = members[:, :, k]
        priors[k] = sum((shares[c] * corner[at, c] for c in (1, 2, 3)), shares[0] * corner[at, 0])
    return found, priors


def batch_analysis(state: DataFrame, obs: DataFrame | None, halo: DataFrame, roi: float, method: str = "etkf", taper: str = "gaspari_cohn", cells: DataFrame | None = None, **options) -> DataFrame:
    """Analysed ``loc, mem, value`` of ``state(loc, x, y, par_id, mem, value)``, tile by tile.

    ``halo(par_id, obs_id)`` names the observations within reach of a tile, ``obs(obs_id, x, y, obs,
    err_std, priors)`` has them with their members. A tile and its observations meet once in a task, so
    members of an observation travel once for each tile it touches and not for each point. Tiles have a
    bounded number of points; a tile's observations are those of its area and halo.

    With ``cells(cell, members)`` of ``grid.cell_members`` no members travel with observations: the halo
    has their columns ``ox, oy, obs, err_std`` and ``IN_CELL``, ``obs`` is left out, and the members are
    interpolated in the tile.
    """
    points = state.groupBy("par_id", "loc", "x", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("mem", "value"))), lambda s: s["value"]).alias("ens"))
    if cells is None:
        near = halo.join(obs, "obs_id").select("par_id", "obs_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "obs", "err_std", "priors")
    else:
        near = _with_cells(halo.select("par_id", "obs_id", "ox", "oy", "obs", "err_std", *IN_CELL), cells)
    shape, weights = TAPER_ARRAYS[taper], WEIGHTS[method]

    def run(tile: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(tile):
            return pd.DataFrame({"loc": [], "ens": []})
        after = [np.asarray(e) for e in tile["ens"]]
        found, priors = _with_priors(found)
        if len(found):
            ox, oy, obs_, err = (found[c].to_numpy() for c in ("ox", "oy", "obs", "err_std"))
            for k, (x, y) in enumerate(zip(tile["x"], tile["y"])):
                rho = shape(np.sqrt((ox - x) ** 2 + (oy - y) ** 2), roi)
                used = rho > 0
                if used.any() and after[k].std() > 0:
                    after[k] = after[k] @ weights(priors[:, used], obs_[used], err[used], rho[used], **options)
        return pd.DataFrame({"loc": tile["loc"], "ens": after})

    out = points.groupBy("par_id").cogroup(near.groupBy("par_id")).applyInPandas(run, "loc bigint, ens array<double>")
    return out.select("loc", F.posexplode("ens").alias("mem", "value"))


def batch_records(
    state: DataFrame, state_records: DataFrame, obs: DataFrame | None, obs_records: DataFrame, impact: DataFrame, halo: DataFrame, method: str = "etkf", kinds: tuple[str, str, str] = ("gaspari_cohn", "gaspari_cohn", "exponential"),
    lx: float | None = None, ly: float | None = None, max_obs: int | None = None, cells: DataFrame | None = None, **options,
) -> DataFrame:
    """Analysed ``rec, loc, mem, value`` of fields on several levels, times and variables, tile by tile.

    ``state(rec, loc, x, y, par_id, mem, value)`` are the fields of ``state_records(rec, name, z, t)``,
    ``obs(obs_id, obs_rec, x, y, z, t, obs, err_std, priors)`` the observations of ``obs_records(obs_rec, hroi,
    vroi, troi)``, ``impact(obs_rec, name, impact)`` their weight for a variable, ``halo(par_id, obs_id)`` those
    within reach of a tile. A tile and its observations meet once in a task. There the horizontal factor is
    computed once for a point, the others once for a record and observation of the tile; records with equal
    factors at all observations share their weights, as levels at one depth or variables without an impact
    of their own do. ``max_obs`` keeps a point's strongest observations, ties to the smaller id. With ``cells``
    the halo has the observations' columns ``obs_rec, ox, oy, oz, ot, obs, err_std`` and ``IN_CELL``, as in
    ``batch_analysis``.
    """
    points = state.groupBy("par_id", "loc", "x", "y", "rec").agg(F.transform(F.sort_array(F.collect_list(F.struct("mem", "value"))), lambda s: s["value"]).alias("ens"))
    if cells is None:
        near = halo.join(obs, "obs_id").select("par_id", "obs_id", "obs_rec", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.col("t").alias("ot"), "obs", "err_std", "priors")
    else:
        near = _with_cells(halo.select("par_id", "obs_id", "obs_rec", "ox", "oy", "oz", "ot", "obs", "err_std", *IN_CELL), cells)
    # some tens of rows each
    radii = {r["obs_rec"]: (r["hroi"], r["vroi"], r["troi"]) for r in obs_records.select("obs_rec", "hroi", "vroi", "troi").collect()}
    effects = {(r["obs_rec"], r["name"]): r["impact"] for r in impact.select("obs_rec", "name", "impact").collect()}
    described = {r["rec"]: (r["name"], r["z"], r["t"]) for r in state_records.select("rec", "name", "z", "t").collect()}  # some tens of rows
    along, up, ago = (TAPER_ARRAYS[k] for k in kinds)
    weights = WEIGHTS[method]

    def axis_gap(a: np.ndarray, b: float, length: float | None) -> np.ndarray:
        gap = np.abs(a - b)
        return gap if length is None else np.minimum(gap, length - gap)

    def run(tile: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(tile):
            return pd.DataFrame({"rec": [], "loc": [], "ens": []})
        tile = tile.reset_index(drop=True)
        after = [np.asarray(e) for e in tile["ens"]]
        known = found["obs_rec"].isin(list(radii))
        found, priors = _with_priors(found[known | found["members"].notna() if "members" in found else known])
        if len(found):
            ox, oy, oz, ot, obs_, err = (found[c].to_numpy(np.float64) for c in ("ox", "oy", "oz", "ot", "obs", "err_std"))
            code, of = pd.factorize(found["obs_rec"])
            hroi, vroi, troi = (np.array([radii[o][k] for o in of], np.float64)[code] for k in range(3))
            kind, shared = {}, {}
            for r in sorted(set(tile["rec"])):
                name, z, t = described[r]
                factor = up(np.abs(oz - z), vroi) * ago(np.abs(ot - t), troi) * np.array([effects.get((o, name), 1.0) for o in of])[code]
                kind[r] = factor.tobytes()
                shared.setdefault(kind[r], factor)
            for (x, y), rows in tile.groupby(["x", "y"]).indices.items():
                flat = along(np.sqrt(axis_gap(ox, x, lx) ** 2 + axis_gap(oy, y, ly) ** 2), hroi)
                known: dict[int, np.ndarray | None] = {}
                for k in rows:
                    if after[k].std() == 0:
                        continue
                    g = kind[tile["rec"][k]]
                    if g not in known:
                        rho = flat * shared[g]
                        used = np.flatnonzero(rho > 0)
                        if max_obs is not None and len(used) > max_obs:
                            used = np.sort(used[np.argsort(-rho[used], kind="stable")[:max_obs]])
                        known[g] = weights(priors[:, used], obs_[used], err[used], rho[used], **options) if len(used) else None
                    if known[g] is not None:
                        after[k] = after[k] @ known[g]
        return pd.DataFrame({"rec": tile["rec"], "loc": tile["loc"], "ens": after})

    out = points.groupBy("par_id").cogroup(near.groupBy("par_id")).applyInPandas(run, "rec int, loc bigint, ens array<double>")
    return out.select("rec", "loc", F.posexplode("ens").alias("mem", "value"))


def _gaspari_cohn(gap: np.ndarray, roi: float | np.ndarray) -> np.ndarray:
    r = np.maximum(2 * gap / roi, 1e-10)
    near = 1 + r * r * (-5 / 3 + r * (5 / 8 + r * (1 / 2 - r / 4)))
    far = 4 - 5 * r + r * r * (5 / 3 + r * (5 / 8 + r * (-1 / 2 + r / 12))) - 2 / (3 * r)
    return np.where(r < 1, near, np.where(r < 2, far, 0.0))


#: The tapers of ``functions.distance`` on arrays.
TAPER_ARRAYS = {"gaspari_cohn": _gaspari_cohn, "step": lambda gap, roi: np.where(gap <= roi, 1.0, 0.0), "exponential": lambda gap, roi: np.exp(-gap / roi)}
