"""The serial adjustment filter, in passes of observations whose groups don't touch each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import local
from skerry.sources.tables import StateStore

#: Observations that a task assimilates one after another, at most, and observations of a pass.
GROUP, PASS = 512, 1 << 16


def groups(obs: DataFrame, reach: float) -> DataFrame:
    """``obs`` with ``gy, gx``: observations of different groups lie more than ``reach`` apart in a direction.

    Groups end at gaps in y, and within those at gaps in x. The rows are one pass's.
    """
    for name, c, by in (("gy", "y", []), ("gx", "x", ["gy"])):
        w = Window.partitionBy(*by).orderBy(c, "obs_id")
        obs = obs.withColumn("open", F.coalesce((F.col(c) - F.lag(c).over(w) > reach).cast("long"), F.lit(0).cast("long")))
        obs = obs.withColumn(name, F.sum("open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("open")
    return obs


def _one_by_one(pairs: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """A group's observations assimilated in order of their ids; the changed rows of ``state(loc, mem, value)``."""
    if pairs.empty or state.empty:
        return state[["loc", "mem", "value"]].iloc[:0]
    locs, at = np.unique(state["loc"].to_numpy(), return_inverse=True)
    mems, mem = np.unique(state["mem"].to_numpy(), return_inverse=True)
    x, there = np.zeros((len(locs), len(mems))), np.zeros((len(locs), len(mems)), bool)
    x[at, mem], there[at, mem] = state["value"].to_numpy(), True
    pairs = pairs[np.isin(pairs["loc"].to_numpy(), locs)].sort_values(["obs_id", "loc"])
    ids, starts = np.unique(pairs["obs_id"].to_numpy(), return_index=True)
    where, rho = np.searchsorted(locs, pairs["loc"].to_numpy()), pairs["rho"].to_numpy()
    values, errors = pairs["obs"].to_numpy(), pairs["err_std"].to_numpy()
    own = np.searchsorted(locs, -1 - ids)
    for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(pairs)])):
        if own[n] == len(locs) or locs[own[n]] != -1 - ids[n]:
            continue
        prior, seen = x[own[n]].copy(), there[own[n]]
        if seen.sum() < 2:
            continue
        mean, var = prior[seen].mean(), prior[seen].var(ddof=1)
        if var <= 0:
            continue
        ratio = errors[a] ** 2 / (var + errors[a] ** 2)
        step = ratio * mean + (1 - ratio) * values[a] + np.sqrt(ratio) * (prior - mean) - prior
        rows = where[a:b]
        both = there[rows] & seen
        count = both.sum(axis=1)
        some = np.maximum(count, 1)[:, None]
        dx = np.where(both, x[rows] - (np.where(both, x[rows], 0).sum(axis=1)[:, None] / some), 0)
        dp = np.where(both, prior - (np.where(both, prior, 0).sum(axis=1)[:, None] / some), 0)
        gain = np.where(count > 1, rho[a:b] * (dx * dp).sum(axis=1) / np.maximum(count - 1, 1) / var, 0)
        x[rows] += np.where(both & (count > 1)[:, None], gain[:, None] * step, 0)
    return pd.DataFrame({"loc": state["loc"], "mem": state["mem"], "value": x[at, mem]})


def assimilate(state: DataFrame, points: DataFrame, prior: DataFrame, obs: DataFrame, roi: float, kind: str = "gaspari_cohn", group: int = GROUP) -> DataFrame:
    """Analysed ``loc, mem, value`` of ``state`` at ``points(loc, x, y)``, one observation after another by id.

    ``prior(obs_id, mem, value)`` is the ensemble at the observations, ``obs(obs_id, x, y, obs, err_std)``.
    Observations not yet used are updated like points of the state. A pass takes the next observations by
    id: groups too far apart to change the same point are assimilated at once, a task for each, and the
    observations of a group one by one. Passes grow as long as no group has more than ``group``
    observations. The state is written after each.
    """
    store = StateStore.temporary(state.sparkSession)
    all_points = points.select("loc", "x", "y").unionByName(obs.select((-1 - F.col("obs_id")).alias("loc"), "x", "y"))
    used_later = (F.col("loc") >= 0) | (-1 - F.col("loc") >= F.col("obs_id"))
    pairs = store.write(local.localize(all_points, obs, roi, kind).where(used_later), 0, "pairs")
    known = obs.select("obs_id", "x", "y", "obs", "err_std").where("obs is not null and err_std is not null")
    known = store.write(known, 0, "obs")
    now = store.write(state.select("loc", "mem", "value").unionByName(prior.select((-1 - F.col("obs_id")).alias("loc"), "mem", "value")), 0, "state")
    reach = (2 if kind.lower() in ("gaspari_cohn", "step") else 4) * roi  # others have no end but the buckets'
    schema = f"loc bigint, mem {now.schema['mem'].dataType.simpleString()}, value double"
    size, after, k = group, None, 0
    while True:
        rest = known if after is None else known.where(F.col("obs_id") > after)
        k += 1
        used = store.write(groups(rest.orderBy("obs_id").limit(size), reach), k, "used")
        last, most = used.groupBy("gy", "gx").agg(F.max("obs_id").alias("last"), F.count("*").alias("n")).agg(F.max("last"), F.max("n")).first()
        if last is None:
            return now.where("loc >= 0")
        if most > group and size > group:
            size = max(group, size // 2)
            continue
        met = store.write(pairs.join(used.drop("x", "y"), "obs_id"), k, "met")
        touched = met.select(F.col("gy").alias("sy"), F.col("gx").alias("sx"), "loc").distinct()
        sent = now.where("value is not null").join(touched, "loc")
        moved = met.groupBy("gy", "gx").cogroup(sent.groupBy("sy", "sx")).applyInPandas(_one_by_one, schema)
        now = store.write(now.join(moved.withColumnRenamed("value", "new"), ["loc", "mem"], "left").select("loc", "mem", F.coalesce("new", "value").alias("value")), k, "state")
        size, after = min(2 * size, PASS), last
