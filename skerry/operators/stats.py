"""Ensemble and observation-space statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(ens: DataFrame, by: list[str]) -> DataFrame:
    """Mean, sample variance and member count; a missing member makes the mean null."""
    whole = F.count("value") == F.count("*")
    return ens.groupBy(*by).agg(
        F.when(whole, F.avg("value")).alias("mean"), F.when(whole, F.var_samp("value")).alias("variance"), F.count("*").alias("members")
    )


def packed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``key`` and its values as an array in order of the members."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("mem", value))), lambda s: s[value]).alias(name))


def covariances(state: DataFrame, obs: DataFrame, pairs: DataFrame, centred: bool = True) -> DataFrame:
    """Sample covariance and correlation of state points ``(loc, mem, value)`` and observed ones ``(obs_id, mem, prior)``.

    Only for ``pairs(loc, obs_id)``, those near each other: members travel as arrays, one row a pair.
    ``centred=False`` gives sums of raw products over n - 1, for ensembles that are centred already.
    """
    met = pairs.select("loc", "obs_id").join(packed(state, "loc", "value", "a"), "loc").join(packed(obs, "obs_id", "prior", "b"), "obs_id")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    product = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    n = F.size("a")
    shift = (lambda x, y: total(F.col(x)) * total(F.col(y)) / n) if centred else lambda x, y: F.lit(0.0)
    raw = lambda x, y: (product(F.col(x), F.col(y)) - shift(x, y)) / (n - 1)
    out = met.select("loc", "obs_id", raw("a", "b").alias("cov"), raw("a", "a").alias("va"), raw("b", "b").alias("vb"))
    return out.select("loc", "obs_id", "cov", (F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("corr"))


def observation_space(obs: DataFrame, prior: DataFrame, post: DataFrame | None = None) -> DataFrame:
    """One row of sums over observations: innovations, error, prior and, with a posterior, analysis statistics.

    ``obs(obs_id, obs, err_std)``; ``prior`` and ``post`` are ``(obs_id, mem, value)``.
    """
    after = F.lit(False)
    members = prior.select("obs_id", "value", after.alias("after"))
    if post is not None:
        members = members.union(post.select("obs_id", "value", F.lit(True)))
    whole = lambda which, f: F.when(F.count_if(which & F.col("value").isNull()) == 0, f(F.when(which, F.col("value"))))
    of = {"b": ~F.col("after"), "a": F.col("after")}  # prior and posterior moments of one aggregation
    moments_of = [whole(w, f).alias(f"{m}{c}") for c, w in of.items() for m, f in (("m", F.avg), ("v", F.var_samp))]
    rows = obs.join(members.groupBy("obs_id").agg(*moments_of), "obs_id")
    if post is not None:
        rows = rows.where("ma is not null")
    square = lambda c: F.sum(c * c)
    sums = [F.count("*").alias("total_nobs"), square(F.col("obs") - F.col("mb")).alias("omb2"), square(F.col("err_std")).alias("varo"), F.sum("vb").alias("varb")]
    if post is not None:
        step = F.col("ma") - F.col("mb")
        sums += [square(step).alias("amb2"), F.sum((F.col("obs") - F.col("ma")) * step).alias("omaamb"), F.sum("va").alias("vara")]
    return rows.agg(*sums)


def rmse(a: str, b: str) -> Column:
    return F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))


def crps(ens: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Continuous ranked probability score of ``ens(by, mem, value)`` against ``truth(by, truth)``.

    Mean absolute error less half the mean pairwise distance, the latter from ranks of sorted members.
    """
    order = Window.partitionBy(*by).orderBy("value", "mem")
    ranked = ens.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    spread = F.sum((2 * F.col("r") - F.col("n") - 1) * F.col("value")) / F.max(F.col("n") * F.col("n"))
    return ranked.join(truth, by).groupBy(*by).agg((F.avg(F.abs(F.col("value") - F.col("truth"))) - spread).alias("crps"))


def increments(prior: DataFrame, post: DataFrame, by: list[str]) -> DataFrame:
    """Posterior less prior for each record; only records that both have."""
    return prior.join(post.withColumnRenamed("value", "post_value"), by).select(*by, (F.col("post_value") - F.col("value")).alias("increment"))


def write_back(model: DataFrame, increment: DataFrame, by: list[str]) -> DataFrame:
    """Model values with increments added; where the increment is missing the prior stays."""
    return model.join(increment, by, "left").select(*by, F.coalesce(F.col("value") + F.col("increment"), F.col("value")).alias("value"))
