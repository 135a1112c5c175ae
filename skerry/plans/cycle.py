"""A full cycle of forecast and analysis on the ring model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import distance
from skerry.operators import inflation, kernels, spectral, stats

POINTS = 40


def observe(truth: DataFrame, every: int, std: float, cycle: int, seed: int = 0) -> DataFrame:
    """``obs_id, obs, err_std``: every so many points of the truth with noise that depends on seed, cycle and point."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(cycle), "i", F.lit(k)), 11) + 0.5) / float(1 << 53)
    noise = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    return truth.where(F.col("i") % every == 1).select(F.col("i").cast("bigint").alias("obs_id"), (F.col("value") + std * noise).alias("obs"), F.lit(std).alias("err_std"))


def analyse(ens: DataFrame, obs: DataFrame, roi: float, method: str = "etkf") -> DataFrame:
    """Posterior members of the ring by local analysis around each point."""
    spark = ens.sparkSession
    points = spark.range(POINTS).select(F.col("id").alias("loc"))
    near = distance.gaspari_cohn(distance.axis_gap(F.col("loc"), F.col("obs_id"), float(POINTS)), F.lit(roi))
    pairs = points.crossJoin(F.broadcast(obs.select("obs_id"))).withColumn("rho", near).where("rho > 0")  # 40 points
    prior = ens.groupBy(F.col("i").cast("bigint").alias("obs_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("mem", "value"))), lambda s: s["value"]).alias("priors"))
    state = ens.select(F.col("i").cast("bigint").alias("loc"), "mem", "value")
    post = kernels.local_analysis(state, obs.join(prior, "obs_id"), pairs, method)
    return post.select("mem", F.col("loc").cast("int").alias("i"), "value")


def twin_experiment(spark: SparkSession, ring: DataFrame, cycles: int, period_hours: float = 6.0, std: float = 0.1, roi: float = 5.0, coef: float = 1.05) -> DataFrame:
    """Error and spread before and after the analysis of each cycle; member 0 is the truth.

    A forecast and its analysis are written as tables between cycles, so lineage stays short and a lost
    executor only repeats its own tasks.
    """
    from skerry.sources.tables import StateStore

    store = StateStore.temporary(spark)
    truth, ens = ring.where("mem = 0"), ring.where("mem > 0")
    summaries = []
    for cycle in range(cycles):
        truth = store.write(spectral.ring_run(truth, 8.0, period_hours, 0.01), cycle, "truth")
        prior = store.write(spectral.ring_run(ens, 8.0, period_hours, 0.01), cycle, "prior")
        ens = store.write(inflation.multiplicative(analyse(prior, observe(truth, 2, std, cycle), roi), coef, ["i"]), cycle, "post")
        summaries.append(_score(prior, truth, "prior").crossJoin(_score(ens, truth, "post")).select(F.lit(cycle).alias("cycle"), "*"))
    return reduce(DataFrame.unionAll, summaries)


def _score(ens: DataFrame, truth: DataFrame, name: str) -> DataFrame:
    means = stats.moments(ens, ["i"]).join(truth.select("i", F.col("value").alias("truth")), "i")
    return means.agg(stats.rmse("mean", "truth").alias(f"{name}_rmse"), F.sqrt(F.avg("variance")).alias(f"{name}_spread"))
