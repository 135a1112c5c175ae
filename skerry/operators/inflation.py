"""Covariance inflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiplicative(ens: DataFrame, coef: float | Column, by: list[str]) -> DataFrame:
    """Perturbations scaled about the ensemble mean."""
    mean = F.avg("value").over(Window.partitionBy(*by))
    return ens.withColumn("value", coef * (F.col("value") - mean) + mean)


def adaptive_prior(stats: DataFrame) -> DataFrame:
    """Adds ``coef``: the factor that explains the innovations; 1 with fewer than 3 observations or no solution."""
    ratio = (F.col("omb2") - F.col("varo")) / F.col("varb")
    return stats.withColumn("coef", F.when((F.col("total_nobs") < 3) | (F.col("varb") <= 0) | (ratio < 0), 1.0).otherwise(F.sqrt(ratio)))


def adaptive_post(stats: DataFrame) -> DataFrame:
    """Adds ``coef`` for the posterior spread; 1 where its ratio is negative or the spread is zero."""
    ratio = (F.col("omb2") - F.col("varo") - F.col("amb2")) / F.col("vara")
    return stats.withColumn("coef", F.when((F.col("total_nobs") < 3) | (F.col("vara") <= 0) | (ratio < 0), 1.0).otherwise(F.sqrt(ratio)))


def adaptive_relaxation(stats: DataFrame) -> DataFrame:
    """Adds ``alpha``, the share of prior perturbations to return to; within -1 and 2, 0 where spread didn't shrink."""
    beta = F.sqrt(F.col("varb") / F.col("vara"))
    wanted = F.sqrt(F.greatest(F.lit(0.0), (F.col("omb2") - F.col("varo") - F.col("amb2")) / F.col("vara")))
    alpha = F.least(F.lit(2.0), F.greatest(F.lit(-1.0), (wanted - 1) / (beta - 1)))
    return stats.withColumn("alpha", F.when((F.col("vara") <= 0) | (beta <= 1), 0.0).otherwise(alpha))


def relax_to_prior(prior: DataFrame, post: DataFrame, alpha: float | Column, by: list[str]) -> DataFrame:
    """Posterior mean with perturbations blended from prior and posterior."""
    w = Window.partitionBy(*by)
    both = prior.withColumnRenamed("value", "b").join(post.withColumnRenamed("value", "a"), [*by, "mem"])
    b, a = F.col("b") - F.avg("b").over(w), F.col("a") - F.avg("a").over(w)
    return both.select(*by, "mem", (F.avg("a").over(w) + alpha * b + (1 - alpha) * a).alias("value"))


def inflate(spec: str) -> tuple[str, str]:
    """``"post,multiplicative"`` as (stage, kind); an unknown stage or kind is an error."""
    parts = [p.strip().lower() for p in spec.split(",")]
    stage = next((p for p in parts if p in ("prior", "post")), None)
    kind = next((p for p in parts if p in ("multiplicative", "rtpp")), None)
    if stage is None or kind is None:
        raise NotImplementedError(f"inflation {spec!r}")
    return stage, kind
