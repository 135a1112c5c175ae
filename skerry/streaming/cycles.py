"""Analysis cycles over event time, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def by_cycle(obs: DataFrame, period_hours: int) -> DataFrame:
    """Count and mean of observations by cycle start and kind; works on streams too."""
    return (
        obs.groupBy(F.window("t", f"{period_hours} hours").alias("w"), "kind")
        .agg(F.count("*").alias("n"), F.avg("obs").alias("mean"))
        .select(F.col("w.start").alias("cycle"), "kind", "n", "mean")
    )


def stream_by_cycle(obs: DataFrame, period_hours: int, late_hours: int) -> DataFrame:
    """``by_cycle`` of a stream: a cycle closes once event time is ``late_hours`` beyond it; later rows are dropped."""
    return by_cycle(obs.withWatermark("t", f"{late_hours} hours"), period_hours)


def analyse_each(obs: DataFrame, analyse: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``analyse`` on every micro-batch of observations that has arrived, then ends."""
    return obs.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
