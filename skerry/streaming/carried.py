"""A state carried from cycle to cycle, in batch and as a stream that gives the same.

Each key has a mean and a variance. In every cycle with observations the variance first grows by
``growth`` for each cycle passed, then the cycle's mean observation, of variance ``error / n``, is
assimilated. In a stream a cycle is closed when the watermark of cycles' ends passes it; rows that come
for a cycle already closed are dropped and counted by ``late_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key string, cycle bigint, n bigint, mean double, variance double"
_STATE = "closed bigint, mean double, variance double, cycles array<bigint>, counts array<bigint>, sums array<double>"
FIRST_VARIANCE, GROWTH, ERROR = 1.0, 0.01, 0.04


def step(mean: float, variance: float, passed: int, n: int, total: float, growth: float, error: float) -> tuple[float, float]:
    """Mean and variance after a cycle's observations."""
    variance += growth * passed
    gain = variance / (variance + error / n)
    return mean + gain * (total / n - mean), (1 - gain) * variance


def cycle_number(t: str, hours: float) -> F.Column:
    return F.floor(F.unix_micros(F.col(t).cast("timestamp")) / int(hours * 3.6e9)).cast("long")


def carried(obs: DataFrame, hours: float, key: str = "kind", t: str = "t", value: str = "obs", growth: float = GROWTH, error: float = ERROR) -> DataFrame:
    """``key, cycle, n, mean, variance`` after every cycle with observations; the batch form.

    Observations are added up by key and cycle first, so what is folded in order, in one array for a key,
    has a place for each cycle.
    """
    sums = obs.where(F.col(value).isNotNull() & F.col(t).isNotNull()).groupBy(F.col(key).cast("string").alias("key"), cycle_number(t, hours).alias("cycle")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
    cycles = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cycle", "n", "total"))).alias("cycles"))
    empty = F.array().cast("array<struct<cycle:bigint,n:bigint,mean:double,variance:double>>")
    start = F.struct(F.lit(None).cast("long").alias("cycle"), F.lit(0.0).alias("mean"), F.lit(FIRST_VARIANCE).alias("variance"), empty.alias("out"))

    def fold(acc, c):
        grown = acc["variance"] + growth * F.coalesce(c["cycle"] - acc["cycle"], F.lit(0))
        gain = grown / (grown + error / c["n"])
        mean, variance = acc["mean"] + gain * (c["total"] / c["n"] - acc["mean"]), (1 - gain) * grown
        return F.struct(c["cycle"].alias("cycle"), mean.alias("mean"), variance.alias("variance"), F.concat(acc["out"], F.array(F.struct(c["cycle"].alias("cycle"), c["n"].alias("n"), mean.alias("mean"), variance.alias("variance")))).alias("out"))

    out = cycles.select("key", F.explode(F.aggregate("cycles", start, fold, lambda acc: acc["out"])).alias("c"))
    return out.select("key", "c.cycle", "c.n", "c.mean", "c.variance")


def carried_stream(obs: DataFrame, hours: float, late_hours: float, key: str = "kind", t: str = "t", value: str = "obs", growth: float = GROWTH, error: float = ERROR) -> DataFrame:
    """``carried`` of a stream, a row when a cycle closes: once rows of a cycle that ends ``late_hours`` after it have come, of any key."""
    period = int(hours * 3.6e6)

    def close(key_: str, state: GroupState, until_ms: float, closed, mean, variance, open_: dict[int, tuple[int, float]]) -> list[tuple]:
        out = []
        for cycle in sorted(c for c in open_ if (c + 1) * period <= until_ms):
            n, total = open_.pop(cycle)
            mean, variance = step(mean, variance, cycle - closed if closed is not None else 0, n, total, growth, error)
            closed = cycle
            out.append((key_, cycle, n, mean, variance))
        if open_ or closed is not None:
            cycles = sorted(open_)
            state.update((closed, mean, variance, cycles, [open_[c][0] for c in cycles], [open_[c][1] for c in cycles]))
        if open_:
            state.setTimeoutTimestamp(int(max((min(open_) + 1) * period, until_ms + 1)))
        return out

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, mean, variance, cycles, counts, sums = state.get if state.exists else (None, 0.0, FIRST_VARIANCE, [], [], [])
        open_ = {c: (n, s) for c, n, s in zip(cycles, counts, sums)}
        for batch in [] if state.hasTimedOut else batches:
            for cycle, part in batch.groupby("cycle")["value"]:
                n, total = open_.get(int(cycle), (0, 0.0))
                open_[int(cycle)] = (n + len(part), total + float(part.sum()))
        rows = close(keys[0], state, state.getCurrentWatermarkMs(), closed, mean, variance, open_)
        yield pd.DataFrame(rows, columns=["key", "cycle", "n", "mean", "variance"])

    known = obs.where(F.col(value).isNotNull() & F.col(t).isNotNull())
    rows = known.select(F.col(key).cast("string").alias("key"), cycle_number(t, hours).alias("cycle"), F.col(value).cast("double").alias("value"))
    # the watermark follows the ends of cycles, so that no row of an open cycle is late
    rows = rows.withColumn("until", F.timestamp_micros((F.col("cycle") + 1) * int(hours * 3.6e9))).withWatermark("until", f"{int(late_hours * 3600)} seconds")
    return rows.groupBy("key").applyInPandasWithState(run, SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped as their cycle was closed."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)
