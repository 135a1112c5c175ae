"""Bounded samples that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, those of the smallest hashes of their keys; about ``n`` if there are more.

    Rows are first thinned by the hash to half as many again, so that the last step reads a bounded
    number of rows however many partitions there are.
    """
    count = df.count()
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / float(1 << 53)
    return df.where(unit < min(1.0, 1.5 * n / max(count, 1))).orderBy(unit, key).limit(n)
