"""Intermediate tables in the folder that the whole cluster shares.

An iterative operator cuts its lineage by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back. A written table outlives any executor, and its size is known to the optimizer, which
then broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions that run on one machine.
LOCAL_DIR = "file:///tmp/checkpoints"
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is set and the session runs on it alone."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (given or LOCAL_DIR).rstrip("/")


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators have left for their results' plans; call it once those results are written."""
    while _roots:
        _delete(spark, _roots.pop())


def held() -> frozenset[str]:
    """Folders of tables that operators have left so far."""
    return frozenset(_roots)


def release(spark: SparkSession, roots: frozenset[str]) -> None:
    """Delete the tables in these folders, whose results are written."""
    for root in roots & _roots:
        _roots.discard(root)
        _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator call, each in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        _roots.add(self.root)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)  # whole texts pass through some of these tables
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def write_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table whose rows stay where they are when grouped by ``key``; the catalog forgets it, the plan does not."""
        table = f"scratch_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").option("path", self.path(name)).bucketBy(buckets, key).saveAsTable(table)
        out = self.spark.table(table)
        out.schema  # noqa: B018 - analysed before the name goes
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        _delete(self.spark, df.scratch_path)


def broadcast_if_small(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """A stored table of few short columns, broadcast only if it was counted to have at most ``rows`` rows (some 20 MB)."""
    return F.broadcast(df) if df.count() <= rows else df
