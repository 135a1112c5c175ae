"""State tables by cycle and tag, and fixed-record binary files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StateStore:
    """Parquet tables in a folder, one for each cycle and tag; writing one again replaces it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> StateStore:
        """A store of its own in the folder the cluster shares."""
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return cls(spark, f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/state-{uuid.uuid4().hex}")

    def path(self, cycle: int | datetime, tag: str) -> str:
        name = cycle.strftime("%Y%m%d%H%M") if isinstance(cycle, datetime) else f"{cycle:06d}"
        return f"{self.root}/cycle={name}/tag={tag}"

    def write(self, state: DataFrame, cycle: int | datetime, tag: str) -> DataFrame:
        state.write.mode("overwrite").parquet(self.path(cycle, tag))
        return self.read(cycle, tag)

    def read(self, cycle: int | datetime, tag: str, **where: object) -> DataFrame:
        """A table's rows, restricted by equalities that reach the scan."""
        out = self.spark.read.parquet(self.path(cycle, tag))
        for column, value in where.items():
            out = out.where(F.col(column) == F.lit(value))
        return out


def write_output(fields: DataFrame, points: DataFrame, folder: str, about: dict[str, str] | None = None) -> None:
    """Write ``fields(mem, name, t, lev, loc, value)`` with the coordinates of ``points(loc, lon, lat, x, y)``, a folder for each member and variable.

    ``about``, such as the projection's text, stands in every row's ``about``, a map.
    """
    notes = F.create_map(*[F.lit(x) for pair in (about or {}).items() for x in pair]) if about else F.create_map().cast("map<string,string>")
    fields.join(points.select("loc", "lon", "lat", "x", "y"), "loc").withColumn("about", notes).write.mode("overwrite").partitionBy("mem", "name").parquet(folder)


def read_output(spark: SparkSession, folder: str, members: list[int] | None = None, names: list[str] | None = None) -> DataFrame:
    """Output written by ``write_output``; only the folders of the members and variables asked for are read."""
    out = spark.read.parquet(folder)
    for column, wanted in (("mem", members), ("name", names)):
        if wanted is not None:
            out = out.where(F.col(column).isin(wanted))
    return out


#: Padding of restart records to 4096 four-byte words, and the value that marks missing points.
RECORD_WORDS = 4096
MISSING = 2.0**100


def read_restart_records(spark: SparkSession, path: str, points: int) -> DataFrame:
    """``file, record, loc, value`` of big-endian four-byte fields padded to whole blocks; missing is null."""
    block = -(-points // RECORD_WORDS) * RECORD_WORDS * 4
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for record in range(len(content) // block):
                    values = np.frombuffer(content, ">f4", points, record * block).astype(float)
                    values[values > MISSING / 2] = np.nan
                    yield pd.DataFrame({"file": name, "record": record, "loc": np.arange(points), "value": values})

    out = files.mapInPandas(run, "file string, record int, loc bigint, value double")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def read_fixed_records(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Rows of files of fixed-size binary records; ``fields`` are names and numpy types, in order.

    No file gives no rows.
    """
    kind = np.dtype(fields)
    names = {"i": "bigint", "u": "bigint", "f": "double", "S": "string"}
    schema = ", ".join(f"`{n}` {names[kind[n].kind]}" for n in kind.names)
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = np.frombuffer(content, kind, len(content) // kind.itemsize)
                columns = {n: np.char.strip(np.char.decode(rows[n], "ascii"), " \x00") if kind[n].kind == "S" else rows[n].astype("int64" if kind[n].kind in "iu" else "float64") for n in kind.names}
                yield pd.DataFrame(columns)

    return files.mapInPandas(run, schema)
