"""Indexed binary files: what is read, what is skipped, what is refused."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.sources import records


def _restart(spark, folder):
    rows = spark.range(5000).select(F.col("id").alias("loc"), F.explode(F.array(*[F.struct(F.lit(k).alias("record"), F.lit(f).alias("field"), F.lit(level).alias("level")) for k, (f, level) in enumerate([("temp", 1), ("temp", 2), ("salt", 1)])])).alias("r"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("file"))
    value = F.when(F.col("loc") % 7 == 3, None).otherwise(F.col("loc") * 0.5 + 1000 * F.col("r.record"))
    rows = rows.select("file", "r.record", "r.field", F.lit(12).alias("step"), F.lit(3.25).alias("day"), "r.level", F.lit(0.0).alias("dens"), "loc", value.alias("value"))
    assert {r.file for r in records.write_restart(rows, folder).collect()} == {"a", "b"}
    return rows


def test_restart_records_by_name_and_level(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    rows = _restart(spark, folder)
    assert os.path.getsize(f"{tmp_path}/r/a.a") == 3 * 2 * 4096 * 4
    back = records.read_records(spark, folder, points=5000)
    key = lambda df: {(r.file[:1], r.record, r.field, r.level, r.loc, r.value) for r in df.collect()}
    assert key(back) == key(rows.withColumn("value", F.col("value").cast("float").cast("double")))
    some = records.read_records(spark, folder, points=5000, fields=["temp"], levels=[2])
    assert some.rdd.getNumPartitions() == 2 and some.where("value is null").count() == 2 * len(range(3, 5000, 7)) and {r.record for r in some.select("record").distinct().collect()} == {1}
    assert records.read_records(spark, f"file://{tmp_path}/none", points=5).count() == 0


def test_records_must_agree_with_their_index(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    _restart(spark, folder)
    path = f"{tmp_path}/r/a.a"
    data = np.fromfile(path, ">f4")
    data[8192 + 4999] *= 2  # the greatest value of the second record
    data.tofile(path)
    assert records.read_records(spark, folder, points=5000, fields=["salt"]).count() == 10_000
    with pytest.raises(Exception, match="the index says"):
        records.read_records(spark, folder, points=5000, levels=[2]).count()


def test_mesh_index_offsets():
    found = records.mesh_index("Nodes_x double 3 0 2\nElements int 6 1 9\n\nDrag double 2 0.5 0.7\n", "f")
    assert [(r.field, r.offset, r.count) for r in found] == [("Nodes_x", 4, 3), ("Elements", 32, 6), ("Drag", 60, 2)]


def test_patches_outside_a_window_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    field = spark.range(10 * 7).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"), F.col("id").cast("double").alias("value"))
    assert records.write_patches(field, folder, "temp", 4, 3).count() == 9
    assert {(r.i, r.j, r.value) for r in records.read_patches(spark, folder).collect()} == {(r.i, r.j, r.value) for r in field.collect()}
    with open(f"{tmp_path}/p/temp_000000_000000.patch", "r+b") as damaged:
        damaged.truncate(120)  # all of its head, not all of its values
    part = records.read_patches(spark, folder, (4, 7, 3, 7)).collect()
    assert {(r.i, r.j) for r in part} == {(i, j) for i in range(4, 7) for j in range(3, 7)} and all(r.value == r.j * 10 + r.i for r in part)
