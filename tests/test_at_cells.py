"""Values at points, gathered once for each cell, and depths in arrays of layers."""

import pytest
from pyspark.sql import functions as F

from skerry.operators import grid, vertical


def test_equals_weights_met_one_by_one(spark):
    g = grid.Grid(5, 4)
    field = g.points(spark).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("mem")))
    field = field.select("loc", "mem", F.when((F.col("loc") != 7) | (F.col("mem") != 1), F.sin(F.col("loc") * 3 + F.col("mem"))).alias("value"))
    at = spark.range(60).select(F.col("id").alias("obs_id"), (F.col("id") * 7 % 43 / 10).alias("x"), (F.col("id") * 13 % 31 / 10).alias("y"))
    cells = grid.find_cell(at, g)
    want = {(r.obs_id, r.mem): r.value for r in grid.interpolate(grid.weights(cells, "obs_id"), field, "obs_id", ["mem"]).collect()}
    got = {(r.obs_id, r.mem): r.value for r in grid.at_points(cells, field, "obs_id", ["mem"], ["value"]).collect()}
    assert None in want.values() and got.keys() == want.keys()
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("layers", [[(1, 10.0, 1.0)], [(1, 10.0, 1.0), (2, 20.0, 2.0), (3, 30.0, 3.0)], [(1, 10.0, 1.0), (2, 20.0, 1.0)], [(1, 10.0, 1.0), (2, 20.0, 1.0), (3, 5.0, 4.0)]])
def test_column_of_an_array(spark, layers):
    rows = spark.createDataFrame([(1, *x) for x in layers], "pid int, lev int, f double, z double")
    obs = spark.range(50).select(F.lit(1).alias("pid"), F.col("id").alias("obs_id"), (F.col("id") / 10 - 0.2).alias("oz"))
    want = {r.obs_id: r.value for r in vertical.interpolate(obs, rows, "pid").collect()}
    column = rows.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("lev", "f", "z"))).alias("layers"))
    got = obs.join(column, "pid").select("obs_id", vertical.in_column("layers", F.col("oz"), "f", "z").alias("value")).where("value is not null")
    assert {r.obs_id: r.value for r in got.collect()} == pytest.approx(want)
