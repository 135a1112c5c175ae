"""Dataset readers: what the queries do not reach."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import grid
from skerry.sources import datasets, tables


def _request(**more):
    return datasets.Request(grid.Grid(5, 5), datetime(2024, 1, 10), **more)


def test_unknown_dataset_is_an_error(spark):
    with pytest.raises(NotImplementedError):
        datasets.read("sonar", spark.range(1), _request())
    assert {"ice_concentration", "ice_drift", "ice_thickness", "profiles", "drift_trajectories", "brightness", "prepared"} <= set(datasets.READERS)


def test_prepared_records_with_vectors(spark, tmp_path):
    rows = np.zeros(4, np.dtype(datasets.PREPARED))
    rows["id"], rows["depth"], rows["var"], rows["value"], rows["lon"], rows["lat"] = b"VSST    ", [5, 6, 5, 6], 0.25, [1, 2, 3, 4], [1, 2, 1, 2], 2
    rows.tofile(f"{tmp_path}/a.uf")
    raw = tables.read_fixed_records(spark, str(tmp_path), datasets.PREPARED).coalesce(1)
    raw = raw.withColumn("obs_id", F.monotonically_increasing_id()).withColumns({"x": F.col("lon"), "y": F.col("lat"), "t": F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz")})
    single = datasets.read("prepared", raw, _request()).collect()
    assert [(r.obs_id, r.z, r.obs, r.err_std) for r in sorted(single)] == [(0, -5, 1, 0.5), (1, -6, 2, 0.5), (2, -5, 3, 0.5), (3, -6, 4, 0.5)]
    both = datasets.read("prepared", raw, _request(options={"vector": True})).collect()
    assert sorted((r.obs_id, r.u, r.v) for r in both) == [(0, 1, 3), (1, 2, 4)]


def test_forecast_lookup(spark):
    records = spark.createDataFrame([("rain", 0, 6, 1, 2.5)], "name string, start int, lead int, member int, rate double")
    ask = lambda lead: spark.createDataFrame([("rain", 0, lead, 1)], "name string, start int, lead int, member int")
    assert datasets.lookup(ask(6), records, F.col("rate")).first().value == 2.5
    with pytest.raises(Exception, match="no record rain, 0, 12, 1"):
        datasets.lookup(ask(12), records, F.col("rate")).collect()


def test_empty_raw_table_gives_an_empty_sequence(spark):
    raw = spark.createDataFrame([], "obs_id bigint, x double, y double, t timestamp_ntz, status_flag int, err double, value double")
    mask = spark.createDataFrame([(3,)], "loc bigint")
    out = datasets.read("ice_concentration", raw, _request(mask=mask))
    assert out.columns == ["obs_id", "x", "y", "z", "t", "obs", "err_std"] and out.count() == 0


def test_mask_counts_by_the_corners_that_have_weight(spark):
    rows = [(0, 1.0, 1.0), (1, 1.5, 1.0), (2, 2.5, 1.5), (3, 3.0, 1.0)]
    obs = spark.createDataFrame(rows, "obs_id bigint, x double, y double")
    kept = datasets.unmasked(obs, _request(mask=spark.createDataFrame([(2 + 5 * 1,)], "loc bigint")))
    assert {r.obs_id for r in kept.collect()} == {0, 3}


def test_equal_grids_pass_through_and_coarse_means_win(spark):
    fine, wide = grid.Grid(6, 6), grid.Grid(3, 3, 0.5, 0.5, 2.0, 2.0)
    field = spark.createDataFrame([(j * 6 + i, float(i * i + 10 * j)) for j in range(6) for i in range(6)], "loc bigint, value double")
    assert {tuple(r) for r in grid.convert(field, fine, fine, [], ["value"]).collect()} == {tuple(r) for r in field.collect()}
    linear = {r.loc: r.value for r in grid.convert(field, fine, wide, [], ["value"]).collect()}
    assert linear[4] == pytest.approx((4 + 9) / 2 + 25)
    nearest = {r.loc: r.value for r in grid.convert(field, fine, wide, [], ["value"], method="nearest").collect()}
    assert nearest[4] == 39.0
    coarse = {r.loc: r.value for r in grid.convert(field, fine, wide, [], ["value"], coarse=True).collect()}
    assert coarse.keys() == linear.keys() and coarse[4] == pytest.approx(np.mean([i * i + 10 * j for i in (2, 3) for j in (2, 3)]))
