"""Scales of observations and nodes, and a stream whose carried state is the batch's."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from skerry.operators import transforms
from skerry.operators.grid import Grid
from skerry.streaming.carried import carried, carried_stream, late_rows


def test_scales_of_observations(spark):
    rng = np.random.default_rng(3)
    n = 16
    xy = rng.uniform(0, n - 1, size=(60, 2))
    values = np.sin(xy[:, 0]) + rng.normal(size=60)
    obs = spark.createDataFrame([(k, float(x), float(y), float(v), 0.5) for k, ((x, y), v) in enumerate(zip(xy, values))], "obs_id bigint, x double, y double, obs double, err_std double")
    bands = transforms.TRANSFORMS["scale_bandpass"](Grid(n, n), [2.0, 5.0], [1.0, 2.0, 4.0], reach=2.0)
    parts = [{r.obs_id: (r.obs, r.err_std) for r in bands.forward_obs(obs, s).collect()} for s in range(3)]
    laid = np.zeros((n, n))
    for j in range(n):
        for i in range(n):
            gap = np.hypot(xy[:, 0] - i, xy[:, 1] - j)
            if gap.min() <= 2.0:
                laid[j, i] = values[gap.argmin()]
    whole = [laid[int(np.floor(y + 0.5)), int(np.floor(x + 0.5))] for x, y in xy]
    assert all(sum(p[k][0] for p in parts) == pytest.approx(whole[k], abs=1e-9) for k in range(60))  # scales sum to the field that was laid
    assert [p[0][1] for p in parts] == [0.5, 1.0, 2.0]
    assert bands.backward_obs(obs, 0) is obs and transforms.TRANSFORMS["identity"]().forward_obs(obs, 0) is obs
    with pytest.raises(NotImplementedError):
        transforms.TRANSFORMS["wavelets"]


def test_node_scales_sum_to_the_field(spark):
    rng = np.random.default_rng(1)
    rows = [(m, k, float(x), float(y), None if k == 7 else float(v)) for m in range(2) for k, (x, y, v) in enumerate(rng.uniform(0, 10, size=(50, 3)))]
    field = spark.createDataFrame(rows, "mem int, node bigint, x double, y double, value double")
    parts = [{(r.mem, r.node): r.value for r in transforms.node_component(field, [3.0, 1.0], ["mem"], c).collect()} for c in range(3)]
    for m, k, *_, v in rows:
        got = [p[m, k] for p in parts]
        assert got == [None] * 3 if v is None else sum(got) == pytest.approx(v)


def test_replayed_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rng = np.random.default_rng(5)
    rows = sorted((start + timedelta(hours=float(h)), rng.choice(["a", "b"]).item(), float(v)) for h, v in zip(rng.uniform(0, 60, 200), rng.normal(size=200)))
    schema = "t timestamp, kind string, obs double"
    cuts = [0, 50, 120, 200]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])] + [[(start + timedelta(hours=200), "a", 0.5), (start + timedelta(hours=200), "b", 0.5)], [(start + timedelta(hours=3), "a", 9.0)] * 2]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    query = carried_stream(stream, 6, 1).writeStream.format("memory").queryName("carried").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).outputMode("append").start()
    assert query.awaitTermination(120)
    got = spark.table("carried").collect()
    want = carried(spark.createDataFrame(rows, schema), 6).collect()
    key = lambda r: (r.key, r.cycle)
    closed = {key(r): r for r in got}
    assert closed.keys() == {key(r) for r in want}
    for r in want:
        assert closed[key(r)].n == r.n and closed[key(r)].mean == pytest.approx(r.mean) and closed[key(r)].variance == pytest.approx(r.variance)
    assert late_rows(query) == 2
