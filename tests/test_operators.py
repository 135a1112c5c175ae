"""Stated facts and identities of the grid, observation, filter and perturbation operators."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import distance, physics, units
from skerry.operators import grid, inflation, kernels, local, observations, spectral, stats, vertical
from skerry.plans.cycle import twin_experiment
from skerry.sources import tables


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_units(spark):
    c = units.convert
    got = _one(spark, a=c(F.lit(1.0), 100, 1), b=c(F.lit(1.0), "km", "m"), c=c(F.lit(1.0), "h", "s"), d=c(F.lit(1.0), "m/s", "km/h"), e=c(F.lit(1.0), "kg", "g"), f=c(F.lit(0.0), "C", "K"), g=c(F.lit(300.0), "K", "F"))
    assert tuple(got) == pytest.approx((0.01, 1000, 3600, 3.6, 1000, 273.15, 80.33))
    with pytest.raises(ValueError):
        units.convert(F.lit(1.0), "km", "s")


def test_times(spark):
    t = F.lit(datetime(1970, 1, 1)).cast("timestamp")
    got = _one(spark, h=units.hours_since_1900(t), back=units.from_hours_since_1900(units.hours_since_1900(t)), same=t, m=units.member_name(F.lit(0)))
    assert got.h == 613608 and got.back == got.same and got.m == "_mem001"


def test_tapers(spark):
    g = lambda d: distance.gaspari_cohn(F.lit(d), F.lit(4.0))
    got = _one(spark, a=g(0.0), b=g(2.0), c=g(4.0), d=distance.gaspari_cohn(F.lit(9.0), F.lit(float("inf"))))
    assert tuple(got) == pytest.approx((1, 5 / 24, 0, 1))
    with pytest.raises(NotImplementedError):
        distance.taper("unknown")


def _cell(spark, x, y, cyclic):
    g = grid.Grid(100, 100, cyclic_x=cyclic, cyclic_y=cyclic)
    return grid.find_cell(spark.createDataFrame([(x, y)], "x double, y double"), g).first()


def test_find_cell(spark):
    on, inside, out, ring = _cell(spark, 10.0, 10.0, False), _cell(spark, 10.8, 10.2, False), _cell(spark, -1.0, -1.0, False), _cell(spark, -1.0, -1.0, True)
    assert (on.p1, on.p2, on.p3, on.p4, on.nearest) == (1010, 1011, 1111, 1110, 1010) and (on.u, on.v) == (0, 0)
    assert inside.nearest == 1011 and (inside.u, inside.v) == pytest.approx((0.8, 0.2))
    assert not out.inside and out.p1 is None
    assert ring.inside and (ring.p1, ring.p2, ring.p3, ring.p4, ring.nearest) == (9999, 9900, 0, 99, 9999)


def test_grid_sizes():
    g = grid.Grid.between(0, 100, 0, 100, 1)
    assert (g.nx, g.ny, g.dx) == (100, 100, 1) and grid.Grid.between(0, 100, 0, 100, 1, centred=True).x0 == 0.5
    assert (g.coarser(1).nx, g.coarser(1).dx) == (50, 2.0)


def test_triangle(spark):
    nodes = spark.range(100).select(F.col("id").alias("node"), (F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    mesh = spark.createDataFrame([(0, 31, 21, 32), (1, 21, 22, 32)], "tri bigint, n1 bigint, n2 bigint, n3 bigint")
    props = grid.triangles(mesh, nodes)
    got = grid.find_triangle(spark.createDataFrame([(7, 1.2, 2.7)], "obs_id bigint, x double, y double"), props, "obs_id", 2.0).first()
    assert got.tri == 0 and (got.w1, got.w2, got.w3) == pytest.approx((0.5, 0.3, 0.2)) and got.nearest == 31
    assert {round(r.area, 9) for r in props.collect()} == {0.5}


def test_bilinear_needs_all_corners(spark):
    g = grid.Grid(3, 3)
    field = g.points(spark).select("loc", F.when(F.col("loc") == 8, None).otherwise(F.col("x") + 10 * F.col("y")).alias("value"))
    at = spark.createDataFrame([(1, 0.25, 0.5), (2, 1.5, 1.5), (3, 9.0, 0.0)], "obs_id bigint, x double, y double")
    got = {r.obs_id: r.value for r in grid.interpolate(grid.weights(grid.find_cell(at, g), "obs_id"), field, "obs_id", []).collect()}
    assert got == {1: pytest.approx(5.25), 2: None}


def test_rotation(spark):
    u, v = grid.rotate(F.lit(1.0), F.lit(0.0), F.lit(math.pi / 2))
    assert tuple(_one(spark, u=u, v=v)) == pytest.approx((0, -1))


@pytest.mark.parametrize(
    "layers,zs,want",
    [
        ([(1, 10.0, 1.0)], (0.1, 0.5), {0.1: 10, 0.5: 10}),
        ([(1, 10.0, 1.0), (2, 20.0, 2.0), (3, 30.0, 3.0)], (0.1, 0.5, 1.0, 2.2, 3.0), {0.1: 10, 0.5: 10, 1.0: 15, 2.2: 27, 3.0: 30}),
        ([(1, 10.0, 1.0), (2, 20.0, 1.0)], (0.7, 1.0), {0.7: 14, 1.0: 20}),
    ],
)
def test_vertical(spark, layers, zs, want):
    rows = spark.createDataFrame([(1, *x) for x in layers], "pid int, lev int, f double, z double")
    obs = spark.createDataFrame([(1, n, z) for n, z in enumerate(zs)], "pid int, obs_id int, oz double")
    got = {zs[r.obs_id]: r.value for r in vertical.interpolate(obs, rows, "pid").collect()}
    assert got == {z: pytest.approx(v) for z, v in want.items()}


def _adjusted(dp, depth):
    dp, n = list(dp), len(dp)
    if depth > 100000 or depth < 1:
        return dp
    for order, count, way in ((range(n), n - 1, 1), (range(n - 1, -1, -1), n - 3, -1)):
        for k in list(order)[: max(count, 0)]:
            dp[k + way] += min(0.0, dp[k])
            dp[k] = max(dp[k], 0.0)
    at, out = 0.0, []
    for k in range(n):
        after = depth if k == n - 1 else min(depth, at + dp[k])
        out.append(after - at)
        at = after
    return out


def test_layer_adjustment(spark):
    draw = np.random.default_rng(1)
    columns = [(n, draw.normal(3, 4, size=draw.integers(1, 9)).tolist(), float(draw.choice([0.5, 12, 30]))) for n in range(60)]
    got = {r.n: r.dps for r in vertical.adjust_layers(spark.createDataFrame(columns, "n int, dps array<double>, depth double")).collect()}
    for n, dps, depth in columns:
        assert got[n] == pytest.approx(_adjusted(dps, depth), abs=1e-9)


def test_profile_quality(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 5.0), (2, 2, 99.0)], "pid int, lev int, value double")
    assert {r.pid for r in observations.profiles(rows, "pid", F.lit(True), F.col("value") < 50).collect()} == {1}


def test_filters_agree_with_the_scalar_solution():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(20, 1))
    b, r, obs = x.var(ddof=1), 0.09, 0.7
    post = x.T @ kernels.etkf_weights(x, np.array([obs]), np.array([0.3]), np.ones(1))
    assert post.mean() == pytest.approx((x.mean() * r + obs * b) / (b + r)) and post.var(ddof=1) == pytest.approx(b * r / (b + r))
    w = kernels.denkf_weights(x, np.array([obs]), np.array([0.3]), np.ones(1), kfactor=1e9)
    assert (x.T @ w).mean() == pytest.approx(post.mean()) and w.sum(axis=0) == pytest.approx(np.ones(20))


def test_many_observations_in_either_space():
    draw = np.random.default_rng(2)
    for count in (5, 60):
        x, err = draw.normal(size=(10, count)), np.full(count, 0.5)
        obs, rho = draw.normal(size=count), draw.uniform(0.1, 1, count)
        s, d = (x - x.mean(axis=0)) * rho / err / 3, (obs - x.mean(axis=0)) * rho / err / 3
        inverse = np.linalg.inv(np.eye(10) + s @ s.T)
        w = kernels.etkf_weights(x, obs, err, rho)
        assert (w.mean(axis=1) - 0.1) == pytest.approx(inverse @ s @ d + (np.linalg.matrix_power(np.eye(10), 1).mean(axis=1) - 0.1), abs=1e-9)


def test_points_without_observations_stay(spark):
    state = spark.createDataFrame([(l, m, float(l + m)) for l in range(3) for m in range(4)], "loc bigint, mem int, value double")
    obs = spark.createDataFrame([(0, 1.0, 0.5, [0.0, 1.0, 2.0, 3.0])], "obs_id bigint, obs double, err_std double, priors array<double>")
    pairs = spark.createDataFrame([(1, 0, 1.0)], "loc bigint, obs_id bigint, rho double")
    got = {(r.loc, r.mem): r.value for r in kernels.local_analysis(state, obs, pairs).collect()}
    assert len(got) == 12 and all(got[(l, m)] == l + m for l in (0, 2) for m in range(4)) and got[(1, 0)] != 1


def test_serial_rounds_equal_one_by_one(spark):
    from skerry.operators import serial

    draw = np.random.default_rng(8)
    g = grid.Grid(12, 10)
    x = draw.normal(size=(6, 120))
    obs = [(n, float(draw.uniform(0, 10.9)), float(draw.uniform(0, 8.9)), float(draw.normal()), 0.4) for n in range(14)]
    state = spark.createDataFrame([(p, m, float(x[m, p])) for p in range(120) for m in range(6)], "loc bigint, mem int, value double")
    df = spark.createDataFrame(obs, "obs_id bigint, x double, y double, obs double, err_std double")
    prior = grid.interpolate(grid.weights(grid.find_cell(df, g), "obs_id"), state, "obs_id", ["mem"])
    got = {(r["loc"], r.mem): r.value for r in serial.assimilate(state, g.points(spark), prior, df, 2.5).collect()}

    def taper(d):
        r = max(2 * d / 2.5, 1e-10)
        if r < 1:
            return 1 - 5 / 3 * r**2 + 5 / 8 * r**3 + r**4 / 2 - r**5 / 4
        return 4 - 5 * r + 5 / 3 * r**2 + 5 / 8 * r**3 - r**4 / 2 + r**5 / 12 - 2 / (3 * r) if r < 2 else 0.0

    y = np.zeros((6, 14))
    for n, a, b, _, _ in obs:
        i, j, u, v = int(a), int(b), a - int(a), b - int(b)
        y[:, n] = (1 - u) * (1 - v) * x[:, j * 12 + i] + u * (1 - v) * x[:, j * 12 + i + 1] + u * v * x[:, (j + 1) * 12 + i + 1] + (1 - u) * v * x[:, (j + 1) * 12 + i]
    for n, a, b, value, err in obs:
        mean, var = y[:, n].mean(), y[:, n].var(ddof=1)
        ratio = err**2 / (err**2 + var)
        step = ratio * mean + (1 - ratio) * value + np.sqrt(ratio) * (y[:, n] - mean) - y[:, n]
        hx = y[:, n].copy()
        for target, places in ((x, [(p, p % 12, p // 12) for p in range(120)]), (y, [(k, o[1], o[2]) for k, o in enumerate(obs)])):
            for p, px, py in places:
                target[:, p] += taper(np.hypot(px - a, py - b)) * np.cov(target[:, p], hx)[0, 1] / var * step
    assert all(got[(p, m)] == pytest.approx(x[m, p], abs=1e-9) for p in range(120) for m in range(6))


def test_settings_and_registries(tmp_path):
    from skerry.sources import config

    (tmp_path / "a.yml").write_text("nens: 20\nroi: '1e3'\nrun: 'yes'\nname: x\n")
    (tmp_path / "b.yml").write_text("nens: 30\n")
    got = config.load(str(tmp_path / "a.yml"), str(tmp_path / "b.yml"), name="zed", args=["--vroi", "inf", "--debug"])
    assert got == {"nens": 30, "roi": 1000.0, "run": True, "name": "zed", "vroi": float("inf"), "debug": True}
    known = config.Registry("reader")
    known.register("Ice")(len)
    assert known["ICE"] is len and list(known) == ["ice"]
    with pytest.raises(NotImplementedError):
        known["other"]


def test_inflation(spark):
    row = spark.createDataFrame([(2, 9.0, 1.0, 2.0, 1.0, 2.0)], "total_nobs int, omb2 double, varo double, varb double, amb2 double, vara double")
    assert inflation.adaptive_prior(row).first().coef == 1 and inflation.adaptive_relaxation(row).first().alpha == 0
    assert inflation.adaptive_prior(row.withColumn("total_nobs", F.lit(5))).first().coef == 2
    assert inflation.inflate("post, multiplicative") == ("post", "multiplicative")
    with pytest.raises(NotImplementedError):
        inflation.inflate("post,other")


def test_halo_equals_distance(spark):
    draw = np.random.default_rng(3)
    obs = [(n, float(draw.uniform(-6, 30)), float(draw.uniform(-6, 26))) for n in range(300)]
    got = {tuple(r) for r in local.halo(spark.createDataFrame(obs, "obs_id bigint, x double, y double"), 25, 20, 6, 2.5).collect()}
    want = set()
    for n, x, y in obs:
        for j in range(20):
            for i in range(25):
                x0, x1, y0, y1 = i // 6 * 6, min(i // 6 * 6 + 5, 24), j // 6 * 6, min(j // 6 * 6 + 5, 19)
                if x0 - 2.5 <= x <= x1 + 2.5 and y0 - 2.5 <= y <= y1 + 2.5:
                    want.add((j // 6 * 5 + i // 6, n))
    assert got == want


def test_spectrum_and_bands(spark):
    i, j = np.meshgrid(np.arange(16), np.arange(16))
    field = [(0, int(a), int(b), float(np.cos(2 * np.pi * 3 * a / 16) + (a * b) % 5)) for a, b in zip(i.ravel(), j.ravel())]
    df = spark.createDataFrame(field, "mem int, i int, j int, value double")
    parts = [{(r.i, r.j): r.value for r in spectral.scale_component(df, ["mem"], 16, 16, [2.0, 5.0], c).collect()} for c in range(3)]
    assert all(sum(p[(a, b)] for p in parts) == pytest.approx(v) for _, a, b, v in field)
    assert spectral.power_spectrum(df, ["mem"], 16, 16).where("k = 3").first().power > 0.01


def test_random_fields(spark):
    keys = spark.range(12).select(F.col("id").cast("int").alias("mem"))
    draw = lambda: spectral.random_fields(keys, ["mem"], 32, 32, std=2.0, hcorr=6.0).orderBy("mem", "j", "i").toPandas()
    a = draw()
    assert a.equals(draw()) and a["value"].std() == pytest.approx(2.0, rel=0.35)


def test_perturbation_bounds(spark):
    f, p = spark.createDataFrame([(1, 0.9)], "i int, value double"), spark.createDataFrame([(1, 0.5)], "i int, value double")
    assert spectral.apply_perturbation(f, p, ["i"], high=1.0).first().value == 1.0
    assert spectral.apply_perturbation(f, p, ["i"], kind="multiply", amp=1.0).first().value == pytest.approx(0.9)


def test_category_bounds():
    assert physics.category_bounds(5, 2)[-1] == 999.0 and physics.category_bounds(1, -1) == [0.0, 100.0] and len(physics.category_bounds(5)) == 6
    with pytest.raises(ValueError):
        physics.category_bounds(5, 7)


def test_restart_records(spark, tmp_path):
    values = np.arange(10, dtype=">f4")
    values[3] = 2.0**100
    block = np.zeros(4096, dtype=">f4")
    block[:10] = values
    (tmp_path / "a.a").write_bytes(block.tobytes() * 2)
    got = tables.read_restart_records(spark, str(tmp_path / "*.a"), 10).collect()
    assert len(got) == 20 and all((r.value is None) == (r["loc"] == 3) for r in got)


def test_fixed_records(spark, tmp_path):
    kind = [("id", "S4"), ("d", "<f8"), ("n", "<i4")]
    (tmp_path / "o.uf").write_bytes(np.array([(b"temp", 1.5, 7), (b"sal", 2.5, 8)], dtype=kind).tobytes())
    assert [tuple(r) for r in tables.read_fixed_records(spark, str(tmp_path), kind).orderBy("n").collect()] == [("temp", 1.5, 7), ("sal", 2.5, 8)]


def test_crps_of_a_point(spark):
    ens = spark.createDataFrame([(1, m, 2.0) for m in range(3)], "loc int, mem int, value double")
    assert stats.crps(ens, spark.createDataFrame([(1, 5.0)], "loc int, truth double"), ["loc"]).first().crps == 3.0


def test_twin_experiment_reduces_error(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(2, 3, 40)
    rows = [(m, i, float(base[i] + (0 if m == 0 else 1 + draw.normal()))) for m in range(21) for i in range(40)]
    got = twin_experiment(spark, spark.createDataFrame(rows, "mem int, i int, value double"), cycles=2).collect()
    assert len(got) == 2 and all(r.post_rmse < r.prior_rmse for r in got)


def test_stream_counts_by_cycle(spark, tmp_path):
    from skerry.streaming.cycles import by_cycle, stream_by_cycle

    rows = [(datetime(2024, 1, 1, h), "a", float(h)) for h in range(24)]
    df = spark.createDataFrame(rows, "t timestamp, kind string, obs double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_by_cycle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 6, 1)
    q = stream.writeStream.format("memory").queryName("cycles").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("cycles").collect())) == sorted(map(tuple, by_cycle(df, 6).collect()))


def test_vortex_turns_but_keeps_its_strength(spark):
    from skerry.operators import models

    n = 16
    flow = models.SpectralFlow(n, 1.0, 0.0, 0.0)
    i, j = np.meshgrid(np.arange(n), np.arange(n))
    u, v = np.cos(2 * np.pi * j / n), np.sin(2 * np.pi * i / n)  # one wavelength: steady
    got = flow.run(u, v, 20.0, 0.1)
    assert np.allclose(got[0], u, atol=1e-6) and np.allclose(got[1], v, atol=1e-6)
    fading = models.SpectralFlow(n, 1.0, 0.0, 0.5).run(u, v, 2.0, 0.1)
    assert np.allclose(fading[0], u * np.exp(-0.5 * 2.0 * (2 * np.pi / n) ** 2), atol=1e-4)


def test_mapping_moves_the_poles(spark):
    from skerry.operators import models

    at = spark.createDataFrame([(0.0, 60.0), (90.0, 10.0)], "lon double, lat double")
    lon, lat = models.two_pole_mapping(F.col("lon"), F.col("lat"), (0.0, 60.0), (180.0, -60.0))
    got = at.select(lat.alias("lat")).collect()
    assert got[0].lat == pytest.approx(90.0, abs=1e-6)
    lon, lat = models.two_pole_mapping(F.col("lon"), F.col("lat"), (0.0, 89.9999), (180.0, -89.9999))
    assert at.select(lat.alias("lat")).collect()[1].lat == pytest.approx(10.0, abs=1e-3)


def test_tiles_give_the_analysis_by_point(spark):
    """Tile by tile or point by point the filter is the same; so is a prior inflated by a coefficient or by hand."""
    from skerry.operators import grid as grids
    from skerry.operators import inflation
    from skerry.plans.analysis import Settings, analyse

    draw = np.random.default_rng(5)
    square = grids.Grid(9, 7)
    state = spark.createDataFrame([(loc, mem, float(v)) for loc, row in enumerate(draw.normal(size=(63, 6))) for mem, v in enumerate(row)], "loc bigint, mem int, value double")
    obs = spark.createDataFrame([(k, float(x), float(y), float(o), 0.3) for k, (x, y, o) in enumerate(zip(draw.uniform(0, 8, 12), draw.uniform(0, 6, 12), draw.normal(size=12)))], "obs_id bigint, x double, y double, obs double, err_std double")
    rows = lambda out: {(r.loc, r.mem): r.value for r in out.post.collect()}
    whole = rows(analyse(state, obs, square, Settings(roi=2.5)))
    for side in (2, 4):
        tiled = rows(analyse(state, obs, square, Settings(roi=2.5, tile=side)))
        assert tiled.keys() == whole.keys() and all(abs(tiled[k] - whole[k]) < 1e-9 for k in whole)
    given = rows(analyse(state, obs, square, Settings(roi=2.5, prior="prior,multiplicative", prior_coef=1.3)))
    by_hand = rows(analyse(inflation.multiplicative(state, 1.3, ["loc"]), obs, square, Settings(roi=2.5)))
    assert all(abs(given[k] - by_hand[k]) < 1e-9 for k in given)
    adaptive = analyse(state, obs, square, Settings(roi=2.5, prior="prior,multiplicative", post="post,multiplicative"))
    assert len(rows(adaptive)) == 63 * 6
    with pytest.raises(ValueError):
        analyse(state, obs, square, Settings(prior="post,rtpp"))


def test_network_places_every_observation(spark):
    from skerry.operators import grid as grids
    from skerry.operators import network

    square = grids.Grid(30, 30)
    open_ = {31, 62, 450}
    masked = square.points(spark).where(~F.col("loc").isin(*open_)).select("loc")
    placed = grids.find_cell(network.network(spark, 200, square, masked), square).collect()
    assert len(placed) == 200 and {r.nearest for r in placed} <= open_
    with pytest.raises(ValueError):
        network.network(spark, 5, square, square.points(spark).select("loc"))


def test_displacements_have_their_size_and_no_divergence(spark):
    from skerry.operators import spectral

    keys = spark.createDataFrame([(0,), (3,)], "mem int")
    flow = spectral.displacement_fields(keys, ["mem"], 16, 20, 0.7, 4.0).toPandas()
    for _, part in flow.groupby("mem"):
        u, v = (part.pivot(index="j", columns="i", values=c).to_numpy() for c in "uv")
        assert abs(np.sqrt((u**2 + v**2).mean()) - 0.7) < 1e-9
        assert abs((np.roll(u, -1, 1) - np.roll(u, 1, 1)) / 2 + (np.roll(v, -1, 0) - np.roll(v, 1, 0)) / 2).max() < 1e-9
    shore = spark.createDataFrame([(i, j, float(i)) for i in range(20) for j in range(16)], "i int, j int, gap double")
    still = spectral.displacement_fields(keys, ["mem"], 16, 20, 0.7, 4.0, shore, 5.0).where("i = 0").toPandas()
    assert (still[["u", "v"]].abs() == 0).all().all()


def test_observation_operators_by_name(spark):
    from skerry.operators import observe

    assert {"identity", "speed", "total", "displacement"} <= set(observe.OPERATORS)
    with pytest.raises(NotImplementedError):
        observe.OPERATORS["radiance"]
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 1.0), (2, 1, None)], "obs_id bigint, mem int, value double")
    assert {r.obs_id for r in observe.complete(rows, 2).collect()} == {1}
    with pytest.raises(ValueError):
        observe.complete(rows, 3)


def test_analysis_by_scales(spark):
    from skerry.operators import grid as grids
    from skerry.plans.analysis import Settings, analyse, analyse_scales

    draw = np.random.default_rng(8)
    square = grids.Grid(8, 8)
    state = spark.createDataFrame([(loc, mem, float(v)) for loc, row in enumerate(draw.normal(size=(64, 5))) for mem, v in enumerate(row)], "loc bigint, mem int, value double")
    obs = spark.createDataFrame([(k, float(x), float(y), float(o), 0.3) for k, (x, y, o) in enumerate(zip(draw.uniform(0, 7, 8), draw.uniform(0, 7, 8), draw.normal(size=8)))], "obs_id bigint, x double, y double, obs double, err_std double")
    rows = lambda df: {(r.loc, r.mem): r.value for r in df.collect()}
    one, usual = rows(analyse_scales(state, obs, square, [2.5], [])), rows(analyse(state, obs, square, Settings(roi=2.5)).post)
    assert all(abs(one[k] - usual[k]) < 1e-9 for k in usual)
    two, before = rows(analyse_scales(state, obs, square, [4.0, 1.5], [2.0])), rows(state)
    assert two.keys() == before.keys() and any(abs(two[k] - before[k]) > 1e-3 for k in two)
    with pytest.raises(ValueError):
        analyse_scales(state, obs, square, [1.0], [2.0])


def test_perturbations_over_cycles(spark):
    from skerry.operators import grid as grids
    from skerry.plans.perturb import Perturbation, options, perturb

    assert options(Perturbation("a", 2.0, 3.0, 4.0)) == (["a"], [[2.0]], [3.0], [4.0])
    assert options(Perturbation(["a", "b"], [[1, 2], 3], [4, 5], 6))[1] == [[1.0, 2.0], [3.0, 3.0]]
    with pytest.raises(ValueError):
        options(Perturbation(["a", "b"], [1, 2, 3], 4, 5))
    with pytest.raises(ValueError):
        options(Perturbation("a", 1, [1, 2, 3], [1, 2]))
    square, store = grids.Grid(12, 10), tables.StateStore.temporary(spark)
    zero = spark.range(2 * 120).selectExpr("if(id < 120, 'p', 'other') name", "cast(id % 120 % 12 as int) i", "cast(floor(id % 120 / 12) as int) j").crossJoin(spark.range(3).selectExpr("cast(id as int) mem", "0.0D value"))
    defs = [Perturbation("p", [[0.5, 0.2]], [4.0, 2.0], [12.0, 6.0], bounds={"p": (-0.6, None)}, wind_from="p")]
    runs = [perturb(zero, defs, square, store, c, 6.0).toPandas() for c in (0, 1)]
    for out in runs:
        assert len(out) == 720 and (out[out.name == "other"].value == 0).all() and out.value.min() >= -0.6 and out[out.name == "p"].value.std() > 0.2
    first, second = (r[r.name == "p"].sort_values(["mem", "i", "j"]).value.to_numpy() for r in runs)
    assert np.corrcoef(first, second)[0, 1] > 0.3  # what is remembered
    again = perturb(zero, defs, square, store, 1, 6.0).toPandas()
    assert np.allclose(again[again.name == "p"].sort_values(["mem", "i", "j"]).value, second)


def test_serial_chain_takes_few_passes(spark, monkeypatch):
    """Observations that all depend on the one before are not a table each, and small groups give the same."""
    from skerry.operators import serial
    from skerry.sources.tables import StateStore

    draw, written, write = np.random.default_rng(9), [], StateStore.write
    monkeypatch.setattr(StateStore, "write", lambda self, *a: written.append(a[1:]) or write(self, *a))
    g = grid.Grid(12, 3)
    state = spark.createDataFrame([(p, m, float(draw.normal())) for p in range(36) for m in range(4)], "loc bigint, mem int, value double")
    obs = spark.createDataFrame([(n, n % 11 + 0.25, 1.5, float(draw.normal()), 0.4) for n in range(24)], "obs_id bigint, x double, y double, obs double, err_std double")
    prior = grid.interpolate(grid.weights(grid.find_cell(obs, g), "obs_id"), state, "obs_id", ["mem"])
    run = lambda **more: {(r["loc"], r.mem): r.value for r in serial.assimilate(state, g.points(spark), prior, obs, 2.5, **more).collect()}
    whole = run()
    assert len(whole) == 144 and len(written) < 12
    assert run(group=9) == pytest.approx(whole, abs=1e-12)
