"""Named queries over the sample tables, each with DuckDB SQL for the same rows where SQL can give them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import calendar, distance, microwave, physics, units
from skerry.operators import alignment, asof, curvilinear, distance_field, fields, grid, inflation, kernels, local, localization, mesh, models, network, observations, observe, scatter, serial, spectral, stats, trajectories, transforms, vertical
from skerry.sources import carriers, datasets, records
from skerry.sources.tables import StateStore, read_output, write_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
GRID = carriers.field_grid
_NY = "(SELECT count(*) // 25 FROM embeddings)"

_ENS = """ens AS (SELECT vec_id AS loc, CAST(vec_id % 25 AS INT) AS i, CAST(vec_id // 25 AS INT) AS j, CAST(m - 1 AS INT) AS mem, CAST(embedding[m] AS DOUBLE) AS value
  FROM embeddings, range(1, 21) AS t(m))"""
_OBS = f"""obs AS (SELECT event_id AS obs_id, event_type AS kind, (event_id * 7 % 2400) / 100 AS x, (event_id * 13 % (100 * {_NY} - 100)) / 100 AS y, ts AS t, (value - 245) / 1960 AS obs,
  CASE event_type WHEN 'click' THEN 0.05 WHEN 'error' THEN 0.07 WHEN 'purchase' THEN 0.09 WHEN 'signup' THEN 0.11 ELSE 0.13 END::DOUBLE AS err_std FROM events)"""
_PROFILE = """profile AS (SELECT l_orderkey AS pid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount) AS INT) AS lev,
  l_quantity::DOUBLE AS dz, l_extendedprice::DOUBLE AS value, l_discount::DOUBLE AS f, l_returnflag, l_linestatus, l_shipdate AS t FROM lineitem)"""
_CELLS = """cells AS (SELECT p_partkey, p_retailprice / 10 + 180 AS t_air, p_size % 11 / 10.0::DOUBLE AS cloud, p_size * 40.0::DOUBLE AS e, (p_partkey % 181 - 90)::DOUBLE AS lat, p_size - 25.0::DOUBLE AS u,
  (p_partkey % 41 - 20)::DOUBLE AS v, p_size / 1.6::DOUBLE AS temp, p_partkey % 80 / 10.0::DOUBLE + 30 AS saln, p_size / 50.0::DOUBLE AS conc FROM part)"""
_CELL_OF = "corner AS (SELECT obs_id, x, y, obs, err_std, floor(x)::BIGINT AS i0, floor(y)::BIGINT AS j0, x - floor(x) AS u, y - floor(y) AS v FROM obs)"
_WEIGHTS = f"""{_CELL_OF}, w AS (SELECT obs_id, j0 * 25 + i0 AS loc, (1 - u) * (1 - v) AS w FROM corner UNION ALL SELECT obs_id, j0 * 25 + i0 + 1, u * (1 - v) FROM corner
  UNION ALL SELECT obs_id, (j0 + 1) * 25 + i0 + 1, u * v FROM corner UNION ALL SELECT obs_id, (j0 + 1) * 25 + i0, (1 - u) * v FROM corner)"""
_PRIOR = "prior AS (SELECT obs_id, mem, sum(w * value) AS value FROM w JOIN ens USING (loc) GROUP BY obs_id, mem HAVING count(*) = 4)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Rounded columns, with one zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def _some_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers.observations(spark, sf_dir)


def _ring_rows(spark: SparkSession, sf_dir: str) -> int | None:
    """The whole rows of a grid with an incomplete one."""
    g = GRID(spark, sf_dir)
    return g.ny if g.last else None


def _prior(spark: SparkSession, sf_dir: str, obs: DataFrame) -> DataFrame:
    """Every member's field at every observation: ``obs_id, mem, value``."""
    return grid.at_points(grid.find_cell(obs, GRID(spark, sf_dir)), carriers.ensemble(spark, sf_dir), "obs_id", ["mem"], ["value"])


# ensemble statistics


@query(f"WITH {_ENS} SELECT loc, round(avg(value), 6) AS mean, round(sqrt(var_samp(value)), 6) AS spread, count(*) AS members FROM ens GROUP BY loc")
def ens_mean_spread(spark, sf_dir):
    out = stats.moments(carriers.ensemble(spark, sf_dir), ["loc"]).select("loc", "mean", F.sqrt("variance").alias("spread"), "members")
    return _round(out, "mean", "spread")


_NEAR = """o AS (SELECT loc AS obs_id, i, j, mem, value AS prior FROM ens), near AS (SELECT e.loc, o.obs_id, value, prior FROM ens e JOIN o ON o.mem = e.mem AND abs(o.i - e.i) < 2 AND abs(o.j - e.j) < 2)"""


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every point as state and as observed one, and the pairs less than two apart in each axis."""
    ens = carriers.ensemble(spark, sf_dir)
    points = GRID(spark, sf_dir).points(spark)
    pairs = local.localize(points, points.select(F.col("loc").alias("obs_id"), "x", "y"), 1.5, "step").select("loc", "obs_id")
    return ens.select("loc", "mem", "value"), ens.select(F.col("loc").alias("obs_id"), "mem", F.col("value").alias("prior")), pairs


@query(f"WITH {_ENS}, {_NEAR} SELECT loc, obs_id, round(covar_samp(value, prior), 6) + 0.0 AS cov, round(corr(value, prior), 6) + 0.0 AS corr FROM near GROUP BY loc, obs_id")
def ens_cov_corr(spark, sf_dir):
    return _round(stats.covariances(*_near(spark, sf_dir)), "cov", "corr")


@query(f"WITH {_ENS}, {_NEAR} SELECT loc, obs_id, round(sum(value * prior) / 19, 6) + 0.0 AS cov, round(sum(value * prior) / sqrt(sum(value * value) * sum(prior * prior)), 6) + 0.0 AS corr FROM near GROUP BY loc, obs_id")
def ens_cov_raw(spark, sf_dir):
    return _round(stats.covariances(*_near(spark, sf_dir), centred=False), "cov", "corr")


@query(f"""WITH {_ENS}, t AS (SELECT loc, value AS truth FROM ens WHERE mem = 0), e AS (SELECT * FROM ens WHERE mem > 0),
a AS (SELECT loc, avg(abs(value - truth)) AS err FROM e JOIN t USING (loc) GROUP BY loc), b AS (SELECT p.loc, avg(abs(p.value - q.value)) AS pairs FROM e p JOIN e q USING (loc) GROUP BY p.loc)
SELECT loc, round(err - pairs / 2, 6) AS crps FROM a JOIN b USING (loc)""")
def ens_crps(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir)
    truth = ens.where("mem = 0").select("loc", F.col("value").alias("truth"))
    return _round(stats.crps(ens.where("mem > 0"), truth, ["loc"]), "crps")


# scalar functions


@query(f"""WITH {_CELLS} SELECT p_partkey, round(u * 3.6, 6) AS kmh, round(t_air - 273.15, 6) AS celsius, round((t_air - 273.15) * 9 / 5 + 32, 6) AS fahrenheit, round(e / 100, 6) AS hpa,
round(cloud * 1000, 6) AS metres, round(saln * 3600, 6) AS seconds, round(conc / 100, 6) AS plain FROM cells""")
def units_convert(spark, sf_dir):
    c = units.convert
    out = carriers.cells(spark, sf_dir).select(
        "p_partkey", c(F.col("u"), "m/s", "km/h").alias("kmh"), c(F.col("t_air"), "K", "C").alias("celsius"), c(F.col("t_air"), "K", "F").alias("fahrenheit"), c(F.col("e"), "Pa", "hPa").alias("hpa"),
        c(F.col("cloud"), "km", "m").alias("metres"), c(F.col("saln"), "h", "s").alias("seconds"), c(F.col("conc"), 100, 1).alias("plain"),
    )
    return _round(out, "kmh", "celsius", "fahrenheit", "hpa", "metres", "seconds", "plain")


@query("SELECT event_id, round(epoch_us(ts) / 3.6e9 + 613608, 6) AS hours, round(epoch_us(ts) / 3.6e9 + 613608 - 6, 6) AS before, round(epoch_us(ts) / 3.6e9 + 613608 + 6, 6) AS after, strftime(ts, '%H:%M:%S') AS clock FROM events")
def hours_since_1900(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    out = carriers.table(spark, sf_dir, "events").select(
        "event_id", units.hours_since_1900(t).alias("hours"), units.hours_since_1900(units.cycle_before(t, 6)).alias("before"), units.hours_since_1900(units.cycle_after(t, 6)).alias("after"),
        units.clock(F.pmod(F.unix_micros(t) / 1e6, F.lit(86400.0))).alias("clock"),
    )
    return _round(out, "hours", "before", "after")


@query("""WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat(event_id % 90 - 45, 'e', event_id % 7 - 3) WHEN 1 THEN concat('1.5E', event_id % 5) WHEN 2 THEN 'inf' WHEN 3 THEN '-inf' WHEN 4 THEN 'yes' WHEN 5 THEN '.FALSE.' WHEN 6 THEN event_type ELSE 'T' END AS text FROM events)
SELECT event_id, text, CASE WHEN regexp_full_match(text, '-?[0-9]+(\\.[0-9]*)?[eE]-?[0-9]+') THEN text::DOUBLE WHEN text = 'inf' THEN 'infinity'::DOUBLE WHEN text = '-inf' THEN '-infinity'::DOUBLE END AS number,
CASE WHEN lower(text) IN ('y','yes','on','t','true','.true.') THEN true WHEN lower(text) IN ('n','no','off','f','false','.false.') THEN false END AS truth FROM t""")
def config_notation(spark, sf_dir):
    """Texts in each notation by event; ids that are null or negative have the last one. Only lower-case infinities count."""
    k = F.col("event_id")
    forms = [F.concat(k % 90 - 45, F.lit("e"), k % 7 - 3), F.concat(F.lit("1.5E"), k % 5), F.lit("inf"), F.lit("-inf"), F.lit("yes"), F.lit(".FALSE."), F.col("event_type")]
    text = F.coalesce(*[F.when(k % 8 == n, F.struct(form.alias("text"))) for n, form in enumerate(forms)], F.struct(F.lit("T").alias("text")))["text"]
    t = F.col("text")
    number = F.when(~F.lower(t).isin("inf", "-inf") | t.isin("inf", "-inf"), units.notation_number(t))
    return carriers.table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", "text", number.alias("number"), units.notation_bool(t).alias("truth"))


_GC = """CASE WHEN r < 1 THEN 1 - 5.0/3*r*r + 5.0/8*r*r*r + r*r*r*r/2 - r*r*r*r*r/4 WHEN r < 2 THEN 4 - 5*r + 5.0/3*r*r + 5.0/8*r*r*r - r*r*r*r/2 + r*r*r*r*r/12 - 2/(3*r) ELSE 0 END"""


@query(f"WITH d AS (SELECT event_id, greatest(2 * (value / 10) / 30, 1e-10) AS r FROM events) SELECT event_id, round({_GC}, 6)::DOUBLE AS rho FROM d")
def taper_gaspari_cohn(spark, sf_dir):
    return _round(carriers.table(spark, sf_dir, "events").select("event_id", distance.gaspari_cohn(F.col("value") / 10, F.lit(30.0)).alias("rho")), "rho")


@query("SELECT event_id, CASE WHEN value / 10 <= 30 THEN 1 ELSE 0 END::DOUBLE AS rho FROM events")
def taper_step(spark, sf_dir):
    return carriers.table(spark, sf_dir, "events").select("event_id", distance.step(F.col("value") / 10, F.lit(30.0)).alias("rho"))


@query("SELECT event_id, round(exp(-value / 10 / 30), 6) AS rho FROM events")
def taper_exponential(spark, sf_dir):
    return _round(carriers.table(spark, sf_dir, "events").select("event_id", distance.exponential(F.col("value") / 10, F.lit(30.0)).alias("rho")), "rho")


@query(f"""WITH {_OBS}, d AS (SELECT obs_id, abs(x - 3) AS dx, abs(y - 17) AS dy FROM obs), g AS (SELECT obs_id, least(dx, 25 - dx) AS dx, least(dy, {_NY} - dy) AS dy FROM d)
SELECT obs_id, round(dx + dy, 6) AS l1, round(sqrt(dx * dx + dy * dy), 6) AS l2 FROM g""")
def cyclic_distance(spark, sf_dir):
    at = (F.col("x"), F.lit(3.0), F.col("y"), F.lit(17.0))
    out = _some_obs(spark, sf_dir).select("obs_id", distance.planar(*at, p=1, lx=25.0, ly=float(carriers.rows(spark, sf_dir))).alias("l1"), distance.planar(*at, lx=25.0, ly=float(carriers.rows(spark, sf_dir))).alias("l2"))
    return _round(out, "l1", "l2")


@query(f"""WITH {_OBS} SELECT obs_id, round(6371 * acos(least(1, greatest(-1, sin(radians(y % 19 * 4)) * sin(radians(60)) + cos(radians(y % 19 * 4)) * cos(radians(60)) * cos(radians(10 - x * 7))))), 4) AS km FROM obs""")
def great_circle(spark, sf_dir):
    out = _some_obs(spark, sf_dir).select("obs_id", distance.great_circle(F.col("x") * 7, F.col("y") % 19 * 4, F.lit(10.0), F.lit(60.0), 6371.0).alias("km"))
    return _round(out, "km", digits=4)


@query(f"WITH {_OBS}, s AS (SELECT obs_id, tan(radians(90 - (y % 19 * 4 + 5)) / 2) AS r, radians(x * 7) AS a FROM obs) SELECT obs_id, round(r * sin(a), 6) + 0.0 AS sx, round(r * cos(a), 6) + 0.0 AS sy FROM s")
def polar_projection(spark, sf_dir):
    sx, sy = distance.stereographic(F.col("x") * 7, F.col("y") % 19 * 4 + 5)
    return _round(_some_obs(spark, sf_dir).select("obs_id", sx.alias("sx"), sy.alias("sy")), "sx", "sy")


_SAT = "CASE WHEN {t} < 273.16 THEN CASE WHEN 22.587 * ({t} - 273.16) / ({t} + 0.7) < -20 THEN 0 ELSE 610.78 * exp(22.587 * ({t} - 273.16) / ({t} + 0.7)) END ELSE 610.78 * exp(17.502 * ({t} - 273.16) / ({t} - 32.19)) END"


@query(f"""WITH {_CELLS}, s AS (SELECT p_partkey, {_SAT.format(t='t_air')} AS sva, {_SAT.format(t='(t_air - 2)')} AS svd FROM cells)
SELECT p_partkey, round(sva, 6) AS sva, round(0.622 * svd / (101325 - svd), 9) AS mix, round(100 * (svd / (101325 - svd)) * ((101325 - sva) / sva), 6) AS rh FROM s""")
def satvap_mixing_humidity(spark, sf_dir):
    sva, svd, p = physics.saturation_vapour(F.col("t_air")), physics.saturation_vapour(F.col("t_air") - 2), F.lit(101325.0)
    out = carriers.cells(spark, sf_dir).select("p_partkey", sva.alias("sva"), physics.mixing_ratio(svd, p).alias("mix"), physics.relative_humidity(sva, svd, p).alias("rh"))
    return _round(_round(out, "sva", "rh"), "mix", digits=9)


@query(f"""WITH {_CELLS}, b AS (SELECT *, 5.67e-8 * pow(t_air, 4) AS black, e * 0.01 AS mb, 611 * pow(10, 7.5 * (t_air - 273.16) / (t_air - 35.86)) AS es FROM cells)
SELECT p_partkey, round(0.97 * black * (0.39 - 0.05 * sqrt(mb)) * (1 - 0.6823 * cloud * cloud), 6) AS berliand, round(black * (0.653 + 0.00535 * mb) * (1 + 0.1762 * cloud * cloud), 6) AS bignami,
round(0.97 * black * (0.254 - 4.95e-5 * es) * (1 - (0.5 + 0.246 * abs(radians(lat))) * pow(cloud, 1.2)), 6) AS budyko, round(black * (0.746 + 0.0066 * mb) * (1 + 0.26 * cloud), 6) AS efimova, round(black * 0.7855 * (1 + 0.26 * cloud), 6) AS maykut FROM b""")
def longwave_down(spark, sf_dir):
    args = (F.col("t_air"), F.col("e"), F.col("cloud"), F.col("lat"))
    names = {"berliand": "berliand", "bignami": "bignami", "budyko": "budyko", "efimova": "efimova_jacobs", "maykut": "maykut_jacobs"}
    return _round(carriers.cells(spark, sf_dir).select("p_partkey", *[physics.longwave_down(k, *args).alias(n) for n, k in names.items()]), *names)


@query(f"""WITH {_CELLS}, s AS (SELECT p_partkey, u, v, sqrt(u * u + v * v) AS ws FROM cells), d AS (SELECT *, greatest(2.5, least(32.5, ws)) AS b FROM s)
SELECT p_partkey, round(u * ws * 1.2 * 1e-3 * (0.692 + 0.071 * b - 0.0007 * b * b), 6) + 0.0 AS taux, round(v * ws * 1.2 * 1e-3 * (0.692 + 0.071 * b - 0.0007 * b * b), 6) + 0.0 AS tauy FROM d""")
def wind_stress(spark, sf_dir):
    x, y = physics.wind_stress(F.col("u"), F.col("v"))
    return _round(carriers.cells(spark, sf_dir).select("p_partkey", x.alias("taux"), y.alias("tauy")), "taux", "tauy")


@query(f"""WITH {_CELLS}, a AS (SELECT p_partkey, cloud, lat, 2 * pi() * (p_partkey % 365) / 365 AS d FROM cells),
s AS (SELECT *, 0.006918 + 0.070257 * sin(d) - 0.399912 * cos(d) + 0.000907 * sin(2*d) - 0.006758 * cos(2*d) + 0.00148 * sin(3*d) - 0.002697 * cos(3*d) AS dec,
  1.00011 + 0.00128 * sin(d) + 0.034221 * cos(d) + 0.000077 * sin(2*d) + 0.000719 * cos(2*d) AS sun FROM a),
z AS (SELECT *, sin(radians(lat)) * sin(dec) AS s2, cos(radians(lat)) * cos(dec) AS c2 FROM s),
p AS (SELECT z.*, greatest(0, s2 + c2 * cos(2 * pi() * ((k - 0.5) / 48 * 86400 + 43200) / 86400)) AS cz FROM z, range(1, 25) AS r(k)),
q AS (SELECT *, 1365 * sun * cz AS top, 1365 * sun * cz * pow(0.7, least(100, 1 / (cz + 1e-9))) AS dir FROM p)
SELECT p_partkey, round(sum(dir + (0.91 * top - dir) * 0.5) / 24 * (1 - 0.62 * any_value(cloud) + 0.0019 * degrees(greatest(0, asin(least(1, any_value(s2 + c2)))))), 4) AS flux FROM q GROUP BY p_partkey""")
def daily_insolation(spark, sf_dir):
    out = carriers.cells(spark, sf_dir).select("p_partkey", physics.daily_insolation((F.col("p_partkey") % 365).cast("double"), 365, F.col("cloud"), F.col("lat")).alias("flux"))
    return _round(out, "flux", digits=4)


@query(f"""WITH {_CELLS} SELECT p_partkey, round(-1.36471e-01 + 8.07004e-01 * saln + temp * (4.68181e-02 - 2.94418e-03 * saln + temp * (-7.45353e-03 + 3.48658e-05 * saln + 3.43570e-05 * temp)), 6) AS sigma0,
round(9.77093e+00 + 7.89879e-01 * saln + temp * (-2.26493e-02 - 2.62983e-03 * saln + temp * (-6.43205e-03 + 3.15235e-05 * saln + 2.75835e-05 * temp)), 6) AS sigma2 FROM cells""")
def seawater_density(spark, sf_dir):
    out = carriers.cells(spark, sf_dir).select("p_partkey", *[physics.sea_density(k, F.col("temp"), F.col("saln")).alias(f"sigma{k}") for k in (0, 2)])
    return _round(out, "sigma0", "sigma2")


@query(f"""WITH {_CELLS} SELECT p_partkey, round(CASE WHEN conc > 0.55 AND conc < 0.8 THEN 1.3 + exp(8 * (conc - 0.76)) WHEN conc > 0 AND conc < 0.55 THEN 0.09 + 2.5 * conc ELSE 9999 END, 6)::DOUBLE AS ice,
round(CASE WHEN conc > 0.55 AND conc < 0.8 THEN 0.2 + exp(2 * (conc - 1.3)) WHEN conc > 0 AND conc < 0.55 THEN 0.03 + 0.7 * conc ELSE 9999 END, 6)::DOUBLE AS snow FROM cells""")
def ice_limit(spark, sf_dir):
    out = carriers.cells(spark, sf_dir).select("p_partkey", physics.ice_limit(F.col("conc")).alias("ice"), physics.ice_limit(F.col("conc"), "snow").alias("snow"))
    return _round(out, "ice", "snow")


# grids


@query(f"""WITH {_OBS}, {_CELL_OF} SELECT obs_id, j0 * 25 + i0 AS p1, j0 * 25 + i0 + 1 AS p2, (j0 + 1) * 25 + i0 + 1 AS p3, (j0 + 1) * 25 + i0 AS p4,
(j0 + CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) * 25 + i0 + CASE WHEN u >= 0.5 THEN 1 ELSE 0 END AS nearest, round(u, 6) AS u, round(v, 6) AS v FROM corner""")
def grid_find_cell(spark, sf_dir):
    return _round(grid.find_cell(_some_obs(spark, sf_dir), GRID(spark, sf_dir)).select("obs_id", "p1", "p2", "p3", "p4", "nearest", "u", "v"), "u", "v")


@query(f"WITH {_ENS}, {_OBS}, {_WEIGHTS}, m AS (SELECT loc, value FROM ens WHERE mem = 0) SELECT obs_id, round(sum(w * value), 6) + 0.0 AS value FROM w JOIN m USING (loc) GROUP BY obs_id HAVING count(*) = 4")
def grid_bilinear(spark, sf_dir):
    field = carriers.ensemble(spark, sf_dir).where("mem = 0").select("loc", "value")
    cells = grid.find_cell(_some_obs(spark, sf_dir), GRID(spark, sf_dir))
    return _round(grid.interpolate(grid.weights(cells, "obs_id"), field, "obs_id", []), "value")


@query(f"""WITH {_ENS}, {_OBS}, {_CELL_OF}, n AS (SELECT obs_id, (j0 + CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) * 25 + i0 + CASE WHEN u >= 0.5 THEN 1 ELSE 0 END AS loc FROM corner)
SELECT obs_id, round(value, 6) + 0.0 AS value FROM n JOIN ens USING (loc) WHERE mem = 0""")
def grid_nearest(spark, sf_dir):
    field = carriers.ensemble(spark, sf_dir).where("mem = 0").select("loc", "value")
    return _round(grid.nearest(grid.find_cell(_some_obs(spark, sf_dir), GRID(spark, sf_dir)), field, "obs_id", []).select("obs_id", "value"), "value")


@query(f"""WITH {_OBS}, {_CELL_OF} SELECT (j0 + CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) * 25 + i0 + CASE WHEN u >= 0.5 THEN 1 ELSE 0 END AS loc, round(avg(obs), 6) + 0.0 AS value, count(*) AS n FROM corner GROUP BY 1 HAVING count(*) > 1""")
def grid_coarsen(spark, sf_dir):
    return _round(grid.coarse_grain(_some_obs(spark, sf_dir).withColumn("value", F.col("obs")), GRID(spark, sf_dir), []), "value")


@query(f"WITH {_OBS} SELECT kind, floor(x / 2)::INT AS bx, floor(y / 2)::INT AS \"by\", round(avg(obs), 6) + 0.0 AS obs, count(*) AS n, arg_min(err_std, obs_id) AS err_std FROM obs GROUP BY ALL HAVING count(*) > 1")
def superob(spark, sf_dir):
    return _round(observations.super_observe(_some_obs(spark, sf_dir), 2, 2, ["kind"]), "obs")


@query(f"WITH {_ENS} SELECT mem, j // 2 AS bj, i // 2 AS bi, round(avg(value), 6) + 0.0 AS value FROM ens GROUP BY ALL HAVING count(*) = 4")
def grid_block_mean(spark, sf_dir):
    return _round(grid.block_mean(carriers.ensemble(spark, sf_dir), ["mem"]), "value")


@query(f"""WITH {_ENS}, n AS (SELECT loc, mem, value, lag(value) OVER l AS b, lead(value) OVER l AS a FROM ens WINDOW l AS (PARTITION BY mem, j ORDER BY i))
SELECT loc, mem, round(CASE WHEN b IS NULL THEN a - value WHEN a IS NULL THEN value - b ELSE (a - b) / 2 END, 6) + 0.0 AS slope FROM n""")
def grid_gradient(spark, sf_dir):
    return _round(grid.gradient(carriers.ensemble(spark, sf_dir), ["mem"]).select("loc", "mem", "slope"), "slope")


@query(f"""WITH {_ENS}, n AS (SELECT e.loc, e.mem, e.value, w.value AS w, x.value AS x, s.value AS s, t.value AS t FROM ens e JOIN ens w ON w.mem = e.mem AND w.j = e.j AND w.i = (e.i + 24) % 25
JOIN ens x ON x.mem = e.mem AND x.j = e.j AND x.i = (e.i + 1) % 25 JOIN ens s ON s.mem = e.mem AND s.i = e.i AND s.j = (e.j + {_NY} - 1) % {_NY} JOIN ens t ON t.mem = e.mem AND t.i = e.i AND t.j = (e.j + 1) % {_NY})
SELECT loc, mem, round(w - 2 * value + x + s - 2 * value + t, 6) + 0.0 AS laplacian FROM n""")
def grid_laplacian(spark, sf_dir):
    return _round(grid.laplacian(carriers.ensemble(spark, sf_dir), ["mem"], ny=_ring_rows(spark, sf_dir)).select("loc", "mem", "laplacian"), "laplacian")


@query(f"""WITH {_ENS}, n AS (SELECT loc, mem, value, lag(value) OVER l AS b, lead(value) OVER l AS a1, lead(value, 2) OVER l AS a2, lead(value, 3) OVER l AS a3 FROM ens WINDOW l AS (PARTITION BY mem, j ORDER BY i))
SELECT loc, mem, round(coalesce((b + value) / 2, (35 * value - 35 * a1 + 21 * a2 - 5 * a3) / 16), 6) + 0.0 AS face FROM n""")
def grid_stagger(spark, sf_dir):
    return _round(grid.stagger(carriers.ensemble(spark, sf_dir), ["mem"]).select("loc", "mem", "face"), "face")


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The grid's cells cut along a diagonal: triangles and nodes."""
    cells = spark.range(24 * (carriers.rows(spark, sf_dir) - 1)).select(F.col("id").alias("c"), (F.floor(F.col("id") / 24) * 25 + F.col("id") % 24).alias("p"))
    both = F.array(F.struct((2 * F.col("c")).alias("tri"), F.col("p").alias("n1"), (F.col("p") + 1).alias("n2"), (F.col("p") + 26).alias("n3")), F.struct((2 * F.col("c") + 1).alias("tri"), F.col("p").alias("n1"), (F.col("p") + 26).alias("n2"), (F.col("p") + 25).alias("n3")))
    nodes = GRID(spark, sf_dir).points(spark).select(F.col("loc").alias("node"), "x", "y")
    return cells.select(F.explode(both).alias("t")).select("t.*"), nodes


_MESH = f"""cell AS (SELECT c, (c // 24) * 25 + c % 24 AS p FROM range((SELECT 24 * (count(*) // 25 - 1) FROM embeddings)) AS r(c)), mesh AS (SELECT 2 * c AS tri, p AS n1, p + 1 AS n2, p + 26 AS n3 FROM cell UNION ALL SELECT 2 * c + 1, p, p + 26, p + 25 FROM cell)"""


@query(f"""WITH {_OBS}, {_CELL_OF}, t AS (SELECT obs_id, j0 * 25 + i0 AS p, j0 * 24 + i0 AS c, u, v FROM corner)
SELECT obs_id, CASE WHEN u >= v THEN 2 * c ELSE 2 * c + 1 END AS tri, round(CASE WHEN u >= v THEN 1 - u ELSE 1 - v END, 6) + 0.0 AS w1, round(CASE WHEN u >= v THEN u - v ELSE u END, 6) + 0.0 AS w2 FROM t WHERE abs(u - v) > 1e-9 AND u > 1e-9 AND v > 1e-9""")
def mesh_find_triangle(spark, sf_dir):
    mesh, nodes = _mesh(spark, sf_dir)
    inside = _some_obs(spark, sf_dir).where("abs((x - floor(x)) - (y - floor(y))) > 1e-9 and x - floor(x) > 1e-9 and y - floor(y) > 1e-9")
    found = grid.find_triangle(inside, grid.triangles(mesh, nodes), "obs_id", 4.0)
    return _round(found.select("obs_id", "tri", "w1", "w2"), "w1", "w2")


@query(f"WITH {_MESH}, e AS (SELECT least(n1, n2) AS a, greatest(n1, n2) AS b FROM mesh UNION ALL SELECT least(n2, n3), greatest(n2, n3) FROM mesh UNION ALL SELECT least(n3, n1), greatest(n3, n1) FROM mesh) SELECT a, b FROM e GROUP BY a, b HAVING count(*) = 1")
def mesh_boundary(spark, sf_dir):
    return grid.boundary_edges(_mesh(spark, sf_dir)[0])


@query(f"""WITH {_OBS}, e AS (SELECT * FROM (VALUES (2.05, 2.05, 20.05, 4.05), (20.05, 4.05, 12.05, 17.05), (12.05, 17.05, 8.05, 9.05), (8.05, 9.05, 2.05, 2.05)) AS t(x1, y1, x2, y2))
SELECT obs_id FROM obs JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY obs_id HAVING count(*) % 2 = 1""")
def point_in_polygon(spark, sf_dir):
    corners = [(2.05, 2.05), (20.05, 4.05), (12.05, 17.05), (8.05, 9.05)]
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])], "x1 double, y1 double, x2 double, y2 double")
    return grid.in_polygon(_some_obs(spark, sf_dir), edges, "obs_id")


@query(f"""WITH {_ENS}, {_MESH}, n AS (SELECT loc, i::DOUBLE AS x, j::DOUBLE AS y, max(CASE WHEN mem = 0 THEN value END) AS u, max(CASE WHEN mem = 1 THEN value END) AS v FROM ens GROUP BY loc, i, j),
c AS (SELECT tri, a.x x1, a.y y1, a.u u1, a.v v1, b.x x2, b.y y2, b.u u2, b.v v2, d.x x3, d.y y3, d.u u3, d.v v3 FROM mesh JOIN n a ON a.loc = n1 JOIN n b ON b.loc = n2 JOIN n d ON d.loc = n3),
g AS (SELECT tri, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS a2, u1 * (y2 - y3) + u2 * (y3 - y1) + u3 * (y1 - y2) AS ux, u1 * (x3 - x2) + u2 * (x1 - x3) + u3 * (x2 - x1) AS uy,
 v1 * (y2 - y3) + v2 * (y3 - y1) + v3 * (y1 - y2) AS vx, v1 * (x3 - x2) + v2 * (x1 - x3) + v3 * (x2 - x1) AS vy FROM c)
SELECT tri, round(sqrt((ux - vy) ** 2 + (uy + vx) ** 2) / abs(a2), 6) AS shear, round((ux + vy) / a2, 6) + 0.0 AS div, round((vx - uy) / a2, 6) + 0.0 AS vort FROM g""")
def triangle_deformation(spark, sf_dir):
    mesh, nodes = _mesh(spark, sf_dir)
    flow = carriers.ensemble(spark, sf_dir).where("mem < 2").groupBy("loc").pivot("mem", [0, 1]).agg(F.first("value"))
    flow = flow.select(F.col("loc").alias("node"), F.col("0").alias("u"), F.col("1").alias("v"))
    out = grid.triangles(mesh, nodes)
    for k in (1, 2, 3):
        out = out.join(flow.select(F.col("node").alias(f"n{k}"), F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}")), f"n{k}")
    return _round(observations.deformation(out).select("tri", "shear", "div", "vort"), "shear", "div", "vort")


# observations


@query(f"""WITH {_PROFILE}, g AS (SELECT pid, lev, value, max(CASE WHEN value BETWEEN 0 AND 90000 THEN 0 ELSE 1 END) OVER (PARTITION BY pid) AS bad FROM profile WHERE l_linestatus = 'O')
SELECT pid, lev, round(value, 2) AS value FROM g WHERE bad = 0""")
def obs_qc_profile(spark, sf_dir):
    kept = observations.profiles(carriers.profiles(spark, sf_dir), "pid", F.col("l_linestatus") == "O", F.col("value").between(0, 90000))
    return _round(kept.select("pid", "lev", "value"), "value", digits=2)


@query(f"WITH {_OBS} SELECT obs_id, round(obs, 6) + 0.0 AS obs FROM obs WHERE obs_id % 23 BETWEEN 0 AND 10 AND err_std > 0 AND x BETWEEN 2 AND 20 AND y BETWEEN 1 AND 18")
def obs_qc_flags(spark, sf_dir):
    rows = _some_obs(spark, sf_dir).withColumn("flag", F.col("obs_id") % 23)
    return _round(observations.flags(rows, "flag", 0, 10, "err_std").where("x between 2 and 20 and y between 1 and 18").select("obs_id", "obs"), "obs")


@query(f"WITH {_ENS}, m AS (SELECT loc AS obs_id, CASE WHEN loc % 40 = mem THEN NULL ELSE value END AS value FROM ens) SELECT obs_id FROM m GROUP BY obs_id HAVING count(value) = 20")
def obs_valid_members(spark, sf_dir):
    holes = F.when(F.col("loc") % 40 == F.col("mem"), None).otherwise(F.col("value"))
    return observations.valid_members(carriers.ensemble(spark, sf_dir).select(F.col("loc").alias("obs_id"), holes.alias("value")), 20)


@query(f"WITH {_OBS} SELECT obs_id FROM obs WHERE t >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 6 HOUR AND t < TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 12 HOUR")
def obs_window(spark, sf_dir):
    return observations.in_window(_some_obs(spark, sf_dir), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), -6, 12).select("obs_id")


@query(f"""WITH {_PROFILE}, d AS (SELECT *, sum(dz) OVER (PARTITION BY pid ORDER BY lev) AS depth FROM profile), b AS (SELECT pid, lev, depth, (CASE WHEN depth > 20 THEN 1 ELSE 0 END + CASE WHEN depth > 60 THEN 1 ELSE 0 END + CASE WHEN depth > 100 THEN 1 ELSE 0 END) AS bin FROM d)
SELECT pid, lev, bin FROM b QUALIFY row_number() OVER (PARTITION BY pid, bin ORDER BY lev) = 1""")
def thin_vertical(spark, sf_dir):
    rows = vertical.layer_depths(carriers.profiles(spark, sf_dir), "pid").withColumnRenamed("z", "depth").select("pid", "lev", "depth")
    targets = rows.select("pid").distinct().withColumn("zs", F.array(*[F.lit(float(z)) for z in (20, 60, 100)]))
    return observations.thin_vertical(rows, targets, "pid").select("pid", "lev", "bin")


@query(f"""WITH {_PROFILE}, a AS (SELECT pid, lev, sum(value) OVER (PARTITION BY pid ORDER BY lev) AS total FROM profile) SELECT pid, lev, round(greatest(0, (total - coalesce(lag(total) OVER (PARTITION BY pid ORDER BY lev), 0)) / 3600), 6) AS rate FROM a""")
def deaccumulate(spark, sf_dir):
    rows = carriers.profiles(spark, sf_dir).withColumn("total", F.sum("value").over(Window.partitionBy("pid").orderBy("lev")))
    return _round(observations.deaccumulate(rows, ["pid"], "lev", "total", 3600).select("pid", "lev", "rate"), "rate")


@query("""WITH s AS (SELECT ts AS s_t, event_id AS sid FROM events WHERE event_type = 'view'), w AS (SELECT event_id AS wid, ts AS t FROM events WHERE event_type <> 'view')
SELECT wid, arg_min(sid, (abs(epoch_us(t) - epoch_us(s_t)), epoch_us(s_t), sid)) AS sid FROM w JOIN s ON abs(epoch_us(t) - epoch_us(s_t)) <= 21600000000 GROUP BY wid""")
def nearest_time(spark, sf_dir):
    events = carriers.table(spark, sf_dir, "events")
    wanted = events.where("event_type <> 'view'").select(F.col("event_id").alias("wid"), F.col("ts").alias("t"))
    series = events.where("event_type = 'view'").select(F.col("ts").alias("s_t"), F.col("event_id").alias("sid"))
    return asof.nearest_in_time(wanted, series, "t", "wid", "sid", bucket_hours=6, width=6).select("wid", "sid")


@query(f"""WITH {_OBS}, n AS (SELECT vec_id AS node, (vec_id % 25)::DOUBLE AS nx, (vec_id // 25)::DOUBLE AS ny FROM embeddings WHERE vec_id % 3 = 0),
d AS (SELECT obs_id, node, sqrt((x - nx) ** 2 + (y - ny) ** 2) AS gap FROM obs JOIN n ON abs(x - nx) <= 2 AND abs(y - ny) <= 2)
SELECT obs_id, round(min(gap), 6) AS gap FROM d WHERE gap <= 2 GROUP BY obs_id""")
def nearest_node(spark, sf_dir):
    nodes = GRID(spark, sf_dir).points(spark).where("loc % 3 = 0").select(F.col("loc").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return _round(observations.nearest_node(_some_obs(spark, sf_dir), nodes, "obs_id", 2.0).select("obs_id", "gap"), "gap")


# vertical


@query(f"WITH {_PROFILE} SELECT pid, lev, sum(dz) OVER (PARTITION BY pid ORDER BY lev) AS z FROM profile")
def layer_depth(spark, sf_dir):
    return vertical.layer_depths(carriers.profiles(spark, sf_dir), "pid").select("pid", "lev", "z")


@query(f"""WITH {_PROFILE}, a AS (SELECT pid, lev, f, sum(dz) OVER l AS z FROM profile WINDOW l AS (PARTITION BY pid ORDER BY lev)),
b AS (SELECT *, lag(f) OVER l AS fp, coalesce(lag(z) OVER l, 0) AS zp, coalesce(lag(z, 2) OVER l, 0) AS zpp, lead(lev) OVER l IS NULL AS last FROM a WINDOW l AS (PARTITION BY pid ORDER BY lev)),
o AS (SELECT pid, pid * 10 + k AS obs_id, k * 7.25::DOUBLE + 1.0::DOUBLE / 3 AS oz FROM (SELECT DISTINCT pid FROM profile), range(10) AS r(k)),
v AS (SELECT o.pid, obs_id, lev, 0 AS part, f AS val FROM o JOIN b USING (pid) WHERE fp IS NULL AND oz >= 0 AND oz < z / 2
UNION ALL SELECT o.pid, obs_id, lev, 1, ((zp + (z - zp) / 2 - oz) * fp + (oz - zp + (zp - zpp) / 2) * f) / ((z - zp) / 2 + (zp - zpp) / 2) FROM o JOIN b USING (pid) WHERE fp IS NOT NULL AND oz >= zp - (zp - zpp) / 2 AND oz < zp + (z - zp) / 2
UNION ALL SELECT o.pid, obs_id, lev, 2, f FROM o JOIN b USING (pid) WHERE last AND oz >= z - (z - zp) / 2 AND oz <= z)
SELECT pid, obs_id, round(arg_max(val, lev * 3 + part), 9) AS value FROM v GROUP BY pid, obs_id""")
def vertical_interp(spark, sf_dir):
    layers = vertical.layer_depths(carriers.profiles(spark, sf_dir), "pid")
    obs = layers.select("pid").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("pid", (F.col("pid") * 10 + F.col("k")).alias("obs_id"), (F.col("k") * 7.25 + F.lit(1.0) / 3).alias("oz"))
    return _round(vertical.interpolate(obs, layers.select("pid", "lev", "f", "z"), "pid"), "value", digits=9)


@query()
def layer_adjust(spark, sf_dir):
    rows = carriers.profiles(spark, sf_dir).withColumn("dp", F.col("dz") - 12)
    columns = rows.groupBy("pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("lev", "dp"))), lambda s: s["dp"]).alias("dps"), F.sum("dz").alias("depth"))
    return vertical.adjust_layers(columns).select("pid", F.posexplode("dps").alias("k", "dp"))


# observation priors, statistics, inflation


@query(f"WITH {_ENS}, {_OBS}, {_WEIGHTS}, {_PRIOR} SELECT obs_id, mem, round(value, 6) + 0.0 AS value FROM prior")
def obs_prior(spark, sf_dir):
    return _round(_prior(spark, sf_dir, _some_obs(spark, sf_dir)), "value")


_STATS = f"""WITH {_ENS}, {_OBS}, {_WEIGHTS}, {_PRIOR}, b AS (SELECT obs_id, avg(value) AS mb, var_samp(value) AS vb FROM prior GROUP BY obs_id),
p AS (SELECT obs_id, mem, mb + 0.5 * (value - mb) + 0.3 * (obs - mb) AS value FROM prior JOIN b USING (obs_id) JOIN obs USING (obs_id)), a AS (SELECT obs_id, avg(value) AS ma, var_samp(value) AS va FROM p GROUP BY obs_id),
s AS (SELECT count(*) AS total_nobs, sum((obs - mb) ** 2) AS omb2, sum(err_std * err_std) AS varo, sum(vb) AS varb, sum((ma - mb) ** 2) AS amb2, sum((obs - ma) * (ma - mb)) AS omaamb, sum(va) AS vara FROM obs JOIN b USING (obs_id) JOIN a USING (obs_id))"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the prior and of a posterior moved three tenths of the way, with half the spread."""
    obs = _some_obs(spark, sf_dir)
    at = grid.at_cells(grid.find_cell(obs, GRID(spark, sf_dir)), carriers.ensemble(spark, sf_dir), "obs_id", ["mem"], ["value"], ["obs"])
    prior = at.select("obs_id", F.explode("at").alias("a")).select("obs_id", "a.mem", "a.value")
    mean = F.aggregate("at", F.lit(0.0), lambda acc, a: acc + a["value"]) / F.size("at")
    moved = at.select("obs_id", "obs", mean.alias("mean"), F.explode("at").alias("a"))
    mean = F.col("mean")
    post = moved.select("obs_id", "a.mem", (mean + 0.5 * (F.col("a.value") - mean) + 0.3 * (F.col("obs") - mean)).alias("value"))
    return stats.observation_space(obs, prior, post)


@query(f"{_STATS} SELECT total_nobs, round(omb2, 4) AS omb2, round(varo, 4) AS varo, round(varb, 4) AS varb, round(amb2, 4) AS amb2, round(omaamb, 4) AS omaamb, round(vara, 4) AS vara FROM s")
def obs_space_stats(spark, sf_dir):
    return _round(_stats(spark, sf_dir), "omb2", "varo", "varb", "amb2", "omaamb", "vara", digits=4)


@query(f"WITH {_ENS} SELECT loc, mem, round(1.2 * (value - avg(value) OVER (PARTITION BY loc)) + avg(value) OVER (PARTITION BY loc), 6) + 0.0 AS value FROM ens")
def inflate_multiplicative(spark, sf_dir):
    return _round(inflation.multiplicative(carriers.ensemble(spark, sf_dir), 1.2, ["loc"]).select("loc", "mem", "value"), "value")


@query(f"{_STATS} SELECT round(CASE WHEN total_nobs < 3 OR varb <= 0 OR omb2 < varo THEN 1 ELSE sqrt((omb2 - varo) / varb) END, 6) AS coef FROM s")
def inflate_adaptive_prior(spark, sf_dir):
    return _round(inflation.adaptive_prior(_stats(spark, sf_dir)).select("coef"), "coef")


@query(f"{_STATS} SELECT round(CASE WHEN total_nobs < 3 OR vara <= 0 OR omb2 - varo - amb2 < 0 THEN 1 ELSE sqrt((omb2 - varo - amb2) / vara) END, 6) AS coef FROM s")
def inflate_adaptive_post(spark, sf_dir):
    return _round(inflation.adaptive_post(_stats(spark, sf_dir)).select("coef"), "coef")


@query(f"""{_STATS} SELECT round(CASE WHEN vara <= 0 OR sqrt(varb / vara) <= 1 THEN 0 ELSE least(2, greatest(-1, (sqrt(greatest(0, (omb2 - varo - amb2) / vara)) - 1) / (sqrt(varb / vara) - 1))) END, 6)::DOUBLE AS alpha FROM s""")
def inflate_adaptive_rtpp(spark, sf_dir):
    return _round(inflation.adaptive_relaxation(_stats(spark, sf_dir)).select("alpha"), "alpha")


@query(f"""WITH {_ENS}, p AS (SELECT loc, mem, value AS b, value * 0.5 + 0.01 * mem AS a FROM ens)
SELECT loc, mem, round(avg(a) OVER l + 0.4 * (b - avg(b) OVER l) + 0.6 * (a - avg(a) OVER l), 6) + 0.0 AS value FROM p WINDOW l AS (PARTITION BY loc)""")
def inflate_rtpp(spark, sf_dir):
    prior = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    post = prior.withColumn("value", F.col("value") * 0.5 + 0.01 * F.col("mem"))
    return _round(inflation.relax_to_prior(prior, post, 0.4, ["loc"]).select("loc", "mem", "value"), "value")


# tiles and localization

_TILES = "tile AS (SELECT loc, i, j, (j // 6) * 5 + i // 6 AS par_id FROM (SELECT vec_id AS loc, vec_id % 25 AS i, vec_id // 25 AS j FROM embeddings))"
_HALO = """box AS (SELECT par_id, min(i) AS x0, max(i) AS x1, min(j) AS y0, max(j) AS y1 FROM tile GROUP BY par_id),
halo AS (SELECT par_id, obs_id FROM box JOIN obs ON x BETWEEN x0 - 2.5 AND x1 + 2.5 AND y BETWEEN y0 - 2.5 AND y1 + 2.5)"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.with_tiles(GRID(spark, sf_dir).points(spark), carriers.NX, 6)


def _halo(spark: SparkSession, sf_dir: str, obs: DataFrame, reach: float) -> DataFrame:
    g = GRID(spark, sf_dir)
    return local.halo(obs, g.nx, g.ny, 6, reach, last=g.last)


@query(f"WITH {_TILES} SELECT loc, par_id::INT AS par_id FROM tile")
def tile_assign(spark, sf_dir):
    return _tiles(spark, sf_dir).select("loc", "par_id")


@query(f"WITH {_OBS}, {_TILES}, {_HALO} SELECT par_id::INT AS par_id, obs_id FROM halo")
def tile_halo_obs(spark, sf_dir):
    return _halo(spark, sf_dir, _some_obs(spark, sf_dir), 2.5)


@query(f"WITH {_OBS}, {_TILES}, {_HALO}, c AS (SELECT par_id, count(*) AS nobs FROM halo GROUP BY par_id), n AS (SELECT par_id, count(*) AS npts FROM tile GROUP BY par_id) SELECT par_id::INT AS par_id, npts * greatest(coalesce(nobs, 0), 1) AS load FROM n LEFT JOIN c USING (par_id)")
def tile_workload(spark, sf_dir):
    return local.workload(_tiles(spark, sf_dir), _halo(spark, sf_dir, _some_obs(spark, sf_dir), 2.5))


@query(f"""WITH {_OBS}, {_TILES}, {_HALO}, c AS (SELECT par_id, count(*) AS nobs FROM halo GROUP BY par_id), n AS (SELECT par_id, count(*) AS npts FROM tile GROUP BY par_id), l AS (SELECT par_id::INT AS par_id, npts * greatest(coalesce(nobs, 0), 1) AS load FROM n LEFT JOIN c USING (par_id))
SELECT par_id, load, least(floor((sum(load) OVER (ORDER BY par_id) - load / 2) * 4 / sum(load) OVER ()), 3)::INT AS task FROM l""")
def task_split(spark, sf_dir):
    loads = local.workload(_tiles(spark, sf_dir), _halo(spark, sf_dir, _some_obs(spark, sf_dir), 2.5))
    return local.split_by_load(loads, 4)


@query(f"""WITH {_OBS}, p AS (SELECT vec_id AS loc, (vec_id % 25)::DOUBLE AS px, (vec_id // 25)::DOUBLE AS py FROM embeddings),
d AS (SELECT loc, obs_id, greatest(2 * sqrt((px - x) ** 2 + (py - y) ** 2) / 3, 1e-10) AS r FROM p JOIN obs ON abs(px - x) < 3 AND abs(py - y) < 3), g AS (SELECT loc, obs_id, {_GC} AS rho FROM d WHERE r < 2)
SELECT loc, obs_id, round(rho, 6)::DOUBLE AS rho FROM g WHERE rho > 0""")
def local_pairs(spark, sf_dir):
    pairs = local.localize(GRID(spark, sf_dir).points(spark), _some_obs(spark, sf_dir), 3.0)
    return _round(pairs, "rho")


@query(f"""WITH {_OBS}, p AS (SELECT vec_id AS loc, (vec_id % 25)::DOUBLE AS px, (vec_id // 25)::DOUBLE AS py FROM embeddings),
d AS (SELECT loc, obs_id, greatest(2 * sqrt((px - x) ** 2 + (py - y) ** 2) / 3, 1e-10) AS r FROM p JOIN obs ON abs(px - x) < 3 AND abs(py - y) < 3), g AS (SELECT loc, obs_id, {_GC} AS rho FROM d WHERE r < 2)
SELECT loc, rank, round(rho, 6)::DOUBLE AS rho FROM (SELECT loc, rho, row_number() OVER (PARTITION BY loc ORDER BY rho DESC, obs_id)::INT AS rank FROM g WHERE rho > 0) WHERE rank <= 8""")
def local_obs_topk(spark, sf_dir):
    return _round(local.strongest(local.localize(GRID(spark, sf_dir).points(spark), _some_obs(spark, sf_dir), 3.0), 8).select("loc", "rank", "rho"), "rho")


@query(f"""WITH {_ENS}, {_OBS}, p AS (SELECT vec_id AS loc, (vec_id % 25)::DOUBLE AS px, (vec_id // 25)::DOUBLE AS py FROM embeddings),
a AS (SELECT loc, obs_id, abs(px - x) AS dx, abs(py - y) AS dy FROM p, obs), d AS (SELECT loc, obs_id, greatest(2 * sqrt(least(dx, 25 - dx) ** 2 + least(dy, {_NY} - dy) ** 2) / 4, 1e-10) AS r FROM a), g AS (SELECT loc, obs_id, {_GC} AS rho FROM d WHERE r < 2)
SELECT loc, obs_id, round(rho, 6)::DOUBLE AS rho FROM g WHERE rho > 0""")
def local_pairs_cyclic(spark, sf_dir):
    pairs = local.localize(GRID(spark, sf_dir).points(spark), _some_obs(spark, sf_dir), 4.0, lx=25.0, ly=float(carriers.rows(spark, sf_dir)))
    return _round(pairs, "rho")


# filters

_ONE = f"""one AS (SELECT 312 AS at, 0.3::DOUBLE AS obs, 0.1::DOUBLE AS err), hx AS (SELECT mem, value AS prior FROM ens WHERE loc = 312), m AS (SELECT avg(prior) AS mb, var_samp(prior) AS vb FROM hx),
step AS (SELECT mem, prior, vb, (err * err / (vb + err * err)) * mb + (1 - err * err / (vb + err * err)) * obs + sqrt(err * err / (vb + err * err)) * (prior - mb) - prior AS step FROM hx, m, one),
rho AS (SELECT loc, {_GC} AS rho FROM (SELECT vec_id AS loc, greatest(2 * sqrt((vec_id % 25 - 12) ** 2 + (vec_id // 25 - 12) ** 2) / 5, 1e-10) AS r FROM embeddings))"""


def _one(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """State, observed members, the observation and the factors of one observation at the point 312."""
    ens = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    prior = ens.where("loc = 312").select("mem", F.col("value").alias("prior"))
    obs = spark.createDataFrame([(0.3, 0.1)], "obs double, err_std double")
    gap = distance.planar(F.col("x"), F.lit(12.0), F.col("y"), F.lit(12.0))
    return ens, prior, obs, GRID(spark, sf_dir).points(spark).select("loc", distance.gaspari_cohn(gap, F.lit(5.0)).alias("rho"))


@query(f"WITH {_ENS}, {_ONE} SELECT mem, round(step, 6) + 0.0 AS step FROM step")
def eakf_increment(spark, sf_dir):
    _, prior, obs, _ = _one(spark, sf_dir)
    every = Window.partitionBy()
    met = prior.crossJoin(F.broadcast(obs)).withColumns({"mb": F.avg("prior").over(every), "vb": F.var_samp("prior").over(every)})
    step = kernels.adjust(F.col("prior"), F.col("mb"), F.col("vb"), F.col("obs"), F.col("err_std"))
    return _round(met.select("mem", step.alias("step")), "step")


@query(f"""WITH {_ENS}, {_ONE}, c AS (SELECT loc, covar_samp(value, prior) AS cov FROM ens JOIN hx USING (mem) GROUP BY loc)
SELECT loc, mem, round(value + rho * cov / vb * step, 6) + 0.0 AS value FROM ens JOIN step USING (mem) JOIN c USING (loc) JOIN rho USING (loc)""")
def eakf_update_one(spark, sf_dir):
    return _round(kernels.serial_step(*_one(spark, sf_dir)), "value")


_TWO = f"""{_ONE}, c AS (SELECT loc, covar_samp(value, prior) AS cov FROM ens JOIN hx USING (mem) GROUP BY loc), e1 AS (SELECT loc, mem, value + rho * cov / vb * step AS value FROM ens JOIN step USING (mem) JOIN c USING (loc) JOIN rho USING (loc)),
hx2 AS (SELECT mem, value AS prior FROM e1 WHERE loc = 338), m2 AS (SELECT avg(prior) AS mb, var_samp(prior) AS vb FROM hx2),
s2 AS (SELECT mem, prior, vb, 0.04 / (vb + 0.04) * mb + (1 - 0.04 / (vb + 0.04)) * -0.2 + sqrt(0.04 / (vb + 0.04)) * (prior - mb) - prior AS step FROM hx2, m2),
rho2 AS (SELECT loc, {_GC} AS rho FROM (SELECT vec_id AS loc, greatest(2 * sqrt((vec_id % 25 - 13) ** 2 + (vec_id // 25 - 13) ** 2) / 5, 1e-10) AS r FROM embeddings)),
c2 AS (SELECT loc, covar_samp(value, prior) AS cov FROM e1 JOIN hx2 USING (mem) GROUP BY loc)"""


@query(f"WITH {_ENS}, {_TWO} SELECT loc, mem, round(value + rho * cov / vb * step, 6) + 0.0 AS value FROM e1 JOIN s2 USING (mem) JOIN c2 USING (loc) JOIN rho2 USING (loc)")
def eakf_serial_two(spark, sf_dir):
    first = kernels.serial_step(*_one(spark, sf_dir))
    gap = distance.planar(F.col("x"), F.lit(13.0), F.col("y"), F.lit(13.0))
    rho = GRID(spark, sf_dir).points(spark).select("loc", distance.gaspari_cohn(gap, F.lit(5.0)).alias("rho"))
    prior = first.where("loc = 338").select("mem", F.col("value").alias("prior"))
    return _round(kernels.serial_step(first, prior, spark.createDataFrame([(-0.2, 0.2)], "obs double, err_std double"), rho), "value")


_LOCAL_ONE = f"""WITH {_ENS}, {_ONE}, s AS (SELECT loc, mem, (prior - mb) * rho / err / sqrt(19) AS s, (obs - mb) * rho / err / sqrt(19) AS dy, vb FROM hx, m, one, rho WHERE rho > 0),
q AS (SELECT loc, sum(s * s) AS q FROM s GROUP BY loc), xs AS (SELECT loc, sum(value * s) AS xs FROM ens JOIN s USING (loc, mem) GROUP BY loc)"""


@query(f"""{_LOCAL_ONE} SELECT e.loc, e.mem, round(CASE WHEN s.s IS NULL THEN value ELSE value + xs * dy / (1 + q) + (1 / sqrt(1 + q) - 1) / q * xs * s.s END, 6) + 0.0 AS value
FROM ens e LEFT JOIN s USING (loc, mem) LEFT JOIN q USING (loc) LEFT JOIN xs USING (loc)""")
def etkf_one_obs(spark, sf_dir):
    return _round(_transform_one(spark, sf_dir, "etkf"), "value")


_DENKF_ERR = "sqrt((vb + err * err) ** 2 + vb * ((obs - mb) / 2) ** 2) - vb"


@query(f"""WITH {_ENS}, {_ONE}, s AS (SELECT loc, mem, (prior - mb) * rho / sqrt({_DENKF_ERR}) / sqrt(19) AS s, (obs - mb) * rho / sqrt({_DENKF_ERR}) / sqrt(19) AS dy FROM hx, m, one, rho WHERE rho > 0),
q AS (SELECT loc, sum(s * s) AS q FROM s GROUP BY loc), xs AS (SELECT loc, sum(value * s) AS xs FROM ens JOIN s USING (loc, mem) GROUP BY loc)
SELECT e.loc, e.mem, round(CASE WHEN s.s IS NULL THEN value ELSE value + xs * dy / (1 + q) - 0.5 * xs * s.s / (1 + q) END, 6) + 0.0 AS value FROM ens e LEFT JOIN s USING (loc, mem) LEFT JOIN q USING (loc) LEFT JOIN xs USING (loc)""")
def denkf_one_obs(spark, sf_dir):
    return _round(_transform_one(spark, sf_dir, "denkf"), "value")


def _transform_one(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    ens, prior, obs, rho = _one(spark, sf_dir)
    members = prior.agg(F.transform(F.sort_array(F.collect_list(F.struct("mem", "prior"))), lambda s: s["prior"]).alias("priors"))
    one = obs.crossJoin(F.broadcast(members)).withColumn("obs_id", F.lit(0).cast("bigint"))
    return kernels.local_analysis(ens, one, rho.where("rho > 0").withColumn("obs_id", F.lit(0).cast("bigint")), method)


def _local_filter(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    obs = observations.in_window(_some_obs(spark, sf_dir), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), -12, 12)
    prior = _prior(spark, sf_dir, obs).groupBy("obs_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("mem", "value"))), lambda s: s["value"]).alias("priors"))
    pairs = local.localize(GRID(spark, sf_dir).points(spark), obs, 3.0)
    ens = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    return _round(kernels.local_analysis(ens, obs.select("obs_id", "obs", "err_std").join(prior, "obs_id"), pairs, method, max_obs=200), "value")


@query()
def etkf_local(spark, sf_dir):
    return _local_filter(spark, sf_dir, "etkf")


@query()
def denkf_local(spark, sf_dir):
    return _local_filter(spark, sf_dir, "denkf")


@query(f"""WITH {_ENS}, {_ONE}, c AS (SELECT loc, covar_samp(value, prior) AS cov FROM ens JOIN hx USING (mem) GROUP BY loc) SELECT loc, mem, round(rho * cov / vb * step, 6) + 0.0 AS increment FROM ens JOIN step USING (mem) JOIN c USING (loc) JOIN rho USING (loc)""")
def increments(spark, sf_dir):
    state = _one(spark, sf_dir)
    return _round(stats.increments(state[0], kernels.serial_step(*state), ["loc", "mem"]), "increment")


@query(f"WITH {_ENS} SELECT loc, mem, round(CASE WHEN loc % 7 = 0 THEN value ELSE value + 0.1 * mem END, 6) + 0.0 AS value FROM ens")
def write_back(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    change = ens.where("loc % 7 <> 0").select("loc", "mem", (0.1 * F.col("mem")).alias("increment"))
    return _round(stats.write_back(ens, change, ["loc", "mem"]), "value")


# spectra, perturbations, models


_MODES = f"""n AS (SELECT {_NY} AS ny, greatest(25, {_NY}) AS n, count(*) AS points FROM embeddings), f AS (SELECT CASE WHEN 2 * a < 25 THEN a ELSE a - 25 END / 25 AS fx, CASE WHEN 2 * b < ny THEN b ELSE b - ny END / ny AS fy, n, ny FROM n, range(25) AS r(a), range((SELECT ny FROM n)) AS s(b)),
k AS (SELECT fx, fy, n, ny, round(sqrt(fx * fx + fy * fy) * n, 9) AS k FROM f)"""
_BAND = "CASE WHEN k <= {b} / 1.5 THEN 1 WHEN k >= {b} * 1.5 THEN 0 ELSE cos(pi() / 2 * (k - {b} / 1.5) / ({b} * 1.5 - {b} / 1.5)) ** 2 END"


@query(f"""WITH {_ENS}, {_MODES}, d AS (SELECT mem, k, fx, fy, any_value(n) AS n, sum(value * cos(2 * pi() * (fx * i + fy * j))) AS re, sum(value * sin(2 * pi() * (fx * i + fy * j))) AS im FROM ens, k GROUP BY mem, k, fx, fy)
SELECT mem, ceil(k)::INT AS k, round(avg((re * re + im * im) / (SELECT points * points FROM n)), 9) AS power FROM d WHERE ceil(k) < n // 2 GROUP BY mem, ceil(k)""")
def power_spectrum(spark, sf_dir):
    field = carriers.ensemble(spark, sf_dir).select("mem", "i", "j", "value")
    g = GRID(spark, sf_dir)
    return _round(spectral.power_spectrum(field, ["mem"], g.ny, g.nx, g.size), "power", digits=9)


@query(f"""WITH {_ENS}, {_MODES}, r AS (SELECT fx, fy, {_BAND.format(b="8.0")} - {_BAND.format(b="3.0")} AS part FROM k), m AS (SELECT * FROM r WHERE part <> 0),
d AS (SELECT mem, fx, fy, part, sum(value * cos(2 * pi() * (fx * i + fy * j))) AS re, sum(value * sin(2 * pi() * (fx * i + fy * j))) AS im FROM ens, m GROUP BY mem, fx, fy, part)
SELECT mem, i, j, round(sum(part * (re * cos(2 * pi() * (fx * i + fy * j)) + im * sin(2 * pi() * (fx * i + fy * j)))) / (SELECT points FROM n), 6) + 0.0 AS value FROM d, (SELECT i, j FROM ens WHERE mem = 0) GROUP BY mem, i, j""")
def bandpass(spark, sf_dir):
    field = carriers.ensemble(spark, sf_dir).select("mem", "i", "j", "value")
    g = GRID(spark, sf_dir)
    return _round(spectral.scale_component(field, ["mem"], g.ny, g.nx, [3.0, 8.0], 1, g.size), "value")


@query()
def perturb_gaussian(spark, sf_dir):
    keys = spark.range(carriers.MEMBERS).select(F.col("id").cast("int").alias("mem"))
    return _round(spectral.random_fields(keys, ["mem"], carriers.rows(spark, sf_dir), carriers.NX, std=0.1, hcorr=5.0), "value")


@query(f"""WITH {_ENS} SELECT n.loc, n.mem, round(sqrt(1 - 0.75 ** 1.0) * n.value + coalesce(0, 0) + 0.75 ** 0.5 * o.value, 6) + 0.0 AS value FROM ens n JOIN ens o ON o.loc = n.loc AND o.mem = (n.mem + 1) % 20""")
def perturb_ar1(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    before = ens.withColumn("mem", (F.col("mem") + 19) % 20)
    return _round(spectral.blend(ens, before, ["loc", "mem"], spectral.memory_weight(6, 12)), "value")


_RING = "ring AS (SELECT mem, loc AS n, 8 * value AS x FROM ens)"


@query(f"""WITH {_ENS}, {_RING} SELECT e.mem, e.n::INT AS i, round(e.x + ((a.x - c.x) * b.x - e.x + 8) * 0.05, 6) + 0.0 AS value FROM ring e JOIN ring a ON a.mem = e.mem AND a.n = (e.n + 1) % (SELECT count(*) FROM embeddings)
JOIN ring b ON b.mem = e.mem AND b.n = (e.n + (SELECT count(*) FROM embeddings) - 1) % (SELECT count(*) FROM embeddings) JOIN ring c ON c.mem = e.mem AND c.n = (e.n + (SELECT count(*) FROM embeddings) - 2) % (SELECT count(*) FROM embeddings)""")
def ring_model_step(spark, sf_dir):
    return _round(spectral.ring_step(_ring(spark, sf_dir), 8.0, 0.05), "value")


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as one ring a member."""
    return carriers.ensemble(spark, sf_dir).select("mem", F.col("loc").cast("int").alias("i"), (8 * F.col("value")).alias("value"))


@query(f"""WITH RECURSIVE {_ENS}, {_RING}, run AS (SELECT mem, list(x ORDER BY n) AS a, 0 AS k FROM ring GROUP BY mem UNION ALL
SELECT mem, [a[i] + ((a[i % len(a) + 1] - a[(i + len(a) - 3) % len(a) + 1]) * a[(i + len(a) - 2) % len(a) + 1] - a[i] + 8) * 0.01 for i in range(1, len(a) + 1)], k + 1 FROM run WHERE k < 20)
SELECT mem, (g - 1)::INT AS i, round(a[g], 6) + 0.0 AS value FROM run, range(1, (SELECT count(*) + 1 FROM embeddings)) AS t(g) WHERE k = 20""")
def ring_model_run(spark, sf_dir):
    return _round(spectral.ring_run(_ring(spark, sf_dir), 8.0, 24.0, 0.01), "value")


@query(f"WITH {_OBS} SELECT date_trunc('day', t) + INTERVAL 6 HOUR * (hour(t) // 6) AS cycle, kind, count(*) AS n, round(avg(obs), 6) + 0.0 AS mean FROM obs GROUP BY ALL")
def cycle_counts(spark, sf_dir):
    from skerry.streaming.cycles import by_cycle

    return _round(by_cycle(_some_obs(spark, sf_dir), 6).select(F.col("cycle").cast("timestamp_ntz").alias("cycle"), "kind", "n", "mean"), "mean")


@query()
def cycle_twin(spark, sf_dir):
    from skerry.plans.cycle import twin_experiment

    return _round(twin_experiment(spark, _ring(spark, sf_dir).where("i < 40"), cycles=3), "prior_rmse", "post_rmse", "prior_spread", "post_spread")


# derived fields and resets


@query(f"WITH {_PROFILE}, s AS (SELECT pid, sum(f) AS total FROM profile GROUP BY pid) SELECT pid, round(CASE WHEN total < 0.15 THEN 0 ELSE total END, 6)::DOUBLE AS total FROM s")
def category_total(spark, sf_dir):
    return _round(fields.category_total(carriers.profiles(spark, sf_dir), ["pid"], "f", 0.15), "total")


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five thickness categories of each cell; a profile's levels fill one cell after the other."""
    return carriers.profiles(spark, sf_dir).select(
        (F.col("pid") * 100 + F.floor((F.col("lev") - 1) / 5)).alias("pid"), ((F.col("lev") - 1) % 5 + 1).alias("cat"), (F.col("f") * 2).alias("area"), (F.col("dz") / 50).alias("volume"), (F.col("pid") % 13 / 12.0).alias("wanted")
    )


_CATS = f"{_PROFILE}, cats AS (SELECT pid * 100 + (lev - 1) // 5 AS pid, (lev - 1) % 5 + 1 AS cat, f * 2 AS area, dz / 50 AS volume, pid % 13 / 12.0::DOUBLE AS wanted FROM profile)"


@query(f"""WITH {_CATS}, p AS (SELECT *, sum(area) OVER (PARTITION BY pid) AS prior FROM cats), s AS (SELECT *, CASE WHEN prior <= 0.01 OR wanted <= 0.01 THEN 0 ELSE least(wanted, 1) / prior END AS scale FROM p)
SELECT pid, cat, round(area * scale, 8) AS area, round(volume * scale, 8) AS volume FROM s""")
def category_rescale(spark, sf_dir):
    return _round(fields.rescale_categories(_categories(spark, sf_dir), ["pid"], "wanted", 0.01).select("pid", "cat", "area", "volume"), "area", "volume", digits=8)


@query(f"""WITH {_CATS}, b AS (SELECT * FROM (VALUES (1, 0.0, 0.3), (2, 0.3, 0.7), (3, 0.7, 1.2), (4, 1.2, 2.0), (5, 2.0, 999.0)) AS t(cat, low, high))
SELECT pid, cat, round(CASE WHEN area > 0 THEN least(greatest(volume, area * low::DOUBLE), area * high::DOUBLE) ELSE 0 END, 6) AS volume FROM cats JOIN b USING (cat)""")
def category_bounds(spark, sf_dir):
    return _round(fields.bound_thickness(_categories(spark, sf_dir), physics.category_bounds(5, 2)).select("pid", "cat", "volume"), "volume")


@query(f"""WITH {_PROFILE}, s AS (SELECT pid, lev, value AS m, sum(dz) OVER l AS p, f, lead(f) OVER l AS below FROM profile WINDOW l AS (PARTITION BY pid ORDER BY lev))
SELECT pid, round((arg_max(m, lev) + sum(coalesce(p * (f - below), 0))) / 9.806, 6) AS height FROM s GROUP BY pid""")
def column_height(spark, sf_dir):
    layers = carriers.profiles(spark, sf_dir).select("pid", "lev", F.col("dz").alias("dp"), F.col("f").alias("alpha"), F.col("value").alias("montgomery"))
    return _round(fields.surface_height(layers, ["pid"]), "height")


@query(f"WITH {_ENS} SELECT mem, round(max(value), 6) AS value, arg_max(j, (value, -j, -i)) AS j, arg_max(i, (value, -j, -i)) AS i FROM ens GROUP BY mem")
def field_maximum(spark, sf_dir):
    return _round(fields.maximum(carriers.ensemble(spark, sf_dir), ["mem"]), "value")


@query(f"WITH {_ENS} SELECT a.loc, round(sum(b.value), 6) + 0.0 AS total FROM ens a JOIN ens b ON a.mem = 0 AND b.mem = 0 AND abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3 GROUP BY a.loc")
def box_sum(spark, sf_dir):
    return _round(fields.box_sums(carriers.ensemble(spark, sf_dir).where("mem = 0"), ["mem"], 3).select("loc", "total"), "total")


@query(f"WITH {_ENS} SELECT mem, floor(sqrt((i - 12) ** 2 + (j - 10) ** 2))::INT AS r, round(avg(value), 6) + 0.0 AS value FROM ens GROUP BY ALL")
def radial_profile(spark, sf_dir):
    return _round(fields.radial_profile(carriers.ensemble(spark, sf_dir), ["mem"], F.lit(12), F.lit(10)), "value")


@query(f"""WITH {_ENS}, p AS (SELECT mem, floor(sqrt((i - 12) ** 2 + (j - 10) ** 2))::INT AS r, avg(value) AS v FROM ens GROUP BY ALL), n AS (SELECT *, lead(v) OVER (PARTITION BY mem ORDER BY r) AS a FROM p)
SELECT mem, round(max(CASE WHEN v >= 0.01 THEN r + coalesce((v - 0.01) / (v - a), 0) END), 6) AS radius FROM n GROUP BY mem""")
def vortex_size(spark, sf_dir):
    profile = fields.radial_profile(carriers.ensemble(spark, sf_dir), ["mem"], F.lit(12), F.lit(10))
    return _round(fields.outer_radius(profile, ["mem"], 0.01), "radius")


@query(f"""WITH {_ENS}, n AS (SELECT loc, value AS x, lag(value) OVER l AS b, lead(value) OVER l AS a, lag(value, 2) OVER l AS b2, lead(value, 2) OVER l AS a2 FROM ens WHERE mem = 0 WINDOW l AS (PARTITION BY j ORDER BY i))
SELECT loc, round(coalesce((b + x) / 2, (15 * x - 10 * a + 3 * a2) / 8), 6) + 0.0 AS low, round(coalesce((x + a) / 2, (15 * x - 10 * b + 3 * b2) / 8), 6) + 0.0 AS high FROM n""")
def grid_corners(spark, sf_dir):
    line = carriers.ensemble(spark, sf_dir).where("mem = 0").select("loc", "i", "j", F.col("value").alias("x"))
    return _round(fields.corners(line, ["j"]).select("loc", "low", "high"), "low", "high")


@query(f"WITH {_ENS}, m AS (SELECT mem, avg(value) AS fill FROM ens WHERE j = {_NY} - 2 GROUP BY mem) SELECT loc, mem, round(CASE WHEN j = {_NY} - 1 AND i < 5 THEN fill ELSE value END, 6) + 0.0 AS value FROM ens JOIN m USING (mem)")
def grid_pole_fill(spark, sf_dir):
    top = carriers.rows(spark, sf_dir) - 1
    ens = carriers.ensemble(spark, sf_dir).withColumn("value", F.when((F.col("j") == top) & (F.col("i") < 5), None).otherwise(F.col("value")))
    return _round(fields.fill_pole(ens, ["mem"], top, top - 1).select("loc", "mem", "value"), "value")


@query(f"WITH {_CELLS}, s AS (SELECT p_partkey, greatest(31, least(36.5, saln)) AS saln, temp - 3 AS temp FROM cells) SELECT p_partkey, round(saln, 6)::DOUBLE AS saln, round(greatest(-0.057 * saln, least(28, temp)), 6)::DOUBLE AS temp FROM s")
def range_reset(spark, sf_dir):
    cells = carriers.cells(spark, sf_dir).select("p_partkey", "saln", (F.col("temp") - 3).alias("temp"))
    return _round(fields.reset_ranges(cells, 31.0, 36.5, 28.0), "saln", "temp")


@query("""WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), n AS (SELECT *, -abs(b) / 2 - abs(c) / 2 AS low FROM m),
f AS (SELECT *, CASE WHEN a + low < 0 THEN greatest((0 - a) / low, 0) ELSE 1 END AS k FROM n)
SELECT vec_id, round(greatest(a, 0), 6) + 0.0 AS mean, round(b * k, 6) + 0.0 AS sx, round(c * k, 6) + 0.0 AS sy FROM f""")
def slope_limiter(spark, sf_dir):
    cells = carriers.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("modes"))
    out = fields.limit_slopes(cells, "modes", [[a / 2, b / 2] for a in (-1, 0, 1) for b in (-1, 0, 1)], least=0.0)
    return _round(out.select("vec_id", *[F.col("modes")[k].alias(n) for k, n in enumerate(("mean", "sx", "sy"))]), "mean", "sx", "sy")


@query(f"""WITH {_ENS}, n AS (SELECT e.loc, e.mem, w.value AS w, x.value AS x, s.value AS s, t.value AS t FROM ens e JOIN ens w ON w.mem = e.mem AND w.j = e.j AND w.i = (e.i + 24) % 25 JOIN ens x ON x.mem = e.mem AND x.j = e.j AND x.i = (e.i + 1) % 25
JOIN ens s ON s.mem = e.mem AND s.i = e.i AND s.j = (e.j + {_NY} - 1) % {_NY} JOIN ens t ON t.mem = e.mem AND t.i = e.i AND t.j = (e.j + 1) % {_NY}) SELECT loc, mem, round(-(t - s) / 2 / 1.2, 6) + 0.0 AS u, round((x - w) / 2 / 1.2, 6) + 0.0 AS v FROM n""")
def wind_from_pressure(spark, sf_dir):
    return _round(fields.geostrophic(carriers.ensemble(spark, sf_dir), ["mem"], 1.0, 1.2, 1.0, _ring_rows(spark, sf_dir)).select("loc", "mem", "u", "v"), "u", "v")


@query(f"""WITH {_ENS}, e AS (SELECT i, j, value FROM ens WHERE mem = 0), n AS (SELECT a.i, a.j, a.value AS a, b.value AS b, c.value AS c, d.value AS d FROM e a JOIN e b ON b.j = a.j AND b.i = (a.i + 1) % 25 JOIN e c ON c.i = a.i AND c.j = (a.j + 1) % {_NY} JOIN e d ON d.i = (a.i + 1) % 25 AND d.j = (a.j + 1) % {_NY})
SELECT 2 * i + p AS i, 2 * j + q AS j, round(CASE WHEN p = 0 AND q = 0 THEN a WHEN q = 0 THEN (a + b) / 2 WHEN p = 0 THEN (a + c) / 2 ELSE (a + b + c + d) / 4 END, 6) + 0.0 AS value FROM n, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS t(p, q)""")
def grid_refine(spark, sf_dir):
    field = carriers.ensemble(spark, sf_dir).where("mem = 0").select("mem", "i", "j", "value")
    return _round(fields.refine(field, ["mem"], carriers.NX, carriers.rows(spark, sf_dir)).select("i", "j", "value"), "value")


@query("""SELECT event_id, round(value, 6) AS z FROM events WHERE ts > TIMESTAMP '2024-01-12 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00' AND value > 100 AND value <= 200""")
def obs_slice(spark, sf_dir):
    rows = fields.slice_at(carriers.table(spark, sf_dir, "events"), "ts", F.lit("2024-01-12 00:00:00").cast("timestamp_ntz"), 12, "value", 100.0, 200.0)
    return _round(rows.select("event_id", F.col("value").alias("z")), "z")


# trajectories, networks, the serial filter and whole analyses


@query(f"WITH {_ENS}, {_TWO}, r AS (SELECT loc, mem, value + rho * cov / vb * step AS value FROM e1 JOIN s2 USING (mem) JOIN c2 USING (loc) JOIN rho2 USING (loc)) SELECT loc, mem, round(value, 6) + 0.0 AS value FROM r")
def eakf_serial_rounds(spark, sf_dir):
    obs = spark.createDataFrame([(0, 12.0, 12.0, 0.3, 0.1), (1, 13.0, 13.0, -0.2, 0.2)], "obs_id bigint, x double, y double, obs double, err_std double")
    ens = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    prior = ens.where("loc in (312, 338)").select(F.when(F.col("loc") == 312, 0).otherwise(1).cast("bigint").alias("obs_id"), "mem", "value")
    return _round(serial.assimilate(ens, GRID(spark, sf_dir).points(spark), prior, obs, 5.0), "value")


@query(f"""WITH e AS (SELECT event_id, ts, user_id, (event_id * 7 % 2400) / 100 AS x, (event_id * 13 % (100 * {_NY} - 100)) / 100 AS y FROM events), a AS (SELECT user_id AS traj, arg_min(event_id, (abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10')), epoch_us(ts))) AS e0 FROM e WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10')) <= 432000000000 GROUP BY user_id),
b AS (SELECT user_id AS traj, arg_min(event_id, (abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-20')), epoch_us(ts))) AS e1 FROM e WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-20')) <= 432000000000 GROUP BY user_id)
SELECT traj, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM a JOIN b USING (traj) JOIN e p ON p.event_id = e0 JOIN e q ON q.event_id = e1 WHERE p.ts < q.ts""")
def trajectory_pairs(spark, sf_dir):
    rows = _some_obs(spark, sf_dir).join(carriers.table(spark, sf_dir, "events").select(F.col("event_id").alias("obs_id"), F.col("user_id").alias("traj")), "obs_id")
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")
    return trajectories.pairs(rows.select("traj", "x", "y", "t"), at(10), at(20), 120, least=1).select("traj", "x0", "y0", "x1", "y1")


@query(f"WITH {_ENS}, b AS (SELECT loc AS node, value FROM ens WHERE mem = 0 AND loc % 3 <> 0), a AS (SELECT loc AS node, value FROM ens WHERE mem = 1 AND loc % 4 <> 0) SELECT node, round((a.value - b.value) / 2, 6) + 0.0 AS u FROM b JOIN a USING (node)")
def node_drift(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir).select(F.col("loc").alias("node"), "mem", F.col("value").alias("x"), F.col("value").alias("y"))
    return _round(trajectories.node_drift(ens.where("mem = 0 and node % 3 <> 0"), ens.where("mem = 1 and node % 4 <> 0"), 2.0).select("node", "u"), "u")


@query(f"""WITH {_ENS}, {_OBS}, {_WEIGHTS}, f AS (SELECT loc, max(CASE WHEN mem = 0 THEN value END) AS u, max(CASE WHEN mem = 1 THEN value END) AS v FROM ens GROUP BY loc), a AS (SELECT obs_id, sum(w * u) AS u, sum(w * v) AS v FROM w JOIN f USING (loc) GROUP BY obs_id)
SELECT obs_id, round(x + u, 6) AS x, round(y + v, 6) AS y FROM obs JOIN a USING (obs_id)""")
def advect_points(spark, sf_dir):
    flow = carriers.ensemble(spark, sf_dir).where("mem < 2").groupBy("loc").pivot("mem", [0, 1]).agg(F.first("value")).toDF("loc", "u", "v")
    return _round(trajectories.advect(_some_obs(spark, sf_dir).select("obs_id", "x", "y"), flow, GRID(spark, sf_dir), "obs_id", 1, 1.0), "x", "y")


@query(f"""WITH {_ENS}, e AS (SELECT i, j, loc, value FROM ens WHERE mem = 0), n AS (SELECT a.loc, a.value AS own, b.value AS b, c.value AS c, d.value AS d FROM e a LEFT JOIN e b ON b.j = a.j AND b.i = a.i - 1 LEFT JOIN e c ON c.i = a.i AND c.j = a.j - 1 LEFT JOIN e d ON d.i = a.i - 1 AND d.j = a.j - 1)
SELECT loc, round(coalesce(own * 0.75 * 0.5 + b * 0.25 * 0.5 + c * 0.75 * 0.5 + d * 0.25 * 0.5, own), 6) + 0.0 AS value FROM n""")
def grid_warp(spark, sf_dir):
    field = carriers.ensemble(spark, sf_dir).where("mem = 0").select("loc", "value")
    shift = GRID(spark, sf_dir).points(spark).select("loc", F.lit(0.25).alias("u"), F.lit(0.5).alias("v"))
    return _round(trajectories.warp(field, shift, GRID(spark, sf_dir), []), "value")


@query()
def synthetic_observations(spark, sf_dir):
    truth = carriers.ensemble(spark, sf_dir).where("mem = 0").select("loc", "value")
    masked = GRID(spark, sf_dir).points(spark).where("i < 5").select("loc")
    return _round(network.observe(network.network(spark, 3000, GRID(spark, sf_dir), masked), truth, GRID(spark, sf_dir), 0.1), "x", "y", "obs")


@query(f"WITH {_OBS} SELECT obs_id FROM obs WHERE (x - 12) ** 2 + (y - 9) ** 2 <= 16")
def network_around(spark, sf_dir):
    return network.around(_some_obs(spark, sf_dir), 12.0, 9.0, 4.0).select("obs_id")


@query("SELECT vec_id AS loc, (vec_id // 25 % 4 * 5 + vec_id % 25 % 5)::INT AS par_id FROM embeddings")
def tile_strided(spark, sf_dir):
    return local.strided(GRID(spark, sf_dir).points(spark), 5, 4).select("loc", "par_id")


@query(f"WITH {_ENS} SELECT loc, mem, round(least(0.5, value + 0.25), 6)::DOUBLE AS value FROM ens")
def perturb_bounded(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    return _round(spectral.apply_perturbation(ens, ens.withColumn("value", F.lit(0.25)), ["loc", "mem"], high=0.5), "value")


@query(f"WITH {_ENS}, t AS (SELECT loc, value AS truth FROM ens WHERE mem = 0) SELECT mem, round(sqrt(avg((value - truth) ** 2)), 6) AS rmse, round(corr(value, truth), 6) AS corr FROM ens JOIN t USING (loc) WHERE mem > 0 GROUP BY mem")
def ens_rmse_corr(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir)
    met = ens.where("mem > 0").join(ens.where("mem = 0").select("loc", F.col("value").alias("truth")), "loc")
    return _round(met.groupBy("mem").agg(stats.rmse("value", "truth").alias("rmse"), F.corr("value", "truth").alias("corr")), "rmse", "corr")


def _analysis(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    from skerry.plans.analysis import Settings, analyse

    obs = observations.in_window(_some_obs(spark, sf_dir), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), -1, 0.5)
    out = analyse(carriers.ensemble(spark, sf_dir), obs, GRID(spark, sf_dir), Settings(method=method, post="post,rtpp"))
    return _round(out.increment, "increment")


@query()
def analysis_etkf(spark, sf_dir):
    return _analysis(spark, sf_dir, "etkf")


@query()
def analysis_eakf(spark, sf_dir):
    return _analysis(spark, sf_dir, "eakf")


# calendars, the vortex, mappings


@query("""SELECT event_id, ((year(ts) - 1) * 360 + dayofyear(ts) + hour(ts) / 24 - 16)::DOUBLE AS d360, ((year(ts) - 1) * 366 + dayofyear(ts) + hour(ts) / 24 - 16)::DOUBLE AS d366,
(date_diff('day', DATE '1900-12-31', ts::DATE) + hour(ts) / 24)::DOUBLE AS calendar, date_diff('day', DATE '1950-01-01', ts::DATE)::INT AS since_1950 FROM events""")
def model_days(spark, sf_dir):
    t = F.col("ts")
    return carriers.table(spark, sf_dir, "events").select(
        "event_id", calendar.model_day(calendar.MONTHS_360, t).alias("d360"), calendar.model_day(calendar.LEAP_16, t).alias("d366"), calendar.model_day(calendar.CALENDAR, t).alias("calendar"), calendar.days_since_1950(t).alias("since_1950")
    )


@query("""WITH p AS (SELECT vec_id AS loc, vec_id % 25 - 12.3::DOUBLE AS dx, vec_id // 25 - 9.6::DOUBLE AS dy FROM embeddings), r AS (SELECT *, sqrt(dx * dx + dy * dy) AS r FROM p), w AS (SELECT *, CASE WHEN r <= 4 THEN 35 * r / 4 ELSE 35 * pow(4 / r, 1.5) END AS s FROM r)
SELECT loc, round(-s * dy / r, 6) + 0.0 AS u, round(s * dx / r, 6) + 0.0 AS v FROM w""")
def rankine_vortex(spark, sf_dir):
    return _round(models.rankine_vortex(GRID(spark, sf_dir).points(spark), 35.0, 4.0, F.lit(12.3), F.lit(9.6)).select("loc", "u", "v"), "u", "v")


@query(f"""WITH {_OBS}, m AS (SELECT obs_id, radians(x * 14) AS lo, tan(radians(90 - (y % 19 * 4 + 5)) / 2) AS r FROM obs), z AS (SELECT obs_id, r * cos(lo) AS x, r * sin(lo) AS y FROM m),
k AS (SELECT tan(radians(15)) AS a, tan(radians(60)) AS b), c AS (SELECT a, -b AS b, tan(radians(90 - degrees(asin((sin(radians(60)) + sin(radians(-30))) / sqrt(2)))) / 2) AS zc FROM k),
q AS (SELECT obs_id, (x - a) AS ux, y AS uy, (x - b) AS lx, (zc - b) / (zc - a) AS f FROM z, c), w AS (SELECT obs_id, f * (ux * lx + uy * uy) / (lx * lx + uy * uy) AS wx, f * (uy * lx - ux * uy) / (lx * lx + uy * uy) AS wy FROM q)
SELECT obs_id, round(degrees(atan2(wy, wx)), 5) + 0.0 AS lon, round(90 - 2 * degrees(atan(sqrt(wx * wx + wy * wy))), 5) + 0.0 AS lat FROM w""".replace("tan(radians(90 - degrees(asin((sin(radians(60)) + sin(radians(-30))) / sqrt(2)))) / 2) AS zc", "sign(cos(radians(60)) - cos(radians(30))) * tan((pi() / 2 - asin((sin(radians(60)) + sin(radians(-30))) / sqrt(pow(cos(radians(60)) - cos(radians(30)), 2) + pow(sin(radians(60)) + sin(radians(-30)), 2)))) / 2) AS zc"))
def two_pole_mapping(spark, sf_dir):
    lon, lat = models.two_pole_mapping(F.col("x") * 14, F.col("y") % 19 * 4 + 5, (0.0, 60.0), (180.0, -30.0))
    return _round(_some_obs(spark, sf_dir).select("obs_id", lon.alias("lon"), lat.alias("lat")), "lon", "lat", digits=5)


@query("SELECT event_id, unnest(generate_series(ts::DATE, (ts + INTERVAL 72 HOUR)::DATE, INTERVAL 2 DAY))::DATE AS file FROM events")
def forcing_files(spark, sf_dir):
    dates = calendar.file_dates(F.col("ts"), F.col("ts") + F.expr("interval 72 hours"), 2)
    return carriers.table(spark, sf_dir, "events").select("event_id", F.explode(dates).alias("file"))


# whole records: localization, observation operators, tiles

_RECORDS = """orec AS (SELECT * FROM (VALUES ('click', 2.0, 8.0, 12.0, MAP {'salt': 0.5}), ('error', 1.5, 6.0, 9.0, MAP {'temp': 0.0}), ('purchase', 1.0, 12.0, 6.0, MAP {'salt': 1.5}), ('signup', 2.0, 5.0, 24.0, MAP {'none': 0.0}),
  ('view', 1.2, 9.0, 3.0, MAP {'salt': 0.25})) AS t(obs_rec, hroi, vroi, troi, impact)), srec AS (SELECT * FROM (VALUES (0, 'temp', 0.0, 0.0), (1, 'temp', 10.0, 0.0), (2, 'salt', 0.0, 6.0), (3, 'salt', 10.0, 6.0)) AS t(rec, name, z, t))"""


def _records(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Observation records with their radii and impact, and two levels of two variables at two times."""
    given = [("click", 2.0, 8.0, 12.0, {"salt": 0.5}), ("error", 1.5, 6.0, 9.0, {"temp": 0.0}), ("purchase", 1.0, 12.0, 6.0, {"salt": 1.5}), ("signup", 2.0, 5.0, 24.0, {"none": 0.0}), ("view", 1.2, 9.0, 3.0, {"salt": 0.25})]
    obs_records = spark.createDataFrame(given, "obs_rec string, hroi double, vroi double, troi double, impact map<string, double>")
    state_records = spark.createDataFrame([(0, "temp", 0.0, 0.0), (1, "temp", 10.0, 0.0), (2, "salt", 0.0, 6.0), (3, "salt", 10.0, 6.0)], "rec int, name string, z double, t double")
    return obs_records, state_records


@query(f"""WITH {_OBS}, {_RECORDS}, p AS (SELECT vec_id AS loc, (vec_id % 25)::DOUBLE AS px, (vec_id // 25)::DOUBLE AS py FROM embeddings), o AS (SELECT obs_id, kind AS obs_rec, x, y, (obs_id % 20)::DOUBLE AS oz, (hour(t))::DOUBLE AS ot FROM obs),
h AS (SELECT loc, obs_id, obs_rec, oz, ot, vroi, troi, impact, greatest(2 * sqrt((px - x) ** 2 + (py - y) ** 2) / hroi, 1e-10) AS r FROM o JOIN orec USING (obs_rec) JOIN p ON abs(px - x) < 2 AND abs(py - y) < 2),
g AS (SELECT loc, obs_id, obs_rec, oz, ot, vroi, troi, impact, {_GC} AS rho FROM h WHERE r < 2), v AS (SELECT g.*, rec, coalesce(element_at(impact, name)[1], 1.0) AS hit, abs(t - ot) AS ago, greatest(2 * abs(z - oz) / vroi, 1e-10) AS r FROM g, srec),
f AS (SELECT rec, loc, obs_id, rho * hit * exp(-ago / troi) * ({_GC}) AS rho FROM v) SELECT rec, loc, obs_id, round(rho, 9)::DOUBLE AS rho FROM f WHERE rho > 1e-8""")
def local_factors(spark, sf_dir):
    obs_records, state_records = _records(spark)
    obs = _some_obs(spark, sf_dir).select("obs_id", F.col("kind").alias("obs_rec"), "x", "y", (F.col("obs_id") % 20).cast("double").alias("z"), F.hour("t").cast("double").alias("t"))
    out = localization.factors(GRID(spark, sf_dir).points(spark), state_records, obs, obs_records)
    return _round(out.where("rho > 1e-8"), "rho", digits=9)


@query("""WITH v(name) AS (VALUES ('temp'), ('salt'), ('ice')) SELECT p_partkey AS obs_rec, name, CASE WHEN name = CASE p_size % 3 WHEN 0 THEN 'temp' WHEN 1 THEN 'salt' ELSE 'ice' END THEN p_size / 10.0 ELSE 1 END::DOUBLE AS impact FROM part, v""")
def obs_impact(spark, sf_dir):
    """Every part as an observation record with an impact of its own on one of three variables."""
    named = F.element_at(F.array(F.lit("temp"), F.lit("salt"), F.lit("ice")), (F.col("p_size") % 3 + 1).cast("int"))
    obs_records = carriers.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obs_rec"), F.create_map(named, F.col("p_size") / 10.0).alias("impact"))
    return localization.impact_of(obs_records, spark.createDataFrame([("temp",), ("salt",), ("ice",)], "name string"))


@query("""WITH g AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, n_regionkey / 10.0 - 0.2 AS corr FROM nation WHERE n_nationkey % 2 = 0), both_ AS (SELECT a, b, corr FROM g UNION ALL SELECT b, a, corr FROM g), m AS (SELECT a, b, max(corr) AS corr FROM both_ GROUP BY a, b)
SELECT p.n_nationkey AS a, q.n_nationkey AS b, round(coalesce(m.corr, CASE WHEN p.n_nationkey = q.n_nationkey THEN 1 ELSE 0 END), 6)::DOUBLE AS corr FROM nation p, nation q LEFT JOIN m ON m.a = p.n_nationkey AND m.b = q.n_nationkey""")
def error_correlation(spark, sf_dir):
    """Error correlations between the nations as observation records."""
    nation = carriers.table(spark, sf_dir, "nation")
    given = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"), (F.col("n_regionkey") / 10.0 - 0.2).alias("corr"))
    return _round(localization.cross_correlation(nation.select(F.col("n_nationkey").alias("obs_rec")), given), "corr")


@query(f"""WITH {_ENS}, {_ONE}, recs AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 1.0), (1, 10.0, 6.0, 0.5)) AS t(rec, z, t, hit)), v AS (SELECT rec, hit, t, greatest(2 * abs(z - 4) / 12, 1e-10) AS r FROM recs), f AS (SELECT rec, hit * exp(-t / 24) * ({_GC}) AS f FROM v),
rr AS (SELECT rec, loc, rho * f AS rho FROM rho, f WHERE rho * f > 0), st AS (SELECT 0 AS rec, loc, mem, value FROM ens UNION ALL SELECT 1, loc, mem, 2 * value FROM ens),
s AS (SELECT rec, loc, mem, (prior - mb) * rr.rho / err / sqrt(19) AS s, (obs - mb) * rr.rho / err / sqrt(19) AS dy FROM hx, m, one, rr), q AS (SELECT rec, loc, sum(s * s) AS q FROM s GROUP BY rec, loc), xs AS (SELECT rec, loc, sum(value * s) AS xs FROM st JOIN s USING (rec, loc, mem) GROUP BY rec, loc)
SELECT e.rec, e.loc, e.mem, round(CASE WHEN s.s IS NULL THEN value ELSE value + xs * dy / (1 + q) + (1 / sqrt(1 + q) - 1) / q * xs * s.s END, 6) + 0.0 AS value FROM st e LEFT JOIN s USING (rec, loc, mem) LEFT JOIN q USING (rec, loc) LEFT JOIN xs USING (rec, loc)""")
def etkf_records_one_obs(spark, sf_dir):
    from skerry.plans.analysis import analyse_records

    ens, prior, _, _ = _one(spark, sf_dir)
    state = ens.select(F.lit(0).alias("rec"), "*").union(ens.select(F.lit(1), "loc", "mem", 2 * F.col("value")))
    state_records = spark.createDataFrame([(0, "a", 0.0, 0.0), (1, "b", 10.0, 6.0)], "rec int, name string, z double, t double")
    obs_records = spark.createDataFrame([("one", 5.0, 12.0, 24.0, {"b": 0.5})], "obs_rec string, hroi double, vroi double, troi double, impact map<string, double>")
    obs = spark.createDataFrame([(0, "one", 12.0, 12.0, 4.0, 0.0, 0.3, 0.1)], "obs_id bigint, obs_rec string, x double, y double, z double, t double, obs double, err_std double")
    observed = prior.select(F.lit(0).cast("bigint").alias("obs_id"), "mem", F.col("prior").alias("value"))
    return _round(analyse_records(state, state_records, obs, obs_records, observed, GRID(spark, sf_dir)), "value")


def _batch_one(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """The one observation at the point 312, analysed tile by tile."""
    ens, prior, obs, _ = _one(spark, sf_dir)
    one = obs.crossJoin(F.broadcast(stats.packed(prior.withColumn("k", F.lit(0)), "k", "prior", "priors"))).select(F.lit(0).cast("bigint").alias("obs_id"), F.lit(12.0).alias("x"), F.lit(12.0).alias("y"), "obs", "err_std", "priors")
    placed = _tiles(spark, sf_dir).select("loc", "x", "y", "par_id")
    halo = _halo(spark, sf_dir, one, 5.0)
    return _round(kernels.batch_analysis(ens.join(placed, "loc"), one, halo, 5.0, method), "value")


@query(ORACLE_SQL["etkf_one_obs"])
def etkf_tiles_one_obs(spark, sf_dir):
    return _batch_one(spark, sf_dir, "etkf")


@query(ORACLE_SQL["denkf_one_obs"])
def denkf_tiles_one_obs(spark, sf_dir):
    return _batch_one(spark, sf_dir, "denkf")


@query()
def etkf_tiles(spark, sf_dir):
    obs = observations.in_window(_some_obs(spark, sf_dir), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), -12, 12)
    members = stats.packed(_prior(spark, sf_dir, obs), "obs_id", "value", "priors")
    state = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value").join(_tiles(spark, sf_dir).select("loc", "x", "y", "par_id"), "loc")
    halo = _halo(spark, sf_dir, obs, 3.0)
    return _round(kernels.batch_analysis(state, obs.select("obs_id", "x", "y", "obs", "err_std").join(members, "obs_id"), halo, 3.0), "value")


_FLOW = "flow AS (SELECT a.loc, a.mem, a.i, a.j, a.value AS u, b.value AS v FROM ens a JOIN ens b ON b.loc = a.loc AND b.mem = (a.mem + 1) % 20)"


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loc, mem, i, j, u, v``: a member and the next one as the components of a vector."""
    ens = carriers.ensemble(spark, sf_dir)
    after = ens.select("loc", F.pmod(F.col("mem") - 1, F.lit(carriers.MEMBERS)).alias("mem"), F.col("value").alias("v"))
    return ens.withColumnRenamed("value", "u").join(after, ["loc", "mem"])


@query(f"WITH {_ENS}, {_FLOW}, {_OBS}, {_WEIGHTS} SELECT obs_id, mem, round(sqrt(sum(w * u) ** 2 + sum(w * v) ** 2), 6) AS value FROM w JOIN flow USING (loc) GROUP BY obs_id, mem HAVING count(*) = 4")
def observe_speed(spark, sf_dir):
    return _round(observe.observe(_flow(spark, sf_dir), _some_obs(spark, sf_dir), GRID(spark, sf_dir), "speed"), "value")


@query(f"WITH {_ENS}, {_FLOW}, {_OBS}, {_WEIGHTS}, s AS (SELECT obs_id, mem, sum(w * u) + sum(w * v) AS s FROM w JOIN flow USING (loc) GROUP BY obs_id, mem HAVING count(*) = 4) SELECT obs_id, mem, round(CASE WHEN s < 0.1 THEN 0 ELSE s END, 6) + 0.0 AS value FROM s")
def observe_total(spark, sf_dir):
    return _round(observe.observe(_flow(spark, sf_dir), _some_obs(spark, sf_dir), GRID(spark, sf_dir), "total", names=("u", "v"), least=0.1), "value")


@query(f"WITH {_ENS}, {_FLOW}, {_OBS}, {_WEIGHTS} SELECT obs_id, mem, round(2 * sum(w * v), 6) + 0.0 AS value FROM w JOIN flow USING (loc) GROUP BY obs_id, mem HAVING count(*) = 4")
def observe_displacement(spark, sf_dir):
    return _round(observe.observe(_flow(spark, sf_dir), _some_obs(spark, sf_dir), GRID(spark, sf_dir), "displacement", days=2.0, component="v"), "value")


@query(f"WITH {_ENS} SELECT loc, mem, round(value - avg(value) OVER (PARTITION BY mem), 6) + 0.0 AS anomaly FROM ens")
def derived_anomaly(spark, sf_dir):
    return _round(observe.DERIVED["anomaly"](carriers.ensemble(spark, sf_dir)).select("loc", "mem", "anomaly"), "anomaly")


# more of the grid


@query(f"""WITH {_ENS}, n AS (SELECT loc, mem, i, j, lag(value) OVER l - 2 * value + lead(value) OVER l AS c FROM ens WINDOW l AS (PARTITION BY mem, j ORDER BY i))
SELECT loc, mem, round(coalesce(c, lead(c) OVER l, lag(c) OVER l), 6) + 0.0 AS curve FROM n WINDOW l AS (PARTITION BY mem, j ORDER BY i)""")
def grid_second_difference(spark, sf_dir):
    return _round(grid.second_difference(carriers.ensemble(spark, sf_dir), ["mem"]).select("loc", "mem", "curve"), "curve")


@query(f"""WITH {_ENS}, a AS (SELECT loc, mem, i, j, value, lag(value) OVER l AS b, lead(value) OVER l AS f FROM ens WINDOW l AS (PARTITION BY mem, i ORDER BY j)),
s AS (SELECT loc, mem, i, j, CASE WHEN b IS NULL THEN f - value WHEN f IS NULL THEN value - b ELSE (f - b) / 2 END AS s FROM a), c AS (SELECT loc, mem, s, lag(s) OVER l AS b, lead(s) OVER l AS f FROM s WINDOW l AS (PARTITION BY mem, j ORDER BY i))
SELECT loc, mem, round(CASE WHEN b IS NULL THEN f - s WHEN f IS NULL THEN s - b ELSE (f - b) / 2 END, 6) + 0.0 AS "cross" FROM c""")
def grid_mixed_difference(spark, sf_dir):
    return _round(grid.mixed_difference(carriers.ensemble(spark, sf_dir), ["mem"]).select("loc", "mem", "cross"), "cross")


@query(f"WITH {_ENS} SELECT loc, mem, round(coalesce((value + lead(value) OVER (PARTITION BY mem, i ORDER BY j)) / 2, value), 6) + 0.0 AS centre FROM ens")
def grid_destagger(spark, sf_dir):
    return _round(grid.destagger(carriers.ensemble(spark, sf_dir), ["mem"], "y").select("loc", "mem", "centre"), "centre")


_ARC = "6371 * acos(least(1, greatest(-1, sin(radians({a})) * sin(radians({b})) + cos(radians({a})) * cos(radians({b})) * cos(radians({d})))))"


@query(f"""WITH {_ENS}, p AS (SELECT loc, i, j, i * 2.0::DOUBLE AS lon, 10 + 60.0::DOUBLE * j / {_NY} AS lat FROM ens WHERE mem = 0), d AS (SELECT *, lead(lon) OVER a AS lon1, lead(lat) OVER a AS lat1, lead(lat) OVER b AS lat2 FROM p WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)),
f AS (SELECT loc, i, j, 200 / ({_ARC.format(a="lat", b="lat1", d="lon1 - lon")}) AS mfx, 300 / ({_ARC.format(a="lat", b="lat2", d="0")}) AS mfy FROM d)
SELECT loc, round(coalesce(mfx, lag(mfx) OVER (PARTITION BY j ORDER BY i)), 6) AS mfx, round(coalesce(mfy, lag(mfy) OVER (PARTITION BY i ORDER BY j)), 6) AS mfy FROM f""")
def grid_map_factors(spark, sf_dir):
    points = GRID(spark, sf_dir).points(spark).select("loc", "i", "j", (F.col("i") * 2.0).alias("lon"), (10 + 60.0 * F.col("j") / carriers.rows(spark, sf_dir)).alias("lat"))
    return _round(grid.map_factors(points, 200.0, 300.0, 6371.0), "mfx", "mfy")


@query(f"WITH {_ENS} SELECT loc, mem, CASE WHEN i < 5 THEN NULL ELSE round(value, 6) + 0.0 END AS value FROM ens")
def mask_field(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir)
    return _round(grid.masked(ens.select("loc", "mem", "value"), ens.where("i < 5 and mem = 0")).select("loc", "mem", "value"), "value")


@query(f"""WITH {_ENS}, {_OBS}, {_CELL_OF}, c AS (SELECT (j0 + CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) * 25 + i0 + CASE WHEN u >= 0.5 THEN 1 ELSE 0 END AS loc, avg(obs) AS m FROM corner GROUP BY 1 HAVING count(*) > 1)
SELECT loc, round(coalesce(m, value), 6) + 0.0 AS value FROM ens LEFT JOIN c USING (loc) WHERE mem = 0""")
def grid_regrid(spark, sf_dir):
    coarse = grid.coarse_grain(_some_obs(spark, sf_dir).withColumn("value", F.col("obs")), GRID(spark, sf_dir), [])
    return _round(grid.regrid(carriers.ensemble(spark, sf_dir).where("mem = 0").select("loc", "value"), coarse, ["loc"]), "value")


@query(f"WITH {_ENS}, {_FLOW} SELECT loc, mem, round(u * cos(radians(i * 3)) + v * sin(radians(i * 3)), 6) + 0.0 AS u, round(v * cos(radians(i * 3)) - u * sin(radians(i * 3)), 6) + 0.0 AS v FROM flow")
def grid_rotate(spark, sf_dir):
    u, v = grid.rotate(F.col("u"), F.col("v"), F.radians(F.col("i") * 3))
    return _round(_flow(spark, sf_dir).select("loc", "mem", u.alias("u"), v.alias("v")), "u", "v")


# more scalar functions


@query(f"WITH {_OBS} SELECT obs_id, round(x * 7, 6) + 0.0 AS lon, round(y % 19 * 4 + 5, 6) + 0.0 AS lat FROM obs")
def polar_inverse(spark, sf_dir):
    sx, sy = distance.stereographic(F.col("x") * 7, F.col("y") % 19 * 4 + 5)
    lon, lat = distance.stereographic_inverse(F.col("sx"), F.col("sy"))
    return _round(_some_obs(spark, sf_dir).select("obs_id", sx.alias("sx"), sy.alias("sy")).select("obs_id", lon.alias("lon"), lat.alias("lat")), "lon", "lat")


@query(f"""WITH {_CELLS}, c AS (SELECT p_partkey, temp, saln, greatest(-2, least(32, temp)) - 3 AS t, greatest(30, least(38, saln)) - 35 AS s, e * 1e4 - 2000e4 AS p FROM cells)
SELECT p_partkey, round(19.2362 + 0.773552 * saln + temp * (-0.088208 - 0.00231866 * saln + temp * (-0.00546858 + 2.82474e-05 * saln + 2.11306e-05 * temp)), 6) AS sigma4,
round(1e-8 * (p + 2000e4) * (s * (-0.105131 + t * 1.06829e-03) + t * (-0.241701 + t * (4.03001e-03 - t * 3.03869e-05) + 0.5 * (p - 2000e4) * (1.00638e-09 + s * 1.48599e-11 - t * 1.31384e-11))), 6) + 0.0 AS baric FROM c""")
def seawater_deep(spark, sf_dir):
    baric = physics.thermobaricity(0, F.col("temp"), F.col("saln"), F.col("e") * 1e4)
    out = carriers.cells(spark, sf_dir).select("p_partkey", physics.sea_density(4, F.col("temp"), F.col("saln")).alias("sigma4"), baric.alias("baric"))
    return _round(out, "sigma4", "baric")


@query(f"WITH {_OBS} SELECT obs_id, CASE WHEN obs_id % 3 > 0 THEN round((y - x) / (obs_id % 3), 6) + 0.0 END AS u FROM obs")
def drift_velocity(spark, sf_dir):
    return _round(_some_obs(spark, sf_dir).select("obs_id", observations.velocity(F.col("x"), F.col("y"), (F.col("obs_id") % 3).cast("double")).alias("u")), "u")


@query("SELECT event_id, (DATE '1900-12-31' + CAST(date_diff('day', DATE '1900-12-31', ts::DATE) AS INT))::DATE AS day, greatest(ts - INTERVAL 6 HOUR, TIMESTAMP '2024-01-05 00:00:00') AS before FROM events")
def calendar_back(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    before = units.cycle_before(t, 6, F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return carriers.table(spark, sf_dir, "events").select("event_id", calendar.date_of(calendar.model_day(calendar.CALENDAR, t)).alias("day"), before.cast("timestamp_ntz").alias("before"))


@query(f"""WITH {_ENS} SELECT n.loc, n.mem, round(sqrt(1 - exp(-1.0)) * n.value + exp(-0.5) * o.value, 6) + 0.0 AS value FROM ens n JOIN ens o ON o.loc = n.loc AND o.mem = (n.mem + 1) % 20""")
def perturb_ar1_exponential(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    before = ens.withColumn("mem", F.pmod(F.col("mem") - 1, F.lit(carriers.MEMBERS)))
    return _round(spectral.blend(ens, before, ["loc", "mem"], spectral.memory_weight_exponential(6, 12)), "value")


@query()
def displacement_fields(spark, sf_dir):
    keys = spark.range(carriers.MEMBERS).select(F.col("id").cast("int").alias("mem"))
    ens = carriers.ensemble(spark, sf_dir).where("mem = 0")
    shore = distance_field.distance_to_mask(distance_field.shore_mask(ens.select("i", "j"), ens.where("value > 0.12").select("i", "j"), carriers.NX, carriers.rows(spark, sf_dir)))
    return _round(spectral.displacement_fields(keys, ["mem"], carriers.rows(spark, sf_dir), carriers.NX, 0.5, 5.0, shore, 4.0), "u", "v")


# displacements, curvilinear grids, brightness temperatures


@query()
def align_field(spark, sf_dir):
    """How far the mean of the even members must move to become that of the odd ones; no SQL form, the sweeps run until they settle."""
    ens = carriers.ensemble(spark, sf_dir)
    side = lambda k: F.avg(F.when(F.col("mem") % 2 == k, F.col("value")))
    fields_ = ens.groupBy("i", "j").agg(side(0).alias("before"), side(1).alias("after")).withColumn("level", F.lit(0))
    ny = carriers.rows(spark, sf_dir)
    moved = alignment.displacement(fields_, ["level"], carriers.NX, ny)
    value = lambda c: fields_.select("level", "i", "j", F.col(c).alias("value"))
    out = alignment.aligned(value("before"), value("before"), value("after"), moved, ["level"], GRID(spark, sf_dir))
    return _round(moved.join(out, ["level", "i", "j"]).select("i", "j", "u", "v", "value"), "u", "v", "value")


# An ocean grid whose poles lie on land: a regular grid seen through the two-pole mapping.
_CURVED = f"""gz AS (SELECT vec_id AS loc, vec_id % 25 AS i, vec_id // 25 AS j, tan(radians(90 - ((vec_id // 25) * 150.0 / {_NY} - 70)) / 2) AS r, radians((vec_id % 25) * 14.4) AS a FROM embeddings WHERE vec_id < 25 * {_NY}),
gq AS (SELECT loc, i, j, r * cos(a) - tan(radians(15)) AS ux, r * sin(a) AS uy, r * cos(a) + tan(radians(60)) AS lx FROM gz),
gw AS (SELECT loc, i, j, (ux * lx + uy * uy) / (lx * lx + uy * uy) AS qx, (uy * lx - ux * uy) / (lx * lx + uy * uy) AS qy FROM gq),
gs AS (SELECT (cos(radians(60)) - cos(radians(30))) AS mx, (sin(radians(60)) + sin(radians(-30))) AS mz), gc AS (SELECT sign(mx) * tan((pi() / 2 - asin(mz / sqrt(mx * mx + mz * mz))) / 2) AS zc FROM gs),
gf AS (SELECT (zc + tan(radians(60))) / (zc - tan(radians(15))) AS f FROM gc),
curved AS (SELECT loc, i, j, degrees(atan2(f * qy, f * qx)) AS lon, 90 - 2 * degrees(atan(sqrt(f * f * (qx * qx + qy * qy)))) AS lat FROM gw, gf),
spots AS (SELECT obs_id, x * 14.4 - 179.63 AS lon, y * 150.0 / {_NY} - 74.89 AS lat FROM obs),
gap AS (SELECT obs_id, s.lon AS a_lon, s.lat AS a_lat, loc, i, j, 6371000 * acos(least(1, greatest(-1, sin(radians(s.lat)) * sin(radians(c.lat)) + cos(radians(s.lat)) * cos(radians(c.lat)) * cos(radians(c.lon - s.lon))))) AS gap FROM spots s, curved c)"""


def _curved(spark, sf_dir):
    """The curvilinear grid, its shape, and the positions that are sought in it."""
    ny = carriers.rows(spark, sf_dir)
    lon, lat = models.two_pole_mapping(F.col("i") * 14.4, F.col("j") * (150.0 / ny) - 70, (0.0, 60.0), (180.0, -30.0))
    points = GRID(spark, sf_dir).points(spark).where(F.col("j") < ny).select("loc", "i", "j", lon.alias("lon"), lat.alias("lat"))
    at = _some_obs(spark, sf_dir).select("obs_id", (F.col("x") * 14.4 - 179.63).alias("lon"), (F.col("y") * (150.0 / ny) - 74.89).alias("lat"))
    return points, ny, at


@query(f"WITH {_OBS}, {_CURVED} SELECT obs_id, round(min(gap), 3) AS gap, arg_min(loc, gap) AS pivot FROM gap GROUP BY obs_id")
def curvilinear_pivot(spark, sf_dir):
    points, ny, at = _curved(spark, sf_dir)
    return _round(curvilinear.pivots(at, points, "obs_id", carriers.NX, ny).select("obs_id", "pivot", "gap"), "gap", digits=3)


@query(f"""WITH {_OBS}, {_CURVED}, p AS (SELECT obs_id, any_value(a_lon) AS lon, any_value(a_lat) AS lat, arg_min(loc, gap) AS nearest FROM gap GROUP BY obs_id),
t(k, di2, dj2, di3, dj3) AS (VALUES (0, 1, 0, 1, 1), (1, 1, 1, 0, 1), (2, 0, 1, -1, 1), (3, -1, 1, -1, 0), (4, -1, 0, -1, -1), (5, -1, -1, 0, -1), (6, 0, -1, 1, -1), (7, 1, -1, 1, 0)),
m0 AS MATERIALIZED (SELECT p.*, t.*, c.i, c.j, c.lon AS lon1, c.lat AS lat1, (c.j + dj2) * 25 + (c.i + di2 + 25) % 25 AS loc2, (c.j + dj3) * 25 + (c.i + di3 + 25) % 25 AS loc3 FROM p JOIN curved c ON c.loc = p.nearest, t),
m AS (SELECT m0.*, b.lon AS lon2, b.lat AS lat2, d.lon AS lon3, d.lat AS lat3 FROM m0 JOIN curved b ON b.loc = loc2 JOIN curved d ON d.loc = loc3),
e AS (SELECT *, dist(lon, lat, lon1, lat1) AS d1, dist(lon, lat, lon2, lat2) AS d2, dist(lon, lat, lon3, lat3) AS d3, dist(lon2, lat2, lon3, lat3) AS s1, dist(lon3, lat3, lon1, lat1) AS s2, dist(lon1, lat1, lon2, lat2) AS s3 FROM m),
b AS (SELECT *, heron(s1, s2, s3) AS whole, heron(s1, d2, d3) AS a1, heron(s2, d1, d3) AS a2, heron(s3, d1, d2) AS a3 FROM e),
w AS (SELECT obs_id, k, i * (a1 + a2 + a3) / whole + (di2 * a2 + di3 * a3) / whole AS fi, j * (a1 + a2 + a3) / whole + (dj2 * a2 + dj3 * a3) / whole AS fj FROM b WHERE whole > 0 AND abs((a1 + a2 + a3) / whole - 1) <= 1e-3)
SELECT obs_id, round(arg_min(fi, k), 5) + 0.0 AS fi, round(arg_min(fj, k), 5) + 0.0 AS fj FROM p LEFT JOIN w USING (obs_id) GROUP BY obs_id""")
def curvilinear_index(spark, sf_dir):
    points, ny, at = _curved(spark, sf_dir)
    placed = curvilinear.pivots(at, points, "obs_id", carriers.NX, ny)
    return _round(curvilinear.grid_index(placed, points, "obs_id", carriers.NX, ny), "fi", "fj", digits=5)


def _inlined(sql: str) -> str:
    """The SQL with its two distance formulas written out."""
    import re

    sql = re.sub(r"dist\((\w+), (\w+), (\w+), (\w+)\)", r"(6371000 * acos(least(1, greatest(-1, sin(radians(\2)) * sin(radians(\4)) + cos(radians(\2)) * cos(radians(\4)) * cos(radians(\3 - \1))))))", sql)
    return re.sub(r"heron\((\w+), (\w+), (\w+)\)", r"sqrt(greatest(0, (\1 + \2 + \3) / 2 * ((\2 + \3 - \1) / 2) * ((\1 + \3 - \2) / 2) * ((\1 + \2 - \3) / 2)))", sql)


ORACLE_SQL["curvilinear_index"] = _inlined(ORACLE_SQL["curvilinear_index"])


@query("""WITH c(channel, vert, freq, b0, b1, b2, b3, b4, b5, b6, b7, o1, o2, v1, v2, l1, l2, r0, r1, r2, r3, f1, f2) AS (VALUES
('19v', true, 18.70, 240.24, 298.88e-2, -725.93e-4, 814.50e-6, -36.07e-7, 0.61, -0.16, -1.69e-2, 12.15e-3, -0.61e-4, 1.73e-3, -0.05e-5, 0.0556, 0.0288, -0.49e-3, -0.53e-4, -2.10e-5, 0.31e-6, 0.00140, 0.00736),
('19h', false, 18.70, 240.24, 298.88e-2, -725.93e-4, 814.50e-6, -36.07e-7, 0.61, -0.16, -1.69e-2, 12.15e-3, -0.61e-4, 1.73e-3, -0.05e-5, 0.0556, 0.0288, 1.13e-3, 0.70e-4, -36.90e-6, -0.12e-6, 0.00293, 0.00656),
('37v', true, 36.50, 239.45, 254.41e-2, -512.84e-4, 452.02e-6, -14.36e-7, 0.58, -0.57, -2.38e-2, 40.06e-3, -2.00e-4, 1.88e-3, 0.09e-5, 0.2027, 0.0261, -1.01e-3, -1.05e-4, -2.10e-5, 0.45e-6, 0.00257, 0.00701)),
x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '19v' WHEN 1 THEN '19h' ELSE '37v' END AS channel, p_partkey % 12 + 1 AS month, (p_size % 30) * 2.0::DOUBLE AS vap, (p_size % 20)::DOUBLE AS wind, p_size % 7 / 20.0::DOUBLE AS liq,
  265.0 + p_partkey % 40::DOUBLE AS ts, p_size / 60.0::DOUBLE AS ice, 50.0 + p_size % 10::DOUBLE AS ang, p_partkey % 50::DOUBLE AS dal FROM part),
y AS (SELECT x.*, c.* EXCLUDE channel, ts - 273.15 AS t, 25 - (ts - 273.15) AS cold, 0.5536 * 35 AS chl, 30.0 / freq AS wl, CASE channel WHEN '19v' THEN 0.9 WHEN '19h' THEN 0.8 ELSE 0.85 END AS pc, month * 0.1 AS bias FROM x JOIN c USING (channel)),
e1 AS (SELECT *, 87.90 * exp(-0.004585 * t) * exp(-3.45e-3 * 35 + 4.69e-6 * 1225 + 1.36e-5 * 35 * t) - 4.44 AS st, pow((3.30 * exp(-0.0346 * t + 0.00017 * t * t) - 6.54e-3 * (1 - 3.06e-2 * t + 2e-4 * t * t) * 35) / wl, 0.988) AS rel,
  3.39e9 * pow(chl, 0.892) * exp(-cold * (2.03e-2 + 1.27e-4 * cold + 2.46e-6 * cold * cold - chl * (3.34e-5 - 4.60e-7 * cold + 4.60e-8 * cold * cold))) AS sig FROM y),
e2 AS (SELECT *, 1 + rel * cos(0.988 * pi() / 2) AS dr, rel * sin(0.988 * pi() / 2) AS di FROM e1), e3 AS (SELECT *, 4.44 + st * dr / (dr * dr + di * di) AS er, -st * di / (dr * dr + di * di) - 2 * sig * wl / 3e10 AS ei, cos(radians(ang)) AS ct, sin(radians(ang)) AS sn FROM e2),
e4 AS (SELECT *, sqrt((er - sn * sn) * (er - sn * sn) + ei * ei) AS md FROM e3), e5 AS (SELECT *, sqrt((md + er - sn * sn) / 2) AS qr, -sqrt((md - er + sn * sn) / 2) AS qi, CASE WHEN vert THEN er * ct ELSE ct END AS nr, CASE WHEN vert THEN ei * ct ELSE 0 END AS ni FROM e4),
e6 AS (SELECT *, (pow(nr - qr, 2) + pow(ni - qi, 2)) / (pow(nr + qr, 2) + pow(ni + qi, 2)) + CASE WHEN vert THEN 4.887e-8 - 6.108e-8 * pow(ts - 273, 3) ELSE 0 END - (r0 + r1 * (ang - 53) + r2 * (ts - 288) + r3 * (ang - 53) * (ts - 288)) * wind AS rf, CASE WHEN vert THEN 3 ELSE 7 END AS w1 FROM e5),
e7 AS (SELECT *, 1 - (1 - CASE WHEN wind <= w1 THEN f1 * wind WHEN wind < 12 THEN f1 * wind + 0.5 * (f2 - f1) * pow(wind - w1, 2) / (12 - w1) ELSE f2 * wind - 0.5 * (f2 - f1) * (12 + w1) END) * rf AS sea,
  ts - CASE WHEN vap <= 48 THEN 273.16 + 0.8337 * vap - 3.029e-5 * pow(vap, 3.33) ELSE 301.16 END AS g FROM e6),
e8 AS (SELECT *, b0 + b1 * vap + b2 * pow(vap, 2) + b3 * pow(vap, 3) + b4 * pow(vap, 4) + b5 * CASE WHEN abs(g) <= 20 THEN 1.05 * g * (1 - g * g / 1200) ELSE 14 * sign(g) END AS td, least(1, ice) AS sic FROM e7),
e9 AS (SELECT *, exp(-(o1 + o2 * (td - 270) + v1 * vap + v2 * vap * vap + l1 * (1 - l2 * ((ts + 273) / 2 - 283)) * liq) / ct) AS tau, (1 - sic) * sea + sic * (0.0005 * ts + 0.001 * dal + pc - 0.15) AS em FROM e8)
SELECT p_partkey, channel, round((td + b6 + b7 * vap) * (1 - tau) + tau * (em * ts + td * (1 - tau) * (1 - em)) - CASE WHEN sic >= 0.15 THEN 0 ELSE bias END, 4) AS tb FROM e9""")
def brightness_temperature(spark, sf_dir):
    channel = F.element_at(F.array(F.lit("19v"), F.lit("19h"), F.lit("37v")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = carriers.table(spark, sf_dir, "part").select(
        "p_partkey", channel.alias("channel"), F.make_date(F.lit(2024), F.col("p_partkey") % 12 + 1, F.lit(15)).alias("date"), (F.col("p_size") % 30 * 2.0).alias("vapour"), (F.col("p_size") % 20).cast("double").alias("wind"),
        (F.col("p_size") % 7 / 20.0).alias("liquid"), (F.col("p_partkey") % 40 + 265.0).alias("surface"), (F.col("p_size") / 60.0).alias("ice"), (F.col("p_size") % 10 + 50.0).alias("angle"), (F.col("p_partkey") % 50).cast("double").alias("along_line"),
    )
    planes = rows.select("channel", "date").distinct().select("channel", "date", F.lit(0.0005).alias("a1"), F.lit(0.001).alias("a2"), (F.when(F.col("channel") == "19v", 0.9).when(F.col("channel") == "19h", 0.8).otherwise(0.85) - 0.15).alias("c"))
    biases = rows.select("channel", F.month("date").alias("month")).distinct().withColumn("bias", F.col("month") * 0.1)
    return _round(microwave.observed_channels(rows, planes, biases).select("p_partkey", "channel", "tb"), "tb", digits=4)


# archives of records


@query("""WITH r AS (SELECT l_suppkey AS field, l_linenumber AS level, l_extendedprice::DOUBLE AS value, l_orderkey, l_partkey FROM lineitem),
q AS (SELECT s_suppkey AS field, level::INT AS level FROM supplier, range(1, 9) AS t(level)),
l AS (SELECT field, level, arg_max(value, (l_orderkey, l_partkey, value)) AS value FROM r GROUP BY field, level) SELECT field, level, round(value, 2) AS value FROM q LEFT JOIN l USING (field, level)""")
def archive_last_match(spark, sf_dir):
    records = carriers.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("field"), F.col("l_linenumber").alias("level"), F.col("l_extendedprice").cast("double").alias("value"), "l_orderkey", "l_partkey")
    requests = carriers.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("field"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("level"))
    return _round(asof.last_match(requests, records, ["field", "level"], ["l_orderkey", "l_partkey", "value"], ["value"], missing="null"), "value", digits=2)


@query("""WITH r AS (SELECT l_suppkey % 50 AS field, (l_shipdate - DATE '1992-01-01')::DOUBLE AS day, min(l_orderkey) AS value FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_orderkey FROM lineitem) GROUP BY ALL),
q AS (SELECT o_orderkey, o_custkey % 50 AS field, (CAST(o_orderdate AS DATE) - DATE '1992-01-01') + 0.25::DOUBLE AS day FROM orders),
n AS (SELECT o_orderkey, arg_min(r.day, (abs(r.day - q.day), r.day)) AS found_day, arg_min(r.value, (abs(r.day - q.day), r.day)) AS value FROM q JOIN r ON r.field = q.field AND abs(r.day - q.day) <= 1 GROUP BY o_orderkey)
SELECT o_orderkey, field, q.day, found_day, value FROM q LEFT JOIN n USING (o_orderkey)""")
def forcing_nearest_day(spark, sf_dir):
    since = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    records = carriers.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("field"), since("l_shipdate").cast("double").alias("day"), F.col("l_orderkey").alias("value"))
    requests = carriers.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("field"), (since("o_orderdate") + 0.25).alias("day"))
    return asof.nearest_day(requests, records, "field", "day", "value", missing="null")


# mesh topology, distance to a mask, points with a least distance

_LAYERS = f"""WITH RECURSIVE {_MESH}, side AS (SELECT n1 AS a, n2 AS b FROM mesh UNION ALL SELECT n2, n3 FROM mesh UNION ALL SELECT n3, n1 FROM mesh), link AS (SELECT a, b FROM side UNION SELECT b, a FROM side),
rim AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM side GROUP BY ALL HAVING count(*) = 1), walk(node, layer) AS (SELECT a, 0 FROM rim UNION SELECT b, 0 FROM rim UNION SELECT b, layer + 1 FROM walk JOIN link ON a = node WHERE layer < {{}}),
layers AS (SELECT node, min(layer) AS layer FROM walk GROUP BY node)"""


@query(_LAYERS.format(7) + " SELECT node, layer FROM layers")
def mesh_layers(spark, sf_dir):
    return mesh.layers(_mesh(spark, sf_dir)[0], 8)


@query(_LAYERS.format(4) + """ SELECT vec_id AS node, round(CAST(embedding[1] AS DOUBLE) * coalesce(layer, 5) / 5, 6) + 0.0 AS value FROM embeddings LEFT JOIN layers ON node = vec_id""")
def mesh_taper(spark, sf_dir):
    field = carriers.ensemble(spark, sf_dir).where("mem = 0").select(F.col("loc").alias("node"), "value")
    return _round(mesh.taper_boundary(field, _mesh(spark, sf_dir)[0], ["value"]), "value")


@query(_LAYERS.format(4) + """, n AS (SELECT vec_id AS node, CAST(embedding[1] AS DOUBLE) AS u, CAST(embedding[2] AS DOUBLE) AS v FROM embeddings)
SELECT node, round(node % 25 + u * coalesce(layer, 5) / 5, 6) AS x, round(node // 25 + v * coalesce(layer, 5) / 5, 6) + 0.0 AS y FROM n LEFT JOIN layers USING (node)""")
def mesh_displaced(spark, sf_dir):
    cells, nodes = _mesh(spark, sf_dir)
    shift = carriers.ensemble(spark, sf_dir).where("mem < 2").groupBy("loc").pivot("mem", [0, 1]).agg(F.first("value")).select(F.col("loc").alias("node"), F.col("0").alias("u"), F.col("1").alias("v"))
    return _round(mesh.displaced(nodes, cells, shift), "x", "y")


@query(f"""WITH {_ENS}, m AS (SELECT i, j, value > 0.12 OR i IN (0, 24) AS masked FROM ens WHERE mem = 0), s AS (SELECT i AS si, j AS sj FROM m WHERE masked)
SELECT i, j, round(min(sqrt((i - si) * (i - si) * 4.0 + (j - sj) * (j - sj) * 2.25)), 6)::DOUBLE AS gap FROM m, s GROUP BY i, j""")
def distance_to_mask(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir).where("mem = 0")
    mask = distance_field.shore_mask(ens.select("i", "j"), ens.where("value > 0.12").select("i", "j"), carriers.NX, carriers.rows(spark, sf_dir), cyclic_y=True)
    return _round(distance_field.distance_to_mask(mask, dx=2.0, dy=1.5), "gap")


@query(f"""WITH RECURSIVE {_OBS}, c AS (SELECT obs_id AS id, x, y, row_number() OVER (ORDER BY (obs_id * 7919) % 100003, obs_id) AS k FROM obs),
pick(k, xs, ys, ids) AS (SELECT 0::BIGINT, []::DOUBLE[], []::DOUBLE[], []::BIGINT[] UNION ALL
 SELECT n.k, list_append(xs, n.x), list_append(ys, n.y), list_append(ids, n.id) FROM pick p, LATERAL (SELECT c.k, c.x, c.y, c.id FROM c WHERE c.k > p.k AND len(list_filter(list_zip(p.xs, p.ys), lambda q: abs(q[1] - c.x) <= 2.5 AND abs(q[2] - c.y) <= 2.5)) = 0 ORDER BY c.k LIMIT 1) n)
SELECT unnest(ids) AS id FROM pick WHERE len(ids) = (SELECT max(len(ids)) FROM pick)""")
def scattered_points(spark, sf_dir):
    candidates = _some_obs(spark, sf_dir).select(F.col("obs_id").alias("id"), "x", "y")
    return scatter.spaced(candidates, 2.5, (F.col("id") * 7919) % 100003).select("id")


# files of binary records


@query(f"WITH {_ENS} SELECT mem, loc, round(-value, 6) + 0.0 AS value FROM ens WHERE mem % 4 = 1")
def restart_records(spark, sf_dir):
    """A restart file for each member with two fields on two levels; one field of one level is read back, by its index."""
    ens = carriers.ensemble(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(level).alias("level"), F.lit(sign).alias("sign")) for f, sign in (("temp", 1.0), ("salt", -1.0)) for level in (1, 2)])
    rows = ens.select(F.format_string("member_%03d", (F.col("mem") / 4).cast("int")).alias("file"), "mem", "loc", "value", F.explode(kinds).alias("k"))
    rows = rows.where(F.col("mem") % 4 == F.col("k.level")).select("file", F.when(F.col("k.field") == "temp", F.col("k.level") - 1).otherwise(F.col("k.level") + 1).alias("record"), "k.field", F.lit(67392).alias("step"), F.lit(351.0).alias("day"), "k.level", F.lit(25.0).alias("dens"), "loc", (F.col("value") * F.col("k.sign")).alias("value"))
    folder = f"{StateStore.temporary(spark).root}/restart"
    files = records.write_restart(rows, folder).count()
    assert files == carriers.MEMBERS // 4
    back = records.read_records(spark, folder, "restart", points=ens.where("mem = 0").count(), fields=["salt"], levels=[1])
    return _round(back.select((F.regexp_extract("file", "(\\d+)", 1).cast("int") * 4 + 1).alias("mem"), "loc", "value"), "value")


@query(f"WITH {_MESH} SELECT tri, unnest([0, 1, 2]) AS corner, unnest([n1, n2, n3]) + 1 AS node FROM mesh")
def mesh_records(spark, sf_dir):
    """Nodes and triangles as named records of one mesh file; the triangles are read back by name."""
    cells, nodes = _mesh(spark, sf_dir)
    part = lambda rows, k, field, kind, loc, value: rows.select(F.lit("mesh").alias("file"), F.lit(k).alias("record"), F.lit(field).alias("field"), F.lit(kind).alias("kind"), loc.cast("long").alias("loc"), value.cast("double").alias("value"))
    corners = cells.select("tri", F.posexplode(F.array("n1", "n2", "n3")).alias("corner", "node"))
    rows = part(nodes, 0, "Nodes_x", "double", F.col("node"), F.col("x")).unionByName(part(nodes, 1, "Nodes_y", "double", F.col("node"), F.col("y")))
    rows = rows.unionByName(part(corners, 2, "Elements", "int", F.col("tri") * 3 + F.col("corner"), F.col("node") + 1))
    folder = f"{StateStore.temporary(spark).root}/mesh"
    records.write_mesh(rows, folder).count()
    back = records.read_records(spark, folder, "mesh", fields=["Elements"])
    return back.select(F.floor(F.col("loc") / 3).alias("tri"), (F.col("loc") % 3).cast("int").alias("corner"), F.col("value").cast("long").alias("node"))


@query(f"WITH {_ENS} SELECT i, j, round(value, 6) + 0.0 AS value FROM ens WHERE mem = 0 AND i >= 3 AND i < 19 AND j >= 2")
def patch_window(spark, sf_dir):
    """A field written in patches of 8 by 6 points and put together again within a window."""
    folder = f"{StateStore.temporary(spark).root}/patches"
    records.write_patches(carriers.ensemble(spark, sf_dir).where("mem = 0"), folder, "temp", 8, 6).count()
    return _round(records.read_patches(spark, folder, (3, 19, 2, 1 << 40)).select("i", "j", "value").where("value is not null"), "value")


# observations within columns, records analysed tile by tile


@query(f"""WITH {_ENS}, {_OBS}, {_WEIGHTS}, l AS (SELECT loc, mem % 5 AS mem, mem // 5 AS lev, value AS f, 10.0 * (mem // 5 + 1) + loc % 3 AS z FROM ens),
c AS (SELECT obs_id, mem, lev, sum(w * f) AS f, sum(w * z) AS z FROM w JOIN l USING (loc) GROUP BY ALL HAVING count(*) = 4),
n AS (SELECT *, lag(f) OVER o AS fp, coalesce(lag(z) OVER o, 0) AS zp, coalesce(lag(z, 2) OVER o, 0) AS zpp, obs_id % 47 - 2.5 AS oz FROM c WINDOW o AS (PARTITION BY obs_id, mem ORDER BY lev)),
v AS (SELECT obs_id, mem, CASE WHEN lev = 0 AND oz >= 0 AND oz < z / 2 THEN f WHEN lev > 0 AND oz >= (zp + zpp) / 2 AND oz < (zp + z) / 2 THEN fp + (oz - (zp + zpp) / 2) / ((zp + z) / 2 - (zp + zpp) / 2) * (f - fp) WHEN lev = 3 AND oz >= (zp + z) / 2 AND oz <= z THEN f END AS value FROM n)
SELECT obs_id, mem, round(any_value(value), 6) + 0.0 AS value FROM v WHERE value IS NOT NULL GROUP BY obs_id, mem""")
def obs_prior_levels(spark, sf_dir):
    ens = carriers.ensemble(spark, sf_dir)
    levels = ens.select("loc", (F.col("mem") % 5).alias("mem"), F.floor(F.col("mem") / 5).cast("int").alias("lev"), "value", (10.0 * (F.floor(F.col("mem") / 5) + 1) + F.col("loc") % 3).alias("z"))
    obs = _some_obs(spark, sf_dir).withColumn("z", F.col("obs_id") % 47 - 2.5)
    return _round(observe.state_to_observations(levels, obs, GRID(spark, sf_dir), "value"), "value")


@query()
def analysis_records(spark, sf_dir):
    """All events assimilated into two variables on two levels, tile by tile; tests hold it against the filter by point."""
    from skerry.plans.analysis import analyse_records

    obs_records, state_records = _records(spark)
    ens = carriers.ensemble(spark, sf_dir)
    state = ens.select(F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("rec"), "loc", "mem", "value").withColumn("value", F.col("value") * (F.col("rec") + 1))
    obs = _some_obs(spark, sf_dir).select("obs_id", F.col("kind").alias("obs_rec"), "x", "y", (F.col("obs_id") % 20).cast("double").alias("z"), F.hour("t").cast("double").alias("t"), "obs", "err_std")
    return _round(analyse_records(state, state_records, obs, obs_records, None, GRID(spark, sf_dir), field=ens), "value")


# scales on irregular nodes and of observations, a state carried from cycle to cycle


@query(f"""WITH {_ENS}, g AS (SELECT loc, i + 0.3 * sin(loc) AS x, j + 0.3 * cos(loc) AS y, value FROM ens WHERE mem = 0),
p AS (SELECT a.loc, b.value, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM g a JOIN g b ON abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6),
s AS (SELECT loc, sum(CASE WHEN d <= 9 THEN exp(-d / 2) * value END) / sum(CASE WHEN d <= 9 THEN exp(-d / 2) END) AS fine, sum(CASE WHEN d <= 36 THEN exp(-d / 8) * value END) / sum(CASE WHEN d <= 36 THEN exp(-d / 8) END) AS coarse FROM p GROUP BY loc)
SELECT 0 AS mem, loc AS node, round(fine - coarse, 6) + 0.0 AS value FROM s""")
def node_scales(spark, sf_dir):
    nodes = carriers.ensemble(spark, sf_dir).where("mem = 0").select(F.lit(0).alias("mem"), F.col("loc").alias("node"), (F.col("i") + 0.3 * F.sin("loc")).alias("x"), (F.col("j") + 0.3 * F.cos("loc")).alias("y"), "value")
    return _round(transforms.node_component(nodes, [2.0, 1.0], ["mem"], 1), "value")


@query()
def obs_scales(spark, sf_dir):
    """The middle scale of all observations; tests hold it against whole arrays."""
    obs = _some_obs(spark, sf_dir).select("obs_id", "x", "y", "obs", "err_std")
    bands = transforms.TRANSFORMS["scale_bandpass"](GRID(spark, sf_dir), [3.0, 8.0], [1.0, 1.2, 1.5])
    return _round(bands.forward_obs(obs, 1), "obs", "err_std")


@query(f"""WITH RECURSIVE {_OBS}, s AS (SELECT kind AS key, epoch_us(t) // 21600000000 AS cycle, count(*) AS n, avg(obs) AS m FROM obs GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cycle) AS k FROM s),
f(key, k, cycle, n, mean, variance) AS (SELECT key, k, cycle, n, 1 / (1 + 0.04 / n) * m, (1 - 1 / (1 + 0.04 / n)) * 1 FROM o WHERE k = 1
 UNION ALL SELECT o.key, o.k, o.cycle, o.n, f.mean + g.v / (g.v + 0.04 / o.n) * (o.m - f.mean), (1 - g.v / (g.v + 0.04 / o.n)) * g.v FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1, LATERAL (SELECT f.variance + 0.01 * (o.cycle - f.cycle) AS v) g)
SELECT key, cycle, n, round(mean, 6) + 0.0 AS mean, round(variance, 8) AS variance FROM f""")
def cycle_state(spark, sf_dir):
    from skerry.streaming.carried import carried

    return _round(_round(carried(_some_obs(spark, sf_dir), 6), "mean"), "variance", digits=8)


# datasets as chains from raw rows to observation sequences, conversion between grids

_SHORE = "shore AS (SELECT vec_id % 25 AS i, vec_id // 25 AS j FROM embeddings WHERE embedding[1] > 0.12)"
_WET = f"""{_SHORE}, hidden AS (SELECT DISTINCT obs_id FROM obs JOIN shore ON (i = floor(x) OR (i = floor(x) + 1 AND x > floor(x))) AND (j = floor(y) OR (j = floor(y) + 1 AND y > floor(y)))),
wet AS (SELECT * FROM obs WHERE obs_id NOT IN (SELECT obs_id FROM hidden))"""
_DAY = "t >= TIMESTAMP '2024-01-09 12:00:00' AND t < TIMESTAMP '2024-01-10 12:00:00'"


def _request(spark, sf_dir, **options) -> datasets.Request:
    mask = carriers.ensemble(spark, sf_dir).where("mem = 0 and value > 0.12").select("loc")
    return datasets.Request(GRID(spark, sf_dir), datetime(2024, 1, 10), mask=mask, err_std=0.1, options=options)


@query(f"WITH {_OBS}, {_WET} SELECT obs_id, x, y, 0.0::DOUBLE AS z, t, round(obs_id % 101 * 0.01, 6)::DOUBLE AS obs, 0.1::DOUBLE AS err_std FROM wet WHERE {_DAY} AND obs_id % 23 <= 10 AND obs_id % 9 > 0")
def read_ice_concentration(spark, sf_dir):
    raw = _some_obs(spark, sf_dir).select("obs_id", "x", "y", "t", (F.col("obs_id") % 23).alias("status_flag"), (F.col("obs_id") % 9).alias("err"), (F.col("obs_id") % 101).alias("value"))
    return _round(datasets.read("ice_concentration", raw, _request(spark, sf_dir)), "obs")


@query(f"""WITH {_OBS}, {_WET}, r AS (SELECT *, t - INTERVAL 36 HOUR + INTERVAL 1 SECOND * (CASE WHEN obs_id % 4 = 0 THEN 0 ELSE obs_id % 600 END) AS b0, t + INTERVAL 12 HOUR + INTERVAL 1 SECOND * (obs_id % 500) AS b1,
 (obs_id % 31 - 15.0) AS dx, (obs_id % 17 - 8.0) AS dy, tan(radians(90 - (y + 40)) / 2) AS pr, radians(x * 3) AS pa, tan(radians(90 - (y + 40.1)) / 2) AS qr, radians((x + 0.1) * 3) AS qa FROM wet WHERE {_DAY} AND obs_id % 3 = 0),
e AS (SELECT *, pr * sin(qa) - pr * sin(pa) AS xx, pr * cos(qa) - pr * cos(pa) AS yx, qr * sin(pa) - pr * sin(pa) AS xy, qr * cos(pa) - pr * cos(pa) AS yy, (epoch_us(b1) - epoch_us(b0)) / 8.64e10 AS days FROM r),
n AS (SELECT *, xx / sqrt(xx * xx + yx * yx) AS axx, yx / sqrt(xx * xx + yx * yx) AS ayx, xy / sqrt(xy * xy + yy * yy) AS axy, yy / sqrt(xy * xy + yy * yy) AS ayy FROM e)
SELECT obs_id, x, y, 0.0::DOUBLE AS z, make_timestamp((epoch_us(b0) + epoch_us(b1)) // 2) AS t, round((axx * dx + axy * dy) / days, 6) + 0.0 AS u, round((ayx * dx + ayy * dy) / days, 6) + 0.0 AS v, 0.1::DOUBLE AS err_std FROM n""")
def read_ice_drift(spark, sf_dir):
    k, t = F.col("obs_id"), F.col("t")
    raw = _some_obs(spark, sf_dir).select(
        "obs_id", "x", "y", "t", (t - F.expr("interval 36 hours")).alias("t0"), (t + F.expr("interval 12 hours")).alias("t1"), F.when(k % 8 == 0, float("nan")).when(k % 4 != 0, (k % 600).cast("double")).alias("dt0"), (k % 500).cast("double").alias("dt1"),
        F.when(k % 3 == 0, 30).otherwise(20).alias("status_flag"), F.lit(1.0).alias("err"), (k % 31 - 15.0).alias("dx"), (k % 17 - 8.0).alias("dy"),
    )
    rotation = grid.rotation_at(lambda x, y: distance.stereographic(x * 3, y + 40), 1.0)
    return _round(datasets.read("ice_drift", raw, _request(spark, sf_dir, rotation=rotation)), "u", "v")


@query(f"""WITH {_OBS}, {_WET} SELECT obs_id, x, y, 0.0::DOUBLE AS z, t, round(obs, 6) + 0.0 AS obs, err_std FROM wet WHERE kind = 'click' AND t::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND obs_id % 13 > 0""")
def read_ice_thickness(spark, sf_dir):
    raw = _some_obs(spark, sf_dir).select("obs_id", "x", "y", "t", "kind", F.when(F.col("obs_id") % 13 > 0, F.col("obs")).otherwise(float("nan")).alias("value"), F.col("err_std").alias("uncertainty"))
    return _round(datasets.read("ice_thickness", raw, _request(spark, sf_dir, kind="click", days=5, use_uncertainty=True)), "obs")


@query(f"""WITH {_PROFILE}, d AS (SELECT *, sum(dz) OVER (PARTITION BY pid ORDER BY lev) AS depth, pid % 240 / 10.0 AS x, pid % 170 / 10.0 AS y, l_linestatus = 'O' AS ok, TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 1 HOUR * (pid % 30 - 15) AS seen FROM profile),
{_SHORE}, hidden AS (SELECT DISTINCT pid FROM d JOIN shore ON (i = floor(x) OR (i = floor(x) + 1 AND x > floor(x))) AND (j = floor(y) OR (j = floor(y) + 1 AND y > floor(y)))),
k AS (SELECT * FROM d WHERE pid NOT IN (SELECT pid FROM hidden) AND pid % 5 > 0 AND pid % 30 - 15 >= -12 AND pid % 30 - 15 < 12 AND lev <> 3 AND depth <= 60 + pid % 90),
g AS (SELECT *, max(CASE WHEN value BETWEEN 0 AND 90000 THEN 0 ELSE 1 END) OVER (PARTITION BY pid) AS bad FROM k), b AS (SELECT *, (depth > 20)::INT + (depth > 60)::INT + (depth > 100)::INT AS bin FROM g WHERE bad = 0)
SELECT pid, lev, x::DOUBLE AS x, y::DOUBLE AS y, -depth AS z, seen AS t, round(value, 2) AS obs, 0.5::DOUBLE AS err_std FROM b QUALIFY row_number() OVER (PARTITION BY pid, bin ORDER BY lev) = 1""")
def read_profiles(spark, sf_dir):
    pid = F.col("pid")
    raw = vertical.layer_depths(carriers.profiles(spark, sf_dir), "pid").select(
        "pid", "lev", (pid % 240 / 10.0).alias("x"), (pid % 170 / 10.0).alias("y"), (F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (pid % 30 - 15).cast("int"))).alias("t"), F.col("z").alias("depth"), "value",
        F.lit(1).alias("t_qc"), F.when(pid % 5 > 0, 2).otherwise(4).alias("x_qc"), F.lit(1).alias("z_qc"), F.when(F.col("lev") == 3, 3).otherwise(1).alias("v_qc"),
    )
    floats = raw.select("pid").distinct()
    targets = floats.withColumn("zs", F.array(*[F.lit(float(z)) for z in (20, 60, 100)]))
    bottom = floats.withColumn("bottom", (60 + pid % 90).cast("double"))
    request = _request(spark, sf_dir, bounds=(0, 90000), targets=targets, bottom=bottom, variance=0.25)
    return _round(datasets.read("profiles", raw, datasets.Request(**{**vars(request), "key": "pid"})), "obs", digits=2)


@query(f"""WITH {_OBS}, r AS (SELECT obs_id, x, y, t, (obs_id % 31 - 15.0) AS u, CASE WHEN obs_id % 50 = 7 THEN NULL ELSE obs_id % 17 - 8.0 END AS v FROM obs WHERE {_DAY})
SELECT min(obs_id) AS obs_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, 0.0::DOUBLE AS z, arg_min(t, obs_id) AS t, round(avg(u), 6) + 0.0 AS u, round(avg(v), 6) + 0.0 AS v, 0.1::DOUBLE AS err_std FROM r WHERE sqrt(u * u + v * v) <= 14 GROUP BY floor(x / 2), floor(y / 2) HAVING count(*) > 1""")
def read_drift_trajectories(spark, sf_dir):
    k = F.col("obs_id")
    raw = _some_obs(spark, sf_dir).select("obs_id", "x", "y", "t", (k % 31 - 15.0).alias("u"), F.when(k % 50 != 7, k % 17 - 8.0).otherwise(float("nan")).alias("v"))
    return _round(datasets.read("drift_trajectories", raw, _request(spark, sf_dir, most=14.0, box=2.0)), "x", "y", "u", "v")


@query(f"""WITH {_OBS}, {_CELL_OF}, k AS (SELECT (j0 + CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) * 25 + i0 + CASE WHEN u >= 0.5 THEN 1 ELSE 0 END AS loc, obs, obs_id FROM corner WHERE obs_id % 4 = 1 AND obs_id % 11 > 0),
m AS (SELECT loc, avg(obs * 1000) AS obs, avg(obs_id % 7200) AS dt FROM k GROUP BY loc HAVING count(*) > 1)
SELECT loc AS obs_id, (loc % 25)::DOUBLE AS x, (loc // 25)::DOUBLE AS y, 0.0::DOUBLE AS z, TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 1 MICROSECOND * CAST(floor(dt * 1e6) AS BIGINT) AS t, round(obs, 6) + 0.0 AS obs, 0.1::DOUBLE AS err_std FROM m WHERE loc NOT IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0.12)""")
def read_brightness(spark, sf_dir):
    k = F.col("obs_id")
    raw = _some_obs(spark, sf_dir).select("obs_id", "x", "y", (k % 7200).cast("double").alias("dtime"), (k % 11 == 0).alias("masked"), F.col("obs").alias("value"), F.element_at(F.array(F.lit("19v"), F.lit("19h"), F.lit("37v"), F.lit("37h")), (k % 4 + 1).cast("int")).alias("channel"))
    return _round(datasets.read("brightness", raw, _request(spark, sf_dir, channel="19h", units=("km", "m"))), "obs")


@query(f"""WITH {_PROFILE}, a AS (SELECT pid AS start, lev AS lead, sum(value) OVER (PARTITION BY pid ORDER BY lev) * CASE WHEN lev = 4 THEN 0.5 ELSE 1 END AS value FROM profile), b AS (SELECT *, lag(value) OVER (PARTITION BY start ORDER BY lead) AS before FROM a)
SELECT start, lead, round(CASE WHEN before IS NOT NULL THEN greatest(0, (value - before) / 3600) WHEN start % 3 > 0 THEN start % 100 / 10.0 END, 6)::DOUBLE AS rate FROM b""")
def forecast_rates(spark, sf_dir):
    rows = carriers.profiles(spark, sf_dir).withColumn("value", F.sum("value").over(Window.partitionBy("pid").orderBy("lev")) * F.when(F.col("lev") == 4, 0.5).otherwise(1.0))
    rows = rows.select(F.lit("rain").alias("name"), F.col("pid").alias("start"), F.col("lev").alias("lead"), F.lit(0).alias("member"), "value")
    first = rows.select("name", "start").distinct().where("start % 3 > 0").withColumn("rate", (F.col("start") % 100 / 10.0).cast("double"))
    return _round(datasets.forecast_rates(rows, first, 3600).select("start", "lead", "rate"), "rate")


@query(f"""WITH {_ENS}, f AS (SELECT loc, i, j, max(CASE WHEN mem = 0 THEN value END) AS u, max(CASE WHEN mem = 1 THEN value END) AS v, 10.0 + i * 2 AS lo, 40.0 + j * 2.5 * 20 / {_NY} AS la FROM ens GROUP BY loc, i, j),
p AS (SELECT *, tan(radians(90 - la) / 2) AS r, tan(radians(90 - la - 0.2) / 2) AS rn, radians(lo) AS a, radians(lo + 0.2) AS an FROM f),
e AS (SELECT loc, i, j, u, v, r * sin(an) - r * sin(a) AS xx, r * cos(an) - r * cos(a) AS yx, rn * sin(a) - r * sin(a) AS xy, rn * cos(a) - r * cos(a) AS yy FROM p),
s AS (SELECT i, j, xx / sqrt(xx * xx + yx * yx) * u + xy / sqrt(xy * xy + yy * yy) * v AS u, yx / sqrt(xx * xx + yx * yx) * u + yy / sqrt(xy * xy + yy * yy) * v AS v FROM e),
d AS (SELECT k AS loc, 0.1 + (k % 20) * 0.01 AS sx, 0.05 + (k // 20) * 0.01 AS sy FROM range(600) AS t(k)), g AS (SELECT loc, (degrees(atan2(sx, sy)) - 10) / 2 AS x, (90 - 2 * degrees(atan(sqrt(sx * sx + sy * sy))) - 40) / (2.5 * 20 / {_NY}) AS y FROM d),
c AS (SELECT loc, floor(x)::INT AS i0, floor(y)::INT AS j0, x - floor(x) AS a, y - floor(y) AS b FROM g WHERE x >= 0 AND y >= 0),
w AS (SELECT loc, i0 AS i, j0 AS j, (1 - a) * (1 - b) AS w FROM c UNION ALL SELECT loc, i0 + 1, j0, a * (1 - b) FROM c UNION ALL SELECT loc, i0 + 1, j0 + 1, a * b FROM c UNION ALL SELECT loc, i0, j0 + 1, (1 - a) * b FROM c)
SELECT loc, round(sum(w * u), 6) + 0.0 AS u, round(sum(w * v), 6) + 0.0 AS v FROM w JOIN s USING (i, j) GROUP BY loc HAVING count(*) = 4""")
def grid_convert_vectors(spark, sf_dir):
    """A vector field on longitudes and latitudes, turned and interpolated to a polar plane."""
    ny = carriers.rows(spark, sf_dir)
    source = grid.Grid(carriers.NX, ny, 10.0, 40.0, 2.0, 2.5 * 20 / ny)
    flow = carriers.ensemble(spark, sf_dir).where("mem < 2").groupBy("loc").pivot("mem", [0, 1]).agg(F.first("value")).select("loc", F.col("0").alias("u"), F.col("1").alias("v"))
    out = grid.convert(flow, source, grid.Grid(20, 30, 0.1, 0.05, 0.01, 0.01), [], ["u", "v"], distance.stereographic, distance.stereographic_inverse, vector=True)
    return _round(out.where("u is not null"), "u", "v")


# interpolation on meshes and rings, daily displacement, output, scales and perturbations of whole states

_ON_MESH = f"""{_CELL_OF}, t AS (SELECT obs_id, j0 * 25 + i0 AS p, j0 * 24 + i0 AS c, u, v FROM corner),
tw AS (SELECT obs_id, CASE WHEN u >= v THEN 2 * c ELSE 2 * c + 1 END AS tri, p AS n1, 1 - greatest(u, v) AS w1, CASE WHEN u >= v THEN p + 1 ELSE p + 26 END AS n2, CASE WHEN u >= v THEN u - v ELSE u END AS w2, CASE WHEN u >= v THEN p + 26 ELSE p + 25 END AS n3 FROM t"""
_PLACED = f"""{_ON_MESH}
 WHERE abs(u - v) > 1e-9 AND u > 1e-9 AND v > 1e-9)"""


def _in_mesh(spark, sf_dir):
    """The mesh, and the observations that lie within a triangle, not on its edges, with their place in it."""
    cells, nodes = _mesh(spark, sf_dir)
    inside = _some_obs(spark, sf_dir).where("abs((x - floor(x)) - (y - floor(y))) > 1e-9 and x - floor(x) > 1e-9 and y - floor(y) > 1e-9")
    return cells, grid.find_triangle(inside, grid.triangles(cells, nodes), "obs_id", 4.0)


@query(f"""WITH {_ENS}, {_OBS}, {_ON_MESH}), m AS (SELECT loc, mem, value FROM ens)
SELECT obs_id, a.mem, round(w1 * a.value + w2 * b.value + (1 - w1 - w2) * c.value, 6) + 0.0 AS value FROM tw JOIN m a ON a.loc = n1 JOIN m b ON b.loc = n2 AND b.mem = a.mem JOIN m c ON c.loc = n3 AND c.mem = a.mem""")
def mesh_interpolate(spark, sf_dir):
    """All members at all observations; on an edge, triangles of both sides give the same."""
    field = carriers.ensemble(spark, sf_dir).select(F.col("loc").alias("node"), "mem", "value")
    found = grid.find_triangle(_some_obs(spark, sf_dir), grid.triangles(*_mesh(spark, sf_dir)), "obs_id", 4.0)
    return _round(grid.on_triangles(found, field, "obs_id", ["mem"]).select("obs_id", "mem", "value"), "value")


@query(f"""WITH {_ENS}, {_OBS}, {_PLACED}, m AS (SELECT loc, value FROM ens WHERE mem = 0) SELECT obs_id, round((a.value + b.value + c.value) / 3, 6) + 0.0 AS value FROM tw JOIN m a ON a.loc = n1 JOIN m b ON b.loc = n2 JOIN m c ON c.loc = n3""")
def mesh_element_value(spark, sf_dir):
    cells, found = _in_mesh(spark, sf_dir)
    field = carriers.ensemble(spark, sf_dir).where("mem = 0").select(F.col("loc").alias("node"), "value")
    return _round(grid.on_elements(found, grid.element_means(field, cells, []), "obs_id", []), "value")


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT event_id, event_id * 0.37 - 50 AS x FROM events), q AS (SELECT event_id, x - n * floor(x / n) AS x, n FROM p, n), r AS (SELECT event_id, floor(x)::BIGINT AS i, x - floor(x) AS f, n FROM q)
SELECT event_id, round((1 - f) * a.embedding[1]::DOUBLE + f * b.embedding[1]::DOUBLE, 6) + 0.0 AS value FROM r JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = (i + 1) % n""")
def ring_interpolate(spark, sf_dir):
    ring = carriers.ensemble(spark, sf_dir).where("mem = 0").select(F.col("loc").alias("i"), "value")
    points = carriers.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 0.37 - 50).alias("x"))
    return _round(grid.on_line(points, ring, "event_id", ring.count(), []), "value")


_STEP = """{out} AS (SELECT k.obs_id, any_value(k.x) + sum(w * u) AS x, any_value(k.y) + sum(w * v) AS y, any_value(k.day) + 1 AS day FROM (SELECT obs_id, x, y, day, unnest([0, 1, 0, 1]) AS a, unnest([0, 0, 1, 1]) AS b FROM {inp} WHERE x BETWEEN 0 AND 24 AND y >= 0) k,
 LATERAL (SELECT least(floor(k.x), 23)::BIGINT AS i0, least(floor(k.y), {ny} - 2)::BIGINT AS j0) c, LATERAL (SELECT (CASE WHEN a = 1 THEN k.x - i0 ELSE 1 - k.x + i0 END) * (CASE WHEN b = 1 THEN k.y - j0 ELSE 1 - k.y + j0 END) AS w, (j0 + b) * 25 + i0 + a AS loc) g
 JOIN flows f ON f.loc = g.loc AND f.day = k.day WHERE k.y <= {ny} - 1 GROUP BY k.obs_id HAVING count(*) = 4)"""


@query(f"""WITH {_ENS}, {_OBS}, flows AS (SELECT a.loc, a.mem AS day, a.value * 2 AS u, b.value * 2 AS v FROM ens a JOIN ens b ON b.loc = a.loc AND b.mem = (a.mem + 1) % 20), s0 AS (SELECT obs_id, x, y, (obs_id % 25)::BIGINT AS day FROM obs),
{_STEP.format(out='s1', inp='s0', ny=_NY)}, {_STEP.format(out='s2', inp='s1', ny=_NY)} SELECT obs_id, round(s2.x - s0.x, 6) + 0.0 AS dx, round(s2.y - s0.y, 6) + 0.0 AS dy FROM s2 JOIN s0 USING (obs_id)""")
def two_day_displacement(spark, sf_dir):
    """Where two daily flows, one for each member as a day, carry the observations; days without a flow give none."""
    ens = carriers.ensemble(spark, sf_dir)
    after = ens.select("loc", F.pmod(F.col("mem") - 1, F.lit(carriers.MEMBERS)).alias("mem"), F.col("value").alias("v"))
    flows = ens.select("loc", "mem", F.col("value").alias("u")).join(after, ["loc", "mem"]).withColumnRenamed("mem", "day")
    out = trajectories.advect_daily(_some_obs(spark, sf_dir).select("obs_id", "x", "y"), flows, GRID(spark, sf_dir), "obs_id", F.col("obs_id") % 25, 2, 2.0)
    return _round(out.select("obs_id", "dx", "dy"), "dx", "dy")


@query(f"WITH {_ENS} SELECT mem, loc, round(value, 6) + 0.0 AS value, i * 2.0::DOUBLE AS lon, j * 0.5::DOUBLE AS lat, 'plane' AS proj FROM ens WHERE mem IN (2, 5)")
def member_output(spark, sf_dir):
    """All members and two variables written with coordinates, a folder each; one variable of two members read back."""
    ens = carriers.ensemble(spark, sf_dir)
    both = ens.select("mem", F.explode(F.array(F.lit("temp"), F.lit("salt"))).alias("name"), F.lit(datetime(2024, 1, 10)).alias("t"), F.lit(0).alias("lev"), "loc", "value")
    folder = f"{StateStore.temporary(spark).root}/output"
    write_output(both, GRID(spark, sf_dir).points(spark).select("loc", (F.col("i") * 2.0).alias("lon"), (F.col("j") * 0.5).alias("lat"), "x", "y"), folder, {"proj": "plane"})
    out = read_output(spark, folder, members=[2, 5], names=["salt"])
    return _round(out.select("mem", "loc", "value", "lon", "lat", F.col("about")["proj"].alias("proj")), "value")


@query()
def analysis_scales(spark, sf_dir):
    """All events assimilated scale by scale; tests hold it against one pass."""
    from skerry.plans.analysis import analyse_scales

    state = carriers.ensemble(spark, sf_dir).select("loc", "mem", "value")
    return _round(analyse_scales(state, _some_obs(spark, sf_dir), GRID(spark, sf_dir), [6.0, 2.0], [4.0]), "value")


@query()
def perturb_state(spark, sf_dir):
    """Two cycles of perturbations of a whole state, on two scales with memory and within bounds; random, so without SQL."""
    from skerry.plans.perturb import Perturbation, perturb

    state = carriers.ensemble(spark, sf_dir).select(F.lit("temp").alias("name"), "mem", "i", "j", "value")
    store, box = StateStore.temporary(spark), GRID(spark, sf_dir)
    defs = [Perturbation(variables="temp", amp=[[0.1, 0.05]], hcorr=[6.0, 3.0], tcorr=[24.0, 12.0], bounds={"temp": (-0.5, 0.5)})]
    once = store.write(perturb(state, defs, box, store, 0, 6.0), 0, "state")
    return _round(perturb(once, defs, box, store, 1, 6.0), "value")
