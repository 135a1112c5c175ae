"""Observation datasets by name: from a raw table to an observation sequence, every check in one chain.

A reader takes a raw table whose positions are in the analysis grid's coordinates and a ``Request``, and
returns ``x, y, z, t, obs, err_std`` with the raw table's key columns kept; vectors have ``u, v`` instead
of ``obs``. Files are Parquet tables or read by ``sources.tables`` and ``sources.records``; a missing
one is an empty table, and an empty table gives an empty sequence. Others register theirs with
``READERS.register``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import units
from skerry.operators import grid as grids
from skerry.operators import observations
from skerry.sources.config import Registry

READERS = Registry("dataset")


@dataclass(frozen=True)
class Request:
    """What is wanted: a grid with its ``mask(loc)``, a time and a window in hours around it, and options of the dataset."""

    grid: grids.Grid
    time: datetime
    low_hours: float = -12.0
    high_hours: float = 12.0
    mask: DataFrame | None = None
    err_std: float = 1.0
    key: str = "obs_id"
    options: dict = field(default_factory=dict)


def read(name: str, raw: DataFrame, request: Request) -> DataFrame:
    """The observation sequence of a registered dataset; an unknown name is an error."""
    return READERS[name](raw, request)


def inside(rows: DataFrame, request: Request) -> DataFrame:
    """Rows within the grid's box, its edges included."""
    g = request.grid
    return rows.where(F.col("x").between(g.x0, g.x0 + g.dx * (g.nx - 1)) & F.col("y").between(g.y0, g.y0 + g.dy * (g.ny - 1)))


def unmasked(rows: DataFrame, request: Request) -> DataFrame:
    """Rows none of whose cell's corners is masked; a corner without weight does not count."""
    if request.mask is None:
        return rows
    key = request.key
    cells = grids.weights(grids.find_cell(rows.select(key, "x", "y").distinct(), request.grid), key).where("w > 0")
    hidden = cells.join(request.mask.select("loc"), "loc", "left_semi").select(key).distinct()
    return rows.join(hidden, key, "left_anti")


def in_time(rows: DataFrame, request: Request) -> DataFrame:
    return observations.in_window(rows, F.lit(request.time).cast("timestamp_ntz"), request.low_hours, request.high_hours)


def _sequence(rows: DataFrame, request: Request, *values: str) -> DataFrame:
    z = F.col("z") if "z" in rows.columns else F.lit(0.0)
    return rows.select(request.key, "x", "y", z.alias("z"), "t", *values, F.col("err_std").cast("double").alias("err_std"))


@READERS.register("ice_concentration")
def ice_concentration(raw: DataFrame, request: Request) -> DataFrame:
    """``raw(key, x, y, t, status_flag, err, value)`` in per cent: flags 0 to 10, errors above zero; the error is the configured one."""
    kept = observations.flags(in_time(raw, request), "status_flag", 0, 10, "err")
    kept = unmasked(inside(kept, request), request)
    return _sequence(kept.withColumns({"obs": F.col("value") * 0.01, "err_std": F.lit(request.err_std)}), request, "obs")


@READERS.register("ice_drift")
def ice_drift(raw: DataFrame, request: Request) -> DataFrame:
    """``raw(key, x, y, t, t0, t1, dt0, dt1, status_flag, err, dx, dy)``: displacement over a window as a velocity a day.

    Flag 30 only. The window's bounds are moved by ``dt0, dt1`` seconds, unknown ones by none; the time is
    its middle. ``options["rotation"]``, from ``grid.rotation_at``, turns the vector to the grid's axes.
    """
    kept = unmasked(inside(observations.flags(in_time(raw, request), "status_flag", 30, 30, "err"), request), request)
    moved = lambda t, d: F.unix_micros(F.col(t).cast("timestamp")) + F.coalesce(F.nanvl(F.col(d).cast("double"), F.lit(0.0)), F.lit(0.0)) * 1e6
    kept = kept.withColumns({"b0": moved("t0", "dt0"), "b1": moved("t1", "dt1")})
    days = (F.col("b1") - F.col("b0")) / 8.64e10
    rotation: Callable | None = request.options.get("rotation")
    u, v = F.col("dx"), F.col("dy")
    if rotation is not None:
        u, v = grids.rotated(u, v, rotation(F.col("x"), F.col("y")))
    middle = F.timestamp_micros(((F.col("b0") + F.col("b1")) / 2).cast("long")).cast("timestamp_ntz")
    kept = kept.withColumns({"u": observations.velocity(F.lit(0.0), u, days), "v": observations.velocity(F.lit(0.0), v, days), "err_std": F.lit(request.err_std), "t": middle})
    return _sequence(kept.where("u is not null"), request, "u", "v")


@READERS.register("ice_thickness")
def ice_thickness(raw: DataFrame, request: Request) -> DataFrame:
    """``raw(key, x, y, t, value, uncertainty, kind)``: one kind of value; errors from the dataset or the configured one.

    ``options``: ``kind``, ``use_uncertainty`` and ``days``, over which files of a product reach: half of the
    days but one on each side of the request's day.
    """
    reach = (int(request.options.get("days", 1)) - 1) // 2
    day, today = F.col("t").cast("date"), F.lit(request.time.date())
    kept = raw.where(F.col("kind") == request.options["kind"]).where(F.abs(F.datediff(day, today)) <= reach)
    kept = unmasked(inside(kept.where(F.col("value").isNotNull() & ~F.isnan("value")), request), request)
    err = F.col("uncertainty") if request.options.get("use_uncertainty") else F.lit(request.err_std)
    return _sequence(kept.withColumns({"obs": F.col("value"), "err_std": err}), request, "obs")


@READERS.register("profiles")
def profiles(raw: DataFrame, request: Request) -> DataFrame:
    """``raw(key, lev, x, y, t, depth, value, t_qc, x_qc, z_qc, v_qc)``: one float's levels, depths down from the surface.

    Times, positions and depths need a flag of 1 or 2, values of 1. Levels below the model's bottom go, a
    value out of ``options["bounds"]`` takes its whole profile along, and of the levels between two of the
    profile's target depths ``options["targets"](key, zs)`` the first stays. ``options["variance"]`` is
    the error's; ``options["bottom"](key, bottom)`` the model's depth there. Levels keep ``lev``.
    """
    key, (low, high) = request.key, request.options["bounds"]
    good = F.col("t_qc").isin(1, 2) & F.col("x_qc").isin(1, 2)
    kept = unmasked(inside(in_time(raw, request).where(good), request), request)
    kept = kept.where(F.col("z_qc").isin(1, 2) & (F.col("v_qc") == 1))
    if request.options.get("bottom") is not None:
        kept = kept.join(request.options["bottom"], key).where(F.col("depth") <= F.col("bottom")).drop("bottom")
    kept = observations.profiles(kept, key, F.lit(True), F.col("value").between(low, high))
    if request.options.get("targets") is not None:
        kept = observations.thin_vertical(kept, request.options["targets"], key).drop("bin")
    kept = kept.withColumns({"obs": F.col("value"), "z": -F.col("depth"), "err_std": F.lit(sqrt(request.options["variance"]))})
    return kept.select(key, "lev", "x", "y", "z", "t", "obs", F.col("err_std").cast("double").alias("err_std"))


@READERS.register("drift_trajectories")
def drift_trajectories(raw: DataFrame, request: Request) -> DataFrame:
    """``raw(key, x, y, t, u, v)`` drift vectors, put together by boxes; vectors beyond ``options["most"]`` or unknown go.

    A box's time, height and error are those of its first vector by key; boxes of one vector go.
    """
    kept = inside(in_time(raw, request), request)
    size = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)
    kept = kept.where(~F.isnan(size) & (size <= request.options["most"]))
    width, key = request.options["box"], request.key
    at = [F.floor(F.col(c) / width).cast("int").alias(f"b{c}") for c in ("x", "y")]
    box = kept.groupBy(*at).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "u", "v")], F.min_by("t", key).alias("t"), F.min(key).alias(key)).where("n > 1")
    return _sequence(box.withColumn("err_std", F.lit(request.err_std)), request, "u", "v")


@READERS.register("brightness")
def brightness(raw: DataFrame, request: Request) -> DataFrame:
    """``raw(key, x, y, dtime, masked, value, channel)``: one channel's means at the grid's points that several values lie next to.

    A value's time is the request's plus ``dtime`` seconds, of a point the mean; ``options``: ``channel`` and,
    to convert, ``units`` as a pair. The key is the point's number.
    """
    kept = raw.where(F.col("channel") == request.options["channel"]).where(~F.coalesce("masked", F.lit(False)) & F.col("value").isNotNull())
    cells = grids.find_cell(kept, request.grid).where("nearest is not null")
    value = F.col("value").cast("double")
    if "units" in request.options:
        value = units.convert(value, *request.options["units"])
    met = cells.groupBy(F.col("nearest").alias(request.key)).agg(F.count("*").alias("n"), F.avg(value).alias("obs"), F.avg("dtime").alias("dtime")).where("n > 1")
    if request.mask is not None:
        met = met.join(request.mask.select(F.col("loc").alias(request.key)), request.key, "left_anti")
    loc, g = F.col(request.key), request.grid
    t = F.timestamp_micros(F.unix_micros(F.lit(request.time).cast("timestamp")) + (F.col("dtime") * 1e6).cast("long")).cast("timestamp_ntz")
    return _sequence(met.withColumns({"x": g.x0 + g.dx * (loc % g.nx), "y": g.y0 + g.dy * F.floor(loc / g.nx), "t": t, "err_std": F.lit(request.err_std)}), request, "obs")


#: Fields of a prepared record, in order: names and numpy types.
PREPARED = [
    ("id", "S8"), ("kind", "<i4"), ("date", "<i4"), ("time", "<f4"), ("lon", "<f8"), ("lat", "<f8"), ("depth", "<f8"), ("i", "<i4"), ("j", "<i4"), ("value", "<f8"),
    ("var", "<f8"), ("a1", "<f8"), ("a2", "<f8"), ("a3", "<f8"), ("a4", "<f8"), ("status", "<i4"), ("h", "<f8"), ("orig", "<i4"), ("profile", "<i4"),
]


@READERS.register("prepared")
def prepared(raw: DataFrame, request: Request) -> DataFrame:
    """``raw`` as of ``PREPARED`` records with ``key, x, y, t``: heights below the surface, errors from variances.

    With ``options["vector"]`` the first half of the keys are first components, the second half the second.
    """
    rows = raw.withColumns({"z": -F.col("depth"), "err_std": F.sqrt("var"), "obs": F.col("value")})
    if not request.options.get("vector"):
        return _sequence(rows, request, "obs")
    half = rows.count() // 2
    key = F.col(request.key)
    second = rows.where(key >= half).select((key - half).alias(request.key), F.col("obs").alias("v"))
    return _sequence(rows.where(key < half).withColumnRenamed("obs", "u").join(second, request.key), request, "u", "v")


def forecast_rates(records: DataFrame, first: DataFrame, seconds: float) -> DataFrame:
    """``name, start, lead, member, rate`` of accumulated ``records(name, start, lead, member, value)``.

    A rate is the gain since the step before, never below zero; of the first step it is the rate that
    ``first(name, start, rate)`` has from a reanalysis, or unknown.
    """
    order = Window.partitionBy("name", "start", "member").orderBy("lead")
    met = records.withColumn("before", F.lag("value").over(order)).join(first.withColumnRenamed("rate", "known"), ["name", "start"], "left")
    rate = F.when(F.col("before").isNull(), F.col("known")).otherwise(F.greatest(F.lit(0.0), (F.col("value") - F.col("before")) / seconds))
    return met.select("name", "start", "lead", "member", rate.alias("rate"))


def lookup(requests: DataFrame, records: DataFrame, value: Column) -> DataFrame:
    """``requests(name, start, lead, member)`` with the record's ``value``; one that is not there is an error when it is met."""
    on = ["name", "start", "lead", "member"]
    found = records.select(*on, F.struct(value.alias("value")).alias("found"))
    what = F.concat(F.lit("no record "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    return requests.join(found, on, "left").select(*requests.columns, F.when(F.col("found").isNull(), F.raise_error(what)).otherwise(F.col("found"))["value"].alias("value"))
