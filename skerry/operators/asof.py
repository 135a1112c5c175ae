"""Nearest values in order, and lookups in archives of records, without pairs of rows.

Both sides of a nearest match are put into buckets of their place and sorted together; each row takes
the last series value before it and the first after it from its bucket, and where the bucket has none
from the edges of the buckets around, of which a bucket sends two rows. Work grows with the rows, not
with how many of one side lie near one of the other.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(wanted: DataFrame, series: DataFrame, place: str, s_place: str, value: str, by: list[str], bucket: float, width: float) -> DataFrame:
    """``by, place, s_place, value`` for each distinct place of ``wanted(by, place)`` with a series row within ``width``.

    ``series(by, s_place, value)``: ties go to the lower place, then the smaller value. Places that lie
    together in large numbers are matched once, as are series rows of one place. Nulls match nothing.
    """
    reach = max(1, ceil(width / bucket))
    keys = [*by, "as_bucket"]
    at = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    asked = wanted.where(F.col(place).isNotNull()).select(*by, F.col(place).alias("as_place")).distinct()
    given = series.where(F.col(s_place).isNotNull()).groupBy(*by, F.col(s_place).alias("as_place")).agg(F.min(value).alias("as_value"))
    given = given.select(*by, at("as_place").alias("as_bucket"), "as_place", F.struct("as_place", "as_value").alias("as_row"))
    asked = asked.select(*by, at("as_place").alias("as_bucket"), "as_place", F.lit(None).cast(given.schema["as_row"].dataType).alias("as_row"))
    order = Window.partitionBy(*keys).orderBy("as_place", F.col("as_row").isNull())
    back = Window.partitionBy(*keys).orderBy(F.desc("as_place"), F.col("as_row").isNull())  # running, too: a frame to the end is read anew for each row
    both = asked.unionByName(given).withColumns({
        "as_before": F.last("as_row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "as_after": F.last("as_row", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
    })
    here = both.where("as_row is null").drop("as_row")
    edges = given.groupBy(*keys).agg(F.min("as_row").alias("low"), F.max("as_row").alias("high"))
    steps = lambda low, high: F.explode(F.sequence(F.col("as_bucket") + low, F.col("as_bucket") + high))
    up = edges.select(*by, steps(1, reach).alias("as_bucket"), F.col("high").alias("below"), F.lit(None).cast(given.schema["as_row"].dataType).alias("above"))
    down = edges.select(*by, steps(-reach, -1).alias("as_bucket"), F.lit(None).cast(given.schema["as_row"].dataType).alias("below"), F.col("low").alias("above"))
    around = up.unionByName(down).groupBy(*keys).agg(F.max("below").alias("below"), F.min("above").alias("above"))
    met = here.join(around, keys, "left").select(*by, "as_place", F.coalesce("as_before", "below").alias("before"), F.coalesce("as_after", "above").alias("after"))
    gap = lambda side: F.abs(F.col(f"{side}.as_place") - F.col("as_place"))
    first = F.col("after").isNull() | (gap("before") <= gap("after"))
    found = met.withColumn("as_row", F.when(first, F.col("before")).otherwise(F.col("after"))).where(F.abs(F.col("as_row.as_place") - F.col("as_place")) <= width)
    return found.select(*by, F.col("as_place").alias(place), F.col("as_row.as_place").alias(s_place), F.col("as_row.as_value").alias(value))


def nearest_in_time(wanted: DataFrame, series: DataFrame, t: str, key: str, value: str, bucket_hours: float, width: float) -> DataFrame:
    """``key, s_t, value``: for each ``wanted(key, t)`` the nearest of ``series(s_t, value)`` within ``width`` hours, ties to the earlier."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = wanted.select(key, micros(t).alias("as_t"))
    found = nearest(asked, series.select(micros("s_t").alias("as_s"), "s_t", value).select("as_s", F.struct("s_t", value).alias("as_v")), "as_t", "as_s", "as_v", [], bucket_hours * 3.6e9, width * 3.6e9)
    return asked.join(found, "as_t").select(key, "as_v.s_t", f"as_v.{value}")


def _or_error(found: Column, missing: str, what: Column) -> Column:
    """``found``, or where it is null an error or null."""
    return found if missing == "null" else F.coalesce(found, F.raise_error(what))


def last_match(requests: DataFrame, records: DataFrame, on: list[str], order: list[str], values: list[str], missing: str = "error") -> DataFrame:
    """The requests with ``values`` of the last record, by ``order``, that equals them in ``on``.

    An archive may hold a field of a level several times; later ones replace earlier ones. A request
    without a record is an error unless ``missing`` is ``null``.
    """
    last = records.groupBy(*on).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("as_last"))
    what = F.concat(F.lit("no record of "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    return requests.join(last, on, "left").withColumn("as_last", _or_error(F.col("as_last"), missing, what)).select(*requests.columns, *[F.col(f"as_last.{v}").alias(v) for v in values])


def nearest_day(requests: DataFrame, records: DataFrame, field: str, day: str, value: str, limit: float = 1.0, missing: str = "error") -> DataFrame:
    """The requests with ``found_day`` and ``value`` of their field's record of the nearest day, at most ``limit`` days away; ties to the earlier day.

    A request without one is an error unless ``missing`` is ``null``.
    """
    series = records.select(field, F.col(day).cast("double").alias("found_day"), value)
    asked = requests.withColumn("as_day", F.col(day).cast("double"))
    found = nearest(asked, series, "as_day", "found_day", value, [field], max(limit, 1e-9), limit).select(field, "as_day", F.struct("found_day", value).alias("as_found"))
    what = F.concat(F.lit("no record within the limit of day "), F.coalesce(F.col("as_day").cast("string"), F.lit("null")), F.lit(" of "), F.coalesce(F.col(field).cast("string"), F.lit("null")))
    out = asked.join(found, [field, "as_day"], "left").withColumn("as_found", _or_error(F.col("as_found"), missing, what))
    return out.select(*requests.columns, "as_found.found_day", f"as_found.{value}")


def exact_match(requests: DataFrame, records: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """The number of the one record that a request overwrites, ``record``: the last that is equal in ``on``, null if there is none."""
    last = records.groupBy(*on).agg(F.max_by(F.col(order[-1]), F.struct(*order)).alias("record"))
    return requests.join(last, on, "left")
