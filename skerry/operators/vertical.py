"""Layer depths and vertical interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.expr import let


def layer_depths(layers: DataFrame, key: str) -> DataFrame:
    """Adds ``z``, the cumulative depth of a layer's far side, from thickness ``dz`` in order of ``lev``."""
    return layers.withColumn("z", F.sum("dz").over(Window.partitionBy(key).orderBy("lev")))


def interpolate(obs: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """``obs_id, value`` of ``obs(key, obs_id, oz)`` in ``layers(key, lev, f, z)``.

    Values stand at layer centres: constant above the first centre, linear between centres, constant
    from the last centre to the last depth, which is included. Intervals are half-open; where they
    overlap the later layer counts. A collapsed interval gives the layer before it.
    """
    order = Window.partitionBy(key).orderBy("lev")
    rows = layers.withColumns({"fp": F.lag("f").over(order), "zp": F.coalesce(F.lag("z").over(order), F.lit(0.0)), "zpp": F.coalesce(F.lag("z", 2).over(order), F.lit(0.0)), "last": F.lead("lev").over(order).isNull()})
    dz, dzp = F.col("z") - F.col("zp"), F.col("zp") - F.col("zpp")
    part = lambda rank, low, high, closed, f_low, f_high: F.struct(
        F.lit(rank).alias("part"), F.least(low, high).alias("low"), F.greatest(low, high).alias("high"), closed.alias("closed"),
        low.alias("z_low"), high.alias("z_high"), f_low.alias("f_low"), f_high.alias("f_high"),
    )
    f, no = F.col("f"), F.lit(False)
    top = F.when(F.col("fp").isNull(), part(0, F.lit(0.0) * dz, 0.5 * dz, no, f, f))
    middle = F.when(F.col("fp").isNotNull(), part(1, F.col("zp") - 0.5 * dzp, F.col("zp") + 0.5 * dz, no, F.col("fp"), f))
    bottom = F.when(F.col("last"), part(2, F.col("z") - 0.5 * dz, F.col("z"), F.lit(True), f, f))
    intervals = rows.select(key, "lev", F.explode(F.array(top, middle, bottom)).alias("p")).where("p is not null").select(key, "lev", "p.*")
    z = F.col("oz")
    met = obs.join(intervals, key).where((z >= F.col("low")) & ((z < F.col("high")) | (F.col("closed") & (z == F.col("high")))))
    wide = F.col("z_high") - F.col("z_low")
    value = F.when(wide == 0, F.col("f_low")).otherwise(((F.col("z_high") - z) * F.col("f_low") + (z - F.col("z_low")) * F.col("f_high")) / wide)
    return met.groupBy(key, "obs_id").agg(F.max_by(value, F.struct("lev", "part")).alias("value"))


def in_column(layers: str, oz: Column, f: str, z: str) -> Column:
    """As ``interpolate``, for one depth in an array of layers in order; null where the column has no value."""
    start = F.struct(F.lit(None).cast("double").alias("fp"), F.lit(0.0).alias("zp"), F.lit(0.0).alias("zpp"), F.lit(None).cast("double").alias("value"))

    def within(low: Column, high: Column) -> Column:
        return (oz >= F.least(low, high)) & (oz < F.greatest(low, high))

    def step(acc: Column, layer: Column) -> Column:
        dz, dzp = layer[z] - acc["zp"], acc["zp"] - acc["zpp"]
        low, high = acc["zp"] - 0.5 * dzp, acc["zp"] + 0.5 * dz
        between = F.when(high == low, acc["fp"]).otherwise(((high - oz) * acc["fp"] + (oz - low) * layer[f]) / (high - low))
        top = acc["fp"].isNull() & within(F.lit(0.0), 0.5 * dz)
        value = F.when(top, layer[f]).when(acc["fp"].isNotNull() & within(low, high), between).otherwise(acc["value"])
        return F.struct(layer[f].alias("fp"), layer[z].alias("zp"), acc["zp"].alias("zpp"), value.alias("value"))

    def last(acc: Column) -> Column:
        low, high = acc["zp"] - 0.5 * (acc["zp"] - acc["zpp"]), acc["zp"]
        return F.when((oz >= F.least(low, high)) & (oz <= F.greatest(low, high)), acc["fp"]).otherwise(acc["value"])

    return F.aggregate(layers, start, step, last)


def adjust_layers(columns: DataFrame, unit: float = 1.0) -> DataFrame:
    """``dps``, thicknesses of a column in order, without negative ones and within ``depth`` times ``unit``.

    A negative thickness is passed down to the next layer, then up from the bottom as far as the
    fourth; interfaces stop at the bottom, where the last layer ends. Depths below 1 or above 100000
    leave a column as it is.
    """
    empty = F.array().cast("array<double>")
    n = F.size("dps")

    def sweep(values: Column, count: Column) -> Column:
        """Passes negative values on over the first ``count`` places; the place after takes the last debt."""
        start = F.struct(F.lit(0.0).alias("debt"), empty.alias("out"))
        step = lambda acc, x: F.struct(
            F.least(F.lit(0.0), x + acc["debt"]).alias("debt"), F.concat(acc["out"], F.array(F.greatest(x + acc["debt"], F.lit(0.0)))).alias("out")
        )
        swept = F.aggregate(F.slice(values, 1, F.greatest(count, F.lit(0))), start, step)
        rest = F.slice(values, F.greatest(count, F.lit(0)) + 1, n)
        owed = lambda done: F.transform(rest, lambda x, i: F.when(i == 0, x + done["debt"]).otherwise(x))
        return let(swept, lambda done: F.concat(done["out"], owed(done)))

    bottom = F.col("depth") * unit
    interface = lambda acc, x: F.struct(F.least(bottom, acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(F.least(bottom, acc["at"] + x))).alias("out"))
    press = lambda up: F.aggregate(up, F.struct(F.lit(0.0).alias("at"), empty.alias("out")), interface, lambda acc: acc["out"])
    ended = lambda p: F.transform(p, lambda x, i: F.when(i == n - 1, bottom).otherwise(x))
    thick = lambda p: F.transform(p, lambda x, i: x - F.when(i == 0, 0.0).otherwise(F.get(p, i - 1)))
    back = lambda down: F.reverse(sweep(F.reverse(down), n - 3))
    fixed = let(sweep(F.col("dps"), n - 1), lambda down: let(back(down), lambda up: let(ended(press(up)), thick)))
    odd = (F.col("depth") > 100000.0) | (F.col("depth") < 1.0)
    return columns.withColumn("dps", F.when(odd, F.col("dps")).otherwise(fixed))
