"""Irregular grids of random points with a least distance, drawn all at once.

Candidates have random priorities. A point is taken when no candidate too near to it comes before it,
and whatever is too near to a taken point goes; rounds repeat until all are taken or gone. Two points of
one cell as wide as the distance are too near, so only the first of each cell can be taken in a round and
only these few meet the points around them. The points taken are those that drawing one by one in order
of priority would give, whatever the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.sources.tables import StateStore


def _too_near(points: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Pairs of ``points(p_id, p_x, p_y, p_rank)`` and ``others(o_...)`` within ``least`` in both axes."""
    cell = lambda c: F.floor(F.col(c) / least).cast("long")
    spread = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = points.withColumn("cx", spread("p_x")).withColumn("cy", spread("p_y"))
    b = others.withColumn("cx", cell("o_x")).withColumn("cy", cell("o_y"))
    near = (F.abs(F.col("p_x") - F.col("o_x")) <= least) & (F.abs(F.col("p_y") - F.col("o_y")) <= least) & (F.col("p_id") != F.col("o_id"))
    return a.join(b, ["cx", "cy"]).where(near)


def _named(points: DataFrame, letter: str) -> DataFrame:
    return points.select(*[F.col(c).alias(f"{letter}_{c}") for c in ("id", "x", "y", "rank")])


def spaced(candidates: DataFrame, least: float, rank: Column | None = None, store: StateStore | None = None, most_rounds: int = 200) -> DataFrame:
    """Of ``candidates(id, x, y)`` a set in which no two are within ``least`` in both axes and to which none can be added.

    ``rank`` is the priority, a hash of the id unless given; ties go to the smaller id.
    """
    store = store or StateStore.temporary(candidates.sparkSession)
    ranked = candidates.select("id", "x", "y", F.struct((F.xxhash64("id") if rank is None else rank).alias("r"), F.col("id").alias("i")).alias("rank"))
    left = store.write(ranked, 0, "left")
    taken = []
    for k in range(1, most_rounds):
        firsts = left.groupBy(*[F.floor(F.col(c) / least).alias(f"cell_{c}") for c in "xy"]).agg(F.min_by(F.struct("id", "x", "y", "rank"), "rank").alias("f")).select("f.*")
        firsts = store.write(firsts, k, "firsts")
        before = _too_near(_named(firsts, "p"), _named(left, "o"), least).where("o_rank < p_rank").select(F.col("p_id").alias("id")).distinct()
        now = store.write(firsts.join(before, "id", "left_anti"), k, "taken")
        taken.append(now)
        gone = _too_near(_named(now, "p"), _named(left, "o"), least).select(F.col("o_id").alias("id")).union(now.select("id")).distinct()
        left = store.write(left.join(gone, "id", "left_anti"), k, "left")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"points did not settle in {most_rounds} rounds")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select("id", "x", "y")


def random_points(spark, count: int, bounds: tuple[float, float, float, float], least: float | None = None, seed: int = 0, tries: int = 10, store: StateStore | None = None) -> DataFrame:
    """``id, x, y`` of ``count`` points within ``(x0, x1, y0, y1)``, no two within ``least`` in both axes.

    ``tries`` times as many candidates are drawn; it is an error if they leave fewer than ``count`` points.
    """
    x0, x1, y0, y1 = bounds
    drawn = spark.range(count * (tries if least else 1)).select("id", (x0 + (x1 - x0) * F.rand(seed)).alias("x"), (y0 + (y1 - y0) * F.rand(seed + 1)).alias("y"))
    if not least:
        return drawn
    store = store or StateStore.temporary(spark)
    points = store.write(spaced(store.write(drawn, 0, "drawn"), least, store=store), 0, "points")
    if points.count() < count:
        raise RuntimeError(f"no room for {count} points that are {least} apart")
    return points.orderBy(F.xxhash64("id"), "id").limit(count)
