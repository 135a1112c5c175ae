"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, known: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the component's smallest node.

    Each half-step keeps at most as many edges as it got and ends in one aggregation by node, so a
    hub's neighbours are combined before the shuffle. Self-loops and repeated edges do no harm; an
    empty table gives an empty result. Rounds grow with the logarithm of the component size; they end
    when every edge leads from a root to a node of its own.

    ``known(node, root)`` are components found before, which the edges add to: edges then join
    components, those within one are done, and only the others take rounds.
    """
    now = scratch.write(_ordered(_between(edges, known) if known else edges), "edges")
    for _ in range(max_rounds):
        if _starlike(now):
            break
        after = scratch.write(_small_star(_large_star(now)), "edges")
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # every edge is now (root, node)
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    found = nodes.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    if not known:
        return found
    if now.isEmpty():
        return known
    moved = known.join(nodes.toDF("root", "whole"), "root", "left").select("node", F.coalesce("whole", "root").alias("root"))
    return moved.union(found.join(known, "node", "left_anti").select("node", "root"))


def _between(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges between components instead of between their nodes."""
    for end in "ab":
        edges = edges.join(known.toDF(end, f"{end}_root"), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return edges.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))


def _starlike(edges: DataFrame) -> bool:
    """Whether no node of the distinct ``edges`` has two smaller neighbours, or both a smaller and a larger one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("n")), F.struct(F.col("b").alias("node"), F.lit(1).alias("n")))).alias("end"))
    seen = ends.groupBy("end.node").agg(F.sum("end.n").alias("below"), F.min("end.n").alias("least"))
    return seen.where("below > 1 or (below = 1 and least = 0)").isEmpty()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    kept = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return (
        moved.union(kept).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )
