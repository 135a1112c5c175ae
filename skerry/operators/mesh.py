"""Topology of triangle meshes: layers of nodes from the boundary inwards, tapers over them, moving nodes.

Meshes are ``(tri, n1, n2, n3)``. Layers come from a frontier that moves on by one join of the edges a
round; a round reads the last frontier and what has been reached, both stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.grid import boundary_edges
from skerry.sources.tables import StateStore


def edges(mesh: DataFrame) -> DataFrame:
    """``node, next`` for both directions of every edge."""
    pairs = [(a, b) for a in ("n1", "n2", "n3") for b in ("n1", "n2", "n3") if a != b]
    return mesh.select(F.explode(F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("next")) for a, b in pairs])).alias("e")).select("e.*").distinct()


def boundary_nodes(mesh: DataFrame) -> DataFrame:
    """``node`` of every edge that only one triangle has."""
    rim = boundary_edges(mesh)
    return rim.select(F.col("a").alias("node")).union(rim.select("b")).distinct()


def neighbour_nodes(mesh: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that share an edge with one of ``nodes(node)``; those may be among them."""
    return edges(mesh).join(nodes.select("node").distinct(), "node").select(F.col("next").alias("node")).distinct()


def layers(mesh: DataFrame, depth: int, store: StateStore | None = None) -> DataFrame:
    """``node, layer``: boundary nodes are layer 0, their neighbours 1, and so on below ``depth``."""
    store = store or StateStore.temporary(mesh.sparkSession)
    links = store.write(edges(mesh), 0, "edges")
    reached = store.write(boundary_nodes(mesh).withColumn("layer", F.lit(0)), 0, "reached")
    for layer in range(1, depth):
        front = reached.where(F.col("layer") == layer - 1).select("node")
        found = links.join(front, "node").select(F.col("next").alias("node")).distinct().join(reached.select("node"), "node", "left_anti").withColumn("layer", F.lit(layer))
        found = store.write(found, layer, "front")
        if found.isEmpty():
            break
        reached = store.write(reached.unionByName(found), layer, "reached")
    return reached


def taper_boundary(field: DataFrame, mesh: DataFrame, values: list[str], depth: int = 5, store: StateStore | None = None) -> DataFrame:
    """``field(node, ...)`` with ``values`` zero at the boundary and growing with the layer to their own at ``depth``."""
    share = layers(mesh, depth, store).select("node", (F.col("layer") / depth).alias("mesh_share"))
    scaled = {v: F.col(v) * F.coalesce("mesh_share", F.lit(1.0)) for v in values}
    return field.join(share, "node", "left").withColumns(scaled).drop("mesh_share")


def displaced(nodes: DataFrame, mesh: DataFrame, shift: DataFrame, depth: int = 5, store: StateStore | None = None) -> DataFrame:
    """``nodes(node, x, y)`` moved by ``shift(node, u, v)``, which is tapered towards the boundary, so that the outline stays."""
    moved = nodes.join(taper_boundary(shift, mesh, ["u", "v"], depth, store).select("node", "u", "v"), "node", "left")
    return moved.select("node", (F.col("x") + F.coalesce("u", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("v", F.lit(0.0))).alias("y"))
