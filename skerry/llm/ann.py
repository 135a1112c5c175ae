"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and every vector is put into its leaf. A query walks the tree
with a priority queue: it goes down to the nearest child, keeps the others by their distance, and goes
on from the nearest one kept, so that leaves come up in the order of promise. How many leaves a query
visits is calibrated: for a sample of queries the true neighbours among all vectors are found by brute
force, and visits are widened until the wanted recall is reached.

Equal vectors are merged before anything else; each keeps its few smallest ids, as no others can be
among the nearest. Leaves are stored as blocks of bounded size and meet the blocks of queries that
visit them; each meeting yields a query's few best, so no leaf or query set has to fit one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.sampling import bounded_sample
from skerry.llm.scratch import Scratch

SAMPLE = 20_000
BRANCHES = 8
LEAF_SAMPLE = 64
CALIBRATION_QUERIES = 200
RECALL = 0.96
BLOCK = 4096
QUERY_BLOCK = 512


class Tree:
    """Centres of a k-means hierarchy over unit vectors."""

    def __init__(self, points: np.ndarray, seed: int = 0, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # a node's children; leaves are -1 - their number
        self.leaves = 0
        self.root = self._grow(points, np.random.default_rng(seed), branches, leaf)

    def _grow(self, points: np.ndarray, draw: np.random.Generator, branches: int, leaf: int) -> int:
        distinct = np.unique(points, axis=0) if len(points) > leaf else points
        if len(distinct) <= leaf:
            self.leaves += 1
            return -self.leaves
        centres = distinct[draw.choice(len(distinct), branches, replace=False)]
        for _ in range(12):
            nearest = _nearest(points, centres)
            centres = np.stack([points[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(branches)])
        nearest = _nearest(points, centres)
        used = [k for k in range(branches) if (nearest == k).any()]
        if len(used) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[node] = [self._grow(points[nearest == k], draw, branches, leaf) for k in used]
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """Leaf number of each point by nearest centres from the root down."""
        out = np.zeros(len(points), dtype=np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            nearest = _nearest(points[rows], self.centres[node])
            todo += [(child, rows[nearest == k]) for k, child in enumerate(self.children[node]) if (nearest == k).any()]
        return out

    def leaves_by_promise(self, point: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order."""
        queue, found, ticket = [(0.0, 0, self.root)], [], 0
        while queue and len(found) < most:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                continue
            apart = ((self.centres[node] - point) ** 2).sum(axis=1)
            for child, distance in zip(self.children[node], apart.tolist()):
                ticket += 1
                heapq.heappush(queue, (distance, ticket, child))
        return found


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int64)
    bias = (centres**2).sum(axis=1) / 2
    for i in range(0, len(points), 8192):
        out[i : i + 8192] = (points[i : i + 8192] @ centres.T - bias).argmax(axis=1)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1))[:, None]


def _best(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, vector places and cosines of each query's best ``k``, with ties at the last."""
    near = _unit(queries) @ _unit(vectors).T
    k = min(k, near.shape[1])
    last = np.partition(near, near.shape[1] - k, axis=1)[:, -k]
    rows, cols = np.nonzero(near >= last[:, None] - 1e-12)
    a, b = queries[rows].astype(np.float64), vectors[cols].astype(np.float64)  # pair by pair: equal pairs give equal cosines
    return rows, cols, (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _pack(rows: DataFrame, block: int, dim: int, keys: list[str], kind: type) -> DataFrame:
    """One row for up to ``block`` rows of equal ``keys``: ids and a matrix as bytes."""

    def run(table: pa.Table) -> pa.Table:
        vectors = _matrix(table.column("vector").combine_chunks(), dim).astype(kind)
        ids = table.column("vid").to_numpy()
        order = np.argsort(ids, kind="stable")
        starts = range(0, len(ids), block)
        out = {k: pa.concat_arrays([table.column(k).slice(0, 1).combine_chunks()] * len(starts)) for k in keys}
        out |= {"vids": pa.array([ids[order[i : i + block]] for i in starts], pa.list_(pa.int64())), "matrix": pa.array([vectors[order[i : i + block]].tobytes() for i in starts], pa.binary())}
        return pa.table(out)

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", vids array<bigint>, matrix binary"
    return rows.groupBy(*keys).applyInArrow(run, schema)


def _meet(pairs: DataFrame, dim: int, k: int, kind: type) -> DataFrame:
    """Best ``k`` of each meeting of a query block and a vector block: ``qid, vid, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: B023, E731
                queries, vectors = (np.frombuffer(get(c).as_py(), dtype=kind).reshape(-1, dim) for c in ("q_matrix", "matrix"))
                rows, cols, scores = _best(queries, vectors, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get("qids").values.to_numpy()[rows]), pa.array(get("vids").values.to_numpy()[cols]), pa.array(scores)], names=["qid", "vid", "score"]
                )

    return pairs.select("qids", "q_matrix", "vids", "matrix").mapInArrow(run, "qid bigint, vid bigint, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def search(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for rows with ids divisible by ``every``.

    Nearness is the cosine in double precision; ties go to the smaller id. Null, zero and non-finite
    vectors, vectors of another length than the most frequent one, and null ids take no part. Of rows
    repeated with id and vector one counts. With fewer than ``k`` other rows all are returned; an empty
    table gives an empty result. Other columns are not read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    double = getattr(table.schema[vector_col].dataType.elementType, "typeName", str)() not in ("float", "byte", "short")  # scores are of the original vectors
    kind, name = (np.float64, "double") if double else (np.float32, "float")
    rows = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast(f"array<{name}>").alias("vector")).where("id is not null and vector is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = length["d"] if length else 1
    rows = rows.where(F.size("vector") == dim).withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast(name)).otherwise(x)))  # one zero
    # a vector's k + 1 smallest ids are all that any query can return of it
    few = rows.dropDuplicates(["vector", "id"]).withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    vectors = scratch.write(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0]), "vectors")
    queries = scratch.write(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector").distinct(), "queries")
    asked = queries.select("vector").distinct().join(vectors.select("vector", "vid"), "vector")

    picked = bounded_sample(vectors.select("vid", "vector"), "vid", sample).select("vector").toArrow()  # bounded by the parameter
    tree = Tree(_unit(_matrix(picked.column("vector").combine_chunks(), dim)) if picked.num_rows else np.zeros((0, dim)))
    shared = spark.sparkContext.broadcast(tree)  # no more centres than sampled vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaf_of(_unit(_matrix(batch.column("vector"), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("vid"), batch.column("vector")], names=["leaf", "vid", "vector"])

    placed = vectors.select("vid", "vector").mapInArrow(place, f"leaf int, vid bigint, vector array<{name}>")
    count = vectors.count()
    salts = 1 + count // (16 * BLOCK)  # a crowded leaf is packed by several tasks
    blocks = scratch.write(_pack(placed.withColumn("salt", F.pmod(F.xxhash64("vid"), F.lit(salts))), BLOCK, dim, ["leaf", "salt"], kind), "blocks")

    tried = bounded_sample(asked, "vid", CALIBRATION_QUERIES, seed=1).select("vid", "vector").toArrow()
    probes = _matrix(tried.column("vector").combine_chunks(), dim) if tried.num_rows else np.zeros((0, dim), kind)
    visits = _calibrate(blocks, tried.column("vid").to_numpy(), probes, tree, k, recall, dim, kind)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(_matrix(batch.column("vector"), dim))
            for i in range(batch.num_rows):
                leaves = shared.value.leaves_by_promise(units[i], visits)
                n = len(leaves)
                again = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), *(batch.column(c).take(again) for c in ("vid", "vector"))], names=["leaf", "vid", "vector"])

    parts = 1 + asked.count() // QUERY_BLOCK
    visiting = asked.select("vid", "vector").mapInArrow(ask, f"leaf int, vid bigint, vector array<{name}>")
    asking = _pack(visiting.withColumn("part", F.pmod(F.xxhash64("vid"), F.lit(parts))), QUERY_BLOCK, dim, ["leaf", "part"], kind)
    pairs = asking.select("leaf", F.col("vids").alias("qids"), F.col("matrix").alias("q_matrix")).join(blocks, "leaf")
    found = scratch.write(_top(_meet(pairs, dim, k + 1, kind), k + 1), "found")
    named = found.join(vectors.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    wanted = queries.join(vectors.select("vector", F.col("vid").alias("qid")), "vector").select("query_id", "qid")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = wanted.join(named, "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrate(blocks: DataFrame, qids: np.ndarray, probes: np.ndarray, tree: Tree, k: int, recall: float, dim: int, kind: type) -> int:
    """Leaf visits at which the wanted share of the probes' true neighbours is found."""
    if not len(qids):
        return tree.leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vectors = np.frombuffer(batch.column("matrix")[i].as_py(), dtype=kind).reshape(-1, dim)
                rows, cols, scores = _best(probes, vectors, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[rows]), pa.array(batch.column("vids")[i].values.to_numpy()[cols]), pa.array(scores), pa.array(np.full(len(rows), batch.column("leaf")[i].as_py()), pa.int32())],
                    names=["qid", "vid", "score", "leaf"],
                )

    truth = _top(blocks.mapInArrow(run, "qid bigint, vid bigint, score double, leaf int"), k + 1).where("qid <> vid").select("qid", "leaf").collect()
    order = {q: {leaf: n for n, leaf in enumerate(tree.leaves_by_promise(u, tree.leaves))} for q, u in zip(qids.tolist(), _unit(probes))}
    ranks = np.sort([order[r["qid"]][r["leaf"]] for r in truth])  # at most k + 1 for each probe
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else tree.leaves
