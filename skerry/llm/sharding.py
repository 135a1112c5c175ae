"""Sharding by minimax contiguous partition of atomic groups.

Equal texts form one group and stay together. Groups stand in a fixed order, by the digest of their
text; the smallest capacity for which a greedy walk fits them into the shards is found by binary
search, and the cuts are made there. The walk needs only the largest prefix sum below a bound, so the
search runs over sketches: windows in which the cuts must lie are cut into cells, Spark sums up each
cell's first and last prefix, and the driver, holding a bounded number of cells, narrows capacity and
windows until they are exact. A group larger than a fair share comes first in the order, in a shard of
its own, so that the other shards stay near equal. DataFrame expressions only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.scratch import Scratch

SHARDS = 24
CELLS = 1024
ROW_BYTES = 8


class _Sketch:
    """Prefix sums known by cells: first and last one of each, ascending."""

    def __init__(self, prefix: DataFrame, windows: list[tuple[int, int]], cells: int):
        cell, base = F.lit(None).cast("long"), 0
        for a, b in windows:
            width = max(1, -(-(b - a + 1) // cells))
            cell = F.when(F.col("upto").between(a, b), base + F.floor((F.col("upto") - a) / width)).otherwise(cell)
            base += cells
        known = prefix.select("upto", cell.alias("cell")).where("cell is not null").groupBy("cell").agg(F.min("upto").alias("a"), F.max("upto").alias("b"))
        rows = sorted((r["a"], r["b"]) for r in known.collect())  # at most shards x cells
        self.first, self.last = [a for a, _ in rows], [b for _, b in rows]

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the largest prefix up to ``x``."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0
        return (self.last[i], self.last[i]) if self.last[i] <= x else (self.first[i], x)

    def above(self, x: int) -> tuple[int, int]:
        """Bounds of the smallest prefix from ``x`` on."""
        i = bisect_left(self.last, x)
        if x <= 0:
            return 0, 0
        return (self.first[i], self.first[i]) if self.first[i] >= x else (x, self.last[i])

    def walk(self, capacity: int, shards: int, side: int) -> list[int]:
        """Greedy cuts from the left, by the lower (0) or upper (1) bounds."""
        at, cuts = 0, []
        for _ in range(shards):
            at = self.below(at + capacity)[side]
            cuts.append(at)
        return cuts

    def walk_back(self, capacity: int, shards: int, total: int, side: int) -> list[int]:
        """Least cuts that leave what follows feasible, found from the right."""
        at, cuts = total, []
        for _ in range(shards - 1):
            at = self.above(at - capacity)[side]
            cuts.append(at)
        return cuts[::-1]


def _search(low: int, high: int, ok) -> int:
    """The smallest value in (low, high] that holds, if high does."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


def _windows(lows: list[int], highs: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in zip(lows, highs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def minimax_cuts(prefix: DataFrame, total: int, largest: int, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """Smallest feasible capacity over ``prefix(upto)``, and prefix sums to cut at.

    Among the cuts that keep to the capacity those nearest to even shares are taken, so that the last
    shard isn't left with a remainder.
    """
    if not total:
        return 0, []
    low, high = max(largest, -(-total // shards)) - 1, -(-total // shards) + largest
    windows = [(0, total)]
    while True:
        sketch = _Sketch(prefix, windows, cells)
        surely = _search(low, high, lambda c: sketch.walk(c, shards, 0)[-1] >= total)
        maybe = _search(low, high, lambda c: sketch.walk(c, shards, 1)[-1] >= total)
        lows, highs = sketch.walk(maybe, shards, 0), sketch.walk(surely, shards, 1)
        if maybe == surely and lows == highs:
            break
        low, high = maybe - 1, surely
        windows = _windows(lows, highs)
    capacity, windows = surely, [(0, total)]
    while True:
        sketch = _Sketch(prefix, windows, cells)
        lows, highs = (sketch.walk_back(capacity, shards, total, side) for side in (0, 1))
        if lows == highs:
            break
        windows = _windows(lows, highs) + [(total, total)]
    even = [total * k // shards for k in range(1, shards)]
    points = F.array(*[F.struct(F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias("a"), F.min(F.when(F.col("upto") >= x, F.col("upto"))).alias("b")) for x in even])
    near = prefix.agg(points.alias("p")).first()["p"] if even else []
    cuts: list[int] = []
    for x, least, found in zip(even, lows, near):
        a, b = found["a"] or 0, found["b"]
        cut = max(least, a if x - a <= b - x else b, cuts[-1] if cuts else 0)
        most = (cuts[-1] if cuts else 0) + capacity
        if cut > most:
            cut = prefix.where(F.col("upto") <= most).agg(F.max("upto")).first()[0] or 0
        cuts.append(cut)
    return capacity, cuts


def _prefix(groups: DataFrame) -> DataFrame:
    """Groups with ``upto``, the running sum of bytes in digest order, by buckets of digests and their offsets."""
    bucket = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    rows = groups.withColumn("bucket", bucket)
    sums = rows.groupBy("bucket").agg(F.sum("bytes").alias("bytes"))  # at most 4096 rows
    offsets = sums.select("bucket", (F.sum("bytes").over(Window.orderBy("bucket")) - F.col("bytes")).alias("offset"))
    running = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("digest"))
    return rows.withColumn("running", running).join(F.broadcast(offsets), "bucket").select("digest", "bytes", (F.col("offset") + F.col("running")).alias("upto"))


def _size(text: Column) -> Column:
    return (F.octet_length(text) + ROW_BYTES).cast("long")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, group_digest``.

    ``law`` is ``bytes``: the largest shard is as small as whole groups in this order allow. Null
    texts have no bytes and are one group with empty texts. Slots are dealt by a hash of id, text and
    number of the copy, so even a shard that one group, one id or one repeated row fills is numbered by
    many tasks. Repeated rows each get a slot, null ids too. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), _size(text).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group_digest"))
    rows = scratch.write(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "rows")  # repeated rows are one with a number
    groups = scratch.write(rows.groupBy(F.col("group_digest").alias("digest")).agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "groups")
    n, total, largest = groups.agg(F.count("*"), F.sum("bytes"), F.max("bytes")).first()
    top = [(r["digest"], r["bytes"]) for r in groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()]
    giants: list[str] = []
    rest = total or 0
    for digest, size in top[: shards - 1]:  # none smaller can exceed a fair share of the rest
        if size * (shards - len(giants)) <= rest:
            break
        giants.append(digest)
        rest -= size
    largest = top[len(giants)][1] if len(giants) < len(top) else 0
    prefix = scratch.write(_prefix(groups.where(~F.col("digest").isin(giants)) if giants else groups), "prefix")
    _, cuts = minimax_cuts(prefix, rest, largest, shards - len(giants))
    ends = {r["upto"]: r["digest"] for r in prefix.where(F.col("upto").isin(cuts)).collect()} if cuts else {}
    number = F.lit(len(giants))
    for cut in cuts:
        number = number + (F.col("group_digest") > ends[cut]).cast("int") if cut in ends else number
    for i, digest in enumerate(giants):
        number = F.when(F.col("group_digest") == digest, i).otherwise(number)
    count = rows.agg(F.sum("copies")).first()[0] or 0
    cells = 256 + count // 50_000
    placed = rows.withColumn("shard", number.cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(cells)))
    sizes = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = scratch.write(sizes.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("offset")), "offsets")
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "copy"))
    return (
        placed.withColumn("within", within)
        .join(offsets, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "group_digest",
        )
    )
