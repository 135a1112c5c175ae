"""SimHash near-duplicates: fingerprints, pigeonhole block joins, Hamming check, components.

Fingerprints within ``max_distance`` differing bits are linked. The 64 bits are cut into ``blocks``
blocks; two such fingerprints agree on at least ``blocks - max_distance`` of them, so each fingerprint
is keyed once for every choice of that many blocks and only equal keys are compared. Equal
fingerprints are merged first: exact copies, however many, take one row in the join.

On a key each fingerprint is first compared with the smallest and with the one before it, two rows a
member; pairs are formed only across the components which that leaves, so a group of near copies does
not become all its pairs. A key that more than ``bucket_limit`` distinct fingerprints share is not
expanded into pairs. Its members, unless all of one component, are keyed again by more blocks, which a
close pair shares too, so that its keys are longer and rarer. What shares long keys with many even then
is crowded: such fingerprints are first linked by
words within one bit of them. Where that leaves one component on a key, nothing is missing there; the
members of all other keys are linked by the words within ``max_distance / 2`` bits, of which any two
close ones share one. Every way is exact, so no link that changes a component is lost or invented.

``deduplicate`` links by similarity of shingle sets: beyond the links above, texts that share a band of
their MinHash signatures and are at most ``WIDE_DISTANCE`` bits apart are compared by the exact Jaccard
index of their shingles. Bands do not depend on how many texts there are. Bands that more than ``BAND_LIMIT``
fingerprints share are tried by longer keys first; what components they hold even then are compared by
the rarest of the shingles in which each text differs from most others of its band.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.components import connected_components
from skerry.llm.scratch import Scratch, broadcast_if_small

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
BUCKET_LIMIT = 256
#: ``deduplicate``: words of a shingle, least Jaccard index, and bits within which texts are compared.
DEDUP_SHINGLE, SIMILARITY = 5, 0.8
WIDE_DISTANCE = 22
#: MinHash bands and hashes a band: 98 % of pairs of a Jaccard index of 0.8 share a band, at every number of texts.
BANDS, BAND_ROWS, BAND_LIMIT = 14, 6, 32
_STEP = 1 << 15
_MINHASH_STEP = 1 << 10
_FACTORS = np.random.default_rng(42).integers(1 << 63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OFFSET = np.arange(8, dtype=np.int16) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter; none for blank texts."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII space only
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1))
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the text's word shingles; 0 for null, empty or blank texts."""
    hashes = shingle_hashes(text, shingle, seed)
    if not hashes:
        return 0
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(packed), _STEP):  # ones from a histogram of each byte
        seen = np.bincount((packed[i : i + _STEP] + _OFFSET).ravel(), minlength=2048).reshape(8, 256)
        ones += (seen @ _BITS).ravel()
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Vectorised column of ``fingerprint``."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return simhash(F.col(text))


def _print_and_keys(text: str, shingle: int) -> Column:
    """Fingerprint and MinHash band keys of a text, together."""

    @F.pandas_udf("fp long, keys array<long>")
    def both(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"fp": pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64"), "keys": [band_keys(t, shingle) for t in texts]})

    return both(F.col(text))


def fewest_blocks(count: int, max_distance: int = MAX_DISTANCE) -> int:
    """Blocks whose keys have a few more bits than ``count`` fingerprints need, so that chance collisions stay in proportion to the rows."""
    blocks = max_distance + 2
    while 64 * (blocks - max_distance) / blocks < log2(max(count, 2)) + 2 and blocks < 2 * max_distance + 4:
        blocks += 1
    return blocks


def block_masks(blocks: int, max_distance: int = MAX_DISTANCE) -> list[int]:
    """Signed masks of all block choices that close fingerprints share one of."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(choice) for choice in combinations(parts, blocks - max_distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _shared_keys(nodes: DataFrame, masks: list[int], scratch: Scratch) -> DataFrame:
    """``key, n`` and the columns of ``nodes``, for keys of two fingerprints or more; counts are combined before they are dealt.

    A key is a hash of a choice of blocks and the bits in them; if two keys meet, their members are compared in vain.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    keyed = nodes.select("*", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return scratch.write(keyed.join(sizes.hint("merge"), "key"), "shared-keys")  # up to half as many as the rows: no table to send through the driver


def _pairs(shared: DataFrame, max_distance: int, apart: str | None = None) -> DataFrame:
    """Distinct pairs ``a < b`` that share a key, differ in at most ``max_distance`` bits and have other values of ``apart``."""
    left, right = (shared.select("key", F.col("fp").alias(c), *([F.col(apart).alias(f"{c}_in")] if apart else [])) for c in "ab")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    if apart:
        close = close & (F.col("a_in") != F.col("b_in"))
    return left.join(right, "key").where(close).select("a", "b").distinct()


def _stars(nodes: DataFrame, radius: int) -> DataFrame:
    """Every word within ``radius`` bits links the fingerprints around it to their smallest; a word has no more of them than neighbours."""
    near = ["0L"] + ["|".join(f"shiftleft(1L,{i})" for i in c) for r in range(1, radius + 1) for c in combinations(range(64), r)]
    words = nodes.select("fp", F.explode(F.expr(f"transform(array({','.join(near)}), m -> fp ^ m)")).alias("word"))
    least = words.withColumn("a", F.min("fp").over(Window.partitionBy("word")))
    return least.where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def _chained(shared: DataFrame, max_distance: int) -> DataFrame:
    """Distinct close pairs of each fingerprint with its key's smallest and with the one before it: all pairs of keys of three, at most two a row of others."""
    order = Window.partitionBy("key").orderBy("fp")
    near = shared.select(F.array(F.first("fp").over(order), F.lag("fp").over(order)).alias("others"), F.col("fp").alias("b"))
    pairs = near.select(F.explode(F.array_distinct("others")).alias("a"), "b")
    return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).distinct()


def _joined(edges: list[DataFrame], scratch: Scratch, roots: DataFrame | None) -> DataFrame:
    """``node, root``: the components ``roots``, where there are any, with these edges added."""
    return scratch.write(connected_components(reduce(DataFrame.union, edges), scratch, roots), "roots") if edges else roots


def _parted(members: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """``members(key, n, fp)`` of the keys that hold several of the components ``roots(node, root)``, with their ``root``."""
    rooted = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "n", "fp", F.coalesce("root", "fp").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return scratch.write(rooted.join(split, "key", "left_semi"), "parted")


def links(nodes: DataFrame, count: int, scratch: Scratch, max_distance: int = MAX_DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` between the distinct fingerprints ``nodes(fp)``, with the components of all links."""
    return reduce(DataFrame.union, _linked(nodes, count, scratch, max_distance, bucket_limit)[0])


def linked(nodes: DataFrame, count: int, scratch: Scratch, max_distance: int = MAX_DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``node, root``: the components of all ``links``; fingerprints without any may be left out."""
    _, roots, more = _linked(nodes, count, scratch, max_distance, bucket_limit)
    return _joined(more, scratch, roots)


def _linked(nodes: DataFrame, count: int, scratch: Scratch, max_distance: int, bucket_limit: int) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """All edges, the components of those that were needed on the way, and the edges that these have not yet."""
    found, roots, start, more = [], None, fewest_blocks(count, max_distance), []
    for blocks in sorted({start, max(start, 2 * max_distance + 1), 3 * max_distance}):
        shared = _shared_keys(nodes, block_masks(blocks, max_distance), scratch)
        found.append(scratch.write(_chained(shared.where(F.col("n") <= bucket_limit), max_distance), "chains"))
        roots = _joined([*more, found[-1]], scratch, roots)
        parted = _parted(shared.where((F.col("n") > 3) | (F.col("n") > bucket_limit)), roots, scratch)
        found.append(scratch.write(_pairs(parted.where(F.col("n") <= bucket_limit), max_distance, "root"), "pairs"))
        more = [found[-1]]
        crowded = parted.where(F.col("n") > bucket_limit).drop("root")
        nodes = scratch.write(crowded.select("fp").distinct(), "crowded")
        if nodes.isEmpty():
            return found, roots, more
    found.append(scratch.write(_stars(nodes, max_distance // 4), "stars"))
    roots = _joined([*more, found[-1]], scratch, roots)
    rest = scratch.write(_parted(crowded, roots, scratch).select("fp").distinct(), "split")
    if rest.isEmpty():
        return found, roots, []
    found.append(scratch.write(_stars(rest, max_distance // 2), "stars"))
    return found, roots, found[-1:]


def band_keys(text: str | None, shingle: int = DEDUP_SHINGLE) -> list[int]:
    """A signed key for each band of the text's MinHash signature: two texts share one with a chance that follows from their Jaccard index alone."""
    hashes = np.unique(np.array(shingle_hashes(text, shingle), dtype=np.uint64))
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _MINHASH_STEP):
        some = hashes[i : i + _MINHASH_STEP, None] * _FACTORS
        np.minimum(least, ((some ^ (some >> np.uint64(29))) * _MIX).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _across(members: DataFrame, limit: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of fingerprints of different components on keys of at most ``limit`` members, and the members of the other keys.

    ``members(key, fp, root)``; keys of one component are left out.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    shared = scratch.write(members.join(sizes.select("key", "n").hint("merge"), "key"), "shared-keys")
    return _pairs(shared.where(F.col("n") <= limit), WIDE_DISTANCE, "root"), shared.where(F.col("n") > limit)


def candidates(keyed: DataFrame, scratch: Scratch, limit: int | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of ``keyed(key, fp, root)`` to compare: they share a key and are of different components.

    Members of a key that more than ``limit`` fingerprints share are keyed again by every two of their
    crowded keys. On a key that is crowded even then, all components' smallest fingerprints are compared
    with the first one's and with the next one's; ``similar`` compares what this leaves.
    """
    limit = limit or BAND_LIMIT
    single, crowded = _across(keyed, limit, scratch)
    found = [single]
    twice = crowded.groupBy("fp", "root").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    twos = F.expr("flatten(transform(keys, (x, i) -> transform(slice(keys, i + 2, size(keys)), y -> xxhash64(x, y))))")
    double, rest = _across(twice.select("fp", "root", F.explode(twos).alias("key")), limit, scratch)
    found.append(double)
    firsts = rest.groupBy("key", "root").agg(F.min("fp").alias("fp"))
    order = Window.partitionBy("key").orderBy("root")
    firsts = firsts.select("fp", F.lead("fp").over(order).alias("next"), F.first("fp").over(order).alias("first"))
    for other in ("next", "first"):
        pair = firsts.where(F.col(other).isNotNull() & (F.col(other) != F.col("fp"))).select(F.least("fp", other).alias("a"), F.greatest("fp", other).alias("b"))
        found.append(pair.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= WIDE_DISTANCE))
    return scratch.write(reduce(DataFrame.union, found).distinct(), "candidates")


def similar(nodes: DataFrame, rows: DataFrame, roots: DataFrame, scratch: Scratch, shingle: int, similarity: float) -> DataFrame:
    """Edges between fingerprints of different components whose texts have a Jaccard index of ``similarity`` or more.

    ``nodes(fp, first)`` are the distinct fingerprints of ``rows(fp, id, text, keys)`` with their smallest
    ids, whose texts count. Compared are those that share a MinHash band, at most ``WIDE_DISTANCE`` bits apart.
    """
    return reduce(DataFrame.union, _similar(nodes, rows, roots.withColumnRenamed("fp", "node"), scratch, shingle, similarity)[0])


def _similar(nodes: DataFrame, rows: DataFrame, roots: DataFrame, scratch: Scratch, shingle: int, similarity: float) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """The edges of ``similar``, the components ``roots(node, root)`` with those that were needed on the way, and the edges that these have not yet."""
    keyed = rows.select("fp", F.explode("keys").alias("key")).distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    pairs = candidates(keyed, scratch)
    sets = _shingle_sets(nodes, rows, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), scratch, shingle)
    found = scratch.write(_alike(pairs, sets, similarity), "similar")
    roots = _joined([found], scratch, roots)
    rest = _still_parted(keyed, roots, scratch)
    if rest.isEmpty():
        return [found], roots, []
    sets = _shingle_sets(nodes, rows, rest.select("fp"), scratch, shingle)
    more = scratch.write(_alike(scratch.write(_by_rare_shingles(rest, sets, scratch, similarity), "rare-pairs"), sets, similarity), "rare-similar")
    return [found, more], roots, [more]


def _shingle_sets(nodes: DataFrame, rows: DataFrame, asked: DataFrame, scratch: Scratch, shingle: int) -> DataFrame:
    """``fp, set``: the distinct shingle hashes of the fingerprints asked for, of the text of the smallest id."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.array(shingle_hashes(t, shingle), dtype=np.uint64)).view(np.int64) for t in texts], dtype=object)

    asked = nodes.join(asked, "fp").select(F.col("fp").alias("asked"), "first")
    asked = broadcast_if_small(scratch.write(asked, "asked"))
    texts = rows.join(asked, (F.col("fp") == F.col("asked")) & F.col("id").eqNullSafe(F.col("first"))).select("fp", "text").dropDuplicates(["fp"])
    return scratch.write(texts.select("fp", hashes("text").alias("set")), "shingles")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have a Jaccard index of ``similarity`` or more."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared_size = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared_size >= similarity * (F.size("set_a") + F.size("set_b") - shared_size)).select("a", "b")


def _still_parted(keyed: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp, root, keys``: members of bands of more than ``BAND_LIMIT`` fingerprints, where those held several components and still hold several of ``roots``."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("n") > BAND_LIMIT) & (F.col("low") != F.col("high")))
    crowded = scratch.write(keyed.join(sizes.select("key"), "key", "left_semi"), "crowded-bands")
    now = crowded.join(roots.toDF("fp", "whole"), "fp", "left").select("key", "fp", F.coalesce("whole", "root").alias("root"))
    split = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return scratch.write(now.join(split, "key", "left_semi").groupBy("fp", "root").agg(F.collect_set("key").alias("keys")), "still-parted")


def _by_rare_shingles(members: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``members(fp, root, keys)`` on a key, of different components, among which are links for all that have the Jaccard index ``similarity``.

    On a key a set is seen as its differences from the shingles that most of its members have, so what all
    share joins nothing. Sets differ in ``|A| + |B| - 2 |A and B|`` shingles, with A and B their differences, and
    are similar if that is at most ``(1 - s) / (1 + s)`` of their sizes' sum. With a set's excess, ``|A|`` less that
    share of its size, they need half the sum of their excesses in common. Where that is nothing, both are
    similar to the member of the least excess too: one pair a member. Of all other pairs one is an outer member, with
    more than that; they share one of the rarest differences of each, far enough from the end for as many to follow.
    """
    part = (1 - similarity) / (1 + similarity)
    keyed = members.select("fp", "root", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    seen = keyed.join(sets, "fp").select("key", F.explode("set").alias("token")).groupBy("key", "token").agg(F.count("*").alias("seen"))
    core = seen.join(counts, "key").where("2 * seen > n").groupBy("key").agg(F.collect_list("token").alias("core"))
    core = keyed.join(sets, "fp").join(core, "key", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
    apart = F.concat(F.array_except("set", "core"), F.array_except("core", "set"))
    apart = core.select("key", "fp", "root", F.size("set").alias("size"), apart.alias("apart")).withColumn("excess", F.size("apart") - part * F.col("size"))
    apart = scratch.write(apart, "differences")
    low = apart.groupBy("key").agg(F.min("excess").alias("least"), F.min_by("fp", F.struct("excess", "fp")).alias("centre"))
    apart = apart.join(low, "key").withColumn("outer", F.col("excess") + F.col("least") > 1e-9)
    central = apart.where(~F.col("outer") & (F.col("fp") != F.col("centre"))).select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    ends = apart.where("outer").groupBy("key").agg(F.min("excess").alias("first"))  # keys without an outer member are done
    apart = apart.join(ends, "key").withColumn("other", F.when(F.col("outer"), F.col("least")).otherwise(F.col("first")))
    common = F.greatest(F.ceil((F.col("excess") + F.col("other")) / 2 - 1e-9), F.lit(1))
    tokens = apart.select("key", "fp", "root", "size", "excess", "outer", common.alias("common"), F.explode("apart").alias("token"))
    rare = tokens.groupBy("key", "token").agg(F.count("*").alias("seen"), F.max("outer").alias("met")).where("seen > 1")
    own = ["key", "fp", "root", "size", "excess", "outer", "common"]
    ordered = tokens.join(rare, ["key", "token"]).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("seen", "token", "met"))).alias("tokens"))
    # differences of one member alone come first, so as many follow a place as shared ones do
    placed = ordered.select(*own, F.size("tokens").alias("shared"), F.posexplode("tokens").alias("at", "t"))
    placed = placed.select(*own, (F.col("shared") - 1 - F.col("at")).alias("after"), F.col("t.token").alias("token"), F.col("t.met").alias("met"))
    placed = scratch.write(placed.where("met and after + 1 >= common").drop("common", "met"), "rare-shingles")
    one, two = (placed.select("key", "token", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "size", "root", "excess", "outer", "after")]) for x in "ab")
    fits = (F.col("root_a") != F.col("root_b")) & (~F.col("outer_b") | (F.col("fp_a") < F.col("fp_b")))
    fits = fits & (F.least("after_a", "after_b") + 1 >= (F.col("excess_a") + F.col("excess_b")) / 2 - 1e-9)
    fits = fits & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9)
    fits = fits & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= WIDE_DISTANCE)
    met = one.where("outer_a").join(two, ["key", "token"]).where(fits)
    return met.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).union(central).distinct()


def _nodes(rows: DataFrame, id_col: str, fp_col: str, scratch: Scratch) -> DataFrame:
    return scratch.write(rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "nodes")


def assign(rows: DataFrame, nodes: DataFrame, roots: DataFrame, scratch: Scratch, id_col: str = "doc_id", fp_col: str = "sh_fingerprint") -> DataFrame:
    """The stored ``rows`` with ``sh_root``, the component's name by ``roots(node, root)``, and ``sh_component``, its smallest id."""
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("sh_component"))
    # only fingerprints of several rows or with a link need a lookup; of the rest the row's own id holds
    table = scratch.write(
        rooted.join(firsts, "root")
        .where("n > 1 or root <> fp or not (sh_component <=> first)")
        .select(F.col("fp").alias(fp_col), F.col("root").alias("sh_root"), "sh_component", F.lit(True).alias("sh_found")),
        "components",
    )
    found = rows.join(table, fp_col, "left")
    return found.select(
        *rows.columns,
        F.coalesce("sh_root", fp_col).alias("sh_root"),
        F.when(F.col("sh_found"), F.col("sh_component")).otherwise(F.col(id_col)).alias("sh_component"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links. Null ids are never the smallest; a
    component of null ids only has a null one. Null and blank texts have fingerprint 0 and are linked
    like others. Repeated rows stay; an empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(text_col).alias("sh_fingerprint")), "fingerprints"
    )
    nodes = _nodes(rows, "doc_id", "sh_fingerprint", scratch)
    roots = linked(nodes.select("fp"), nodes.count(), scratch, **options)
    return assign(rows, nodes, roots, scratch).select(
        "doc_id", F.lower(F.lpad(F.hex("sh_fingerprint"), 16, "0")).alias("fingerprint"), F.col("sh_component").alias("component_id")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = DEDUP_SHINGLE, similarity: float = SIMILARITY, **options) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of its smallest id, all columns kept whatever their names.

    Linked are fingerprints of ``shingle`` words up to ``MAX_DISTANCE`` bits apart, and those further
    apart that ``similar`` finds. Of repeated rows with the smallest id one stays; of a component
    without any id one arbitrary row stays. Null and blank texts are equal texts.
    """
    scratch = Scratch(docs.sparkSession, "simhash-dedup")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("sh_row")
    both = _print_and_keys(text_col, shingle)
    rows = docs.select(whole, docs[id_col].alias("sh_id"), both.alias("sh_both")).select("sh_row", "sh_id", F.col("sh_both.fp").alias("sh_fingerprint"), F.col("sh_both.keys").alias("sh_keys"))
    rows = scratch.write(rows, "rows")
    slim = rows.select("sh_id", "sh_fingerprint")
    nodes = _nodes(slim, "sh_id", "sh_fingerprint", scratch)
    roots = linked(nodes.select("fp"), nodes.count(), scratch, **options)
    texts = rows.select(F.col("sh_fingerprint").alias("fp"), F.col("sh_id").alias("id"), F.col("sh_row")[text_col].alias("text"), F.col("sh_keys").alias("keys"))
    _, roots, more = _similar(nodes, texts, roots, scratch, shingle, similarity)
    labels = scratch.write(assign(slim, nodes, _joined(more, scratch, roots), scratch, id_col="sh_id"), "labels")
    smallest = F.col("sh_id").eqNullSafe(F.col("sh_component"))
    several = labels.where(smallest).groupBy("sh_root").agg(F.count("*").alias("n"), F.min("sh_fingerprint").alias("s_fp"), F.min("sh_id").alias("s_id"))
    several = scratch.write(several.where("n > 1"), "several")  # rows that share the smallest id: the smallest fingerprint's, once
    gone = labels.where(~smallest).select(F.col("sh_fingerprint").alias("g_fp"), F.col("sh_id").alias("g_id"))
    gone = gone.union(labels.where(smallest).join(several, "sh_root", "left_semi").select("sh_fingerprint", "sh_id")).distinct()
    gone = broadcast_if_small(scratch.write(gone, "gone"))
    kept = rows.join(gone, (F.col("sh_fingerprint") == F.col("g_fp")) & F.col("sh_id").eqNullSafe(F.col("g_id")), "left_anti")
    several = broadcast_if_small(several)
    once = rows.join(several, (F.col("sh_fingerprint") == F.col("s_fp")) & F.col("sh_id").eqNullSafe(F.col("s_id"))).dropDuplicates(["sh_root"])
    return kept.select("sh_row.*").unionByName(once.select("sh_row.*"))
