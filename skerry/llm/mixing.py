"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is a share of all words; a document's expected copies are target over source
size. The whole part is certain. The fractional parts are settled by pivots: two documents exchange
word mass at random, without changing either's expectation or their sum, until one fraction is 0 or 1;
the other goes on to the next pivot. A source's sum of words thus stays on its target but for the
last document. Pivots run as a reduction tree: rows are dealt into chunks by a hash, each chunk is
folded in one aggregation and passes on a single open document, and those are folded again, ``FAN``
at a time, until one is left. Within a chunk long documents pivot first, and a source's
documents above its mean length come before the others: the short ones then take over what the last
long one is off by, so that the last open document is short. DataFrame expressions only; draws are hashes, so reruns agree.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.scratch import Scratch

FAN = 256
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    """Number of words of ASCII-space-separated text; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))).otherwise(0).cast("long")


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def source_targets(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """By source: ``source_size``, ``source_rows``, ``rank`` in code point order (null last), ``target``.

    Ranks come from a range partitioning and its partitions' offsets, the limit of the shares from a
    few aggregations; no table passes through one task.
    """
    sources = rows.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("source_rows"))
    order = [F.col("mix_source").asc_nulls_last()]
    dealt = scratch.write(sources.repartitionByRange(8, *order).withColumn("part", F.spark_partition_id()), "sources")
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each of the few partitions
    offsets = offsets.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    ranked = dealt.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = scratch.write(ranked.withColumn("weight", weight.cast("long")).drop("part", "offset"), "ranks")
    cap = MOST_COPIES * F.col("source_size")
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (all_weight or 1), -1
    while True:
        full = cap <= level * F.col("weight")
        n, held, open_weight = ranked.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, ((total or 0) - (held or 0)) / open_weight
    return scratch.write(ranked.withColumn("target", F.least(cap.cast("double"), level * F.col("weight"))), "targets")


def _pivot(acc: Column, x: Column, seed: int) -> Column:
    """Settle the open document or the next one; the other stays open."""
    let = lambda value, body: F.transform(F.array(value), body).getItem(0)
    c = acc["open"]
    a, p, b, q = c["size"].cast("double"), c["p"], x["size"].cast("double"), x["p"]

    def moved(s: Column) -> Column:
        p2 = F.when(s["go"], F.when(a * (1 - p) <= b * q, 1.0).otherwise(p + s["up"] / a)).otherwise(F.when(a * p <= b * (1 - q), 0.0).otherwise(p - s["down"] / a))
        q2 = F.when(s["go"], F.when(b * q <= a * (1 - p), 0.0).otherwise(q - s["up"] / b)).otherwise(F.when(b * (1 - q) <= a * p, 1.0).otherwise(q + s["down"] / b))
        return F.struct(p2.alias("p"), q2.alias("q"))

    def settled(s: Column) -> Column:
        first = (s["p"] == 0.0) | (s["p"] == 1.0)
        c2, x2 = c.withField("p", s["p"]), x.withField("p", s["q"])
        return F.struct(F.when(first, x2).otherwise(c2).alias("open"), F.concat(acc["done"], F.array(F.when(first, c2).otherwise(x2))).alias("done"))

    up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
    draw = F.struct(up.alias("up"), down.alias("down"), (_unit(F.lit(seed), c["key"], x["key"]) * (up + down) < down).alias("go"))
    return let(draw, lambda s: let(moved(s), settled))


def plan(rows: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """Copies of each row of ``rows(mix_ref, mix_key, mix_source, mix_size)``: adds size, target and ``copies``.

    Keys tell rows apart, equal ones too, so that chunks stay near ``FAN`` rows whatever ids and sizes are.
    """
    targets = source_targets(rows, scratch)
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    items = rows.join(targets.withColumnRenamed("mix_source", "t_source"), F.col("mix_source").eqNullSafe(F.col("t_source")))
    items = items.withColumn("r", expected).withColumn("base", F.floor("r").cast("int")).withColumn("p", F.col("r") - F.col("base"))
    item = F.struct(
        F.col("mix_size").alias("size"), F.xxhash64(F.lit(seed), "mix_key").alias("key"), F.col("mix_ref").alias("ref"), "base", "p", "source_size", "target"
    )
    items = items.select("rank", "source_rows", F.ceil(F.col("source_rows") / FAN).alias("chunks"), item.alias("item"))
    sure = (F.col("item.size") == 0) | (F.col("item.p") <= 0.0)
    out = lambda df, bit: df.select("item.ref", "item.size", "item.source_size", "item.target", (F.col("item.base") + bit).alias("copies"))
    drawn = (_unit(F.lit(seed), F.col("item.key")) < F.col("item.p")).cast("int")
    open_items = items.where(~sure)
    long = F.col("item.size") * F.col("source_rows") > F.col("item.source_size")
    # long documents first; what the last of them is off by, the short ones take over in equal parts
    settled, last = _tree(open_items.where(long), targets, scratch, seed)
    done = [out(items.where(sure), F.lit(0)), out(settled, F.col("item.p").cast("int")), out(last, drawn)]
    off = last.select("rank", (F.col("item.size") * (drawn - F.col("item.p"))).alias("off"))
    short = open_items.where(~long)
    mass = short.groupBy("rank").agg(F.sum("item.size").alias("mass")).join(off, "rank", "left")
    mass = scratch.write(mass.select("rank", (F.coalesce("off", F.lit(0.0)) / F.col("mass")).alias("less")), "taken-over")
    moved = F.least(F.greatest(F.col("item.p") - F.col("less"), F.lit(0.0)), F.lit(1.0))
    short = short.join(mass, "rank").withColumn("item", F.col("item").withField("p", moved))
    settled, last = _tree(short, targets, scratch, seed + 1)
    done += [out(settled, F.col("item.p").cast("int")), out(last, drawn)]
    return reduce(DataFrame.unionAll, done)


def _tree(items: DataFrame, targets: DataFrame, scratch: Scratch, seed: int) -> tuple[DataFrame, DataFrame]:
    """Fold ``items(rank, chunks, item)`` by source: the settled ones, and the last open one of each source."""
    level = items.withColumn("chunk", F.pmod(F.col("item.key"), F.col("chunks")))
    width = max(1, ceil((targets.agg(F.max("source_rows")).first()[0] or 0) / FAN))
    settled = []
    while True:
        packed = level.groupBy("rank", "chunk").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        kind = level.schema["item"].dataType.simpleString()
        start = F.struct(F.col("items")[0].alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
        fold = F.aggregate(F.slice("items", 2, F.size("items")), start, lambda acc, x: _pivot(acc, x, seed))
        folded = scratch.write(packed.select("rank", "chunk", fold.alias("f")), "folded")
        settled.append(folded.select("rank", F.explode("f.done").alias("item")))
        if width == 1:
            return reduce(DataFrame.unionAll, settled), folded.select("rank", F.col("f.open").alias("item"))
        width = ceil(width / FAN)
        level = folded.select("rank", F.floor(F.col("chunk") / FAN).alias("chunk"), F.col("f.open").alias("item"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken, copies``.

    Null texts have size 0 and are taken with no words. A null source is a source, the last. Repeated
    rows count each; equal rows and null ids draw like others. An empty table gives an empty result.
    Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(docs[id_col].alias("mix_ref"), docs[source_col].alias("mix_source"), n_words(docs[text_col]).alias("mix_size"))
    counted = scratch.write(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "counted")  # equal rows are told apart by a number
    rows = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    rows = rows.select("mix_ref", F.xxhash64("mix_ref", "mix_size", "i").alias("mix_key"), "mix_source", "mix_size")
    out = plan(scratch.write(rows, "sizes"), scratch, seed)
    return out.select(F.col("ref").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan`` takes it, with all their columns, whatever their names.

    Draws are those of ``mix``. Rows of the same id, source and size are told apart by their places in
    the input, so reruns over the same files agree.
    """
    scratch = Scratch(docs.sparkSession, "mixing-rows")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("mix_row")
    rows = docs.select(whole, F.monotonically_increasing_id().alias("mix_ref"), docs[id_col].alias("mix_id"), docs[source_col].alias("mix_source"), n_words(docs[text_col]).alias("mix_size"))
    rows = scratch.write(rows, "rows")
    slim = rows.drop("mix_row").withColumn("same", F.xxhash64("mix_id", "mix_source", "mix_size")).withColumn("part", F.shiftright("mix_ref", 33))
    # equal rows are numbered by their places: first those of earlier partitions, then within a partition
    before = slim.groupBy("same", "part").agg(F.count("*").alias("n"))
    before = before.select("same", "part", (F.sum("n").over(Window.partitionBy("same").orderBy("part")) - F.col("n")).alias("offset"))
    slim = slim.withColumn("within", F.row_number().over(Window.partitionBy("same", "part").orderBy("mix_ref"))).join(before, ["same", "part"])
    number = (F.col("offset") + F.col("within")).cast("long")
    slim = scratch.write(slim.select("mix_ref", F.xxhash64("mix_id", "mix_size", number).alias("mix_key"), "mix_source", "mix_size"), "slim")
    copies = plan(slim, scratch, seed).where("copies > 0").select(F.col("ref").alias("mix_ref"), F.col("copies").alias("mix_copies"))
    return rows.join(copies, "mix_ref").select("mix_row", F.explode(F.sequence(F.lit(1), "mix_copies"))).select("mix_row.*")
