"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Every text becomes a vector of transformed statistics. For each language and source the estimates
start from coordinate-wise medians and median deviations and are improved by concentration steps until
they stand: the share ``H`` of rows nearest by Mahalanobis distance gives the next mean and covariance.
Variances are not taken below those of ``FLOOR``, since most texts have no symbols or repeats at all,
and correlations are shrunk by ``PRIOR_ROWS`` rows without any. Rows whose squared distance under the
final, rescaled estimates is beyond ``CUTOFF`` are rejected. A group of fewer than ``MIN_GROUP`` rows
that pass the base has no regular covariance of its own: it is judged with the others of its kind in its
language, and if these are too few as well, with those of all languages.

DataFrame expressions only: a statistics pass over the text, then small aggregations over the slim
statistics. The nearest share is found from a histogram of log distances, which is combined before it
is shuffled, so a group that holds a third of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.scratch import Scratch

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows whose nearest share makes the estimates, and the smallest group that has its own: twice the dimensions and two.
H = 0.75
MIN_GROUP = 12
PRIOR_ROWS = 10
#: Concentration steps at most, and the change of any estimate below which they end: the histogram's bins blur no less.
STEPS, SETTLED = 8, 2e-2
#: Squared distance that a normal vector of five dimensions exceeds with a chance of 1e-6.
CUTOFF = 35.9
#: Least standard deviations: words, word length, symbols, repeated lines, repeated words.
FLOOR = (0.7, 0.09, 0.55, 0.65, 0.65)
MEDIAN_CHI2 = 4.351
_DIMS = len(FLOOR)
_BINS_PER_E = 50
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once a row."""
    return F.transform(F.array(value), body).getItem(0)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three found twice or more; windows are told apart by 64-bit hashes."""

    def count(hashes: Column) -> Column:
        def places(windows: Column) -> Column:
            twin = lambda w, k: F.coalesce(F.get(windows, k - 1)["h"] == w["h"], F.lit(False)) | F.coalesce(F.get(windows, k + 1)["h"] == w["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(windows, twin), lambda w: w["i"]))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
        covered = F.aggregate(_let(ordered, places), start, step, lambda acc: acc["n"].cast("long"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(windows, count))


def statistics(text: Column) -> Column:
    """Struct of the counts that the rules use; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    return F.struct(
        _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def measure(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` with ``q_`` columns: counts, base verdict, transformed vector, language and source."""
    rows = docs.select(*keep, docs[lang_col].alias("q_lang"), docs[source_col].alias("q_source"), statistics(docs[text_col]).alias("q"))
    kept = rows.columns[: len(keep)]
    rows = rows.select(
        *kept, "q_lang", "q_source", F.col("q.w.n_words").alias("q_n_words"), *[F.col(f"q.{c}").alias(f"q_{c}") for c in _STATS[1:4]],
        F.col("q.w.n_repeat_words").alias("q_n_repeat_words"),
    )
    n = F.col("q_n_words")
    share = lambda c: 100.0 * F.col(c) / (1 + n)
    vector = (
        F.log1p(n), F.log((1.0 + F.col("q_word_chars")) / (1 + n)), F.log1p(share("q_n_symbols")),
        F.log1p(F.col("q_n_dup_lines").cast("double")), F.log1p(share("q_n_repeat_words")),
    )
    return rows.withColumns(
        {"q_base_failed": (n < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * n)} | {f"q_x{i}": v for i, v in enumerate(vector)}
    )


def _grouped(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``q_group``: language and source; small ones pooled by language, then together."""
    sizes = rows.where("not q_base_failed").groupBy("q_lang", "q_source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("small", F.col("n") < MIN_GROUP)
    pooled = F.sum(F.when(F.col("small"), F.col("n"))).over(Window.partitionBy("q_lang"))
    names = sizes.select(
        F.col("q_lang").alias("g_lang"),
        F.col("q_source").alias("g_source"),
        F.when(~F.col("small"), F.to_json(F.struct("q_lang", "q_source"))).when(pooled >= MIN_GROUP, F.concat(F.lit("small "), F.to_json(F.struct("q_lang")))).otherwise("*").alias("q_group"),
    )
    names = scratch.write(names, "groups")
    return rows.join(names, rows["q_lang"].eqNullSafe(names["g_lang"]) & rows["q_source"].eqNullSafe(names["g_source"]), "left").drop("g_lang", "g_source")


def _factor(model: DataFrame, cov: Callable[[int, int], Column]) -> DataFrame:
    """Adds the Cholesky factor ``l{i}{j}`` of the floored and shrunk covariance."""
    out = model
    for i in range(_DIMS):
        for j in range(i + 1):
            rest = F.greatest(cov(i, i), F.lit(FLOOR[i] ** 2)) if i == j else cov(i, j) * F.col("near") / (F.col("near") + PRIOR_ROWS)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("q_group", *[f"m{i}" for i in range(_DIMS)], *[f"l{i}{j}" for i in range(_DIMS) for j in range(i + 1)])


def _with_distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``q_d2``, the squared Mahalanobis distance under the row's group, and ``q_e0..``, what the vector is off the mean."""
    out = rows.join(model.select("q_group", *_PARAMETERS), "q_group", "left").withColumns({f"q_e{i}": F.col(f"q_x{i}") - F.col(f"m{i}") for i in range(_DIMS)})
    for i in range(_DIMS):
        rest = F.col(f"q_e{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    distance = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, _DIMS)), F.col("y0") * F.col("y0"))
    return out.select(*rows.columns, *[f"q_e{i}" for i in range(_DIMS)], distance.alias("q_d2"))


_LOWER = [(i, j) for i in range(_DIMS) for j in range(i + 1)]
_PARAMETERS = [*[f"m{i}" for i in range(_DIMS)], *[f"l{i}{j}" for i, j in _LOWER]]


def _bin() -> Column:
    return F.floor(F.log(F.col("q_d2") + 1e-4) * _BINS_PER_E)


def _bin_at(far: DataFrame, share: float, name: str) -> DataFrame:
    """By group the bin of distances up to which the share of rows lies."""
    bins = far.groupBy("q_group", _bin().alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("q_group")
    return (
        bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w)).where(F.col("upto") >= share * F.col("all")).groupBy("q_group").agg(F.min("bin").alias(name))
    )


def _concentrated(far: DataFrame, model: DataFrame) -> DataFrame:
    """The next estimates, from the share ``H`` of each group's rows that is nearest, and how far they ``moved``.

    One pass: counts and moments are summed up by group and bin of the distance, and the bins up to the
    share then added.
    """
    offs = {f"s{i}": F.col(f"q_e{i}") for i in range(_DIMS)} | {f"p{i}{j}": F.col(f"q_e{i}") * F.col(f"q_e{j}") for i, j in _LOWER}
    bins = far.groupBy("q_group", _bin().alias("bin")).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in offs.items()])
    w = Window.partitionBy("q_group")
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = bins.withColumn("before", before).withColumn("all", F.sum("n").over(w)).where(F.col("before") < H * F.col("all"))
    sums = near.groupBy("q_group").agg(F.sum("n").alias("near"), *[F.sum(k).alias(k) for k in offs])
    old = model.select("q_group", *[F.col(c).alias(f"old_{c}") for c in _PARAMETERS])
    mean = lambda i: F.col(f"s{i}") / F.col("near")
    moments = sums.join(old, "q_group").withColumns({f"m{i}": F.col(f"old_m{i}") + mean(i) for i in range(_DIMS)})
    new = _factor(moments, lambda i, j: F.col(f"p{i}{j}") / F.col("near") - mean(i) * mean(j))
    moved = F.greatest(*[F.abs(F.col(c) - F.col(f"old_{c}")) for c in _PARAMETERS])
    return new.join(old, "q_group").select("q_group", *_PARAMETERS, moved.alias("moved"))


def fit(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Estimates by group of grouped rows: mean, Cholesky factor of the covariance and a scale."""
    used = rows.where("not q_base_failed")
    median = lambda c: F.round(F.percentile_approx(c, 0.5, 10000), 2)
    centre = used.groupBy("q_group").agg(*[median(f"q_x{i}").alias(f"m{i}") for i in range(_DIMS)])
    centre = scratch.write(centre, "centre")
    spread = used.join(centre, "q_group").groupBy("q_group").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(_DIMS)], *[(1.4826 * median(F.abs(F.col(f"q_x{i}") - F.col(f"m{i}")))).alias(f"s{i}") for i in range(_DIMS)]
    )
    spread = spread.withColumn("near", F.lit(0))  # no correlations yet
    model = scratch.write(_factor(spread, lambda i, j: F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)), "start")
    for _ in range(STEPS):
        model = scratch.write(_concentrated(_with_distance(used, model), model), "model")
        moved = model.agg(F.max("moved")).first()[0]
        if moved is None or moved < SETTLED:
            break
    middle = _bin_at(_with_distance(used, model), 0.5, "middle")
    scale = F.greatest(F.exp((F.col("middle") + 1) / _BINS_PER_E) / MEDIAN_CHI2, F.lit(1.0))
    return scratch.write(model.select("q_group", *_PARAMETERS).join(middle, "q_group").withColumn("scale", scale).drop("middle"), "fitted")


def judge(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``q_distance`` and ``q_kept``; rows of a group without estimates stand on the base alone."""
    far = _with_distance(rows, model.drop("scale")).join(model.select("q_group", "scale"), "q_group", "left")
    far = far.withColumn("q_distance", F.col("q_d2") / F.col("scale"))
    return far.withColumn("q_kept", ~F.col("q_base_failed") & (F.coalesce("q_distance", F.lit(0.0)) <= CUTOFF)).select(*rows.columns, "q_distance", "q_kept")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: id, counts, ``base_failed``, ``distance`` and ``kept``.

    Null texts have no words and fail the base. Null languages and sources form groups of their own.
    Repeated rows are judged alike; ties at the limit of the nearest share all count. An empty table
    gives an empty result. Columns besides the four named ones are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(measure(docs, text_col, lang_col, source_col, [docs[id_col].alias("doc_id")]), "statistics")
    rows = _grouped(rows, scratch)
    out = judge(rows, fit(rows, scratch))
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in _STATS], F.col("q_base_failed").alias("base_failed"), F.col("q_distance").alias("distance"), F.col("q_kept").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns."""
    scratch = Scratch(docs.sparkSession, "quality-rows")
    rows = scratch.write(measure(docs, text_col, lang_col, source_col, [F.struct(*[docs[c] for c in docs.columns]).alias("q_row")]), "rows")
    slim = _grouped(rows.drop("q_row"), scratch)
    model = fit(slim, scratch)
    return judge(_grouped(rows, scratch), model).where("q_kept").select("q_row.*")
