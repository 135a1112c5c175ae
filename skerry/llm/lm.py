"""LM scoring by a weighted backoff automaton.

States are the learnt histories of fewer than ``ORDER`` words, the empty one included. A word's arc from a
history is there if the history was learnt with that word after it, and carries its smoothed log-probability;
every other word takes the history's failure arc, which carries a backoff weight to the history without its
first word. The empty history has an arc for every word. Smoothing is hierarchical Dirichlet,
``P(w|h) = (c(hw) + PRIOR P(w|h')) / (c(h) + PRIOR)``, so the failure arc of ``h`` weighs
``PRIOR / (c(h) + PRIOR)`` and no n-gram is too rare for an arc.

The automaton grows with the corpus, so no task holds it whole. Texts are read once into chunks of bounded
size, each with its own vocabulary, kept in a table. Each chunk's distinct n-grams go, as ascending 64-bit
hashes with their counts, to ranges of hashes; a range adds them up and returns to every chunk the totals of
its own n-grams in the same order: the part of the automaton that its texts can walk. A range holds a bounded
number of hashes, told apart by ``KEY_BYTES`` bytes in it, and its rows are packed arrays, so what is shuffled
is in proportion to the texts, and the chance that an n-gram meets another one's hash is the same at every
size, about one in a million.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.scratch import Scratch

ORDER = 3
#: Pseudo-counts that the shorter history's distribution is worth.
PRIOR = 32.0
#: Of a seen word's count, what goes to the class of unseen words.
DISCOUNT = 0.75
FOLDS, HELD_OUT_FOLD = 5, 1
CHUNK_BYTES = 8 << 20
#: Hashes added up in one group, at most about.
RANGE_HASHES = 1 << 20
KEY_BYTES = 5
#: The end of a text; no word holds a space.
END = b" "


class _Vocabulary(dict):
    """Words of a chunk, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def held_out(doc_id) -> bool:
    """Documents whose crc32 of the id as text leaves 1 are not learnt from; nor are null ids."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT_FOLD


def _pack_tokens(tokens: np.ndarray, words: int) -> bytes:
    """Word numbers, each byte of all of them together and no more bytes than the vocabulary needs."""
    width = max(1, (int(words).bit_length() + 7) // 8)
    planes = tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack_tokens(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(-1, count)
    out = np.zeros((count, 4), dtype=np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i4").ravel()


class _Chunk:
    def __init__(self):
        self.words, self.ids, self.held, self.sizes, self.tokens, self.bytes = _Vocabulary(), [], [], [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        data = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII space only
        data.append(END)
        self.ids.append(doc_id)
        self.held.append(held_out(doc_id))
        self.sizes.append(len(data))
        self.tokens.append(np.fromiter(map(self.words.__getitem__, data), dtype=np.int32, count=len(data)))
        self.bytes += len(text or "") + 64

    def row(self, name: int, id_type: pa.DataType) -> pa.RecordBatch:
        """Words are numbered in the order of their hashes."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype=np.uint64, count=len(self.words))
        order = np.argsort(hashes, kind="stable")
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        tokens = number[np.concatenate(self.tokens)]
        learnt = ~np.repeat(np.array(self.held), self.sizes)
        counts = np.bincount(tokens[learnt], minlength=len(order)).astype(np.uint32)
        columns = {
            "chunk": pa.array([name], pa.int64()), "ids": pa.array([self.ids], pa.list_(id_type)), "held": pa.array([self.held], pa.list_(pa.bool_())),
            "sizes": pa.array([self.sizes], pa.list_(pa.int32())), "tokens": pa.array([_pack_tokens(tokens, len(order))], pa.binary()),
            "n_words": pa.array([len(order)], pa.int64()), "n_tokens": pa.array([len(tokens)], pa.int64()), "n_learnt": pa.array([int(learnt.sum())], pa.int64()),
            "hashes": pa.array([hashes[order].tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chunk, kind = TaskContext.get().partitionId(), 0, _Chunk(), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                chunk.add(doc_id.as_py(), text.as_py())
                if chunk.bytes >= chunk_bytes:
                    yield chunk.row(part << 24 | number, kind)
                    chunk, number = _Chunk(), number + 1
        if chunk.ids:
            yield chunk.row(part << 24 | number, kind)

    return docs.mapInArrow(
        run,
        f"chunk bigint, ids array<{id_type}>, held array<boolean>, sizes array<int>, tokens binary, n_words bigint, n_tokens bigint, n_learnt bigint, hashes binary, counts binary",
    )


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes that tells their order."""
    x = left * np.uint64(0x9E3779B97F4A7C15) ^ right
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) + right


class _Texts:
    """A chunk's texts, one after the other, as arrays."""

    def __init__(self, row: pa.RecordBatch | pa.Table, i: int):
        get = lambda c: row.column(c)[i]
        self.ids, self.held = get("ids").values, get("held").values.to_numpy(zero_copy_only=False).astype(bool)
        self.sizes = get("sizes").values.to_numpy()
        self.tokens = _unpack_tokens(get("tokens").as_py(), int(self.sizes.sum()))
        self.hashes = np.frombuffer(get("hashes").as_py(), dtype=np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ngrams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n from 2 to ``order``: the places where an n-gram ends, and its hash at each."""
        words = self.hashes[self.tokens]
        before = np.arange(len(words)) - np.repeat(self.starts, self.sizes)  # words before in the same text
        shorter = words
        for n in range(2, order + 1):
            at = np.flatnonzero(before >= n - 1)
            here = _joined(shorter[at - 1], words[at])
            yield at, here
            if n < order:
                shorter = np.zeros(len(words), dtype=np.uint64)
                shorter[at] = here


_PACKED = "range bigint, chunk bigint, steps binary, far binary, counts binary, large binary"
_TOTALS = "range bigint, chunk bigint, counts binary, large binary, seen bigint"
_LARGE = np.dtype([("at", "<u4"), ("value", "<i8")])


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """An array of the bytes of ``values`` between consecutive ``edges``."""
    offsets = (edges * values.itemsize * (values.shape[1] if values.ndim > 1 else 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and how many each row has."""
    values, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(part):
            offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
            if part.buffers()[2] is not None:
                values.append(np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
            sizes.append(np.diff(offsets))
    return np.concatenate(values), np.concatenate(sizes)


def _narrow(values: np.ndarray, edges: np.ndarray, width: int) -> tuple[pa.Array, pa.Array]:
    """Values as ``width`` bytes each, and those that do not fit by their places in the row."""
    at = np.flatnonzero(values >> (8 * width))
    rows = np.searchsorted(edges, at, side="right") - 1
    large = np.empty(len(at), dtype=_LARGE)
    large["at"], large["value"] = at - edges[rows], values[at]
    low = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return _binary(low, edges), _binary(large, np.searchsorted(at, edges))


def _wide(low: pa.ChunkedArray, large: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and how many each has."""
    data, sizes = _bytes(low)
    values = np.zeros((len(data) // width, 8), dtype=np.uint8)
    values[:, :width] = data.reshape(-1, width)
    values, sizes = values.view("<i8").ravel(), sizes // width
    far, many = _bytes(large)
    far = far.view(_LARGE)
    values[np.repeat(np.cumsum(sizes) - sizes, many // _LARGE.itemsize) + far["at"]] = far["value"]
    return values, sizes


def _places(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each hash and its place in the range, rising with the hash."""
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    scaled = high * np.uint64(ranges) + (low * np.uint64(ranges) >> np.uint64(32))  # hash * ranges, without its 32 lowest bits
    spare = np.uint64(8 * (KEY_BYTES - 4))  # bits of the place below the 32 of scaled
    rest = (low * np.uint64(ranges) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - 8 * (KEY_BYTES - 4))
    return (scaled >> np.uint64(32)).astype(np.int64), (scaled & np.uint64(0xFFFFFFFF)) << spare | rest


def _distinct(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range and place of the distinct n-grams in ascending order, and which of them each hash is."""
    distinct, which = np.unique(hashes, return_inverse=True)
    tops, places = _places(distinct, ranges)
    fresh = np.concatenate(([True], (np.diff(tops) != 0) | (np.diff(places) != 0)))[: len(tops)]  # hashes that meet in a place are one
    return tops[fresh], places[fresh], (np.cumsum(fresh) - 1)[which]


def _dealt(chunk: int, n: int, tops: np.ndarray, places: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Ascending n-grams and their counts as a row for each range that has any."""
    edges = np.concatenate((np.flatnonzero(np.diff(tops, prepend=-1)), [len(tops)]))
    names = (n << 40) + tops[edges[:-1]]
    steps = np.diff(places.astype(np.int64), prepend=0)
    steps[edges[:-1]] = places[edges[:-1]]
    columns = [pa.array(names), pa.array(np.full(len(names), chunk, np.int64)), *_narrow(steps, edges, 4), *_narrow(counts, edges, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["range", "chunk", "steps", "far", "counts", "large"])


def _deal_words(ranges: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, counts = (np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in (("hashes", np.uint64), ("counts", np.uint32)))
                tops, places, which = _distinct(hashes, ranges)
                yield _dealt(batch.column("chunk")[i].as_py(), 1, tops, places, np.bincount(which, weights=counts).astype(np.int64))

    return run


def _deal_ngrams(ranges: int, order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = _Texts(batch, i)
                learnt = ~np.repeat(texts.held, texts.sizes)
                for n, (at, hashes) in enumerate(texts.ngrams(order), 2):
                    if len(at):
                        tops, places, which = _distinct(hashes, ranges)
                        yield _dealt(batch.column("chunk")[i].as_py(), n, tops, places, np.bincount(which, weights=learnt[at]).astype(np.int64))

    return run


def _add_range(table: pa.Table) -> pa.Table:
    """Of a range's rows: the totals of each row's hashes; ``seen`` holds, in one row, how many hashes were learnt."""
    steps, sizes = _wide(table.column("steps"), table.column("far"), 4)
    counts, _ = _wide(table.column("counts"), table.column("large"), 1)
    ends = np.cumsum(steps)
    starts = np.cumsum(sizes) - sizes
    _, which = np.unique(ends - np.repeat(ends[starts] - steps[starts], sizes), return_inverse=True)
    totals = np.bincount(which, weights=counts)
    seen = np.zeros(len(sizes), dtype=np.int64)
    seen[0] = int((totals > 0).sum())
    own, large = _narrow(totals[which].astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), 1)
    return pa.table({"range": table.column("range"), "chunk": table.column("chunk"), "counts": own, "large": large, "seen": seen})


def unigram_log10(counts: np.ndarray, n: int, v: int, discount: float = DISCOUNT) -> np.ndarray:
    """Smoothed unigrams: a discount of each seen word goes to the class of unseen ones."""
    if not n:
        return np.zeros(len(counts))
    return np.log10(np.where(counts > 0, (counts - discount) / n, discount * v / n))


class Automaton:
    """The part of the automaton that a chunk's texts walk, in the order in which they walk it.

    ``arcs[k]`` has for each place the weight of its word's arc from the state of the ``k`` words before,
    NaN where there is none; ``failures[k]`` the weight of that state's failure arc.
    """

    def __init__(self, unigrams: np.ndarray, counts: list[np.ndarray], starts: np.ndarray, prior: float):
        self.arcs, self.failures = [unigrams], [np.zeros(len(unigrams))]
        lower = 10.0**unigrams
        for shorter, longer in zip(counts, counts[1:]):
            history = np.concatenate(([0], shorter[:-1]))
            history[starts] = 0
            lower = (longer + prior * lower) / (history + prior)
            self.arcs.append(np.where(longer > 0, np.log10(lower), np.nan))
            self.failures.append(np.log10(prior / (history + prior)))

    def walk(self) -> np.ndarray:
        """The log10 weight of every place's path: failure arcs from the longest history to the first with an arc, then that arc.

        A state depends on the words before only, so all places take the same step at once.
        """
        weight = self.arcs[0]
        for arc, failure in zip(self.arcs[1:], self.failures[1:]):
            weight = np.where(np.isnan(arc), failure + weight, arc)
        return weight


def _score_chunk(n: int, v: int, word_ranges: int, ranges: int, order: int, prior: float) -> Callable:
    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        texts = _Texts(chunk, 0)
        names = found.column("range").to_numpy()
        rank = np.argsort(names, kind="stable")
        values, sizes = _wide(found.column("counts"), found.column("large"), 1)
        ends = np.cumsum(sizes)
        totals = lambda k: np.concatenate([np.zeros(0), *(values[ends[i] - sizes[i] : ends[i]] for i in rank if names[i] >> 40 == k)])
        words = totals(1)[_distinct(texts.hashes, word_ranges)[2]]
        counts = [words[texts.tokens]]
        for k, (at, hashes) in enumerate(texts.ngrams(order), 2):
            here = np.zeros(len(texts.tokens))
            if len(at):
                here[at] = totals(k)[_distinct(hashes, ranges)[2]]
            counts.append(here)
        automaton = Automaton(unigram_log10(words, n, v)[texts.tokens], counts, texts.starts, prior)
        base = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))[texts.tokens]
        sums = lambda x: np.add.reduceat(x, texts.starts)
        columns = [
            texts.ids, pa.array(texts.held), pa.array(texts.sizes.astype(np.int64)), pa.array(sums((counts[0] > 0).astype(np.int64))),
            pa.array(np.full(len(texts.sizes), n)), pa.array(sums(base), pa.float64()), pa.array(sums(automaton.walk()), pa.float64()),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null texts are empty: their only token is the end. Null ids are held out. Repeated rows are learnt
    from and scored each. Without any training token all unigram weights are 0. An empty table gives an
    empty result; other columns are not read. A text longer than ``chunk_bytes`` is a chunk of its own.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    chunks = scratch.write_bucketed(_chunks(slim, chunk_bytes), "chunks", "chunk")  # chunks stay where they are when totals come to them
    n_words, n_tokens, n = (x or 0 for x in chunks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_learnt")).first())
    word_ranges, ranges = n_words // RANGE_HASHES + 1, n_tokens // RANGE_HASHES + 1
    words = chunks.select("chunk", "hashes", "counts").mapInArrow(_deal_words(word_ranges), _PACKED)
    words = scratch.write(words.groupBy("range").applyInArrow(_add_range, _TOTALS), "words")
    v = words.agg(F.sum("seen")).first()[0] or 0
    totals = words
    if order > 1:
        ngrams = chunks.select("chunk", "held", "sizes", "tokens", "hashes", F.array("chunk").alias("ids"))
        totals = words.union(ngrams.mapInArrow(_deal_ngrams(ranges, order), _PACKED).groupBy("range").applyInArrow(_add_range, _TOTALS))
    texts = chunks.select("chunk", "ids", "held", "sizes", "tokens", "hashes")
    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.groupBy("chunk").cogroup(totals.select("chunk", "range", "counts", "large").groupBy("chunk")).applyInArrow(_score_chunk(n, v, word_ranges, ranges, order, prior), schema)
