"""Two tokenizers over the same texts: byte-aligned groups of tokens and corpus-wide link counts.

Both tokenizers encode a text; byte offsets where a token of either ends cut the tokens into groups,
and the two tokens that end there are linked. A one-to-one group holds two tokens of the same bytes, so
an array from each A id to the B id of its bytes tells such links without a lookup: they are counted in
vectors as long as A's vocabulary, one a task. Only links of irregular groups, which never join tokens
of the same bytes, are shuffled as pairs, summed up for a batch of documents beforehand.

Batches of documents are stored with the links of each document as numbers into the batch's own pairs.
Counts of these pairs come back by one join of batches and pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.chunks import CHUNKS_KEPT, ChunkMemo, batches
from skerry.llm.scratch import Scratch
from skerry.llm.token_files import character_bytes

BATCH_ROWS, BATCH_CHARS = 1024, 1 << 21
_SPACE = "▁"


class TokenPair:
    """A byte-level tokenizer A (``tokenizers``) and a piece model B (``sentencepiece``), which puts a space before texts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.bytes_a = [b""] * self.a.get_vocab_size()
        byte_of = character_bytes()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece runs across white space; texts can't be cut there")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lone_space = self.b.piece_to_id(_SPACE)
        plain = {self.bytes_b[i]: i for i in range(len(pieces)) if self.b.is_byte(i)}
        plain |= {self.bytes_b[i]: i for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i))}
        #: B's id of the same bytes by A's id, or -1.
        self.same = np.array([plain.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.memo = ChunkMemo(self._chunks, CHUNKS_KEPT // 2)  # results are longer than ids alone

    def _chunks(self, surfaces: list[str]) -> list[tuple]:
        """``(groups, links, n_a, n_b)`` of chunks that begin with a space or newline; groups None if their bytes do not come back."""
        if not surfaces:
            return []
        all_a = [e.ids for e in self.a.encode_batch(surfaces, add_special_tokens=False)]
        all_b = self.b.encode([s[1:] if s[0] == " " else s for s in surfaces], num_threads=1)
        return [self._aligned(s, a, b) for s, a, b in zip(surfaces, all_a, all_b)]

    def _aligned(self, surface: str, a: list[int], b: list[int]) -> tuple:
        if surface[0] != " ":  # B's own space before it
            if b[0] != self.lone_space:
                return None, b"", 0, 0
            b = b[1:]
        data, bytes_a, bytes_b = surface.encode(), self.bytes_a, self.bytes_b
        if b"".join(map(bytes_a.__getitem__, a)) != data or b"".join(map(bytes_b.__getitem__, b)) != data:
            return None, b"", 0, 0
        groups, links, i, j, end_a, end_b = [], [], 0, 0, 0, 0
        first_a, first_b = 0, 0
        while i < len(a):
            if end_a <= end_b:
                end_a += len(bytes_a[a[i]])
                i += 1
            while end_b < end_a:
                end_b += len(bytes_b[b[j]])
                j += 1
            if end_a == end_b:
                groups.append(",".join(map(str, a[first_a:i])) + "|" + ",".join(map(str, b[first_b:j])))
                links.append(a[i - 1] << 32 | b[j - 1])
                first_a, first_b = i, j
        return ";".join(groups).encode(), np.array(links, np.int64).tobytes(), len(a), len(b)

    def texts(self, texts: list[str]) -> list[tuple | None]:
        """``(n_a, n_b, links, groups' hash)`` of each text, None where it has no tokens."""
        out: list[tuple | None] = [None] * len(texts)
        full = [i for i, t in enumerate(texts) if t and _SPACE not in t]
        for i, found in zip(full, self.memo.results([texts[i] for i in full], " ")):
            groups, links, n_a, n_b = zip(*found)
            if None not in groups:
                out[i] = sum(n_a), sum(n_b), np.frombuffer(b"".join(links), np.int64), hashlib.sha256(b";".join(groups)).hexdigest()
        return out


@lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str) -> TokenPair:
    return TokenPair(path_a, path_b)


def _batch_row(pair: TokenPair, some: list[tuple]) -> tuple[dict, np.ndarray]:
    """A batch of documents as one row, and its one-to-one links by A id."""
    found = pair.texts([t or "" for _, t in some])
    none = np.empty(0, np.int64)
    links = [f[2] if f else none for f in found]
    doc = np.repeat(np.arange(len(some)), [len(x) for x in links])
    keys = np.concatenate(links)
    a = keys >> 32
    one = pair.same[a] == (keys & 0xFFFFFFFF)
    regular = np.bincount(a[one], minlength=len(pair.same))
    pairs, number, n = np.unique(keys[~one], return_inverse=True, return_counts=True)
    column = a.copy()
    column[~one] = len(pair.same) + number
    width = len(pair.same) + len(pairs)
    cells, times = np.unique(doc * width + column, return_counts=True)
    row = {
        "docs": [d for d, _ in some], "n_a": [f[0] if f else 0 for f in found], "n_b": [f[1] if f else 0 for f in found], "n_links": [len(x) for x in links],
        "hashes": [f[3] if f else "" for f in found], "cells": np.bincount(cells // width, minlength=len(some)).tolist(),
        "columns": (cells % width).astype("<u4").tobytes(), "times": times.astype("<u4").tobytes(), "keys": pairs.tolist(), "counts": n.tolist(),
    }
    return row, regular


_SCHEMA = (
    "batch string, docs array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, hashes array<string>, cells array<int>, columns binary, times binary, keys array<bigint>, counts array<bigint>, regular binary"
)
_ARROW = pa.schema([
    ("batch", pa.string()), *[(c, pa.list_(pa.int64())) for c in ("docs", "n_a", "n_b", "n_links")], ("hashes", pa.list_(pa.string())), ("cells", pa.list_(pa.int32())),
    ("columns", pa.binary()), ("times", pa.binary()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("regular", pa.binary()),
])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = BATCH_ROWS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Group, link and count columns of every document under tokenizers A and B.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. ``count_sum`` adds up, over
    the document's links, how many links in all documents join the same two ids; ``n_best`` counts the
    links whose pair is the most frequent of its B id, ties included. Texts that are null or empty, or
    that one tokenizer does not give back byte for byte, have no tokens: zeros and an empty hash. Null
    and repeated ids pass through, row by row; an empty table gives no rows. Other columns are not read.

    Broadcast are arrays over the two vocabularies; pairs of ids, which are not bounded so, are joined.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    for path in (path_a, path_b):
        spark.sparkContext.addFile(path)
    name_a, name_b = (p.rsplit("/", 1)[-1] for p in (path_a, path_b))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        pair = _pair(SparkFiles.get(name_a), SparkFiles.get(name_b))
        total, task = np.zeros(len(pair.same), np.int64), uuid.uuid4().hex
        rows = ((d.as_py(), t.as_py()) for b in arrow for d, t in zip(b.column(0), b.column(1)))
        for k, some in enumerate(batches(rows, batch_rows, batch_chars)):
            row, regular = _batch_row(pair, some)
            total += regular
            yield pa.RecordBatch.from_pylist([row | {"batch": f"{task}-{k}"}], _ARROW)
        yield pa.RecordBatch.from_pylist([{"regular": total.astype("<i8").tobytes()}], _ARROW)

    texts = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("body"))
    stored = scratch.write(texts.mapInArrow(run, _SCHEMA), "batches")
    held = stored.where("regular is null")
    pairs = held.select("batch", F.explode(F.arrays_zip("keys", "counts")).alias("p")).select("batch", F.col("p.keys").alias("key"), F.col("p.counts").alias("n"))
    counts = scratch.write(pairs.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
    same = _pair(path_a, path_b).same
    regular = _added_up(stored, len(same))
    best = _best(counts, regular, same)
    back = pairs.select("batch", "key").join(counts, "key").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("known"))
    return _scored(held.join(back, "batch", "left"), regular, best, same)


def _added_up(stored: DataFrame, size: int) -> np.ndarray:
    """The tasks' vectors of one-to-one links, added up by id: at most a row for each id of A's vocabulary comes to the driver."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in arrow:
            for cell in batch.column(0):
                total += np.frombuffer(cell.as_py(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    found = stored.where("regular is not null").select("regular").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def _best(counts: DataFrame, regular: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Highest count of a pair by B id; at most a row for each id of B's vocabulary comes to the driver."""
    found = counts.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("n").alias("n")).toPandas()
    out = np.zeros(int(max([-1, *same.tolist(), *found["b"].tolist()])) + 1, np.int64)
    out[found["b"].to_numpy()] = found["n"].to_numpy()
    np.maximum.at(out, same[same >= 0], regular[same >= 0])
    return out


def _scored(rows: DataFrame, regular: np.ndarray, best: np.ndarray, same: np.ndarray) -> DataFrame:
    at_best = np.where(same >= 0, regular == best[same], False)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                cell = {c: row.column(c)[0] for c in row.schema.names}
                known = cell["known"].values
                key, n = (known.field(c).to_numpy() for c in ("key", "n")) if known is not None else (np.empty(0, np.int64),) * 2
                count = np.concatenate((regular, n))
                first = np.concatenate((at_best, n == best[key & 0xFFFFFFFF]))
                columns, times = (np.frombuffer(cell[c].as_py(), "<u4").astype(np.int64) for c in ("columns", "times"))
                ends = np.concatenate(([0], np.cumsum(cell["cells"].values.to_numpy())))
                sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (count[columns] * times, first[columns] * times)]
                links = cell["n_links"].values
                arrays = [cell["docs"].values, cell["n_a"].values, cell["n_b"].values, links, links, pa.array(sums[1]), pa.array(sums[0]), cell["hashes"].values]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = rows.select("docs", "n_a", "n_b", "n_links", "hashes", "cells", "columns", "times", "known")
    return rows.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
