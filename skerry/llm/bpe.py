"""Byte-level BPE by backtracking over longest matches.

A token sequence is the one that the merges give exactly if every two neighbours are compatible: the
bytes of the two, merged on their own, give just these two tokens. Encoding walks a piece from left to
right with the longest token at each place, falls back to shorter ones where a neighbour is not
compatible, and backtracks from places that no token continues; no place is tried twice. An
Aho-Corasick automaton over the vocabulary, its bytes mapped to Latin-1 characters, finds the longest
token at every place in one pass. Compatibility and whole pieces are memoised within fixed bounds.

Compatibility is read off how the two tokens were built. Left of the border stand, over time, the
pieces of the left token's right edge; right of it those of the right token's left edge. The two are
incompatible if two such pieces that stand there together would merge across the border before either
is used up by its own token (of equal ranks the left merge comes first).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

PIECES_KEPT = 1 << 18
PAIRS_KEPT = 1 << 19
_LONGEST_KEPT = 64
_NEVER = 1 << 60


class _Memo(dict):
    """Results of ``make`` by key; emptied when it holds ``most`` of them."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class BytePairEncoder:
    """Encoder and decoder for ``{token bytes: rank}`` and a pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # the White_Space property, as the library's regex engine takes \s
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter = _Memo(self._shorter, len(ranks)).__getitem__
        self.edges = _Memo(self._edges, len(ranks)).__getitem__
        self.pairs = _Memo(self._compatible, PAIRS_KEPT).__getitem__
        self.piece_ids = _Memo(self._piece_ids, PIECES_KEPT).__getitem__

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """Parts of a short byte string after its merges, or as soon as ``until`` are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: int) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]]:
        """The pieces at the token's left and right edge: bytes, rank when made, rank when used up."""
        sides = []
        for side in (0, -1):
            piece, used, chain_ = self.bytes_of[token], _NEVER, []
            while True:
                made = self.ranks[piece] if len(piece) > 1 else -1
                chain_.append((piece, made, used))
                if len(piece) == 1:
                    break
                piece, used = self.merged(piece, until=2)[side], made
            sides.append(chain_)
        return sides[0], sides[1]

    def _compatible(self, pair: int) -> bool:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        rank_of = self.ranks.get
        starts = self.edges(right)[0]
        for x, made_x, used_x in self.edges(left)[1]:
            for y, made_y, used_y in starts:
                if made_x < used_y and made_y < used_x:
                    rank = rank_of(x + y)
                    if rank is not None and rank < used_x and rank <= used_y:
                        return False
        return True

    def compatible(self, left: int, right: int) -> bool:
        return self.pairs(left << 32 | right)

    def _shorter(self, token: int) -> int | None:
        """The longest other token that the token starts with."""
        data = self.bytes_of[token]
        return next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), None)

    def encode_piece(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        longest: list[int] = [0] * len(data)
        for end, (size, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the last is the longest
        open_at = bytearray(b"\x01") * (len(data) + 1)
        tokens: list[int] = []
        at = 0
        token: int | None = longest[0]
        while at < len(data):
            while token is not None:
                end = at + len(self.bytes_of[token])
                if open_at[end] and (not tokens or self.compatible(tokens[-1], token)):
                    break
                token = self.shorter(token)
            if token is None:  # nothing continues here: close the place and take the last token back
                open_at[at] = 0
                token = tokens.pop()
                at -= len(self.bytes_of[token])
            else:
                tokens.append(token)
                at = end
                token = longest[at] if at < len(data) else None
        return tokens

    def _piece_ids(self, piece: str) -> tuple[int, ...]:
        return tuple(self.encode_piece(piece.encode()))

    def _ids(self, text: str):
        pieces = self.pieces.findall(text)
        if len(max(pieces, key=len)) <= _LONGEST_KEPT:
            return map(self.piece_ids, pieces)
        return (self.piece_ids(p) if len(p) <= _LONGEST_KEPT else self._piece_ids(p) for p in pieces)

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text, without special tokens; none for null or empty texts."""
        return list(chain.from_iterable(self._ids(text))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(load_ranks(path), pattern)


def tokenise(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = True
) -> DataFrame:
    """Encode every whole text, decode the ids again, and return a row for each document.

    Columns: ``doc_id``, those in ``keep``, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by a
    space), ``decoded_sha256`` (of the decoded bytes) and, with ``with_ids``, ``ids``. Null texts count
    as empty. Repeated rows and null ids pass through; an empty table gives an empty result. The
    vocabulary file goes to the executors by ``SparkContext.addFile``. A map over Arrow batches: no
    shuffle, and memory bounded by a batch and the two memo tables.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]
    source = docs.select(docs[id_col].alias("doc_id"), *[docs[c] for c in keep], docs[text_col].alias("bpe_text"))
    passed = source.columns[:-1]
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in passed)
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(SparkFiles.get(name), pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sizes, sums, back, all_ids = [], [], [], []
                for text in batch.column("bpe_text"):
                    ids = encoder.encode(text.as_py())
                    sizes.append(len(ids))
                    sums.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, dtype=np.int32))
                columns = [batch.column(c) for c in passed] + [pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids))))
                names = [*passed, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)
