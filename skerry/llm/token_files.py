"""Token-id files: documents' ids in ascending order of document, entropy coded in blocks (``ans``).

A folder holds ``frequencies.bin``, the table that all blocks share, and files ``part-NNNNNN.ids``. A
file is a run of blocks and a footer with a row for each block: where it lies, the number of its first
id in the whole corpus, and the document pieces in it. A document may run over several blocks, never
over two files. Any block, and any segment of a block, is decoded by itself.

Files are ranges of document ids. The bounds are quantiles of the ids; a document id that fills more
than one range (nulls, for instance, which come first) is spread over its ranges by a hash of the ids.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import ans
from skerry.llm.chunks import CHUNKS_KEPT, ChunkMemo, batches, is_odd
from skerry.llm.scratch import Scratch

IDS_PER_FILE = 1 << 23
MOST_FILES = 1 << 14
END_ID = 0
#: Punctuation that, behind a word, is one piece; a letter behind an apostrophe would be another.
_PUNCTUATION = string.punctuation
_NOT_LATIN = "\u0250"
#: A chunk that is a Latin word, with the newline before and the punctuation behind it: its pieces are these three.
_WORD = r"^(?P<line>\n?)(?P<core>[A-Za-zªµºÀ-ÖØ-öø-ɏ]+)(?P<end>[!-/:-@\[-`{-~]*)\z"
#: Places that ids are copied to at a time.
_PLACES = 1 << 18
_FOOT = struct.Struct("<QI4s")
_FOOT_MAGIC = b"IDX1"
_BLOCK = np.dtype([("at", "<u8"), ("size", "<u4"), ("first", "<u8"), ("n", "<u4"), ("pieces", "<u4")])
#: ``seq`` numbers the documents of a file; a piece has a flag for a null id.
_PIECE = np.dtype([("seq", "<u8"), ("doc", "<i8"), ("null", "u1"), ("n", "<u4"), ("whole", "u1")])
_NULL_ID = -(1 << 63)


class _Library:
    """The library's ids of chunks, as bytes.

    A Latin word, alone or before punctuation, is what the library's pre-tokenizer makes of it: its
    pieces go to the library's model directly. Any other chunk goes through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.memo = ChunkMemo(self.encode)
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.characters = {byte: c for c, byte in character_bytes().items()}
        self.space = self.characters[0x20]

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is not None:
                self.pieces[piece] = ids
                return ids
            if not piece.isascii() or piece == "\n":
                spelt = piece.encode().decode("latin-1").translate(self.characters)
            else:
                spelt = self.space + piece[1:] if piece[:1] == " " else piece
            ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if len(self.pieces) >= CHUNKS_KEPT:
                self.old, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def _plain(self, surface: str) -> bytes | None:
        line = surface[:1] == "\n"
        words = surface[1:] if line else surface
        core = words.rstrip(_PUNCTUATION)
        if not core or max(core) >= _NOT_LATIN or not core[core[0] == " " :].isalpha():
            return None
        ids = self._piece(core)
        if len(core) < len(words):
            ids += self._piece(words[len(core) :])
        return self._piece("\n") + ids if line else ids

    def encode(self, surfaces: list[str]) -> list[bytes]:
        out = [self._plain(s) for s in surfaces]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, e in zip(rest, self.whole.encode_batch([surfaces[i] for i in rest], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def ids(self, texts: list[str], tail: bytes) -> list[np.ndarray]:
        """Ids of whole texts, which must not be empty, with ``tail`` behind each.

        Arrow cuts the texts, tells their chunks apart and Latin words from what stands around them, so each
        distinct word is looked up once a call; its ids are then copied to all its places together. Other
        chunks, and whole texts with a blank at an end or several in a row, are left to ``memo``.
        """
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), pattern="\n", replacement=" \n"), pattern=" ")
        flat, bounds, every = parts.flatten(), parts.offsets.to_numpy().astype(np.int64), np.arange(len(texts))
        follows = np.ones(len(flat), bool)  # a text's first chunk has no space before it
        follows[bounds[:-1]] = False
        coded = flat.filter(pa.array(follows)).dictionary_encode()
        chunks, places = coded.dictionary, coded.indices.to_numpy()
        cut = pc.extract_regex(chunks, _WORD)
        line, core, end = cut.flatten()
        plain, line = cut.is_valid().to_numpy(zero_copy_only=False), pc.equal(line, "\n").fill_null(False)
        core = pc.if_else(line, core, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), core, pa.scalar("", pa.large_string()))).dictionary_encode()
        end = end.dictionary_encode()

        other = chunks.filter(pa.array(~plain)).to_pylist()
        odd, at = np.array([is_odd(c) for c in other], bool), np.flatnonzero(~plain)
        firsts = flat.take(pa.array(bounds[:-1])).to_pylist()
        uncut = {i for i, first in enumerate(firsts) if is_odd(first)}
        if odd.any():
            owner = np.repeat(every, np.diff(bounds) - 1)
            uncut |= {*owner[np.isin(places, at[odd])].tolist()}
        asked = [c if c[0] == "\n" else " " + c for c, no in zip(other, odd) if not no]
        got = [b"".join(x) for x in self.memo.results([*asked, *(texts[i] if i in uncut else firsts[i] for i in every.tolist())])]

        values = [*self._pieces(core.dictionary), *self._pieces(end.dictionary), *got[: len(asked)], self._piece("\n"), b""]
        three = np.full((len(chunks), 3), len(values) - 1)
        three[line.to_numpy(zero_copy_only=False), 0] = len(values) - 2
        three[plain, 1] = core.indices.drop_null().to_numpy()
        three[plain, 2] = len(core.dictionary) + end.indices.drop_null().to_numpy()
        three[at[~odd], 1] = len(core.dictionary) + len(end.dictionary) + np.arange(len(asked))
        sizes, table = _table(values)
        chunk_sizes, chunk_ids = sizes[three].sum(axis=1), _spread(sizes, table, three.ravel())

        # distinct chunks, first chunks or uncut texts, the tail, and nothing
        sizes, table = _table([*got[len(asked) :], tail, b""])
        sizes, table, nothing = np.concatenate((chunk_sizes, sizes)), np.concatenate((chunk_ids, table)), len(chunks) + len(texts) + 1
        which, inner = np.full(len(flat) + len(texts), nothing - 1), np.ones(len(flat) + len(texts), bool)
        inner[bounds[:-1] + every] = inner[bounds[1:] + every] = False
        which[inner] = places
        which[bounds[:-1] + every] = len(chunks) + every
        for i in uncut:
            which[bounds[i] + i + 1 : bounds[i + 1] + i] = nothing
        ends = np.cumsum(sizes[which])[bounds[1:] + every]
        return np.split(_spread(sizes, table, which), ends[:-1])

    def _pieces(self, pieces: pa.Array) -> list[bytes]:
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        return [self._piece(p) if ids is None else ids for p, ids in zip(names, map(self.pieces.get, names))]


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each value, and all their ids."""
    return np.fromiter(map(len, values), np.int64, len(values)) // 4, np.frombuffer(b"".join(values), np.uint32)


def _spread(sizes: np.ndarray, table: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of the entries ``which``, one after another, of a table of entries of these sizes."""
    starts, out = np.cumsum(sizes) - sizes, [np.empty(0, np.uint32)]
    for k in range(0, len(which), _PLACES):
        some = which[k : k + _PLACES]
        n = sizes[some]
        out.append(table[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(out)


def character_bytes() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 as itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


@lru_cache(maxsize=2)
def _library(path: str) -> _Library:
    return _Library(path)


def encode_texts(texts: list[str], path: str, end_id: int | None = END_ID) -> list[np.ndarray]:
    """Ids of whole texts as the library gives them, with ``end_id`` after each."""
    full = [i for i, t in enumerate(texts) if t]
    tail = b"" if end_id is None else np.uint32(end_id).tobytes()
    out = [np.frombuffer(tail, np.uint32)] * len(texts)
    for i, ids in zip(full, _library(path).ids([texts[i] for i in full], tail) if full else ()):
        out[i] = ids
    return out


def token_rows(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n, ids`` (compressed little-endian integers) a document, then a row of counts by id for each task, in ``counts``."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        path, pack, counts = SparkFiles.get(name), zstandard.ZstdCompressor(1), np.zeros(0, np.int64)
        rows = ((d.as_py(), t.as_py()) for b in arrow for d, t in zip(b.column(0), b.column(1)))
        for some in batches(rows, 1024, 1 << 22):
            ids = encode_texts([t or "" for _, t in some], path)
            seen = np.bincount(np.concatenate(ids))
            counts = np.pad(counts, (0, max(0, len(seen) - len(counts))))
            counts[: len(seen)] += seen
            packed = [pack.compress(x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes()) for x in ids]
            columns = [pa.array([d for d, _ in some], pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(some), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(counts.astype("<i8").tobytes(), 1)], pa.binary())], names=["doc", "n", "ids", "counts"])

    return docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("body")).mapInArrow(run, "doc bigint, n bigint, ids binary, counts binary")


def count_ids(rows: DataFrame) -> np.ndarray:
    """Corpus counts by id; the driver gets at most one row for each id of the vocabulary."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in arrow:
            for cell in batch.column(0):
                seen = np.frombuffer(zlib.decompress(cell.as_py()), "<i8")
                total = np.pad(total, (0, max(0, len(seen) - len(total))))
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = rows.where("counts is not null").select("counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def _ranged(rows: DataFrame, files: int) -> DataFrame:
    """``rows(doc, n, ids)`` with ``part``, in which all of a range's rows are, and ``mix``, the order of rows of one document id."""
    key, mix = F.coalesce("doc", F.lit(_NULL_ID)), F.xxhash64("ids")
    if files == 1:
        return rows.select("*", F.lit(0).alias("part"), mix.alias("mix"))
    wanted = [k / files for k in range(1, files)]
    bounds = sorted(rows.agg(F.percentile_approx(key, F.array(*[F.lit(w) for w in wanted]), F.lit(max(10_000, 16 * files)))).first()[0])
    values = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series, mixed: pd.Series) -> pd.Series:
        low, high = np.searchsorted(values, ids, "left"), np.searchsorted(values, ids, "right")
        share = (mixed.to_numpy() >> 33).astype(np.float64) / (1 << 31) + 0.5  # ascends with the hash
        return pd.Series((low + np.floor(share * np.where(high > low, high - low + 1, 1))).astype(np.int32))

    return rows.select("*", mix.alias("mix")).withColumn("part", part(key, "mix"))


def write_files(rows: DataFrame, folder: str, counts: np.ndarray, ids_per_file: int = IDS_PER_FILE, block_ids: int = ans.BLOCK_IDS) -> DataFrame:
    """Write the stored ``rows(doc, n, ids)`` and the table of frequencies; returns ``path`` of the files.

    Rows of one document id are in the order of a hash of their ids. The driver holds a number for
    each file. A task writes beside a file's name and renames it at the end, so it may run again.
    """
    fs, where = pafs.FileSystem.from_uri(folder)
    fs.create_dir(where, recursive=True)
    freq = ans.table(counts)
    with fs.open_output_stream(f"{where}/frequencies.bin", compression=None) as out:
        out.write(zlib.compress(freq.astype("<u4").tobytes()))
    files = int(min(MOST_FILES, max(1, -(-int(counts.sum()) // ids_per_file))))
    ranged = _ranged(rows, files)
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(folder)
        coder, now, paths = ans.Coder(freq), None, []
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in arrow:
            for part, doc, n, packed in zip(*(batch.column(c) for c in ("part", "doc", "n", "ids"))):
                part, n, data = part.as_py(), n.as_py(), unpack.decompress(packed.as_py())
                if now is None or now.part != part:
                    paths += [now.close()] if now else []
                    now = _Writer(fs, where, part, starts[part], coder, block_ids)
                now.add(doc.as_py(), np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.uint32))
        paths += [now.close()] if now else []
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    dealt = ranged.repartition(files, "part").sortWithinPartitions("part", F.col("doc").asc_nulls_first(), "mix")
    return dealt.select("part", "doc", "n", "ids").mapInArrow(run, "path string")


class _Writer:
    """One file: ids gathered to a block's length, coded and written."""

    def __init__(self, fs, where: str, part: int, start: int, coder: ans.Coder, block_ids: int):
        self.fs, self.part, self.coder, self.block_ids = fs, part, coder, block_ids
        self.path = f"{where}/part-{part:06d}.ids"
        self.draft = f"{self.path}.{TaskContext.get().taskAttemptId()}"
        self.out = fs.open_output_stream(self.draft, compression=None)
        self.first, self.at, self.seq = start, 0, 0
        self.blocks, self.all_pieces, self.ids, self.pieces, self.held = [], [], [], [], 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = self.held + len(ids) <= self.block_ids
        while len(ids):
            take = ids[: self.block_ids - self.held]
            ids = ids[len(take) :]
            self.ids.append(take)
            self.pieces.append((self.seq, doc or 0, doc is None, len(take), whole))
            self.held += len(take)
            if self.held == self.block_ids:
                self.flush()
        self.seq += 1

    def flush(self) -> None:
        if self.held:
            block = self.coder.encode(np.concatenate(self.ids))
            self.out.write(block)
            self.blocks.append((self.at, len(block), self.first, self.held, len(self.pieces)))
            self.all_pieces.append(zlib.compress(np.array(self.pieces, _PIECE).tobytes(), 1))
            self.at, self.first = self.at + len(block), self.first + self.held
            self.ids, self.pieces, self.held = [], [], 0

    def close(self) -> str:
        self.flush()
        sizes = np.array([len(p) for p in self.all_pieces], "<u4")
        foot = np.array(self.blocks, _BLOCK).tobytes() + sizes.tobytes() + b"".join(self.all_pieces)
        self.out.write(foot + _FOOT.pack(len(foot), len(self.blocks), _FOOT_MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.path)
        return self.path


def _footer(source) -> list[tuple]:
    """``(block row, deflated pieces)`` for every block of an open file."""
    end = source.size() - _FOOT.size
    source.seek(end)
    size, count, magic = _FOOT.unpack(source.read(_FOOT.size))
    if magic != _FOOT_MAGIC:
        raise ValueError("not a file of token ids")
    source.seek(end - size)
    foot = source.read(size)
    at, found = count * (_BLOCK.itemsize + 4), []
    for block, n in zip(np.frombuffer(foot, _BLOCK, count), np.frombuffer(foot, "<u4", count, count * _BLOCK.itemsize)):
        found.append((block, foot[at : at + n]))
        at += int(n)
    return found


def _frequencies(fs, where: str) -> np.ndarray:
    with fs.open_input_file(f"{where}/frequencies.bin") as source:
        return np.frombuffer(zlib.decompress(source.read()), "<u4")


def read_pieces(files: DataFrame, folder: str, scratch: Scratch, with_ids: bool = False, blocks_per_task: int = 4) -> DataFrame:
    """Document pieces of the files ``files(path)``, a row for each block a document is in.

    ``path, seq, doc, whole, start, n, crc``, with ``with_ids`` also the piece's ``ids``. ``start`` is the
    corpus-wide number of the first id, ``whole`` says that the piece is the document. Blocks are dealt
    to tasks whatever file they are in.
    """

    def index(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in arrow:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as source:
                    rows = [(path, int(b["at"]), int(b["size"]), int(b["first"]), p) for b, p in _footer(source)]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "at", "size", "first", "pieces"])

    names = ["path", "seq", "doc", "whole", "start", "n", "crc", *["ids"] * with_ids]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(folder)
        coder = None
        for batch in arrow:
            for path, at, size, first, packed in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size", "first", "pieces"))):
                coder = coder or ans.Coder(_frequencies(fs, where))
                with fs.open_input_file(path) as source:
                    source.seek(at)
                    ids = coder.decode(source.read(size)).astype("<u4")
                pieces = np.frombuffer(zlib.decompress(packed), _PIECE)
                ends = np.cumsum(pieces["n"].astype(np.int64))
                starts = ends - pieces["n"]
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [
                    pa.array([path] * len(pieces), pa.string()), pa.array(pieces["seq"].astype(np.int64)), pa.array(pieces["doc"].astype(np.int64), mask=pieces["null"].astype(bool)),
                    pa.array(pieces["whole"].astype(bool)), pa.array(starts + first), pa.array(pieces["n"].astype(np.int64)), pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    blocks = scratch.write(files.mapInArrow(index, "path string, at bigint, size bigint, first bigint, pieces binary"), "blocks")
    count = blocks.count()
    tasks = max(1, -(-count // blocks_per_task), min(count, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = "path string, seq bigint, doc bigint, whole boolean, start bigint, n bigint, crc bigint" + ", ids array<int>" * with_ids
    return blocks.repartition(tasks, "path", "at").mapInArrow(run, schema)


def joined_crc(sums: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings put together, from the ``(bytes, crc)`` of each; at most a block's bytes of zeros are made."""
    total = 0
    for size, crc in sums:
        zeros = bytes(size)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


def read_documents(files: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; pieces of one document are put together."""
    pieces = scratch.write(read_pieces(files, folder, scratch), "pieces")

    @F.pandas_udf("bigint")
    def crc(parts: pd.Series) -> pd.Series:
        return pd.Series([joined_crc([(4 * p["n"], p["crc"]) for p in some]) for some in parts], dtype="int64")

    cut = pieces.where("not whole").groupBy("path", "seq").agg(F.first("doc").alias("doc"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"))
    cut = cut.select("doc", F.col("parts")[0]["start"].alias("start"), F.expr("aggregate(parts, 0L, (a, p) -> a + p.n)").alias("n"), crc("parts").alias("crc"))
    whole = pieces.where("whole").select("doc", "start", "n", "crc")
    return whole.union(cut).select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def tokenise_write_read(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Encode every whole text, write all ids with an end id after each document, and read the files back.

    A row for each document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` (with
    the end id) and ``ids_crc32`` (of little-endian 32-bit integers). Null and empty texts have the end
    id alone. Null ids come first; of rows with one id the order follows from a hash of their ids, so
    repeated rows are alike whichever comes first. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    rows = scratch.write(token_rows(docs, tokenizer_path, id_col, text_col), "ids")
    folder = scratch.path("files")
    files = scratch.write(write_files(rows.where("counts is null").select("doc", "n", "ids"), folder, count_ids(rows), **sizes), "paths")
    scratch.drop(rows)
    return read_documents(files, folder, scratch)
