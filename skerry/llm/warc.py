"""WARC archives: a writer, and a reader that splits compressed archives at any byte.

Each record is a gzip member of its own. The reader cuts archives into byte ranges; a task looks for
the gzip magic from its range's start, takes a place for a record only if inflating it gives a WARC
header, and owns the records that start inside its range, reading on beyond it to finish the last one.
Members are inflated one at a time; a candidate that is no record is skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.scratch import Scratch

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 1 << 20
READ_BYTES = 1 << 18
RANGES_PER_TASK = 16
MIN_DEDUP_BYTES = 100
_VERSION = b"WARC/1.1\r\n"


def encode_record(fields: dict[str, object], payload: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    fields = fields | {"Content-Length": len(payload)}
    head = _VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(payload) + pack.compress(b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and payload of an inflated record, or None if it is none."""
    if not data.startswith(b"WARC/"):
        return None
    head, found, body = data.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit() or len(body) < int(size):
        return None
    return fields, body[: int(size)]


def _inflate(source, at: int, buffer: bytes) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and its end, or None if no record starts there.

    ``buffer`` holds the bytes from ``at`` on as far as read; more are read as needed.
    """
    pack, out, ahead = zlib.decompressobj(31), bytearray(), at + len(buffer)
    piece = buffer
    while True:
        try:
            out += pack.decompress(piece)
        except zlib.error:
            return None
        if len(out) >= 5 and not out.startswith(b"WARC/"):
            return None
        if pack.eof:
            return bytes(out), ahead - len(pack.unused_data)
        source.seek(ahead)
        piece = source.read(READ_BYTES)
        if not piece:
            return None
        ahead += len(piece)


def read_range(source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records that start in ``[start, end)`` of a seekable archive: offset, fields, payload."""
    source.seek(start)
    buffer, base = source.read(READ_BYTES + 16), start  # buffer holds the archive from base on
    at = start
    while at < end:
        place = buffer.find(MAGIC, at - base)
        if place < 0:
            more_from = base + len(buffer)
            if more_from >= end + len(MAGIC) - 1:
                return
            source.seek(more_from)
            piece = source.read(READ_BYTES)
            if not piece:
                return
            tail = buffer[-2:] if len(buffer) >= 2 else buffer
            base, buffer = more_from - len(tail), tail + piece
            at = max(at, base)
            continue
        place += base
        if place >= end:
            return
        member = _inflate(source, place, buffer[place - base :])
        record = parse_record(member[0]) if member else None
        if record is None:
            at = place + 1
            continue
        yield place, *record
        at = member[1]
        if at - base >= len(buffer):
            source.seek(at)
            buffer, base = source.read(READ_BYTES), at


def write_archives(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write ``records(record_id, record_type, uri, payload, digest, payload_bytes, refers_to)``, an archive a task.

    Returns ``(path, bytes)`` of the archives. A task writes beside its archive's name and renames it
    at the end, so a task that runs again, or twice at once, leaves one whole archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, where = pafs.FileSystem.from_uri(folder)
        fs.create_dir(where, recursive=True)
        path = f"{where}/part-{task.partitionId():06d}.warc.gz"
        draft = f"{path}.{task.taskAttemptId()}"
        size = 0
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                columns = [batch.column(c) for c in ("record_id", "record_type", "uri", "payload", "digest", "payload_bytes", "refers_to")]
                for i in range(batch.num_rows):
                    record_id, kind, uri, payload, digest, length, refers = (c[i].as_py() for c in columns)
                    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if record_id is None else record_id}>", "WARC-Target-URI": " ".join((uri or "").split())}
                    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Payload-Length": length}
                    if kind == "revisit":
                        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers}>"}
                    size += out.write(encode_record(fields, payload or b"", level))
        fs.move(draft, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64())})

    return records.mapInArrow(run, "path string, bytes bigint")


def read_archives(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives ``files(path, bytes)``: a row for each, whatever the ranges.

    ``record_id, record_type, uri, payload_bytes, payload_digest, refers_to``, of the full payload: of
    responses from the bytes read, of revisits from the header, as their payload is the referred one's.
    """
    ranges = files.where("bytes > 0").select("path", F.col("bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                rows = []
                with fs.open_input_file(path) as source:
                    for _, fields, payload in read_range(source, start, end):
                        refers = _page(fields.get("warc-refers-to", ""))
                        kind = fields["warc-type"]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if kind == "revisit":
                            size, digest = int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((_page(fields["warc-record-id"]), kind, fields.get("warc-target-uri", ""), size, digest, refers))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    names = ["record_id", "record_type", "uri", "payload_bytes", "payload_digest", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "record_id bigint, record_type string, uri string, payload_bytes bigint, payload_digest string, refers_to bigint"
    # a number of tasks that follows from the ranges: rows of a path and two numbers would all be put into one
    count = files.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    tasks = max(ceil(count / RANGES_PER_TASK), min(int(count), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    return ranges.repartition(tasks, "path", "start").mapInArrow(run, schema)


def _page(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Archive every page, payloads stored once, and read the archives back.

    Of records with equal payloads of ``min_bytes`` or more the one with the smallest id is a
    response, others are revisits of it. Null html is an empty payload; records with a null id are
    responses. Of repeated rows with that smallest id each is a response. Empty tables give no records.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(
        pages[id_col].cast("long").alias("record_id"), pages[url_col].alias("uri"), F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("record_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.write(firsts.select(F.col("digest").alias("shared"), "first"), "shared-payloads")
    joined = rows.join(firsts, F.col("digest") == F.col("shared"), "left")
    again = F.coalesce(F.col("record_id") > F.col("first"), F.lit(False))
    records = joined.select(
        "record_id", "uri", "digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )
    folder = scratch.path("archives")
    files = scratch.write(write_archives(records, folder), "files")
    return read_archives(files, folder)
