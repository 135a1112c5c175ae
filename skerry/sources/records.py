"""Binary files with a text index beside them, and tiled output: read record by record, patch by patch.

Three layouts. ``restart``: big-endian four-byte fields, padded to blocks, with a line ``field = step day
level density min max`` for each in a ``.b`` file beside the ``.a`` file. ``mesh``: records of one type
behind four bytes each, with a line ``name type length min max`` in a ``.dat`` file beside the ``.bin``
file. ``patch``: a file for each part of a grid, whose first line says which part it is.

The driver reads the indexes, which have a line for each record. A record that is asked for is an input
partition of its own, found by its offset, so records that are not asked for are never read; a patch
outside the window is left out likewise. A record's least and greatest value must be those of its index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skerry.sources.tables import MISSING, RECORD_WORDS

CONSISTENT = 1e-4
#: Types of a mesh file's records: the name in the index and numpy's.
MESH_TYPES = {"int": "<i4", "double": "<f8"}
_HEADER = "field         time step  model day  k  dens          min                  max"
_SCHEMA = "file string, record int, field string, step int, day double, level int, dens double, loc bigint, value double"


@dataclass
class _Record(InputPartition):
    file: str
    record: int
    field: str
    offset: int
    count: int
    kind: str
    low: float
    high: float
    step: int | None = None
    day: float | None = None
    level: int | None = None
    dens: float | None = None


def restart_index(text: str, file: str, points: int) -> list[_Record]:
    """Records of a restart file from its index; lines before the table's head are comments."""
    block = -(-points // RECORD_WORDS) * RECORD_WORDS * 4
    lines = text.split("\n")
    start = next((k for k, line in enumerate(lines) if line.split()[:2] == ["field", "time"]), -1) + 1
    found = []
    for k, line in enumerate(x for x in lines[start:] if x.strip()):
        name, _, rest = line.partition("=")
        step, day, level, dens, low, high = rest.split()
        found.append(_Record(file, k, name.strip(), k * block, points, ">f4", float(low), float(high), int(step), float(day), int(level), float(dens)))
    return found


def mesh_index(text: str, file: str) -> list[_Record]:
    """Records of a mesh file from its index."""
    found, offset = [], 4
    for line in text.split("\n"):
        parts = line.split()
        if len(parts) < 5:
            continue
        name, kind, count, low, high = parts[:5]
        kind = MESH_TYPES[kind]
        found.append(_Record(file, len(found), name, offset, int(count), kind, float(low), float(high)))
        offset += 4 + int(count) * np.dtype(kind).itemsize
    return found


def _values(record: _Record) -> np.ndarray:
    """A record's values, missing ones as NaN; raises where they disagree with the index."""
    fs, path = pafs.FileSystem.from_uri(record.file)
    with fs.open_input_file(path) as source:
        source.seek(record.offset)
        data = source.read(record.count * np.dtype(record.kind).itemsize)
    values = np.frombuffer(data, record.kind, record.count).astype(np.float64)
    values[values > MISSING / 2] = np.nan
    known = values[~np.isnan(values)]
    if len(known):
        for name, got, said in (("min", known.min(), record.low), ("max", known.max(), record.high)):
            if abs(got - said) > CONSISTENT * max(abs(got), abs(said), 1e-30):
                raise ValueError(f"record {record.record} of {record.file}: {name} is {got}, the index says {said}")
    return values


class IndexedRecords(DataSource):
    """``spark.read.format("indexed_records")`` with options ``path`` (a folder), ``layout``, ``points``, ``fields`` and ``levels`` (JSON lists)."""

    @classmethod
    def name(cls) -> str:
        return "indexed_records"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options)


class _RecordReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.layout = options["path"], options.get("layout", "restart")
        self.points = int(options.get("points", 0))
        self.fields = json.loads(options.get("fields", "null"))
        self.levels = json.loads(options.get("levels", "null"))

    def partitions(self) -> list[_Record]:
        index, data = {"restart": (".b", ".a"), "mesh": (".dat", ".bin")}[self.layout]
        fs, where = pafs.FileSystem.from_uri(self.folder)
        found = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)), key=lambda x: x.path):
            if info.path.endswith(index):
                with fs.open_input_stream(info.path) as source:
                    text = source.read().decode()
                file = f"{self.folder.rstrip('/')}/{info.base_name.removesuffix(index)}{data}"
                found += restart_index(text, file, self.points) if self.layout == "restart" else mesh_index(text, file)
        wanted = lambda value, allowed: allowed is None or value in allowed
        return [r for r in found if wanted(r.field, self.fields) and wanted(r.level, self.levels)]

    def read(self, record: _Record) -> Iterator[pa.RecordBatch]:
        if record is None:
            return
        values = _values(record)
        for start in range(0, len(values), 1 << 16):
            some = values[start : start + (1 << 16)]
            same = lambda v, kind: pa.array([v] * len(some), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    same(record.file.rsplit("/", 1)[-1], pa.string()), same(record.record, pa.int32()), same(record.field, pa.string()), same(record.step, pa.int32()), same(record.day, pa.float64()),
                    same(record.level, pa.int32()), same(record.dens, pa.float64()), pa.array(np.arange(start, start + len(some))), pa.array(some, from_pandas=True),
                ],
                names=["file", "record", "field", "step", "day", "level", "dens", "loc", "value"],
            )


def read_records(spark: SparkSession, folder: str, layout: str = "restart", points: int = 0, fields: list[str] | None = None, levels: list[int] | None = None) -> DataFrame:
    """``file, record, field, step, day, level, dens, loc, value`` of the records asked for, all by default; missing values are null."""
    spark.dataSource.register(IndexedRecords)
    return spark.read.format("indexed_records").options(path=folder, layout=layout, points=str(points), fields=json.dumps(fields), levels=json.dumps(levels)).load()


class _Files:
    """Data and index of one file after another, each written under a draft's name and then renamed."""

    def __init__(self, folder: str, data: str, index: str):
        self.fs, self.where = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.where, recursive=True)
        self.ends, self.name, self.lines = (data, index), None, []

    def open(self, name: str, lines: list[str]) -> None:
        self.close()
        self.name, self.lines = name, lines
        self.draft = f"{self.where}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.out = self.fs.open_output_stream(self.draft, compression=None)

    def close(self) -> list[str]:
        if self.name is None:
            return []
        self.out.close()
        self.fs.move(self.draft, f"{self.where}/{self.name}{self.ends[0]}")
        with self.fs.open_output_stream(self.draft, compression=None) as out:
            out.write("".join(f"{x}\n" for x in self.lines).encode())
        self.fs.move(self.draft, f"{self.where}/{self.name}{self.ends[1]}")
        name, self.name = self.name, None
        return [name]


def _record_at_a_time(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """Rows that are sorted by record, as ``(keys, values)`` of one record after another."""
    now, parts = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        values = batch.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
        start = 0
        rows = list(zip(*columns))
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k] != rows[start]:
                if now is not None and rows[start] != now:
                    yield dict(zip(keys, now)), np.concatenate(parts)
                    parts = []
                now = rows[start]
                parts.append(values[start:k])
                start = k
    if now is not None:
        yield dict(zip(keys, now)), np.concatenate(parts)


def write_restart(rows: DataFrame, folder: str, comments: tuple[str, ...] = ("", "", "", "")) -> DataFrame:
    """Write ``rows(file, record, field, step, day, level, dens, loc, value)``, a restart file and its index for each ``file``.

    A record must have every point; null values are marked as missing. Returns ``file``. Records of one
    file follow each other in a task, which holds one of them at a time.
    """
    keys = ["file", "record", "field", "step", "day", "level", "dens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, names = _Files(folder, ".a", ".b"), []
        for key, values in _record_at_a_time(batches, keys):
            if files.name != key["file"]:
                names += files.close()
                files.open(key["file"], [*comments, _HEADER])
            stored = values.astype(">f4")
            known = stored[~np.isnan(stored)].astype(float)
            low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
            padded = np.full(-(-len(values) // RECORD_WORDS) * RECORD_WORDS, MISSING, ">f4")
            padded[: len(values)] = np.where(np.isnan(stored), np.float32(MISSING), stored)
            files.out.write(padded.tobytes())
            files.lines.append(f"{key['field']:<9s}={key['step']:11d} {key['day']:11.2f} {key['level']:3d} {key['dens']:7.3f} {low:16.7E} {high:16.7E}")
        names += files.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    dealt = rows.select(*keys, "loc", "value").repartition("file").sortWithinPartitions(*keys, "loc")
    return dealt.select(*keys, F.col("value").cast("double").alias("value")).mapInArrow(run, "file string")


def write_mesh(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows(file, record, field, kind, loc, value)``, a mesh file and its index for each ``file``; ``kind`` is ``int`` or ``double``."""
    keys = ["file", "record", "field", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, names = _Files(folder, ".bin", ".dat"), []
        for key, values in _record_at_a_time(batches, keys):
            if files.name != key["file"]:
                names += files.close()
                files.open(key["file"], [])
            form = "d" if key["kind"] == "int" else ".17g"
            low, high = (int(x) if key["kind"] == "int" else x for x in (np.nanmin(values), np.nanmax(values)))
            files.out.write(np.array([len(values)], "<i4").tobytes() + values.astype(MESH_TYPES[key["kind"]]).tobytes())
            files.lines.append(f"{key['field']} {key['kind']} {len(values)} {low:{form}} {high:{form}}")
        names += files.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    dealt = rows.select(*keys, "loc", "value").repartition("file").sortWithinPartitions(*keys, "loc")
    return dealt.select(*keys, F.col("value").cast("double").alias("value")).mapInArrow(run, "file string")


def write_patches(field: DataFrame, folder: str, name: str, width: int, height: int) -> DataFrame:
    """Write ``field(i, j, value)`` as files of patches of ``width`` by ``height`` points; returns ``file``. Points may be missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, names = _Files(folder, ".patch", ".done"), []

        def put(pi: int, pj: int, rows: list[tuple]) -> None:
            values = np.full((height, width), np.nan)
            for i, j, v in rows:
                values[j - pj * height, i - pi * width] = np.nan if v is None else v
            i1, j1 = max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1
            head = {"name": name, "i0": pi * width, "i1": i1, "j0": pj * height, "j1": j1, "width": width, "height": height}
            files.open(f"{name}_{pj:06d}_{pi:06d}", [])
            files.out.write(json.dumps(head).encode() + b"\n" + values.astype("<f8").tobytes())
            names.extend(files.close())

        now, rows = None, []
        for batch in batches:
            for pi, pj, i, j, v in zip(*(batch.column(c).to_pylist() for c in ("pi", "pj", "i", "j", "value"))):
                if now is not None and now != (pi, pj):
                    put(*now, rows)
                    rows = []
                now = (pi, pj)
                rows.append((i, j, v))
        if now is not None:
            put(*now, rows)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    placed = field.select(F.floor(F.col("i") / width).cast("int").alias("pi"), F.floor(F.col("j") / height).cast("int").alias("pj"), "i", "j", F.col("value").cast("double").alias("value"))
    return placed.repartition("pi", "pj").sortWithinPartitions("pi", "pj").mapInArrow(run, "file string")


class PatchFiles(DataSource):
    """``spark.read.format("patch_files")`` with options ``path`` and ``window`` (JSON ``[i0, i1, j0, j1]``, upper ends excluded)."""

    @classmethod
    def name(cls) -> str:
        return "patch_files"

    def schema(self) -> str:
        return "name string, i bigint, j bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return _PatchReader(self.options)


class _PatchReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.window = options["path"], json.loads(options.get("window", "null"))

    def partitions(self) -> list[InputPartition]:
        fs, where = pafs.FileSystem.from_uri(self.folder)
        paths = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)) if x.path.endswith(".patch"))
        return [InputPartition(p) for p in paths]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        i0, i1, j0, j1 = self.window or (-(1 << 62), 1 << 62, -(1 << 62), 1 << 62)
        with fs.open_input_file(partition.value) as source:
            line = b""
            while not line.endswith(b"\n"):
                line += source.read(1)
            head = json.loads(line)
            low_i, high_i, low_j, high_j = max(i0, head["i0"]), min(i1, head["i1"]), max(j0, head["j0"]), min(j1, head["j1"])
            if low_i >= high_i or low_j >= high_j:
                return  # the values stay unread
            row = 8 * head["width"]
            source.seek(len(line) + (low_j - head["j0"]) * row)
            values = np.frombuffer(source.read((high_j - low_j) * row), "<f8").reshape(-1, head["width"])
        values = values[:, low_i - head["i0"] : high_i - head["i0"]]
        j, i = np.mgrid[low_j:high_j, low_i:high_i]
        yield pa.RecordBatch.from_arrays([pa.array([head["name"]] * values.size), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(values.ravel(), from_pandas=True)], names=["name", "i", "j", "value"])


def read_patches(spark: SparkSession, folder: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``name, i, j, value`` of tiled output put together by each file's place in the grid; of a window only the rows in it are read."""
    spark.dataSource.register(PatchFiles)
    return spark.read.format("patch_files").options(path=folder, window=json.dumps(window)).load()
