"""NumPy archives of a matrix and its row ids, read by ranges of rows.

The archive's directory tells where each member lies. A matrix that is stored as it is, row
after row, is planned as ranges of rows by their byte offsets; a compressed one, or one kept
by columns, is one range of its file and is read from its start in bounded pieces or, by
columns, whole. A file that is no archive, lacks a member, holds objects, or whose members
don't fit each other or their lengths, is an error that names it. Ranges of a stored member
are not held against the checksum of the whole; compressed members are.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT, SCHEMA = "npz_rows", "chunk_id string, ordinal long, embedding array<double>"
#: Bytes of the matrix to a range, and rows to a batch.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 4096
_LOCAL_HEADER = 30
_FAULTS = (zipfile.BadZipFile, zlib.error, KeyError, ValueError, EOFError)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


@dataclass
class Member:
    """An array in an archive: shape, type, and where its elements begin if they are stored."""

    name: str
    shape: tuple
    dtype: np.dtype
    by_columns: bool
    stored_at: int | None


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    end: int


def _shape(file) -> tuple[tuple, bool, np.dtype]:
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    if version not in read:
        raise ValueError(f"array format {version}")
    return read[version](file)


def _member(raw, archive: zipfile.ZipFile, name: str) -> Member:
    info = archive.getinfo(f"{name}.npy")
    with archive.open(info) as file:
        shape, by_columns, dtype = _shape(file)
        header = file.tell()
    if dtype.hasobject:
        raise ValueError(f"{name} holds objects")
    if info.file_size != header + int(np.prod(shape)) * dtype.itemsize:
        raise ValueError(f"{name} has {info.file_size - header} bytes for the shape {shape}")
    at = None
    if info.compress_type == zipfile.ZIP_STORED:
        raw.seek(info.header_offset)
        local = raw.read(_LOCAL_HEADER)
        at = info.header_offset + _LOCAL_HEADER + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little") + header
    return Member(name, shape, dtype, by_columns, at)


def _slices(raw, archive: zipfile.ZipFile, member: Member, first: int, end: int) -> Iterator[np.ndarray]:
    """The rows from ``first`` to ``end``, a batch at a time."""
    width = int(np.prod(member.shape[1:])) * member.dtype.itemsize
    spans = [(at, min(at + BATCH_ROWS, end)) for at in range(first, end, BATCH_ROWS)]
    if member.by_columns and len(member.shape) > 1:
        with archive.open(f"{member.name}.npy") as file:
            whole = np.lib.format.read_array(file, allow_pickle=False)
        yield from (whole[a:b] for a, b in spans)
        return
    if member.stored_at is not None:
        file = raw
        file.seek(member.stored_at + first * width)
    else:
        file = archive.open(f"{member.name}.npy")
        _shape(file)
        for at in range(0, first * width, 1 << 20):
            file.read(min(1 << 20, first * width - at))
    for a, b in spans:
        data = file.read((b - a) * width)
        if len(data) != (b - a) * width:
            raise ValueError(f"{member.name} ends in row {a + len(data) // max(width, 1)}")
        yield np.frombuffer(data, member.dtype).reshape(b - a, *member.shape[1:])


class NpzReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.vectors, self.ids = options["path"], options.get("vectors", "embeddings"), options.get("ids", "chunk_ids")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def _members(self, raw, archive: zipfile.ZipFile) -> tuple[Member, Member]:
        x, names = (_member(raw, archive, name) for name in (self.vectors, self.ids))
        if len(x.shape) != 2 or len(names.shape) != 1 or x.shape[0] != names.shape[0]:
            raise ValueError(f"a matrix of shape {x.shape} with ids of shape {names.shape}")
        return x, names

    def partitions(self) -> list[Rows]:
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [root] if info.type == pafs.FileType.File else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".npz"))
        out = []
        for path in files:
            try:
                with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
                    x, names = self._members(raw, archive)
            except _FAULTS as e:
                raise ValueError(f"{path}: {e}") from e
            whole = x.stored_at is None or names.stored_at is None or x.by_columns
            step = max(1, x.shape[0]) if whole else max(1, self.range_bytes // max(1, x.shape[1] * x.dtype.itemsize))
            out += [Rows(path, at, min(at + step, x.shape[0])) for at in range(0, x.shape[0], step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        try:
            with fs.open_input_file(partition.path) as raw, fs.open_input_file(partition.path) as also, zipfile.ZipFile(raw) as archive, zipfile.ZipFile(also) as second:
                x, names = self._members(raw, archive)
                at = partition.first
                for some, ids in zip(_slices(raw, archive, x, partition.first, partition.end), _slices(also, second, names, partition.first, partition.end), strict=True):
                    flat = pa.array(some.astype(np.float64).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(str).tolist(), pa.string()), pa.array(np.arange(at, at + len(some))), lists], names=["chunk_id", "ordinal", "embedding"])
                    at += len(some)
        except _FAULTS as e:
            raise ValueError(f"{partition.path}: {e}") from e


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpzReader:
        return NpzReader(dict(self.options))


def read_rows(spark: SparkSession, path: str, *, vectors: str, ids: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(chunk_id, ordinal, embedding) of an archive, or of all ``.npz`` files of a folder."""
    spark.dataSource.register(NpzSource)
    return spark.read.format(FORMAT).option("vectors", vectors).option("ids", ids).option("range_bytes", str(range_bytes)).load(path)
