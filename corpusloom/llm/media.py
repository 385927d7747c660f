"""Media columns in archive directories, behind a Spark data source of their own.

Writing: each task appends the media of its rows to one archive, followed by an index
of keys, offsets, lengths and checksums; only archives of committed tasks enter the
manifest. Reading: byte ranges of the archives are planned from the manifest, a range
owns the members that begin in it, and payloads leave in Arrow batches bounded by
bytes. A member that can't be read or fails its checksum is opened and read again by
its own offset, without the rest of its range; if it stays bad, the task fails.

The media of a text is a PNG image of 8-bit grey samples, 64 to a row: its UTF-8 bytes,
padded by zeros to a positive multiple of 64. Defined results: a null text is empty; a
null doc_id is stored and read back as null; repeated rows are members of their own, and
equal texts equal media; members keep the order of their rows, so no ties arise; a text
of any length is one member, read whole in a batch of its own if it passes the bound;
an empty table gives an empty directory with a manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .scratch import column, scratch_path, small_batches

FORMAT = "member_archive"
ROW = 64
RANGE_BYTES, BATCH_BYTES, RETRIES = 8 << 20, 4 << 20, 3
TRAILER = struct.Struct("<QQ8s")
MAGIC, PNG = b"members1", b"\x89PNG\r\n\x1a\n"


# --- the image ---------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def to_png(raw: bytes, level: int = 1) -> bytes:
    payload = padded(raw)
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, bytes before padding)."""
    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    at, packed, n = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IDAT":
            packed.append(body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, ROW + 1)
    return rows[:, 1:].tobytes(), n


def features(payload: bytes) -> str:
    """Mean, deviation, entropy of the samples and share of rises over the mean."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, levels = len(x), np.arange(256)
    mean = float((counts * levels).sum()) / n
    deviation = float(np.sqrt((counts * (levels - mean) ** 2).sum() / n))
    p = counts[counts > 0] / n
    over = x > mean
    rises = float((over[1:] & ~over[:-1]).sum()) / n
    return f"mean={mean:.4f};std={deviation:.4f};entropy={-float((p * np.log2(p)).sum()):.4f};rises={rises:.4f}"


# --- archives ----------------------------------------------------------------


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


@dataclass
class ArchiveMessage(WriterCommitMessage):
    name: str = ""
    members: int = 0
    data_bytes: int = 0


@dataclass
class ByteRange(InputPartition):
    name: str
    begin: int
    end: int
    data_bytes: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ArchiveMessage:
        fs, root = _open_fs(self.path)
        name = f"part-{uuid.uuid4().hex}.members"  # a repeated attempt writes an archive of its own
        out, at = None, 0
        parts: list[pa.RecordBatch] = []
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            offsets, lengths, sums = [], [], []
            for media in batch.column("media"):
                raw = media.as_py() or b""
                out.write(raw)
                offsets.append(at)
                lengths.append(len(raw))
                sums.append(zlib.crc32(raw))
                at += len(raw)
            parts.append(pa.RecordBatch.from_arrays([batch.column("key"), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["key", "offset", "length", "crc32"]))
        if out is None:
            return ArchiveMessage()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema) as stream:
            for part in parts:
                stream.write_batch(part)
        index = sink.getvalue().to_pybytes()
        out.write(index)
        out.write(TRAILER.pack(at, len(index), MAGIC))
        out.close()
        return ArchiveMessage(name, sum(p.num_rows for p in parts), at)

    def commit(self, messages: list) -> None:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        archives = [{"name": m.name, "members": m.members, "data_bytes": m.data_bytes} for m in messages if m and m.name]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(archives).encode())

    def abort(self, messages: list) -> None:
        fs, root = _open_fs(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict) -> None:
        self.path = path
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRange]:
        fs, root = _open_fs(self.path)
        ranges = []
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith("_manifest-"):
                with fs.open_input_stream(info.path) as f:
                    for a in json.loads(f.read()):
                        ends = max(a["data_bytes"], 1)
                        ranges += [ByteRange(a["name"], at, min(at + self.range_bytes, ends), a["data_bytes"]) for at in range(0, ends, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def _member(self, fs: pafs.FileSystem, path: str, handle: list, offset: int, length: int, crc: int) -> bytes:
        for attempt in range(self.retries + 1):
            try:
                if handle[0] is None:
                    handle[0] = fs.open_input_file(path)
                raw = handle[0].read_at(length, offset)
                if len(raw) == length and zlib.crc32(raw) == crc:
                    return raw
                raise OSError(f"member at {offset} of {path}: wrong checksum")
            except OSError:
                handle[0] = None
                if attempt == self.retries:
                    raise
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _open_fs(self.path)
        path = f"{root}/{partition.name}"
        handle = [fs.open_input_file(path)]
        size = handle[0].size()
        at, index_bytes, magic = TRAILER.unpack(handle[0].read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or at != partition.data_bytes:
            raise ValueError(f"{path} is no archive of members")
        index = pa.ipc.open_stream(handle[0].read_at(index_bytes, at)).read_all()
        offsets = index["offset"].to_numpy()
        own = np.flatnonzero((offsets >= partition.begin) & (offsets < max(partition.end, partition.begin + 1)))
        if partition.end >= partition.data_bytes:  # empty members may stand at the very end
            own = np.flatnonzero(offsets >= partition.begin)
        lengths, sums, keys = index["length"].to_numpy(), index["crc32"].to_numpy(), index["key"]
        begin = 0
        while begin < len(own):
            end, held = begin, 0
            while end < len(own) and (end == begin or held + lengths[own[end]] <= self.batch_bytes):
                held += lengths[own[end]]
                end += 1
            some = own[begin:end]
            media = [self._member(fs, path, handle, int(offsets[i]), int(lengths[i]), int(sums[i])) for i in some]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)).combine_chunks(), pa.array(media, pa.binary())], names=["key", "media"])
            begin = end


class MemberArchives(DataSource):
    """``format("member_archive")``: rows (key, media); the key's type is an option."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"key {self.options.get('keytype', 'bigint')}, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def store_media(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each row's text as a member of the archive directory ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [to_png((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["key", "media"])

    small_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(MemberArchives)
    kind = docs.schema[id_col].dataType.simpleString()
    media = docs.select(column(id_col).alias("key"), column(text_col).alias("t")).mapInArrow(encode, f"key {kind}, media binary")
    media.write.format(FORMAT).mode("append").option("keytype", kind).save(path)


def read_media(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    spark.dataSource.register(MemberArchives)
    return spark.read.format(FORMAT).option("keytype", key_type).load(path)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of the payloads of (key, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stored in batch.column(1):
                raw = stored.as_py()
                payload, n = from_png(raw)
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(raw), hashlib.sha256(raw).hexdigest(), features(payload)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = media.schema["key"].dataType.simpleString()
    return media.select("key", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return media_features(read_media(spark, path))


QUERIES = {"op5_media_columns": op5_media_columns}
ORACLES: dict[str, str] = {}
