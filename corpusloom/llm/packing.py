"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Documents are tokenised, ended by a separator, and cut only where longer than a
sequence. A piece then goes to the open sequence (or to a new one) that makes the
sum, over gaps, of the squared number of open sequences with that gap smallest:
no gap becomes common, so that most pieces find one that they fill exactly.

Defined results: a null or empty text is the separator alone; a null doc_id passes
through; repeated rows are packed as rows of their own; an empty table gives an
empty result; ties between gaps go to the smallest, those between pieces of a length
to the lesser hash of their keys; a text of any length is tokenised and cut whole.
Columns of ``docs`` other than the id and the text are ignored; ``pack`` passes those
of its pieces through, whatever their names, but for ``sequence_id`` and ``offset``,
which the result's own replace.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import column, packed, small_batches, unpacked
from .words import MOST, tokenizer

CAPACITY, SEPARATOR = 2048, 0
TEXTS_AT_ONCE = 256
#: Documents to a packing task: its few unfilled sequences are then a share of some 1e-3.
DOCS_PER_TASK = 250_000


def tokenize(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False, kept_words: int = MOST) -> DataFrame:
    """A row for each piece: the id, piece, start, length, ids_crc32 and, if
    asked for, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path, kept_words).encode_many, np.uint32(separator).astype("<u4").tobytes()
        step = capacity * 4
        for batch in batches:
            row, number, sums, kept, sizes = [], [], [], [], []
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                texts = [t.as_py() or "" for t in batch.column(1)[k : k + TEXTS_AT_ONCE]]
                for i, ids in enumerate(encode(texts), k):
                    ids += end
                    for at in range(0, len(ids), step):
                        part = ids[at : at + step]
                        row.append(i)
                        number.append(at // step)
                        sizes.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part)
            numbers = np.array(number, np.int64)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(numbers, pa.int32()), pa.array(numbers * capacity), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if keep_ids else [])], names=names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if keep_ids:
        schema = schema.add("ids", T.BinaryType())
    names = schema.names
    return docs.select(column(id_col).alias("k"), column(text_col).alias("t")).mapInArrow(run, schema)


class SumOfSquares:
    """Open sequences by gap; ``place`` gives (sequence number, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # of open sequences with each gap; 0 and capacity stay empty
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> tuple[int, int]:
        if not 0 < size <= self.capacity:
            raise ValueError(f"a piece of {size} in sequences of {self.capacity}")
        best, gap = (2 * self.count[self.capacity - size] + 1 if size < self.capacity else 0), self.capacity
        if size < self.capacity:
            now = self.count[size : self.capacity]
            some = np.flatnonzero(now)
            if len(some):
                change = 2 * (self.count[some] - now[some]) + 2  # count[0] is always 0
                if some[0] == 0:
                    change[0] -= 1  # a filled sequence is open no more
                at = int(np.argmin(change))
                if change[at] <= best:
                    gap = int(some[at]) + size
        if gap == self.capacity:
            number, self.made = self.made, self.made + 1
        else:
            number = self.open[gap].pop()
            self.count[gap] -= 1
        if left := gap - size:
            self.open.setdefault(left, []).append(number)
            self.count[left] += 1
        return number, self.capacity - gap


def pack(pieces: DataFrame, tasks: int, *, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Rows without their ids are dealt by the hash of their keys and row number and
    packed, longest first, task by task in one streaming pass: what a task holds is
    one counter a gap and the numbers of its open sequences, never a group of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = SumOfSquares(capacity), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [packer.place(n) for n in batch.column(1).to_pylist()]
            number, at = pa.array([base + n for n, _ in placed], pa.int64()), pa.array([a for _, a in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), number, at], names=["row", "length", "sequence_id", "offset"])

    taken = ("sequence_id", "offset")
    rows = pieces.select(packed(pieces, *taken).alias("row"), column(length_col).cast("int").alias("length"))
    mixed = F.xxhash64(*[F.col("row")[c] for c in key_cols], "length")
    dealt = rows.withColumns({"mix": mixed, "tie": F.monotonically_increasing_id()}).repartition(tasks, "mix", "tie").sortWithinPartitions(F.desc("length"), "mix", "tie").drop("mix", "tie")
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema).select(*unpacked(pieces, "row", *taken), *taken)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, joined in place; needs pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))


def pack_documents(docs: DataFrame, path: str, *, docs_per_task: int = DOCS_PER_TASK, kept_words: int = MOST) -> DataFrame:
    """A row for each piece, with its sequence and place there, by the ``doc_id`` and ``text``
    of ``docs`` alone. ``kept_words`` bounds the word tables of a Python worker; fewer cost time alone."""
    small_batches(docs.sparkSession)
    tasks = max(1, math.ceil(docs.count() / docs_per_task))
    return pack(tokenize(docs, path, kept_words=kept_words), tasks)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLES: dict[str, str] = {}
