"""Readers and writers of corpora, references, chunks and vectors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import npz

REFERENCE = "references array<struct<id:string,judul:string,tahun:string,penulis:array<string>,kategori:string,ringkasan:string,poin_kunci:array<string>,relevansi_topik:array<string>,doi:string,url:string>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text): each file whole; a missing path is an error."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """One row a reference; a missing file gives no rows."""
    try:
        raw = spark.read.schema(REFERENCE).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], REFERENCE)
    return raw.select(F.explode("references").alias("r")).select("r.*")


def write_chunks(chunks: DataFrame, path: str, *, settings: dict | None = None, mode: str = "overwrite") -> None:
    """The chunks as Parquet, and beside them a manifest of one row."""
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    spark = chunks.sparkSession
    manifest = spark.read.parquet(f"{path}/chunks").agg(F.count("*").alias("total_chunks"))
    for k, v in (settings or {}).items():
        manifest = manifest.withColumn(k, F.lit(v))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def write_vectors(chunks: DataFrame, path: str, *, model: str, mode: str = "overwrite") -> None:
    """Chunks with their vectors in one table: readers prune the columns they don't need."""
    chunks.withColumn("embedding_dim", F.size("embedding")).withColumn("embedding_model", F.lit(model)).write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str, *, precision: str = "float") -> DataFrame:
    """(chunk_id, embedding), and nothing else of the file."""
    return spark.read.parquet(path).select("chunk_id", F.col("embedding").cast(f"array<{precision}>").alias("embedding"))


def chunk_map(chunks: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row a chunk_id: the last one's columns, at the first one's place."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", order)]
    return chunks.groupBy("chunk_id").agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("r")).select("chunk_id", order, "r.*")


def read_chunk_file(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a JSON file with a list ``chunks``; without one no rows."""
    raw = spark.read.json(path, multiLine=True)
    if "chunks" not in raw.columns:
        return spark.createDataFrame([], "chunk_id string, text string, section string, keywords array<string>")
    return raw.select(F.explode("chunks").alias("c")).select("c.*")


def read_npz(spark: SparkSession, path: str, *, vectors: str = "embeddings", ids: str = "chunk_ids") -> DataFrame:
    """(chunk_id, ordinal, embedding) of NumPy archives that hold a matrix and its row ids:
    by ranges of rows where the path's scheme is one that Arrow opens, and else a file to a
    task, whose rows leave in batches."""
    try:
        npz.file_system(path)
    except pa.ArrowInvalid:
        return _read_npz_whole(spark, path, vectors, ids)
    return npz.read_rows(spark, path, vectors=vectors, ids=ids)


def _read_npz_whole(spark: SparkSession, path: str, vectors: str, ids: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                with np.load(io.BytesIO(raw.as_py()), allow_pickle=False) as held:
                    x, names = held[vectors].astype(np.float64), held[ids].astype(str)
                for at in range(0, len(x), 4096):
                    some = x[at : at + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * x.shape[1]), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 4096].tolist(), pa.string()), pa.array(np.arange(at, at + len(some))), lists], names=["chunk_id", "ordinal", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "chunk_id string, ordinal long, embedding array<double>")


REPORT = "part string, item string, metric string, value double, note string"


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows (part, item, metric, value, note) as JSON lines."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)
