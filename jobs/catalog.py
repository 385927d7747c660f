"""The jobs as queries: run twice into one new folder, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.frozen import shared_folder
from corpusloom.operators.postings import ID_SPAN
from corpusloom.plans.queries_text import CORPUS_CHUNKS_SQL

from . import build_chunks, update_index


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_build_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "chunks")
    for _ in range(2):
        build_chunks.run(spark, f"{sf_dir}/documents.parquet", out)
    long = [F.col(c).cast("long").alias(c) for c in ("chunk_no", "char_start", "char_end", "token_count")]
    return build_chunks.read_chunks(spark, out).select("doc_id", "source", "part", "chunk_id", "section", "subsection", "text", *long, F.array_join("keywords", ",").alias("keywords"), "has_numbers", "has_list", "location")


def job2_update_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "index")
    for _ in range(2):
        # a stream reads a folder or a pattern: this one fits the table as a file and as a folder
        update_index.run(spark, f"{sf_dir}/documents.parque[t]", out, f"{out}/checkpoint")
    return update_index.read_index(spark, out).select("term", "block", F.size("doc_ids").cast("long").alias("n"), F.array_join("doc_ids", ",").alias("doc_ids"))


QUERIES = {"job1_build_chunks": job1_build_chunks, "job2_update_index": job2_update_index}
ORACLES = {
    "job1_build_chunks": CORPUS_CHUNKS_SQL,
    "job2_update_index": f"SELECT term, doc_id // {ID_SPAN} AS block, count(DISTINCT doc_id) AS n, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS doc_ids FROM (SELECT unnest(string_split(lower(text), ' ')) AS term, doc_id FROM documents WHERE doc_id IS NOT NULL) GROUP BY 1, 2",
}
