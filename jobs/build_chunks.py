"""Batch job: the chunk table of a corpus, and what is in it.

    python -m jobs.build_chunks jobs/build_chunks.json [name=value ...]

Documents (doc_id, text, source) are cleaned, normalised, cut into overlapping chunks and
tagged; the chunks are written by source, with statistics of each source beside them. A
whole run replaces the table. A run over some ``sources`` replaces those alone and leaves
the others as they are. Either way, a run repeated over the same documents gives the same
table, and one that died is mended by the next.

A document without a source goes to the part ``none``; one with a null text has no chunks.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.engine import ingest
from jobs.settings import session, settings

log = logging.getLogger("jobs.build_chunks")

NONE = "none"
COLUMNS = "doc_id long, source string, chunk_id string, chunk_no int, section string, subsection string, text string, char_start int, char_end int, token_count int, keywords array<string>, has_numbers boolean, has_list boolean, location string, part string"
STATISTICS = "n_chunks long, avg_tokens double, min_tokens int, max_tokens int, avg_chars double, total_chars long, n_documents long, n_tagged long, part string"


def run(spark: SparkSession, documents: str, out: str, *, sources: Sequence[str] = (), size: int = 200, overlap: int = 50, least: int = 50) -> dict[str, int]:
    """Write ``out``/chunks and ``out``/statistics; how many documents were read and
    chunks written."""
    part = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit(NONE))
    docs = spark.read.parquet(documents).select("doc_id", "text", "source")
    if sources:
        docs = docs.filter(part.isin(list(sources)))
    n_read = docs.count()
    log.info("read %d documents of %s", n_read, documents)

    chunks = ingest(docs, source_col="source", size=size, overlap=overlap, least=least).withColumnRenamed("source_file", "source")
    rows = chunks.select("doc_id", "source", "chunk_id", "chunk_no", "section", "subsection", "text", "char_start", "char_end", "token_count", "keywords", *[F.col(f"metadata.{c}").alias(c) for c in ("has_numbers", "has_list", "location")], part.alias("part"))
    overwrite = "dynamic" if sources else "static"
    # sources of any size: large ones are split over several tasks, small ones share one
    rows.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy("part").parquet(f"{out}/chunks")

    written = read_chunks(spark, out)
    written = written.filter(F.col("part").isin(list(sources))) if sources else written
    whole = statistics(written)
    whole.write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy("part").parquet(f"{out}/statistics")
    counts = {r["part"]: r["n_chunks"] for r in read_statistics(spark, out).select("part", "n_chunks").orderBy(F.desc("n_chunks")).limit(20).collect()}
    n_written = written.count()
    log.info("wrote %d chunks to %s/chunks; largest parts: %s", n_written, out, counts)
    return {"documents": n_read, "chunks": n_written}


def statistics(chunks: DataFrame) -> DataFrame:
    """Chunk statistics of each part."""
    n, length = F.col("token_count"), F.length("text")
    return chunks.groupBy("part").agg(
        F.count("*").alias("n_chunks"), F.avg(n).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(length).alias("avg_chars"),
        F.sum(length).cast("long").alias("total_chars"), F.count_distinct("doc_id").alias("n_documents"), F.count_if(F.size("keywords") > 0).alias("n_tagged"),
    )


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(f"{out}/chunks")


def read_statistics(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(STATISTICS).parquet(f"{out}/statistics")


def main(args: list[str]) -> None:
    with session("build_chunks") as spark:
        run(spark, **settings(args))


if __name__ == "__main__":
    main(sys.argv[1:])
