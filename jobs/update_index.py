"""Incremental job: a term index that takes the documents that have arrived.

    python -m jobs.update_index jobs/update_index.json [name=value ...]

The files of ``documents``, a folder or a pattern, are a stream that ends when all present ones are read; the
checkpoint remembers them, so a run takes only what has come since the last one. Each
batch of files is a batch of the index, by terms' buckets, and a row of ``out``/batches: a
batch that is run again after a failure replaces its own folders. The index is one of sets:
a document that comes again adds the terms it has now, and none is forgotten. Rows
without an id are counted and left out.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import postings
from jobs.settings import session, settings

log = logging.getLogger("jobs.update_index")

DOCUMENTS = "doc_id long, text string"
BATCHES = "n_documents long, n_without_id long, least_id long, most_id long, batch long"


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, *, files_per_batch: int = 1000, buckets: int = postings.BUCKETS) -> dict[str, int]:
    """Bring ``out``/index up to date and wait for the stream's end; batches and documents
    taken by this run."""
    taken = {"batches": 0, "documents": 0}

    def store(docs: DataFrame, batch: int) -> None:
        docs = docs.persist()
        try:
            postings.write_index(docs, f"{out}/index", batch=batch, buckets=buckets)
            counts = docs.agg(F.count("doc_id").alias("n_documents"), F.count_if(F.col("doc_id").isNull()).alias("n_without_id"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"))
            counts.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/batches")
        finally:
            docs.unpersist()
        row = read_batches(docs.sparkSession, out).filter(F.col("batch") == batch).first()
        log.info("batch %d: indexed documents %s to %s, %d in all; %d without an id left out", batch, row["least_id"], row["most_id"], row["n_documents"], row["n_without_id"])
        taken["batches"] += 1
        taken["documents"] += row["n_documents"]

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("took %d documents of %s in %d batches into %s", taken["documents"], documents, taken["batches"], out)
    return taken


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """(term, block, doc_ids), over all batches."""
    return postings.read_index(spark, f"{out}/index")


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(BATCHES).parquet(f"{out}/batches")


def main(args: list[str]) -> None:
    with session("update_index") as spark:
        run(spark, **settings(args))


if __name__ == "__main__":
    main(sys.argv[1:])
