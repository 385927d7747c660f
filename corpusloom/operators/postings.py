"""Inverted index and boolean lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.frozen import frozen

#: Documents, by span of integral id, to a list of an index block.
ID_SPAN = 100_000
#: Folders of a stored index, by the hash of a term.
BUCKETS = 32
STORED = "term string, block long, least long, most long, doc_ids array<bigint>, batch long, bucket int"


def add_documents(index: DataFrame, new: DataFrame) -> DataFrame:
    """Documents are lower-cased when they enter."""
    return index.unionByName(new.withColumn("text", F.lower("text")))


def list_documents(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Documents numbered from 1: ranks in range partitions plus the rows before them."""
    ranged = frozen(docs.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()))
    starts = ranged.groupBy(F.shiftright("__at", 33).alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    starts = starts.withColumn("__before", F.expr("coalesce(sum(__n) over (order by __p rows between unbounded preceding and 1 preceding), 0)"))
    return ranged.withColumn("__p", F.shiftright("__at", 33)).join(F.broadcast(starts), "__p").withColumn("no", (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("long")).drop("__p", "__at", "__n", "__first", "__before")


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id), terms between single spaces, repeated ones kept."""
    return docs.select(F.explode(F.split(F.lower("text"), " ", -1)).alias("term"), "doc_id")


def sorted_postings(docs: DataFrame) -> DataFrame:
    return postings(docs).orderBy("term", "doc_id")


def index_blocks(docs: DataFrame, span: int = ID_SPAN) -> DataFrame:
    """(term, block, doc_ids): sorted ids (integral) of the documents with a term, a list for
    each span of ids, so that a term in all documents is many lists of bounded length."""
    terms = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), " ", -1))).alias("term"), F.floor(F.col("doc_id") / span).alias("block"), "doc_id")
    return terms.groupBy("term", "block").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def inverted_index(docs: DataFrame) -> DataFrame:
    """(term, doc_ids), the blocks of each term joined. Such a list is as long as its term's
    document count: for corpora beyond a task's memory use ``index_blocks``, or look terms
    up as ``boolean_and`` does."""
    blocks = F.array_sort(F.collect_list(F.struct("block", "doc_ids")))
    return index_blocks(docs).groupBy("term").agg(F.flatten(F.transform(blocks, lambda b: b["doc_ids"])).alias("doc_ids"))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def boolean_and(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Documents with both terms; none if either term is unknown. No list is built:
    terms are looked up in each document where it lies."""
    terms = F.split(F.lower("text"), " ", -1)
    return docs.filter(F.array_contains(terms, first.lower()) & F.array_contains(terms, second.lower())).select("doc_id").distinct()


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, *, batch: int = 0, buckets: int = BUCKETS, span: int = ID_SPAN) -> None:
    """Store the blocks of ``docs`` with their least and greatest ids, by batch and bucket.

    A batch written again takes the place of its folders, so a replay changes nothing;
    rows without an id have no place in an index. A bucket that hot terms fill is split
    over several tasks."""
    blocks = index_blocks(docs.filter(F.col("doc_id").isNotNull()), span).filter(F.col("term").isNotNull())
    ids = F.col("doc_ids").cast("array<bigint>")
    rows = blocks.select("term", F.col("block").cast("long").alias("block"), F.array_min(ids).alias("least"), F.array_max(ids).alias("most"), ids.alias("doc_ids"), F.lit(batch).cast("long").alias("batch"), _bucket(F.col("term"), buckets).alias("bucket"))
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)


def _merged(blocks: DataFrame) -> DataFrame:
    """One list for a term and block, whatever the batches that hold some of it."""
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_ids"))))
    return blocks.groupBy("term", "block").agg(ids.alias("doc_ids"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, block, doc_ids) of a stored index."""
    return _merged(spark.read.schema(STORED).parquet(path))


def lookup(spark: SparkSession, path: str, terms: list[str], *, buckets: int = BUCKETS) -> DataFrame:
    """Documents that hold all ``terms``, by a stored index: only the folders of the terms'
    buckets are read, and in them the row groups that may hold a term; lists meet block by
    block, after blocks whose spans of ids don't meet are gone."""
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        raise ValueError("no terms")
    stored = spark.read.schema(STORED).parquet(path)
    stored = stored.filter(F.col("bucket").isin([_bucket(F.lit(t), buckets) for t in wanted]) & F.col("term").isin(wanted))
    spans = stored.groupBy("term", "block").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list("doc_ids").alias("lists"))
    met = spans.groupBy("block").agg(F.count("*").alias("n"), F.max("least").alias("low"), F.min("most").alias("high"), F.collect_list(F.flatten("lists")).alias("lists"))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.array_distinct(F.get("lists", F.lit(0))), F.array_intersect)
    return met.filter((F.col("n") == len(wanted)) & (F.col("low") <= F.col("high"))).select(F.explode(both).alias("doc_id"))
