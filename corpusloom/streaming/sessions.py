"""Chat sessions as state: counters, last latency, clearing and greeting, kept over a stream.

Events are (conv_id, epoch, turn, kind, elapsed): ``kind`` is ``open``, ``user``,
``assistant`` or ``clear``; ``epoch`` counts the clearings of a session so far, that of a
``clear`` is the one it begins; ``elapsed`` is the seconds a response took, null or empty
for one that failed. A turn comes once. Events without conv_id, epoch, turn or a known kind
are left out.

The state is one row for each (conv_id, epoch): counters, and the last time with its turn. They
add up in any order, and the last epoch of a session is what stands. So late and unordered
events give the same result as one batch. Rows of a key are added before they are shuffled, so a
session that holds most events is no burden to one task. States of epochs gone by are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.operators.session import NO_TIME, STATUS

KINDS = ("open", "user", "assistant", "clear")
EVENTS = "conv_id long, epoch long, turn long, kind string, elapsed string"
STATE = "n_questions long, n_responses long, timed long, last_time string"
PARTIAL = f"conv_id long, epoch long, {STATE}"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counted(events: DataFrame) -> DataFrame:
    """The state of each (conv_id, epoch) of the events that count; ``timed`` is the turn of the
    last response with a time."""
    kind = F.col("kind")
    some = events.filter(F.col("conv_id").isNotNull() & F.col("epoch").isNotNull() & F.col("turn").isNotNull() & kind.isin(*KINDS))
    timed = F.when((kind == "assistant") & (F.coalesce("elapsed", F.lit("")) != ""), F.col("turn"))
    return some.withColumn("timed", timed).groupBy("conv_id", "epoch").agg(
        F.count_if(kind == "user").alias("n_questions"), F.count_if(kind == "assistant").alias("n_responses"),
        F.max("timed").alias("timed"), F.max_by("elapsed", "timed").alias("last_time"),
    )


def shown(states: DataFrame, connected: Column) -> DataFrame:
    """(conv_id, epoch, n_questions, n_responses, last_time, greet, status) of states, the
    last epoch of each session: ``greet`` is whether the session stands without a turn, so that it begins with a greeting."""
    columns = [c.split()[0] for c in STATE.split(", ")]
    last = states.groupBy("conv_id").agg(F.max_by(F.struct("epoch", *columns), "epoch").alias("s"))
    none = F.col("n_questions") + F.col("n_responses") == 0
    return last.select("conv_id", "s.*").select("conv_id", "epoch", "n_questions", "n_responses", F.coalesce("last_time", F.lit(NO_TIME)).alias("last_time"), none.alias("greet"), F.when(connected, STATUS[0]).otherwise(STATUS[1]).alias("status"))


def batch_states(events: DataFrame) -> DataFrame:
    """The states of all ``events`` at once: what the stream comes to."""
    return counted(events)


def session_stream(events: DataFrame) -> DataFrame:
    """The states that a stream of events changes, by Spark's own aggregation over a stream;
    with RocksDB (``PROVIDER``) as its state store they needn't fit into memory."""
    return counted(events)


def follow(spark: SparkSession, source: str, out: str, checkpoint: str, *, files: int = 1000) -> StreamingQuery:
    """Take the events (Parquet) that have come under ``source`` since the last call and
    write the states they change under ``out``, a folder for each micro-batch; one run again
    writes its own folder again."""

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(source)
        return session_stream(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def states(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each (conv_id, epoch), of what ``follow`` has written."""
    rows = spark.read.schema(f"{PARTIAL}, batch long").parquet(out)
    columns = [c.split()[0] for c in STATE.split(", ")]
    last = rows.groupBy("conv_id", "epoch").agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return last.select("conv_id", "epoch", "s.*")
