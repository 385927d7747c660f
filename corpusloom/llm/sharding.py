"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a pseudo-random number from (key, shard) alone; the record goes
to the shard whose weighted draw is largest. A further shard can only win records
for itself, so it moves about 1/(n+1) of them and no others.

Defined results: a null key counts as the empty string; a null text is empty;
repeated rows each get a slot of their own; equal draws go to the lower shard
number; texts of any length are digested whole; an empty table gives an empty result.
``shard_records`` passes other columns through, whatever their names, but for ``shard``,
``grown_shard`` and ``slot``, which the result's own replace; the query ignores them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import column, materialize, packed, unpacked

SHARDS = 24
#: Hex digits of each draw: 52 bits, which a double holds exactly.
DIGITS = 13


def _draw(key: Column, shard: int) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, DIGITS), 16, 10).cast("double")
    return (bits + 0.5) / float(16**DIGITS)


def _score(key: Column, shard: int, weight: float) -> Column:
    return F.struct((F.lit(-float(weight)) / F.ln(_draw(key, shard))).alias("score"), F.lit(-shard).alias("order"))


def _best(key: Column, weights: Sequence[float]) -> Column:
    """(score, minus the shard) of the largest draw."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [_score(key, s, w) for s, w in enumerate(weights)]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a string key: largest ``weight / -ln(draw)``."""
    return (-_best(key, weights)["order"]).cast("int")


def shard_records(df: DataFrame, key: str, weights: Sequence[float], *, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one more shard of the mean
    weight, which takes one draw more) and ``slot``, gapless from 0 in each shard, by the
    key's digest.

    Slots come from one range exchange, whose last key is the row's own number,
    so that even a key that holds a third of all rows is split over tasks; what
    is gathered besides is a row for each task and shard.
    """
    taken = ("shard", "grown_shard", "slot")
    text_key = F.coalesce(column(key).cast("string"), F.lit(""))
    rows = df.select(packed(df, *taken).alias("row"), text_key.alias("key"), F.md5(text_key).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.withColumn("best", _best(F.col("key"), weights))
    grown = F.greatest("best", _score(F.col("key"), len(weights), sum(weights) / len(weights)))
    placed = rows.select("row", "digest", "tie", (-F.col("best")["order"]).cast("int").alias("shard"), (-grown["order"]).cast("int").alias("grown_shard"))
    by = ["shard", "digest", F.col("row")[key], *[F.col("row")[c] for c in order], "tie"]
    placed = placed.repartitionByRange(*by).sortWithinPartitions(*by).select("row", "shard", "grown_shard", F.monotonically_increasing_id().alias("at"))
    placed = materialize(placed, "shards")
    spans = placed.groupBy("shard", F.shiftright("at", 33).alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("shard", "task", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = placed.withColumn("task", F.shiftright("at", 33)).join(spans, ["shard", "task"])
    return joined.select(*unpacked(df, "row", *taken), "shard", "grown_shard", (F.col("at") - F.col("first") + F.col("before")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of equal weight."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_records(rows, "doc_id", [1.0] * SHARDS, order=["text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _crc_step() -> str:
    step = "xor(a, x)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda c: xor(c >> 1, (c & 1) * 3988292384))[1]"
    return step


def _sql_shard(n: int) -> str:
    draws = ", ".join(f"{{'score': -1.0 / ln((('0x' || substr(md5(k || '/{s}'), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {16**DIGITS}.0), 'o': -{s}}}" for s in range(n))
    return f"(-list_max([{draws}]).o)::INT"


ORACLE = f"""
WITH k AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, (strlen(t) + 8)::BIGINT AS size, hex(encode(t)) AS h, {_sql_shard(SHARDS)} AS shard, {_sql_shard(SHARDS + 1)} AS grown_shard, md5(k) AS d FROM k),
c AS (SELECT *, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, x: {_crc_step()}, 4294967295::BIGINT), 4294967295) AS text_crc32 FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY d, doc_id, text_crc32) - 1 AS slot, grown_shard FROM c
"""

QUERIES = {"op10_sharding": op10_sharding}
ORACLES = {"op10_sharding": ORACLE}
