r"""Lines that many documents share are dropped everywhere but in one document.

Lines are exploded and normalised, their keys hashed (128 bits), documents counted
per hash, and what is left is reassembled by position.

A line's key is the line stripped of ``[\x20\x09-\x0D]`` at both ends with A-Z
lower-cased. Defined results: null and empty texts are one empty line; a null
doc_id is no document, so it is neither counted nor kept; rows that repeat a
doc_id are one document to the counts and a result row each; ties don't arise, as the
largest doc_id keeps a line, at all of its places; lines and texts of any length are
taken whole; an empty table gives an empty result. Other columns pass through
``dedup_lines`` untouched, whatever their names, but for ``n_lines`` and ``n_dropped``,
which the result's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import column, drop_scratch, materialize, packed
from .skew import heavy_keys, spread_join

MIN_CHARS, MIN_DOCS = 40, 5
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` reassembled from the kept lines, and the columns
    ``n_lines`` and ``n_dropped``.

    Texts are split and hashed once; what is exchanged are hashes, ids and positions of
    lines, never texts. Counting combines on the map side, and a line in a third of all
    documents is joined in many parts. Only the last join moves texts, once.
    """
    taken = (id_col, text_col, "n_lines", "n_dropped")
    keys = ["h1", "h2"]
    base = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"), packed(docs, *taken).alias("rest"))
    lines = base.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars)
    lines = materialize(lines.select("id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines")
    tie = F.xxhash64("id", "th", "pos")
    # Rows are at least as many as documents, so no key that counts is lost here.
    often = materialize(lines.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs), "often")
    hits = materialize(spread_join(lines, often.select(*keys), keys, heavy_keys(often, keys, "n"), tie), "hits")
    drop_scratch(lines, often)
    holders = hits.groupBy(*keys, "id").agg(F.count("*").alias("n"))
    shared = holders.groupBy(*keys).agg(F.count("id").alias("holders"), F.max("id").alias("keeper"), F.sum("n").alias("n"))
    shared = materialize(shared.filter(F.col("holders") >= min_docs).select(*keys, "keeper", "n"), "shared")
    lost = spread_join(hits, shared.select(*keys, "keeper"), keys, heavy_keys(shared, keys, "n"), tie).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    # Written, so that the last join is one of plain exchanges, whose skew Spark splits by itself.
    lost = materialize(lost.groupBy("id", "th").agg(F.collect_set("pos").alias("lost")).withColumnsRenamed({"id": "lid", "th": "lth"}), "lost")
    drop_scratch(hits, shared)
    # The lines are split before the exchange: an expression over them there can't be evaluated once per line.
    whole = base.select("id", "rest", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    joined = whole.join(lost, F.col("id").eqNullSafe(F.col("lid")) & (F.col("th") == F.col("lth")), "left")
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("lost", F.array().cast("array<int>")))
    kept = F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    own = {id_col: F.col("id"), text_col: kept}
    columns = [own[c].alias(c) if c in own else F.col("rest")[c].alias(c) for c in docs.columns if c not in taken[2:]]
    return joined.select(*columns, n.cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> doc_id AS lost FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": ORACLE}
