"""Queries on the evaluation report and on tables that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.embed import HashingEmbedder
from corpusloom.functions.frozen import scratch_folder
from corpusloom.functions.tokens import word_count
from corpusloom.operators import search
from corpusloom.sources import corpus

from . import evaluation
from .catalog import register, table
from .engine import Engine
from .queries_search import _LEX_SQL, _METRIC_NAMES, _PAIRS, _TOP_SQL, V, _items, _metric_sql, _queries, lexical_items
from .queries_search import _CARD as CARD
from .queries_search import _RULES as RULES
from .queries_text import quote, sql_words


#: Of the report but for the eigenvalues, which ``pca_geometry`` shows.
_PARTS = [p for p in evaluation.PARTS if p != "geometry"]
_SECTIONS = "['src' || (item_id % 5), 'src' || ((item_id + 1) % 5)]"
_HIT = "list_contains((SELECT sections FROM relevant r WHERE r.query_id = k.query_id), (SELECT source FROM documents d WHERE d.doc_id = k.item_id))"


def _rows_sql(part: str, cells: dict[str, str], source: str, item: str = "''") -> str:
    names, values = ", ".join(map(quote, cells)), ", ".join(f"({v})::DOUBLE" for v in cells.values())
    return f"SELECT '{part}' AS part, {item} AS item, unnest([{names}]) AS metric, unnest([{values}]) AS value, '' AS note FROM {source}"


_NORMS = {"norm_mean": "avg(n)", "norm_std": "stddev_pop(n)", "norm_min": "min(n)", "norm_max": "max(n)", "is_normalized": "bool_and(abs(n - 1) <= 1.1e-4)::INT"}
_WORDS = {"tokens_min": "min(n)", "tokens_max": "max(n)", "tokens_mean": "avg(n)", "tokens_std": "stddev_pop(n)", "short_chunks": "count(*) FILTER (n < 30)"}
_ALIKE = {
    "intra_mean": "avg(s) FILTER (same)", "intra_std": "stddev_pop(s) FILTER (same)", "inter_mean": "avg(s) FILTER (NOT same)", "inter_std": "stddev_pop(s) FILTER (NOT same)",
    "separation_ratio": "(avg(s) FILTER (same)) / (avg(s) FILTER (NOT same))", "cosine_mean": "avg(s)",
}
_NORM_SOURCE = f"(SELECT sqrt(list_dot_product({V}, {V})) AS n FROM embeddings)"
_WORD_SOURCE = f"(SELECT len({sql_words('text')}) AS n FROM documents)"
_PER = {c: f'"{c}"' for c in _METRIC_NAMES} | {"chunk_hit@3": "hit"}
_MEANS = {c: f"avg({v})" for c, v in _PER.items()}
_REPORT_SQL = f"""WITH relevant AS (SELECT item_id AS query_id, {_SECTIONS} AS sections FROM benchmark), {_LEX_SQL}, {_metric_sql(hit=_HIT)}, p AS {_PAIRS},
c AS (SELECT i.item_id AS query_id, CASE WHEN i.item_id % 4 > 0 THEN (EXISTS (SELECT 1 FROM k WHERE k.query_id = i.item_id AND k.rank <= 3 AND k.item_id IN (i.item_id, i.item_id + 1)))::INT END AS hit FROM benchmark i),
per AS (SELECT * FROM m JOIN c USING (query_id)),
e AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
rows_of AS ({_rows_sql("intrinsic", _NORMS, _NORM_SOURCE)}
 UNION ALL {_rows_sql("intrinsic", {"element_mean": "avg(x)", "element_std": "stddev_pop(x)", "element_min": "min(x)", "element_max": "max(x)"}, f"(SELECT unnest({V}) AS x FROM embeddings)")}
 UNION ALL {_rows_sql("intrinsic", {"uniformity_loss": "ln(avg(exp(-2 * d)))"}, "p")}
 UNION ALL {_rows_sql("intrinsic", _WORDS, _WORD_SOURCE)}
 UNION ALL {_rows_sql("coherence", _ALIKE, "p")}
 UNION ALL {_rows_sql("coherence", {"cosine_max": "greatest(max(s), 0)"}, "p")}
 UNION ALL {_rows_sql("section_coherence", {"n_chunks": "n", "avg_sim": "a", "std_sim": "b"}, "(SELECT e.label, e.n, avg(s) AS a, stddev_pop(s) AS b FROM e LEFT JOIN (SELECT * FROM p WHERE same) x ON x.label = e.label GROUP BY ALL)", "label::VARCHAR")}
 UNION ALL {_rows_sql("duplicates", {"n_duplicates": "count(*) FILTER (s >= 0.3)", "n_pairs": "count(*)"}, "p")}
 UNION ALL {_rows_sql("retrieval", _MEANS, "per")}
 UNION ALL {_rows_sql("retrieval_per_query", _PER, "per", "query_id::VARCHAR")}
 UNION ALL {_rows_sql("coverage", {"total": "count(*)", "main": "count(*) FILTER (NOT starts_with(source, 'Referensi'))", "reference": "count(*) FILTER (starts_with(source, 'Referensi'))", "sections": "count(DISTINCT source)"}, "documents")}
 UNION ALL {_rows_sql("coverage_sections", {"n_chunks": "n"}, "(SELECT source, count(*) AS n FROM documents GROUP BY source)", "source")}),
cards AS (SELECT CASE metric WHEN 'is_normalized' THEN 'Normalisasi L2' WHEN 'uniformity_loss' THEN 'Uniformity Loss' WHEN 'separation_ratio' THEN 'Separation Ratio' WHEN 'P@3' THEN 'Precision@3' ELSE metric END AS metric, CASE WHEN metric = 'uniformity_loss' THEN -value ELSE value END AS value FROM rows_of WHERE part IN ('intrinsic', 'coherence', 'retrieval')),
whole AS (SELECT * FROM rows_of
 UNION ALL SELECT 'scorecard', '', metric, value, CASE WHEN value >= good THEN 'BAIK' WHEN value >= fair THEN 'CUKUP' ELSE 'PERLU PERHATIAN' END FROM cards JOIN (VALUES {CARD}) t(metric, good, fair) USING (metric)
 UNION ALL SELECT 'recommendations', '', metric, value, priority FROM rows_of JOIN (VALUES {RULES}) t(metric, op, bound, priority) USING (metric) WHERE part IN ('intrinsic', 'coherence', 'duplicates', 'retrieval') AND CASE WHEN op = '>' THEN value > bound ELSE value < bound END)"""


def _report(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("section"))
    items = lexical_items(spark, d)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    q = F.col("query_id")
    sections = F.array(*[F.concat(F.lit("src"), ((q + k) % 5).cast("string")) for k in (0, 1)])
    relevant = asked.select("query_id", sections.alias("sections"), F.when(q % 4 > 0, F.array(q, q + 1)).alias("ids"))
    return evaluation.evaluate(vectors, items, asked, relevant, id_col="vec_id", parts=_PARTS, duplicate=0.3)


@register("evaluation_report", f"{_REPORT_SQL} SELECT part, item, metric, round(value, 6) AS value, note FROM whole")
def evaluation_report(spark, d):
    return _report(spark, d).withColumn("value", F.round("value", 6))


@register("evaluation_lines", f"{_REPORT_SQL} SELECT part, row_number() OVER (PARTITION BY part ORDER BY item, metric) AS no, CASE WHEN item <> '' THEN item || ' ' ELSE '' END || metric || ' = ' || coalesce(printf('%.3f', round(value, 6)), '-') || CASE WHEN note <> '' THEN ' [' || note || ']' ELSE '' END AS line FROM whole WHERE part IN ('coverage', 'coverage_sections', 'scorecard', 'recommendations', 'duplicates')")
def evaluation_lines(spark, d):
    some = _report(spark, d).filter(F.col("part").isin("coverage", "coverage_sections", "scorecard", "recommendations", "duplicates"))
    return evaluation.report_lines(some.withColumn("value", F.round("value", 6)), digits=3)


@register("chunk_table", f"SELECT d.doc_id::VARCHAR AS chunk_id, d.text, d.source AS section, len({sql_words('d.text')}) AS token_count, (SELECT count(*) FROM documents) AS total_chunks, 200::BIGINT AS chunk_size_target FROM documents d", longs=("token_count", "total_chunks", "chunk_size_target"))
def chunk_table(spark, d):
    """Chunks and their manifest, written and read again."""
    path = scratch_folder(spark, "chunks")
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("section"), word_count(F.col("text")).alias("token_count"))
    corpus.write_chunks(chunks, path, settings={"chunk_size_target": 200})
    return corpus.read_chunks(spark, path).crossJoin(F.broadcast(corpus.read_manifest(spark, path)))  # one row


@register("vector_table", f"SELECT vec_id::VARCHAR AS chunk_id, pos, x FROM (SELECT vec_id, unnest({V}) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)", longs=("pos",))
def vector_table(spark, d):
    """Vectors, written beside their chunks and read again without them."""
    path = scratch_folder(spark, "vectors")
    corpus.write_vectors(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label"), path, model="given")
    return corpus.read_vectors(spark, path, precision="double").select("chunk_id", F.posexplode("embedding").alias("pos", "x"))


@register("chunk_lookup", "SELECT doc_id % 50 AS chunk_id, min(doc_id) AS ordinal, arg_max(source, doc_id) AS source FROM documents GROUP BY 1")
def chunk_lookup(spark, d):
    """The last chunk of each id, at the first one's place."""
    return corpus.chunk_map(table(spark, d, "documents").select((F.col("doc_id") % 50).alias("chunk_id"), F.col("doc_id").alias("ordinal"), "source"))


@register("index_search", f"SELECT query_id, item_id::VARCHAR AS item_id, round(score, 6) AS score, rank FROM ({_TOP_SQL % 5})", longs=("rank",))
def index_search(spark, d):
    """An index, saved, loaded and searched."""
    path = scratch_folder(spark, "index")
    Engine(_items(spark, d).withColumnRenamed("item_id", "chunk_id").withColumn("ordinal", F.col("chunk_id")), HashingEmbedder(64)).save(path)
    chunks = Engine.load(spark, path, HashingEmbedder(64)).chunks
    hits = search.vector_topk(_queries(spark, d), chunks, 5, item_id="chunk_id")
    return hits.select("query_id", F.col("chunk_id").cast("string").alias("item_id"), F.round("score", 6).alias("score"), "rank")
