"""Queries on vectors, retrieval, ranking metrics, routing and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import embed, vectors
from corpusloom.functions.frozen import scratch_folder
from corpusloom.operators import answer, cells, metrics, present, ranking, search, session

from .catalog import register, table
from .engine import Engine
from .queries_text import quote, sql_words

V = "embedding::DOUBLE[]"
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_PAIRS = f"(SELECT a.label = b.label AS same, a.label AS label, a.vec_id AS a, b.vec_id AS b, {_DOT} AS s, list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) + list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 2 * {_DOT} AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
_TOP_SQL = f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id %% 20 = 0 QUALIFY rank <= %d"


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _queries(spark, d):
    return table(spark, d, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _items(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


@register("vector_topk", f"SELECT query_id, item_id, round(score, 6) AS score, rank FROM ({_TOP_SQL % 10})", longs=("rank",))
def vector_topk(spark, d):
    return _round(search.vector_topk(_queries(spark, d), _items(spark, d), 10), "score")


@register("vector_topk_threshold", f"SELECT query_id, item_id, round(score, 6) AS score, rank FROM ({_TOP_SQL % 10}) WHERE score >= 0.15", longs=("rank",))
def vector_topk_threshold(spark, d):
    return _round(search.with_threshold(search.vector_topk(_queries(spark, d), _items(spark, d), 10)), "score")


@register("cosine_scores", "SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(" + _DOT + ", 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0")
def cosine_scores(spark, d):
    return search.stored_scores(_queries(spark, d), _items(spark, d), 6)


@register("l2_normalize", f"SELECT vec_id, pos, round(x / n, 6) AS x FROM (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos, greatest(sqrt(list_dot_product(e, e)), 1e-9) AS n FROM (SELECT vec_id, list_transform({V}, lambda x: x * 3.0) AS e FROM embeddings))", longs=("pos",))
def l2_normalize(spark, d):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3.0)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(tripled)).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


@register("mean_pool_by_label", f"SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest({V}) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos", longs=("pos",))
def mean_pool_by_label(spark, d):
    pooled = embed.mean_pool(table(spark, d, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@register("norm_stats", f"SELECT round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max, bool_and(abs(n - 1) <= 1.1e-4) AS is_normalized FROM (SELECT sqrt(list_dot_product({V}, {V})) AS n FROM embeddings)")
def norm_stats(spark, d):
    return _round(metrics.norm_stats(table(spark, d, "embeddings")), "norm_mean", "norm_std", "norm_min", "norm_max")


@register("element_stats", f"SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (SELECT unnest({V}) AS x FROM embeddings)")
def element_stats(spark, d):
    return _round(metrics.element_stats(table(spark, d, "embeddings")), "mean", "std", "min", "max")


@register("token_stats", f"SELECT min(n) AS tokens_min, max(n) AS tokens_max, round(avg(n), 6) AS tokens_mean, round(stddev_pop(n), 6) AS tokens_std, count(*) FILTER (n < 30) AS short_chunks FROM (SELECT len({sql_words('text')}) AS n FROM documents)", longs=("tokens_min", "tokens_max",))
def token_stats(spark, d):
    return _round(metrics.token_stats(table(spark, d, "documents")), "tokens_mean", "tokens_std")


@register("coherence", f"SELECT round(avg(s) FILTER (same), 6) AS intra_mean, round(stddev_pop(s) FILTER (same), 6) AS intra_std, round(avg(s) FILTER (NOT same), 6) AS inter_mean, round(stddev_pop(s) FILTER (NOT same), 6) AS inter_std, round(avg(s), 6) AS cosine_mean FROM {_PAIRS}")
def coherence(spark, d):
    out = metrics.coherence(table(spark, d, "embeddings"))
    return _round(out.drop("separation_ratio"), "intra_mean", "intra_std", "inter_mean", "inter_std", "cosine_mean")


@register("separation_ratio", f"SELECT round((avg(s) FILTER (same)) / (avg(s) FILTER (NOT same)), 4) AS separation_ratio FROM {_PAIRS}")
def separation_ratio(spark, d):
    return _round(metrics.coherence(table(spark, d, "embeddings")).select("separation_ratio"), "separation_ratio", digits=4)


@register("section_coherence", f"SELECT e.label::VARCHAR AS section, e.n AS n_chunks, round(avg(s), 6) AS avg_sim, round(stddev_pop(s), 6) AS std_sim FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) e LEFT JOIN (SELECT * FROM {_PAIRS} WHERE same) p ON p.label = e.label GROUP BY ALL")
def section_coherence(spark, d):
    return _round(metrics.section_coherence(table(spark, d, "embeddings")), "avg_sim", "std_sim")


@register("pair_extremes", f"SELECT count(*) AS n_pairs, round(ln(avg(exp(-2 * d))), 6) AS uniformity_loss, round(greatest(max(s), 0), 6) AS cosine_max FROM {_PAIRS}")
def pair_extremes(spark, d):
    return _round(metrics.pair_extremes(table(spark, d, "embeddings"), id_col="vec_id"), "uniformity_loss", "cosine_max")


@register("near_duplicate_vectors", f"SELECT a, b, round(s, 6) AS cosine FROM {_PAIRS} WHERE s >= 0.3")
def near_duplicate_vectors(spark, d):
    return _round(metrics.near_duplicate_pairs(table(spark, d, "embeddings"), 0.3, id_col="vec_id"), "cosine")


@register("near_duplicate_classes", f"WITH c AS (SELECT min(vec_id) AS vec_id, count(*) AS n, embedding FROM embeddings GROUP BY embedding) SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 6) AS cosine, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.vec_id < b.vec_id OR (a.vec_id = b.vec_id AND a.n > 1) WHERE {_DOT} >= 0.95")
def near_duplicate_classes(spark, d):
    return _round(cells.near_classes(table(spark, d, "embeddings"), id_col="vec_id"), "cosine")


@register("near_duplicate_links", "WITH l AS (SELECT a.vec_id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE " + _DOT + " >= 0.95 GROUP BY a.vec_id) SELECT e.vec_id, min(e.vec_id) OVER (PARTITION BY embedding) AS class_id, coalesce(l.n, 0) AS n_links FROM embeddings e LEFT JOIN l ON l.vec_id = e.vec_id")
def near_duplicate_links(spark, d):
    return cells.near_links(table(spark, d, "embeddings"), id_col="vec_id")


@register("vector_topk_cells", f"SELECT query_id, item_id, round(score, 6) AS score, rank FROM ({_TOP_SQL % 10})", longs=("rank",))
def vector_topk_cells(spark, d):
    path = scratch_folder(spark, "cells")
    cells.write_cells(table(spark, d, "embeddings"), path, id_col="vec_id")
    return _round(cells.topk(_queries(spark, d), path, 10), "score")


@register("pca_geometry")
def pca_geometry(spark, d):
    return metrics.pca_geometry(table(spark, d, "embeddings"))


_LABELLED = "CASE WHEN source IN ('src1', 'src2') THEN 'reference_x.json' ELSE source END"


@register("source_label", f"SELECT doc_id, CASE WHEN contains({_LABELLED}, 'reference') THEN 'Referensi Ilmiah | ' || source WHEN sub NOT IN ('Umum', 'Pendahuluan', '', source) THEN source || ' > ' || sub ELSE source END AS label FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'Umum' WHEN 1 THEN source WHEN 2 THEN '' ELSE lang END AS sub FROM documents)")
def source_label(spark, d):
    docs = table(spark, d, "documents")
    sub = F.when(F.col("doc_id") % 4 == 0, "Umum").when(F.col("doc_id") % 4 == 1, F.col("source")).when(F.col("doc_id") % 4 == 2, "").otherwise(F.col("lang"))
    name = F.when(F.col("source").isin("src1", "src2"), "reference_x.json").otherwise(F.col("source"))
    return docs.select("doc_id", search.source_label(F.col("source"), sub, name).alias("label"))


_KEYS = "[CASE WHEN item_id % 3 = 0 THEN 'x' ELSE 'y' END, 'l' || (item_id % 7)]"


@register("keyword_filter", f"WITH h AS ({_TOP_SQL % 10}), m AS (SELECT *, list_has_any({_KEYS}, ['x', 'l5']) AS m FROM h) SELECT query_id, item_id, rank FROM (SELECT *, max(m) OVER (PARTITION BY query_id) AS any_m FROM m) WHERE m OR NOT any_m", longs=("rank",))
def keyword_filter(spark, d):
    hits = search.vector_topk(_queries(spark, d), _items(spark, d), 10)
    keys = F.array(F.when(F.col("item_id") % 3 == 0, "x").otherwise("y"), F.concat(F.lit("l"), F.col("item_id") % 7))
    return search.keyword_filter(hits.withColumn("keywords", keys), ["x", "l5"]).select("query_id", "item_id", "rank")


# The default topics, and two that occur in the test questions.
_SYNONYMS = {**lexicon.QUERY_SYNONYMS, "the": ["and", "of", "to"], "der": ["die", "und"]}


def _expand_sql(synonyms=_SYNONYMS) -> str:
    parts = [f"CASE WHEN (contains(low, {quote(k)}) OR {' OR '.join(f'contains(low, {quote(t)})' for t in v)}) AND NOT contains(low, {quote(t)}) THEN {quote(t)} END" for k, v in synonyms.items() for t in v]
    return f"SELECT item_id, text || CASE WHEN len(l) > 0 THEN ' ' || array_to_string(l, ' ') ELSE '' END AS expanded FROM (SELECT *, list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) AS l FROM (SELECT *, lower(text) AS low FROM benchmark))"


@register("query_expansion", _expand_sql())
def query_expansion(spark, d):
    return table(spark, d, "benchmark").select("item_id", search.expand_query(F.col("text"), _SYNONYMS).alias("expanded"))


def _bag(t: str) -> str:
    return f"list_distinct({sql_words(f'lower({t})')})"


_STOP = "[" + ", ".join(map(quote, lexicon.STOPWORDS + ["the", "of"])) + "]"


def _minus(t: str, stop: str = _STOP) -> str:
    return f"list_filter({t}, lambda w: NOT list_contains({stop}, w))"


_RERANK_SQL = f"""WITH q AS (SELECT item_id, {_minus(_bag('text'))} AS q FROM benchmark),
d AS (SELECT doc_id, source, {_minus(_bag('text'))} AS t, {_bag("source || ' ' || lang")} AS s FROM documents)
SELECT item_id, doc_id, round(0.5 + 0.12 * len(list_intersect(q, t)) / greatest(len(q), 1) + 0.10 * len(list_intersect(q, s)) / greatest(len(q), 1), 6) AS rerank_score FROM q, d"""


@register("rerank", _RERANK_SQL)
def rerank(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat("source", F.lit(" "), "lang").alias("section"))
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    return _round(search.rerank_all(q, docs, [*lexicon.STOPWORDS, "the", "of"], score=0.5, query_id="item_id", item_id="doc_id"), "rerank_score")


_CHUNK_SQL = "SELECT e.vec_id AS chunk_id, e.embedding, d.text, d.source AS section, d.lang AS subsection, d.source AS source_file FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"
_RETRIEVE_SQL = f"""WITH c AS ({_CHUNK_SQL}), q AS (SELECT c.chunk_id AS query_id, b.text AS query, c.embedding FROM c JOIN benchmark b ON c.chunk_id = b.item_id * 20),
h AS (SELECT q.query_id, q.query, c.*, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.chunk_id) AS rank FROM q, c QUALIFY rank <= 10),
b AS (SELECT *, {_minus(_bag('query'))} AS qs, {_minus(_bag('text'))} AS ts, {_bag('section')} AS ss FROM h WHERE s >= 0.15),
r AS (SELECT *, s + 0.12 * len(list_intersect(qs, ts)) / greatest(len(qs), 1) + 0.10 * len(list_intersect(qs, ss)) / greatest(len(qs), 1) AS rr FROM b)
SELECT query_id, chunk_id, rank, round(s, 6) AS similarity_score, round(rr, 6) AS rerank_score, CASE WHEN subsection NOT IN ('Umum', 'Pendahuluan', '', section) THEN section || ' > ' || subsection ELSE section END AS source_label,
row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, rank) AS place FROM r QUALIFY place <= 5"""


def _chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("section"), F.col("lang").alias("subsection"), F.col("source").alias("source_file"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(docs, "chunk_id")


def _asked(spark, d, chunks):
    return chunks.select(F.col("chunk_id").alias("query_id"), "embedding").join(table(spark, d, "benchmark").select((F.col("item_id") * 20).alias("query_id"), F.col("text").alias("query")), "query_id")


@register("retrieve_full", _RETRIEVE_SQL, longs=("rank", "place",))
def retrieve_full(spark, d):
    chunks = _chunks(spark, d)
    out = search.retrieve(_asked(spark, d, chunks), chunks, stopwords=[*lexicon.STOPWORDS, "the", "of"])
    return _round(out.select("query_id", "chunk_id", "rank", "similarity_score", "rerank_score", "source_label", "place"), "similarity_score", "rerank_score")


_NEAR_SQL = f"""WITH p AS (SELECT query_id, item_id AS c, score, rank FROM ({_TOP_SQL % 5})),
n AS (SELECT p.query_id, e.vec_id AS c, p.score * 0.7 AS score, row_number() OVER (PARTITION BY p.query_id, e.vec_id ORDER BY p.rank, e.vec_id - p.c) AS k FROM p JOIN embeddings e ON abs(e.vec_id - p.c) <= 1 AND e.vec_id <> p.c WHERE NOT EXISTS (SELECT 1 FROM p x WHERE x.query_id = p.query_id AND x.c = e.vec_id))
SELECT query_id, c AS chunk_id, round(score, 6) AS score, false AS is_context FROM p UNION ALL SELECT query_id, c, round(score, 6), true FROM n WHERE k = 1"""


@register("neighbour_context", _NEAR_SQL)
def neighbour_context(spark, d):
    hits = search.vector_topk(_queries(spark, d), _items(spark, d), 5).select("query_id", F.col("item_id").alias("chunk_id"), "score", F.col("rank").alias("place"))
    order = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ordinal"))
    return _round(search.with_neighbours(hits, order), "score")


_PART_SQL = "SELECT source AS query_id, doc_id AS place, '[Konteks ' || doc_id || ']' || chr(10) || 'Sumber   : ' || lang || chr(10) || 'Relevansi: 0.50' || chr(10) || '---' || chr(10) || text AS part FROM documents"


@register("context_budget", f"SELECT query_id, place, CASE WHEN s <= 3000 THEN part ELSE left(part, (3000 - s + length(part))::INT) || '...' END AS part FROM (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY place) AS s FROM ({_PART_SQL})) WHERE s <= 3000 OR (s - length(part) <= 3000 AND 3000 - s + length(part) > 100)")
def context_budget(spark, d):
    part = answer.context_part(F.col("doc_id"), F.col("lang"), F.lit(0.5), F.col("text"))
    return answer.context_budget(table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("place"), part.alias("part")))


@register("format_context", f"WITH b AS (SELECT query_id, place, CASE WHEN s <= 3000 THEN part ELSE left(part, (3000 - s + length(part))::INT) || '...' END AS part FROM (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY place) AS s FROM ({_PART_SQL})) WHERE s <= 3000 OR (s - length(part) <= 3000 AND 3000 - s + length(part) > 100)) SELECT query_id, repeat(chr(10), 2) || string_agg(part, repeat('=', 40) || repeat(chr(10), 2) ORDER BY place) AS context FROM b GROUP BY query_id")
def format_context(spark, d):
    return answer.format_context(context_budget(spark, d))


_OUT, _IN = ["nd", *lexicon.OUT_OF_SCOPE], ["the", *lexicon.IN_SCOPE]


def _has(t, terms):
    return "(" + " OR ".join(f"contains({t}, {quote(x)})" for x in terms) + ")"


_SCOPE_SQL = f"({_has('lower(text)', _OUT)} AND NOT {_has('lower(text)', _IN)})"


@register("scope_classify", f"SELECT conv_id, turn, {_SCOPE_SQL} AS out_of_scope FROM conversations")
def scope_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", answer.out_of_scope(F.col("text"), _OUT, _IN).alias("out_of_scope"))


@register("mode_route", f"SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN 'DATABASE RAG' WHEN {_SCOPE_SQL} THEN 'OUT OF SCOPE' ELSE 'GENERAL KNOWLEDGE' END AS mode FROM conversations")
def mode_route(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", answer.route(F.col("turn") % 3, answer.out_of_scope(F.col("text"), _OUT, _IN)).alias("mode"))


_LEX_SQL = f"""q AS (SELECT item_id AS query_id, {_bag('text')} AS q FROM benchmark),
d AS (SELECT doc_id AS item_id, {_bag('text')} AS t, list_distinct(list_filter([lower(lang), 'kw', 'the ' || lower(lang)], lambda x: x IS NOT NULL)) AS k, {_bag('source')} AS s FROM documents),
r AS (SELECT query_id, item_id, len(list_intersect(q, t)) + 2 * len(list_intersect(q, k)) + 1.5 * len(list_intersect(q, s)) AS raw FROM q, d),
l AS (SELECT query_id, item_id, CASE WHEN raw > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM l)"""


def _lexical_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical_items(spark, d):
    """Documents with keywords of one and of several words, in several cases."""
    keywords = F.array("lang", F.lit("kw"), F.lit("KW"), F.concat(F.lit("The "), "lang"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text", keywords.alias("keywords"), F.col("source").alias("section"))


def _first_ranks(spark, d):
    """An item answers a query if their ids add up to a multiple of 3."""
    group = lambda c: F.pmod(c, F.lit(3)).cast("string")
    relevant = _lexical_queries(spark, d).select("query_id", F.array(group(-F.col("query_id"))).alias("sections"))
    return ranking.first_ranks(_lexical_queries(spark, d), lexical_items(spark, d).withColumn("third", group(F.col("item_id"))), relevant, group_col="third")


@register("lexical_rank", f"WITH {_LEX_SQL} SELECT query_id, item_id, round(score, 6) AS score, rank FROM k", longs=("rank",))
def lexical_rank(spark, d):
    return ranking.whole_ranking(_lexical_queries(spark, d), lexical_items(spark, d), digits=6)


def _metric_sql(ks=(1, 3, 5), hit="(item_id + query_id) % 3 = 0") -> str:
    out = ["coalesce(1.0 / min(rank) FILTER (hit), 0) AS \"MRR\""]
    for k in ks:
        hits = f"count(*) FILTER (hit AND rank <= {k})"
        ideal = f"(SELECT sum(1 / log2(i + 1)) FROM range(1, {k + 1}) t(i) WHERE i <= h{k})"
        out += [f'h{k} / {k}.0 AS "P@{k}"', f'h{k} / 2.0 AS "R@{k}"', f'CASE WHEN h{k} > 0 THEN d{k} / {ideal} ELSE 0 END AS "NDCG@{k}"']
    inner = ", ".join(f"count(*) FILTER (hit AND rank <= {k}) AS h{k}, sum(1 / log2(rank + 1)) FILTER (hit AND rank <= {k}) AS d{k}" for k in ks)
    picked = ", ".join(["mrr AS \"MRR\"", *out[1:]])
    return f"h AS (SELECT query_id, rank, {hit} AS hit FROM k), g AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (hit), 0) AS mrr, {inner} FROM h GROUP BY query_id), m AS (SELECT query_id, {picked} FROM g)"


_METRIC_NAMES = ["MRR", *[f"{m}@{k}" for k in (1, 3, 5) for m in ("P", "R", "NDCG")]]


def _per_query(spark, d):
    ranked = _first_ranks(spark, d)
    n = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(2).alias("n_relevant")).distinct()
    return metrics.ranking_metrics(ranked, n)


@register("ir_metrics_per_query", f"WITH {_LEX_SQL}, {_metric_sql()} SELECT query_id, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _METRIC_NAMES) + " FROM m")
def ir_metrics_per_query(spark, d):
    out = _per_query(spark, d)
    return out.select("query_id", *[F.round(f"`{c}`", 6).alias(c) for c in _METRIC_NAMES])


@register("ir_metrics_avg", f"WITH {_LEX_SQL}, {_metric_sql()} SELECT " + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in _METRIC_NAMES) + " FROM m")
def ir_metrics_avg(spark, d):
    out = metrics.mean_metrics(_per_query(spark, d))
    return out.select(*[F.round(f"`{c}`", 6).alias(c) for c in _METRIC_NAMES])


@register("chunk_hit", f"WITH {_LEX_SQL} SELECT i.item_id AS query_id, CASE WHEN i.item_id % 4 = 0 THEN 'none' WHEN EXISTS (SELECT 1 FROM k WHERE k.query_id = i.item_id AND k.rank <= 3 AND k.item_id IN (i.item_id, i.item_id + 1)) THEN 'true' ELSE 'false' END AS hit FROM benchmark i")
def chunk_hit(spark, d):
    ids = F.when(F.col("item_id") % 4 > 0, F.array("item_id", F.col("item_id") + 1))
    found = metrics.chunk_hit(_first_ranks(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ids.alias("ids")))
    return found.withColumn("hit", F.coalesce(F.col("hit").cast("string"), F.lit("none")))


def _tidy(spark, d):
    e = table(spark, d, "embeddings")
    c = metrics.coherence(e).select(F.expr("stack(2, 'Separation Ratio', separation_ratio, 'intra_mean', intra_mean) as (metric, value)"))
    n = metrics.norm_stats(e).select(F.lit("Normalisasi L2").alias("metric"), F.col("is_normalized").cast("int").cast("double").alias("value"))
    u = metrics.pair_extremes(e, id_col="vec_id").select(F.lit("Uniformity Loss").alias("metric"), (-F.col("uniformity_loss")).alias("value"))
    t = metrics.token_stats(table(spark, d, "documents")).select(F.lit("short_chunks").alias("metric"), F.col("short_chunks").cast("double").alias("value"))
    r = metrics.mean_metrics(_per_query(spark, d)).select(F.expr("stack(4, 'Precision@3', `P@3`, 'MRR', MRR, 'NDCG@3', `NDCG@3`, 'P@1', `P@1`) as (metric, value)"))
    return c.unionByName(n).unionByName(u).unionByName(t).unionByName(r)


_TIDY_SQL = f"""WITH {_LEX_SQL}, {_metric_sql()}, p AS {_PAIRS},
x AS (SELECT 'Separation Ratio' AS metric, (avg(s) FILTER (same)) / (avg(s) FILTER (NOT same)) AS value FROM p UNION ALL SELECT 'intra_mean', avg(s) FILTER (same) FROM p
 UNION ALL SELECT 'Normalisasi L2', bool_and(abs(sqrt(list_dot_product({V}, {V})) - 1) <= 1.1e-4)::INT::DOUBLE FROM embeddings
 UNION ALL SELECT 'Uniformity Loss', -ln(avg(exp(-2 * d))) FROM p
 UNION ALL SELECT 'short_chunks', count(*)::DOUBLE FROM documents WHERE len({sql_words('text')}) < 30
 UNION ALL SELECT 'Precision@3', avg("P@3") FROM m UNION ALL SELECT 'MRR', avg("MRR") FROM m UNION ALL SELECT 'NDCG@3', avg("NDCG@3") FROM m UNION ALL SELECT 'P@1', avg("P@1") FROM m)"""
_CARD = ", ".join(f"('{a}', {b}, {c})" for a, b, c in metrics.SCORECARD)
_RULES = ", ".join(f"('{a}', '{b}', {c}, '{e}')" for a, b, c, e in metrics.ADVICE)


@register("scorecard", f"{_TIDY_SQL} SELECT metric, round(value, 4) AS value, CASE WHEN value >= good THEN 'BAIK' WHEN value >= fair THEN 'CUKUP' ELSE 'PERLU PERHATIAN' END AS status FROM x JOIN (VALUES {_CARD}) t(metric, good, fair) USING (metric)")
def scorecard(spark, d):
    return _round(metrics.scorecard(_tidy(spark, d)), "value", digits=4)


@register("recommendations", f"{_TIDY_SQL} SELECT metric, round(value, 4) AS value, priority FROM x JOIN (VALUES {_RULES}) t(metric, op, bound, priority) USING (metric) WHERE CASE WHEN op = '>' THEN value > bound ELSE value < bound END")
def recommendations(spark, d):
    return _round(metrics.recommendations(_tidy(spark, d)), "value", digits=4)


@register("coverage", "SELECT count(*) AS total, count(*) FILTER (NOT starts_with(s, 'Referensi')) AS main, count(*) FILTER (starts_with(s, 'Referensi')) AS reference, count(DISTINCT s) AS sections FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'Referensi ' || source ELSE source END AS s FROM documents)")
def coverage(spark, d):
    section = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Referensi "), F.col("source"))).otherwise(F.col("source"))
    return metrics.coverage(table(spark, d, "documents").select(section.alias("section")))


@register("session_stats", "SELECT conv_id, count(*) FILTER (role = 'user') AS n_questions, count(*) FILTER (role = 'assistant') AS n_responses, arg_max(text, turn) FILTER (role = 'assistant') AS last_response FROM conversations GROUP BY conv_id")
def session_stats(spark, d):
    return session.session_stats(table(spark, d, "conversations"))


@register("session_ask", "WITH l AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, t + 1, 'user', 'q ' || conv_id FROM l WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, t + 2, 'assistant', 'a' FROM l WHERE conv_id % 2 = 0")
def session_ask(spark, d):
    turns = table(spark, d, "conversations")
    ids = turns.select("conv_id").distinct()
    asked = ids.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" q "), F.col("conv_id"), F.lit(" "))).otherwise("  ").alias("text"))
    return session.ask(turns, asked, ids.select("conv_id", F.lit("a").alias("response"), F.lit(True).alias("ok")))


@register("session_clear", "SELECT conv_id, turn, role, text FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn <= 1)")
def session_clear(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return session.clear(turns, turns.filter((F.col("conv_id") % 3 == 0) & (F.col("turn") <= 1)).select("conv_id", F.lit(1).alias("turn")).distinct())


@register("session_greeting", "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT DISTINCT -1 - conv_id, 0, 'assistant', 'Halo' FROM conversations WHERE conv_id % 5 = 0")
def session_greeting(spark, d):
    turns = table(spark, d, "conversations")
    ids = turns.select("conv_id").union(turns.filter(F.col("conv_id") % 5 == 0).select((-1 - F.col("conv_id")).alias("conv_id")))
    return session.greet(ids, turns, "Halo")


_ESC = "replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@register("transcript", f"SELECT conv_id, string_agg('<div class=\"' || CASE WHEN role = 'user' THEN 'user' ELSE 'bot' END || '\">' || {_ESC} || '</div>', '' ORDER BY turn) AS html FROM conversations GROUP BY conv_id")
def transcript(spark, d):
    return session.transcript(table(spark, d, "conversations"))


@register("topic_catalogue", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, t)) + ")" for t in lexicon.TOPICS) + ") t(label, detail, query)")
def topic_catalogue(spark, d):
    return session.topics(spark, lexicon.TOPICS)


def _marked():
    return F.concat(F.lit("## Judul\n1. Satu\n\n1. a **b**\n2. c *d*\n- x `y`\n  - z → (Sumber: Seksi 1)\n"), F.col("text"), F.lit("\n\n📚 Referensi:\n- satu\n* dua <i>"))


_MARKED_SQL = "('## Judul' || chr(10) || '1. Satu' || chr(10) || chr(10) || '1. a **b**' || chr(10) || '2. c *d*' || chr(10) || '- x `y`' || chr(10) || '  - z → (Sumber: Seksi 1)' || chr(10) || text || chr(10) || chr(10) || '📚 Referensi:' || chr(10) || '- satu' || chr(10) || '* dua <i>')"


def _inline_sql(t: str) -> str:
    """RE2 looks at no neighbours: exact for emphasis marks that don't touch others."""
    t = _ESC.replace("coalesce(text, '')", t)
    t = rf"regexp_replace({t}, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g')"
    t = rf"regexp_replace({t}, '(^|[^*])\*([^*]+)\*([^*]|$)', '\1<em>\2</em>\3', 'g')"
    t = rf"regexp_replace({t}, '`([^`]+)`', '<code>\1</code>', 'g')"
    return rf"""regexp_replace({t}, '→?\s*\(Sumber:\s*([^)]{{1,55}})\)', '<span class="src-tag" title="\1">Sumber: \1</span>', 'g')"""


_INDENT = r"length(line) - length(regexp_replace(line, '^\s+', ''))"
_ITEM = f"'<li' || CASE WHEN kind = 'bullet' AND {_INDENT} >= 2 THEN ' class=\"sub\"' ELSE '' END || '>' || shown || '</li>'"


def _blocks_sql(text: str, strip_marks: bool = True) -> str:
    """CTEs up to ``blocks`` (conv_id, turn, block, kind, html)."""
    bare = r"CASE kind WHEN 'heading' THEN regexp_replace(line, '^(#+\s*|\d+\.\s+)', '') WHEN 'ordered' THEN regexp_replace(line, '^\d+\.\s+', '') WHEN 'bullet' THEN regexp_replace(line, '^\s*[*\-]\s+', '') ELSE line END" if strip_marks else "line"
    return rf"""l AS (SELECT conv_id, turn, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM conversations),
a AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,3}}\s') THEN 'heading' WHEN regexp_matches(line, '^\d+\.\s+\S.{{0,80}}$') AND NOT regexp_matches(coalesce(lead(line) OVER w, ''), '^\s*[*\-\d]') THEN 'heading' WHEN regexp_matches(line, '^\d+\.\s') THEN 'ordered' WHEN regexp_matches(line, '^\s*[*\-]\s') THEN 'bullet' WHEN regexp_matches(line, '^\s*$') THEN 'gap' ELSE 'text' END AS first FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
b AS (SELECT *, CASE WHEN first = 'heading' AND regexp_matches(line, '^\d+\.\s') AND lag(first) OVER w = 'ordered' THEN 'ordered' ELSE first END AS kind FROM a WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
c AS (SELECT *, CASE WHEN kind IN ('ordered', 'bullet') AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS starts, {bare} AS bare FROM b WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
n AS (SELECT *, (sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS block, {_inline_sql('bare')} AS shown FROM c),
g AS (SELECT conv_id, turn, block, kind, string_agg(CASE kind WHEN 'heading' THEN '<span class="bh">' || shown || '</span>' WHEN 'gap' THEN '<span class="bg"></span>' WHEN 'text' THEN '<span class="bp">' || shown || '</span>' ELSE {_ITEM} END, '' ORDER BY i) AS html FROM n GROUP BY ALL),
blocks AS (SELECT conv_id, turn, block, kind, CASE kind WHEN 'ordered' THEN '<ol class="bol">' || html || '</ol>' WHEN 'bullet' THEN '<ul class="bul">' || html || '</ul>' ELSE html END AS html FROM g)"""


_BODY_SQL = rf"regexp_replace({_MARKED_SQL}, '(?is)\s*📚\s*Referensi.*$', '')"
_ENTRY_SQL = _inline_sql(r"regexp_replace(e, '^[*\-\d.]\s*', '')")
_ANSWERS_SQL = rf"""WITH {_blocks_sql(_BODY_SQL)},
r AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_extract({_MARKED_SQL}, '(?is)(📚\s*Referensi.*)$', 1), chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)📚\s*Referensi')) AS es FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN len(es) > 0 THEN '<div class="ref-block"><div class="ref-head">Referensi</div>' || array_to_string(list_transform(es, lambda e: '<div class="ref-entry">' || {_ENTRY_SQL} || '</div>'), '') || '</div>' ELSE '' END AS refs FROM r)
SELECT conv_id, turn, string_agg(html, '' ORDER BY block) || any_value(refs) AS html FROM blocks JOIN s USING (conv_id, turn) GROUP BY ALL"""


@register("render_blocks", f"WITH {_blocks_sql(_MARKED_SQL)} SELECT * FROM blocks")
def render_blocks(spark, d):
    return present.blocks(table(spark, d, "conversations").select("conv_id", "turn", _marked().alias("text")), ["conv_id", "turn"])


@register("render_answers", _ANSWERS_SQL)
def render_answers(spark, d):
    return present.render(table(spark, d, "conversations").select("conv_id", "turn", _marked().alias("text")), ["conv_id", "turn"])


@register("reference_entries", "SELECT conv_id, turn, 'satu|dua' AS entries FROM conversations")
def reference_entries(spark, d):
    found = F.transform(present.reference_entries(_marked()), lambda s: F.regexp_replace(F.regexp_replace(s, r"^[*\-]\s*", ""), r"\s*<i>", ""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, "|").alias("entries"))


def _checksum_sql(word: str) -> str:
    """CRC-32 of a word's bytes, bit by bit."""
    step = "xor(a, x)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda c: xor(c >> 1, (c & 1) * 3988292384))[1]"
    octets = f"list_transform(range(0, len(hex(encode({word}))) // 2), lambda i: ('0x' || substr(hex(encode({word})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, x: {step}, 4294967295::BIGINT), 4294967295)"


_PLAIN_STOP = "[" + ", ".join(map(quote, lexicon.STOPWORDS)) + "]"
_ANSWER_SQL = f"""WITH d AS (SELECT doc_id::VARCHAR AS id, source AS section, CASE WHEN lang NOT IN ('Umum', 'Pendahuluan', '', source) THEN source || ' > ' || lang ELSE source END AS label, text, trim(trim(coalesce(source, '') || ' ' || coalesce(lang, '')) || ' ' || text) AS t FROM documents),
q AS (SELECT item_id::VARCHAR AS id, expanded AS t FROM ({_expand_sql(lexicon.QUERY_SYNONYMS)})),
w AS (SELECT 'd' AS side, id, unnest({sql_words('lower(t)')}) AS word FROM d UNION ALL SELECT 'q', id, unnest({sql_words('lower(t)')}) FROM q),
h AS (SELECT word, {_checksum_sql('word')} AS h FROM (SELECT DISTINCT word FROM w)),
v AS (SELECT side, id, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM w JOIN h USING (word) GROUP BY ALL),
u AS (SELECT side, id, i, (x / greatest(sqrt(sum(x * x) OVER (PARTITION BY side, id)), 1e-9))::FLOAT::DOUBLE AS x FROM v),
s AS (SELECT a.id AS query, b.id AS chunk, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.i = b.i AND a.side = 'q' AND b.side = 'd' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, chunk) AS rank FROM s QUALIFY rank <= 10),
b AS (SELECT r.*, d.label, d.text, {_minus(_bag('k.text'), _PLAIN_STOP)} AS qs, {_minus(_bag('d.text'), _PLAIN_STOP)} AS ts, {_bag('d.section')} AS ss FROM r JOIN d ON d.id = chunk JOIN benchmark k ON k.item_id::VARCHAR = query WHERE s >= 0.15),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s + 0.12 * len(list_intersect(qs, ts)) / greatest(len(qs), 1) + 0.10 * len(list_intersect(qs, ss)) / greatest(len(qs), 1) DESC, rank) AS place FROM b QUALIFY place <= 5),
f AS (SELECT query, place, '[Konteks ' || place || ']' || chr(10) || 'Sumber   : ' || label || chr(10) || 'Relevansi: ' || printf('%.2f', s) || chr(10) || '---' || chr(10) || text AS part FROM p WHERE s >= 0.4),
o AS (SELECT *, sum(length(part)) OVER (PARTITION BY query ORDER BY place) AS upto FROM f),
g AS (SELECT query, string_agg(CASE WHEN upto <= 3000 THEN part ELSE left(part, (3000 - upto + length(part))::INT) || '...' END, repeat('=', 40) || repeat(chr(10), 2) ORDER BY place) AS part FROM o WHERE upto <= 3000 OR (upto - length(part) <= 3000 AND 3000 - upto + length(part) > 100) GROUP BY query),
m AS (SELECT item_id, text, part, CASE WHEN part IS NOT NULL THEN 'DATABASE RAG' WHEN {_has('lower(text)', lexicon.OUT_OF_SCOPE)} AND NOT {_has('lower(text)', lexicon.IN_SCOPE)} THEN 'OUT OF SCOPE' ELSE 'GENERAL KNOWLEDGE' END AS mode FROM benchmark LEFT JOIN g ON query = item_id::VARCHAR)
SELECT item_id AS query_id, text AS query, mode, CASE WHEN part IS NULL THEN '[MODE: ' || mode || ']' ELSE string_split(substr(part, instr(part, '---' || chr(10)) + 4), chr(10))[1] END AS response, true AS ok FROM m"""


@register("answer_batch", _ANSWER_SQL)
def answer_batch(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("section"), F.col("lang").alias("subsection"), F.col("source").alias("source_file"))
    engine = Engine.build(docs, embed.HashingEmbedder(64), answer.ExtractiveGenerator()).written(scratch_folder(spark, "index"))
    return engine.answer(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))).drop("prompt")
