"""Quality of embeddings and of rankings.

Means and deviations over all pairs come from sums of vectors and of their outer
products, in one pass over rows; only what has no such form compares pairs, block by
block in matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions import vectors
from corpusloom.functions.frozen import frozen
from corpusloom.functions.tokens import word_count, word_set
from corpusloom.functions.vectors import norm
from corpusloom.operators import moments

#: Vectors to a side of a block: of pairs that leave it as rows, and of pairs that are only added up.
PAIR_BLOCK, EXTREMES_BLOCK = 4096, 8192
#: Span of ids of the items that are listed at once behind a query's matches.
ID_BLOCK = 4096
#: Levels of a badge; metric, good from, fair from.
BADGES = ("BAIK", "CUKUP", "PERLU PERHATIAN")
SCORECARD = (("Normalisasi L2", 1.0, 0.9), ("Uniformity Loss", 1.5, 1.0), ("Separation Ratio", 1.5, 1.2), ("Precision@3", 0.65, 0.45), ("MRR", 0.80, 0.60), ("NDCG@3", 0.70, 0.50))
#: Metric, comparison, limit, priority of the advice it gives.
ADVICE = (("short_chunks", ">", 0.0, "TINGGI"), ("separation_ratio", "<", 1.5, "TINGGI"), ("P@1", "<", 0.8, "SEDANG"), ("n_duplicates", ">", 0.0, "SEDANG"), ("intra_mean", "<", 0.6, "RENDAH"))


def norm_stats(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    n = norm(F.col(vector_col)).alias("n")
    unit = F.bool_and(F.abs(F.col("n") - 1) <= 1e-4 + 1e-5)
    return df.select(n).agg(F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"), F.min("n").alias("norm_min"), F.max("n").alias("norm_max"), unit.alias("is_normalized"))


def element_stats(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    x = df.select(F.explode(vector_col).alias("x")).select(F.col("x").cast("double").alias("x"))
    return x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def token_stats(df: DataFrame, text_col: str = "text", short: int = 30) -> DataFrame:
    n = df.select(word_count(F.col(text_col)).alias("n"))
    return n.agg(F.min("n").alias("tokens_min"), F.max("n").alias("tokens_max"), F.avg("n").alias("tokens_mean"), F.stddev_pop("n").alias("tokens_std"), F.count_if(F.col("n") < short).alias("short_chunks"))


def _compared(df: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows whose vectors are not null nor empty and hold finite numbers alone, and
    their length; vectors of several lengths are an error."""
    some = df.filter(vectors.usable(F.col(vector_col)))
    n = F.size(vector_col)
    found = some.agg(F.min(n).alias("least"), F.max(n).alias("most")).first()
    if found["least"] != found["most"]:
        raise ValueError(f"vectors of several lengths, {found['least']} to {found['most']}")
    return some, found["most"] or 0


def _spread(pairs: Column, s: Column, q: Column) -> tuple[Column, Column]:
    """(mean, population deviation), null without pairs."""
    some = F.when(pairs > 0.5, pairs)
    mean = s / some
    return mean, F.when(some.isNotNull(), F.sqrt(F.greatest(q / some - mean * mean, F.lit(0.0))))


def coherence(df: DataFrame, *, vector_col: str = "embedding", section_col: str = "label") -> DataFrame:
    """Cosine within and across sections, of unit vectors: means, population deviations
    and the ratio of the means; without pairs 0, and no row without vectors. Vectors
    that are null or hold no finite numbers alone are left out."""
    some, dim = _compared(df, vector_col)
    each = frozen(moments.moments(some, vector_col, section_col, dim))
    total = moments.pair_sums(moments.whole(each), dim)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    parts = moments.pair_sums(each, dim).select(F.lit(True).alias("within"), pairs.alias("p"), "s", "q")
    parts = parts.union(total.select(F.lit(False), pairs, "s", "q"))
    one = parts.agg(*[F.coalesce(F.sum(F.when(F.col("within") == w, F.col(c))), F.lit(0.0)).alias(f"{c}_{n}") for w, n in ((True, "in"), (False, "all")) for c in ("p", "s", "q")], F.count_if(~F.col("within")).alias("k")).filter("k > 0")
    sums = {"intra": [F.col(f"{c}_in") for c in "psq"], "inter": [F.col(f"{c}_all") - F.col(f"{c}_in") for c in "psq"], "cosine": [F.col(f"{c}_all") for c in "psq"]}
    found = {f"{name}_{what}": F.coalesce(value, F.lit(0.0)) for name, three in sums.items() for what, value in zip(("mean", "std"), _spread(*three), strict=True)}
    ratio = F.when(F.col("inter_mean") != 0, F.col("intra_mean") / F.col("inter_mean")).otherwise(0.0)
    return one.select(*[c.alias(n) for n, c in found.items()]).select("intra_mean", "intra_std", "inter_mean", "inter_std", ratio.alias("separation_ratio"), "cosine_mean")


def section_coherence(df: DataFrame, *, vector_col: str = "embedding", section_col: str = "label") -> DataFrame:
    """(section, n_chunks, avg_sim, std_sim); a section of one has nulls. Pairs with a
    zero vector, whose similarity is 0, don't count, nor do vectors that are null or
    hold no finite numbers alone."""
    some, dim = _compared(df, vector_col)
    sums = moments.pair_sums(moments.moments(some, vector_col, section_col, dim), dim)
    mean, deviation = _spread(F.col("some") * (F.col("some") - 1) / 2, F.col("s"), F.col("q"))
    return sums.select(F.col("g").alias("section"), F.col("n").cast("long").alias("n_chunks"), mean.alias("avg_sim"), deviation.alias("std_sim"))


def _blocks(df: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """Rows that can be compared, dealt to all pairs of blocks of bounded size that hold them."""
    some = df.filter(F.col(id_col).isNotNull() & vectors.usable(F.col(vector_col)))
    n = max(1, -(-some.count() // block))
    rows = some.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    return rows.select("id", "v", "dim", "at", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"))


def _pairs_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, inner products, squared distances) of the pairs of a block pair, some
    rows at a time; the first row has the lesser id."""
    at, lo, hi = table["at"].to_numpy(), table["lo"][0].as_py(), table["hi"][0].as_py()
    a, b = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
    v = pc.list_flatten(table["v"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
    n2 = (v * v).sum(axis=1)
    for k in range(0, len(a), 256):
        some = a[k : k + 256]
        s = v[some] @ v[b].T
        d = np.maximum(n2[some, None] + n2[b] - 2 * s, 0.0)
        p, q = np.nonzero(some[:, None] < b if lo == hi else np.ones(s.shape, bool))
        yield np.minimum(some[p], b[q]), np.maximum(some[p], b[q]), s[p, q], d[p, q]


def pair_extremes(df: DataFrame, *, id_col: str, vector_col: str = "embedding", block: int = EXTREMES_BLOCK, near: float | None = None) -> DataFrame:
    """One row: n_pairs, uniformity_loss (null without pairs) and cosine_max (never under
    0, as a vector's own place in the matrix counts as 0), of unit vectors; with ``near``
    also n_near, the pairs whose cosine reaches it.

    The loss is a sum over all pairs that no sum over rows gives, so each is computed, in
    blocks, and no pair leaves one. A null id, and a vector that is null, empty or holds a null or a
    non-finite element, take no part; vectors pair with those of their own length."""
    schema = pa.schema([("n", pa.int64()), ("e", pa.float64()), ("m", pa.float64()), ("k", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        n, total, top, some = 0, 0.0, 0.0, 0
        at, same = table["at"].to_numpy(), table["lo"][0].as_py() == table["hi"][0].as_py()
        v = pc.list_flatten(table["v"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
        first = at == table["lo"][0].as_py()
        x, y = v[first], v if same else v[~first]
        a, b = ((z * z).sum(axis=1) for z in (x, y))
        room = np.empty((2, 256 * 1024))  # used again, as fresh memory costs more than the sums
        for k in range(0, len(x), 256):
            for j in range(k if same else 0, len(y), 1024):  # tiles that stay in a core's cache
                part, other = x[k : k + 256], y[j : j + 1024]
                s, d = (z[: len(part) * len(other)].reshape(len(part), -1) for z in room)
                np.matmul(part, other.T, out=s)
                np.multiply(s, -2, out=d)
                d += a[k : k + 256, None]
                d += b[j : j + 1024]
                if same and j < k + 256:  # each two rows once
                    later = np.arange(k, k + len(s))[:, None] < np.arange(j, j + s.shape[1])
                    s, d = s[later], d[later]
                if s.size:
                    n, top = n + s.size, max(top, float(s.max()))
                    some += int(np.count_nonzero(s >= near)) if near is not None else 0
                    np.maximum(d, 0.0, out=d)
                    d *= -2
                    total += float(np.exp(d, out=d).sum())
        return pa.table([[n], [total], [top], [some]], schema=schema)

    parts = _blocks(df, id_col, vector_col, block).groupBy("lo", "hi", "dim").applyInArrow(run, "n long, e double, m double, k long")
    found = [F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.when(F.sum("n") > 0, F.ln(F.sum("e") / F.sum("n"))).alias("uniformity_loss"), F.coalesce(F.greatest(F.max("m"), F.lit(0.0)), F.lit(0.0)).alias("cosine_max")]
    return parts.agg(*found, *([] if near is None else [F.coalesce(F.sum("k"), F.lit(0)).alias("n_near")]))


def near_duplicate_pairs(df: DataFrame, threshold: float = 0.95, *, id_col: str, vector_col: str = "embedding", block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b, cosine) of unit vectors, a < b, whatever the threshold, so all blocks meet.
    What takes no part in ``pair_extremes`` takes none here."""
    schema = T.StructType([T.StructField("a", df.schema[id_col].dataType), T.StructField("b", df.schema[id_col].dataType), T.StructField("cosine", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        out = [(i[s >= threshold], j[s >= threshold], s[s >= threshold]) for i, j, s, _ in _pairs_of(table)]
        a, b, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        ids = table["id"].combine_chunks()
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s.astype(np.float64))], schema=arrow)

    return _blocks(df, id_col, vector_col, block).groupBy("lo", "hi", "dim").applyInArrow(run, schema)


def pca_geometry(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Explained variance: components for 80, 90 and 95 %, isotropy, first five shares
    and compression at 90 %, over min(rows, length) components. Vectors that are null or
    hold no finite numbers alone are left out; no row without vectors."""
    some, dim = _compared(df, vector_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pieces in batch["ms"]:
                n, s, g = moments.unpack(np.concatenate([np.frombuffer(p) for p in pieces]), dim)
                values = np.linalg.eigvalsh((g - np.outer(s, s) / n) / max(1.0, n - 1))[::-1][: int(min(n, dim))]
                values = np.maximum(values, 0.0)
                share = values / values.sum() if values.sum() > 0 else values
                run_sum = np.cumsum(share)
                at = [int((run_sum < t - 1e-12).sum()) + 1 for t in (0.8, 0.9, 0.95)]
                yield pd.DataFrame([[dim, *at, float(values[-1] / values[0]) if values[0] > 0 else 0.0, share[:5].tolist(), at[1] / dim]], columns=["dim", "dims_80", "dims_90", "dims_95", "isotropy", "top5", "compression"])

    return moments.joined(moments.moments(some, vector_col, None, dim)).mapInPandas(run, "dim int, dims_80 int, dims_90 int, dims_95 int, isotropy double, top5 array<double>, compression double")


def keyword_set(keywords: Column) -> Column:
    """The different keywords, lower-cased and whole: one of several words is no word."""
    return F.array_distinct(F.transform(F.array_compact(F.coalesce(keywords, F.array().cast("array<string>"))), F.lower))


def lexical_scores(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of queries (query_id, query) with items (item_id, text,
    keywords, section) that share a word: shared words of the text count 1, whole keywords
    that are a word of the query 2, words of the section 1.5, divided by the query's best.

    Words are the join key, so items that share none with a query never meet it."""
    q = queries.select("query_id", F.explode(word_set(F.col("query"))).alias("w"))
    sides = [(word_set(F.col("text")), 1.0), (keyword_set(F.col("keywords")), 2.0), (word_set(F.coalesce(F.col("section"), F.lit(""))), 1.5)]
    terms = None
    for words, weight in sides:
        side = items.select("item_id", F.explode(words).alias("w"), F.lit(weight).alias("weight"))
        terms = side if terms is None else terms.unionByName(side)
    raw = terms.join(q, "w").groupBy("query_id", "item_id").agg(F.sum("weight").alias("raw"))
    best = raw.groupBy("query_id").agg(F.max("raw").alias("best"))
    return raw.join(best, "query_id").select("query_id", "item_id", (F.col("raw") / F.col("best")).alias("score"))


def rank(scores: DataFrame, *, tie: str = "item_id") -> DataFrame:
    """``scores`` with ``rank``, from 1 for each query, by score and then the lesser item.

    One range exchange over all queries at once, so that the items of one query, which may
    be the whole corpus, are sorted in many tasks; each adds what the tasks before it hold."""
    by = ["query_id", F.desc("score"), F.asc(tie)]
    placed = frozen(scores.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    spans = placed.groupBy("query_id", task.alias("__task")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("query_id").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("query_id", "__task", (before + 1 - F.col("__first")).alias("__shift"))
    return placed.withColumn("__task", task).join(spans, ["query_id", "__task"]).withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__task", "__shift")


def rank_all(scores: DataFrame, queries: DataFrame, items: DataFrame, *, block: int = ID_BLOCK) -> DataFrame:
    """``rank`` of all items (integral item_id) for all queries (query_id): those without
    a score come after the others, with score 0, by id.

    Ids are listed by block and rid of the query's matches there, so no pair of a query
    and an item is made but as a row of the result."""
    at = F.floor(F.col("item_id") / block).alias("__b")
    listed = items.select("item_id").distinct().groupBy(at).agg(F.sort_array(F.collect_list("item_id")).alias("__ids"))
    every = listed.crossJoin(F.broadcast(queries.select("query_id").distinct()))
    met = scores.groupBy("query_id", at).agg(F.collect_list("item_id").alias("__met"))
    none = F.array().cast(T.ArrayType(items.schema["item_id"].dataType))
    rest = every.join(met, ["query_id", "__b"], "left").withColumn("__met", F.coalesce("__met", none))
    rest = rest.select("query_id", "__b", F.size("__met").cast("long").alias("__n"), F.array_except("__ids", "__met").alias("__rest"))
    whole = Window.partitionBy("query_id")
    before = F.coalesce(F.sum(F.size("__rest").cast("long")).over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = rest.withColumn("__first", F.sum("__n").over(whole) + before + 1).select("query_id", "__first", F.posexplode("__rest").alias("__pos", "item_id"))
    tail = rest.select("query_id", "item_id", F.lit(0.0).alias("score"), (F.col("__first") + F.col("__pos")).alias("rank"))
    return rank(scores).select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank")).unionByName(tail)


def _dcg(at: Column) -> Column:
    return 1.0 / F.log2(at + 1.0)


def ranking_metrics(ranked: DataFrame, n_relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query, of (query_id, rank, hit) and (query_id, n_relevant): P@k divides by k;
    R@k divides hits by the number of relevant sections, so it may pass 1; NDCG@k
    takes the retrieved gains, sorted, as ideal; MRR looks at the whole ranking."""
    columns = [F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("MRR")]
    for k in ks:
        top = F.col("hit") & (F.col("rank") <= k)
        columns += [F.count_if(top).alias(f"hits_{k}"), F.coalesce(F.sum(F.when(top, _dcg(F.col("rank")))), F.lit(0.0)).alias(f"dcg_{k}")]
    found = n_relevant.join(ranked.groupBy("query_id").agg(*columns), "query_id", "left").na.fill(0)
    out = [F.col("query_id"), F.col("MRR")]
    for k in ks:
        hits = F.col(f"hits_{k}")
        ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when(i <= hits, _dcg(i)).otherwise(0.0))  # noqa: B023  used at once
        out += [(hits / k).alias(f"P@{k}"), F.when(F.col("n_relevant") > 0, hits / F.col("n_relevant")).otherwise(0.0).alias(f"R@{k}"), F.when(hits > 0, F.col(f"dcg_{k}") / ideal).otherwise(0.0).alias(f"NDCG@{k}")]
    return found.select(*out)


def chunk_hit(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, hit): whether any of the ids of (query_id, ids) is among the first k of
    (query_id, item_id, rank); null, which no mean counts, for a query without ids."""
    top = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("item_id").alias("top"))
    none = F.array().cast(relevant.schema["ids"].dataType)
    some = F.arrays_overlap(F.coalesce("top", none), F.col("ids"))
    return relevant.join(top, "query_id", "left").select("query_id", F.when(F.size(F.coalesce("ids", none)) > 0, F.coalesce(some, F.lit(False))).alias("hit"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(f"`{c}`").alias(c) for c in per_query.columns if c != "query_id"])


def badge(value: Column, good: Column, fair: Column, higher: bool = True) -> Column:
    over = (lambda a, b: a >= b) if higher else (lambda a, b: a <= b)
    return F.when(over(value, good), BADGES[0]).when(over(value, fair), BADGES[1]).otherwise(BADGES[2])


def scorecard(metrics: DataFrame, table=SCORECARD) -> DataFrame:
    """(metric, value, status) of the metrics (metric, value) in the table."""
    limits = metrics.sparkSession.createDataFrame(list(table), "metric string, good double, fair double")
    return metrics.join(F.broadcast(limits), "metric").select("metric", "value", badge(F.col("value"), F.col("good"), F.col("fair")).alias("status"))


def recommendations(metrics: DataFrame, table=ADVICE) -> DataFrame:
    """(metric, value, priority) of the rules that fire."""
    rules = metrics.sparkSession.createDataFrame(list(table), "metric string, op string, bound double, priority string")
    fires = F.when(F.col("op") == ">", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    return metrics.join(F.broadcast(rules), "metric").filter(fires).select("metric", "value", "priority")


def coverage(items: DataFrame, section_col: str = "section", reference_prefix: str = "Referensi") -> DataFrame:
    """One row: total, main and reference chunks, and distinct sections."""
    section = F.coalesce(F.col(section_col), F.lit("?"))
    ref = section.startswith(reference_prefix)
    return items.agg(F.count("*").alias("total"), F.count_if(~ref).alias("main"), F.count_if(ref).alias("reference"), F.count_distinct(section).alias("sections"))
