"""Queries over whole tables: no row, text or pair left out."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.operators import metrics, ranking, search
from corpusloom.plans import catalog, queries_search, queries_text  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df().to_dict("records")


def plain_rerank(query, text, section, stop, score):
    q = set(query.lower().split()) - stop
    n = max(len(q), 1)
    return score + 0.12 * len(q & (set(text.lower().split()) - stop)) / n + 0.10 * len(q & set(section.lower().split())) / n


def test_rerank_scores_all_items_with_all_documents(spark):
    stop = {*lexicon.STOPWORDS, "the", "of"}
    found = {(r["item_id"], r["doc_id"]): r["rerank_score"] for r in catalog.QUERIES["rerank"](spark, SF).collect()}
    expected = {(b["item_id"], d["doc_id"]): plain_rerank(b["text"], d["text"], f"{d['source']} {d['lang']}", stop, 0.5) for b in plain("benchmark") for d in plain("documents")}
    assert found.keys() == expected.keys() and max(abs(found[k] - v) for k, v in expected.items()) <= 1e-6


def test_rerank_blocks(spark):
    q = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "x")], "query_id int, query string")
    items = spark.createDataFrame([("i", "A c", "b"), ("j", None, None), ("k", "", "x the"), ("l", "c x", "y")], "item_id string, text string, section string")
    for blocks in ({}, {"query_block": 1, "item_block": 2}):
        found = {(r["query_id"], r["item_id"]): r["rerank_score"] for r in search.rerank_all(q, items, ["the"], score=0.0, **blocks).collect()}
        assert found == {(a, b): pytest.approx(plain_rerank(t or "", u or "", s or "", {"the"}, 0.0)) for a, t in ((1, "a b c"), (2, ""), (3, None), (4, "x")) for b, u, s in (("i", "A c", "b"), ("j", None, None), ("k", "", "x the"), ("l", "c x", "y"))}
    assert search.rerank_all(q.limit(0), items, [], score=0.0).count() == 0


def plain_expansion(text):
    for short, long in lexicon.ABBREVIATIONS:
        text = re.sub(rf"\b{re.escape(short)}\b", f"{long} ({short})", text)
    return text


@pytest.fixture
def early(spark, tmp_path):
    """Documents whose abbreviations, units and typos stand far from their ends, and their texts."""
    texts = {1: "ASI 5g gisi " + "kata " * 100, 2: "x " * 300 + "MPASI 180cm balits " + "y " * 300, 3: "TTD", 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), texts


def test_expand_abbreviations_reads_whole_texts(spark, early):
    found = {r["doc_id"]: r["normal"] for r in catalog.QUERIES["expand_abbreviations"](spark, early[0]).collect()}
    assert found == {k: plain_expansion(t + queries_text._UNITS_TAIL) for k, t in early[1].items()}
    assert found[1].startswith("Air Susu Ibu (ASI) 5g gisi kata")
    found = {r["doc_id"]: r["normal"] for r in catalog.QUERIES["expand_abbreviations"](spark, SF).collect()}
    assert found == {d["doc_id"]: plain_expansion(d["text"] + queries_text._UNITS_TAIL) for d in plain("documents")}


def test_normalize_text_reads_whole_texts(spark, early):
    def normal(text):
        text = plain_expansion(text)
        for names, whole in lexicon.UNITS:
            text = re.sub(rf"(\d+)({names})" + (r"\b" if whole else ""), r"\1 \2", text)
        for wrong, right in lexicon.TYPOS:
            text = re.sub(rf"\b{re.escape(wrong)}\b", right, text, flags=re.I)
        return text

    found = {r["doc_id"]: r["normal"] for r in catalog.QUERIES["normalize_text"](spark, early[0]).collect()}
    assert found == {k: normal(t + queries_text._UNITS_TAIL) for k, t in early[1].items()}
    assert found[1].startswith("Air Susu Ibu (ASI) 5 g gizi kata") and "(MPASI) 180 cm balita y" in found[2]
    found = {r["doc_id"]: r["normal"] for r in catalog.QUERIES["normalize_text"](spark, SF).collect()}
    assert found == {d["doc_id"]: normal(d["text"] + queries_text._UNITS_TAIL) for d in plain("documents")}


def test_cosine_scores_cover_all_vectors(spark):
    rows = plain("embeddings")
    x = np.stack([r["embedding"] for r in rows]).astype(float)
    ids = [r["vec_id"] for r in rows]
    expected = {(a, b): s for a, line in zip(ids, x @ x.T) if a % 20 == 0 for b, s in zip(ids, line)}
    found = {(r["query_id"], r["item_id"]): r["score"] for r in catalog.QUERIES["cosine_scores"](spark, SF).collect()}
    assert found.keys() == expected.keys() and max(abs(found[k] - v) for k, v in expected.items()) <= 1e-6


def test_all_scores_blocks(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in (1, 2, 4, 9, 10)], "item_id long, embedding array<float>")
    q = df.filter("item_id < 9").withColumnRenamed("item_id", "query_id")
    for blocks in ({}, {"query_block": 1, "corpus_block": 2}):
        found = sorted(map(tuple, search.all_scores(q, df, **blocks).collect()))
        assert found == [(a, b, a * b + 1.0) for a in (1, 2, 4) for b in (1, 2, 4, 9, 10)]
    assert search.all_scores(q.limit(0), df).count() == 0


def test_items_that_share_no_word_are_ranked_too(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "nothing shared"), (3, "c")], "query_id long, query string")
    texts = {7: "x", 3: "b", 5: "y", 9: "a b", 4: "c", 6: "z"}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string").withColumns({"keywords": F.array().cast("array<string>"), "section": F.lit("s")})
    expected = {1: [9, 3, 4, 5, 6, 7], 2: [3, 4, 5, 6, 7, 9], 3: [4, 3, 5, 6, 7, 9]}
    for block in (1, 2, 4096):
        found = metrics.rank_all(metrics.lexical_scores(q, items), q, items, block=block).collect()
        assert len(found) == 18
        for k, order in expected.items():
            assert [r["item_id"] for r in sorted((r for r in found if r["query_id"] == k), key=lambda r: r["rank"])] == order
            assert sorted(r["rank"] for r in found if r["query_id"] == k) == [1, 2, 3, 4, 5, 6]
    ranked = metrics.rank_all(metrics.lexical_scores(q, items), q, items).withColumn("hit", F.col("item_id") == 6)
    per = metrics.ranking_metrics(ranked, q.select("query_id", F.lit(1).alias("n_relevant"))).collect()
    assert {r["query_id"]: r["MRR"] for r in per} == {1: 1 / 5, 2: 1 / 4, 3: 1 / 4}


def test_queries_that_match_nothing_count(spark, tmp_path):
    spark.createDataFrame([(0, "d e"), (1, "q"), (2, "c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, t, "l", "s") for k, t in enumerate(["a", "b", "c", "d"])], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    per = {r["query_id"]: r["MRR"] for r in catalog.QUERIES["ir_metrics_per_query"](spark, str(tmp_path)).collect()}
    assert per == {0: 1.0, 1: pytest.approx(1 / 3, abs=1e-6), 2: pytest.approx(1 / 3, abs=1e-6)}
    assert catalog.QUERIES["ir_metrics_avg"](spark, str(tmp_path)).first()["MRR"] == pytest.approx((1 + 1 / 3 + 1 / 3) / 3, abs=1e-6)
    hits = {r["query_id"]: r["hit"] for r in catalog.QUERIES["chunk_hit"](spark, str(tmp_path)).collect()}
    assert hits == {0: "none", 1: "true", 2: "true"}
    assert catalog.QUERIES["lexical_rank"](spark, str(tmp_path)).count() == 12


def test_keyword_filter_takes_all_hits(spark):
    hits = {}
    for r in catalog.QUERIES["vector_topk"](spark, SF).collect():
        hits.setdefault(r["query_id"], []).append((r["query_id"], r["item_id"], r["rank"]))
    wanted = {q: [h for h in some if h[1] % 3 == 0 or h[1] % 7 == 5] or some for q, some in hits.items()}
    found = sorted(tuple(r) for r in catalog.QUERIES["keyword_filter"](spark, SF).collect())
    assert found == sorted(h for some in wanted.values() for h in some)


def test_whole_keywords_count(spark):
    q = spark.createDataFrame([(1, "gizi ibu")], "query_id long, query string")
    rows = [(1, "gizi", ["x"], "s"), (2, "z", ["ibu hamil"], "s"), (3, "z", ["IBU", "ibu", None], "s"), (4, None, None, None)]
    items = spark.createDataFrame(rows, "item_id long, text string, keywords array<string>, section string")
    assert {r["item_id"]: r["score"] for r in metrics.lexical_scores(q, items).collect()} == {1: 0.5, 3: 1.0}


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_first_ranks_are_those_of_the_whole_ranking(spark, block):
    rng = random.Random(3)
    words = "a b c d e f g".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    items = spark.createDataFrame([(k * 7 % 61, some(4), [some(2), rng.choice(words)], rng.choice(["s a", "t", "u", None])) for k in range(61)], "item_id long, text string, keywords array<string>, section string").repartition(5)
    q = spark.createDataFrame([(k, some(5)) for k in range(9)] + [(9, "nothing"), (10, None)], "query_id long, query string")
    relevant = spark.createDataFrame([(k, [["s a"], ["t", "u"], ["none of them"], []][k % 4]) for k in range(10)], "query_id long, sections array<string>")
    ranked = metrics.rank_all(metrics.lexical_scores(q, items), q, items).join(items.select("item_id", "section"), "item_id").join(relevant, "query_id", "left")
    whole = {}
    for r in ranked.orderBy("rank").collect():
        whole.setdefault(r["query_id"], []).append((r["item_id"], r["rank"], r["section"] in (r["sections"] or [])))
    for k in (1, 5, 100):
        found = {}
        for r in ranking.first_ranks(q, items, relevant, k=k, query_block=block).collect():
            found.setdefault(r["query_id"], []).append((r["item_id"], r["rank"], r["hit"]))
        assert found.keys() == whole.keys()
        for query, rows in found.items():
            first = next((x for x in whole[query] if x[2]), None)
            assert sorted(rows, key=lambda x: x[1]) == whole[query][:k] + ([first] if first and first[1] > k else [])
    assert ranking.first_ranks(q, items.limit(0), relevant).count() == 0 == ranking.first_ranks(q.limit(0), items, relevant).count()


def test_terms_within_terms_are_all_found(spark):
    from corpusloom.operators import enrich

    table = {"a": ["gizi buruk"], "b": ["gizi"], "c": ["buruk sekali", "zi b"], "d": [""], "e": [], "f": ["uruk"], "g": ["none"]}
    rows = spark.createDataFrame([(1, "Gizi Buruk"), (2, ""), (3, None), (4, "GIZI buruk sekali")], "id long, text string")
    found = {r["id"]: r["tags"] for r in rows.select("id", enrich.keyword_tags(F.col("text"), table).alias("tags")).collect()}
    assert found == {1: ["a", "b", "c", "d", "f"], 2: ["d"], 3: [], 4: ["a", "b", "c", "d", "f"]}
    assert [r[0] for r in rows.select(enrich.keyword_tags(F.col("text"), {})).collect()] == [[], [], [], []]


def test_guards_change_no_result(spark):
    from corpusloom.functions import clean

    texts = ["STUNTIG ſtuntig stuntıg STUNTİG Stuntig", "xSTUNTIG stuntig_ balits", "BALITS baKits", "ASI ASIx (ASI) MPASI ASI", "", None, "kata biasa"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    plain = F.col("text")
    for wrong, right in lexicon.TYPOS:
        plain = F.regexp_replace(plain, rf"(?iU)\b{re.escape(wrong)}\b", right)
    expanded = F.col("text")
    for short, long in lexicon.ABBREVIATIONS:
        expanded = F.regexp_replace(expanded, rf"(?U)\b{re.escape(short)}\b", f"{long} ({short})")
    for r in rows.select(plain.alias("a"), clean.fix_typos(F.col("text"), lexicon.TYPOS).alias("b"), expanded.alias("c"), clean.expand_abbreviations(F.col("text"), lexicon.ABBREVIATIONS).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]


@pytest.mark.parametrize(("block", "cells"), [(2, 3), (3, 40), (4096, 1_000_000)])
def test_whole_ranking_needs_no_sort_of_pairs(spark, block, cells):
    rng = random.Random(5)
    words = "a b c d e f g".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    items = spark.createDataFrame([(k * 7 % 61 - 20, some(4), [some(2), rng.choice(words)], rng.choice(["s a", "t", "u", None])) for k in range(61)], "item_id long, text string, keywords array<string>, section string").repartition(5)
    q = spark.createDataFrame([(k, some(5)) for k in range(9)] + [(9, "nothing"), (10, None)], "query_id long, query string")
    found = ranking.whole_ranking(q, items, query_block=block, cells=cells)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" not in plan
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == 11 * 61 and rows == sorted((r["query_id"], r["item_id"], r["score"], r["rank"]) for r in metrics.rank_all(metrics.lexical_scores(q, items), q, items).collect())
    assert ranking.whole_ranking(q.limit(0), items).count() == 0 == ranking.whole_ranking(q, items.limit(0)).count()


def test_whole_ranking_ranks_rows_without_an_id_last(spark):
    items = spark.createDataFrame([(None, "x"), (5, "x"), (5, "a"), (None, "a"), (-1, "x")], "item_id long, text string").withColumns({"keywords": F.array().cast("array<string>"), "section": F.lit("s")})
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    found = ranking.whole_ranking(q, items).orderBy("rank").collect()
    assert [(r["item_id"], r["score"], r["rank"]) for r in found] == [(5, 1.0, 1), (None, 1.0, 2), (-1, 0.0, 3), (5, 0.0, 4), (None, 0.0, 5)]


def test_lexical_rank_makes_no_row_for_a_pair_before_the_result(spark):
    plan = catalog.QUERIES["lexical_rank"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_blocks_of_all_scores_send_few_copies(spark, monkeypatch):
    """Vectors are sent once for each block of the other side; a task's pairs are bounded."""
    df, given, deal = spark.createDataFrame([(20, [1.0])], "item_id long, embedding array<float>"), [], search._deal
    monkeypatch.setattr(search, "_deal", lambda *a: given.extend(a[4:6]) or deal(*a))
    assert search.all_scores(df.withColumnRenamed("item_id", "query_id"), df).count() == 1
    assert sum(1 / n for n in given) <= 2 / 1024 and given[0] * given[1] <= 1 << 20


def test_cosine_scores_are_stored_in_few_bytes(spark, tmp_path):
    """Like scores lie side by side in large blocks, so column files keep them once."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((9000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    made = pa.table([pa.array(np.arange(9000)), pa.array(list(x)), pa.array(np.arange(9000) % 10)], ["vec_id", "embedding", "label"])
    pq.write_table(made, tmp_path / "embeddings.parquet")
    catalog.QUERIES["cosine_scores"](spark, str(tmp_path)).write.parquet(out := str(tmp_path / "out"))
    got, full = pq.read_table(out), np.full((450, 9000), np.nan)
    full[got["query_id"].to_numpy() // 20, got["item_id"].to_numpy()] = got["score"].to_numpy()
    assert len(got) == full.size and np.abs(full - x[::20].astype(float) @ x.T.astype(float)).max() < 5.1e-7
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * full.size


def test_stored_scores_are_those_of_all_pairs(spark, monkeypatch):
    rows = [(k, [float(k), 1.0]) for k in (1, 2, 4, 9, 10)] + [(3, [1.0]), (5, [2.0]), (6, None), (7, []), (8, [None, 1.0]), (None, [1.0, 1.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    q = df.filter("item_id < 9").select(F.col("item_id").cast("int").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    expected = sorted((r["query_id"], r["item_id"], r["score"]) for r in search.all_scores(q, df).collect())
    assert len(expected) == 4 * 6 + 4
    for least, blocks in ((1 << 22, {}), (1, {}), (1 << 22, {"query_block": 1, "corpus_block": 2})):
        monkeypatch.setattr(search, "STORED_PAIRS", least)
        found = search.stored_scores(q, df, 6, **blocks)
        assert found.dtypes == search.all_scores(q, df).dtypes
        assert sorted(map(tuple, found.collect())) == expected
    assert search.stored_scores(q.limit(0), df, 6).count() == 0 == search.stored_scores(q, df.limit(0), 6).count()


@pytest.mark.parametrize("kind", ["spread", "equal", "overflow"])
def test_bands_give_each_pair_once_and_like_scores_together(kind):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((60, 8)), rng.standard_normal((70, 8))
    if kind == "equal":
        x[:], y[:] = 1.0, 2.0
    if kind == "overflow":
        x[::3, 0] = y[::2, 0] = 1e200
    for held, tile in ((1 << 23, 1 << 20), (500, 140), (1, 70)):
        runs = list(search._alike(x, y, 1, held, tile))
        i, j, s = (np.concatenate(z) for z in zip(*runs, strict=True))
        assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(60) for b in range(70)]
        assert max(len(z[0]) for z in runs) <= 5 * held // 4 + max(tile, 70)
        with np.errstate(all="ignore"):
            np.testing.assert_allclose(s, (x @ y.T)[i, j], rtol=1e-9, atol=0.05 + 1e-9)
        if kind == "spread" and held > 1 << 20:
            assert 1 + np.count_nonzero(np.diff(s)) == len(np.unique(s))


def test_stored_scores_round_as_sql():
    values = [0.0000005, -0.0000005, 0.0000015, 2.5e-6, 0.1234565, -0.9999995, 0.4999999999e-6, 1e300, -3.0, 7.0000005]
    found = search._rounded(np.array(values), 1e6).tolist()
    assert found == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert not np.signbit(search._rounded(np.array([-1e-9]), 1e6))[0]
