"""Small cases with known results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import clean, embed, tokens, vectors
from corpusloom.operators import answer, enrich, metrics, postings, present, search, segment
from corpusloom.plans.engine import Engine, ingest
from corpusloom.sources import corpus


def value(spark, column, **cells):
    kinds = {str: "string", int: "int", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [("2.500 gram 21,6%", "2500 gram 21.6%"), ("1.234.567", "1234.567"), ("1,2,3", "1.2,3")])
def test_numbers(spark, text, expected):
    assert value(spark, clean.clean_numbers(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [("a\n====\nb", "a\n\nb"), ("é", "é"), ("﻿a\x00b", "ab"), ("a  \r\nb\t c", "a\nb  c"), ("‛x‟ ‘y’ – —", "'x\" ‘y’ - -"), ("• a\n✓\n\nb", "- a\n- b"), ("a\n\n\n\nb", "a\n\nb"), ("  a \n", "a"), ("a b", "a\nb")],
)
def test_clean_text(spark, text, expected):
    assert value(spark, clean.clean_text(F.col("t")), t=text) == expected


def test_normalize(spark):
    out = value(spark, clean.normalize_text(F.col("t"), abbreviations=lexicon.ABBREVIATIONS, units=lexicon.UNITS, typos=lexicon.TYPOS), t="MPASI 5g GISI 7% balits 3kgx")
    assert out == "Makanan Pendamping ASI (MPASI) 5 g gizi 7 % balita 3kgx"


def test_sentences(spark):
    assert value(spark, segment.sentences(F.col("t")), t="Menurut dr. Ani hadir. Lalu pulang.") == ["Menurut dr.", "Ani hadir.", "Lalu pulang."]


def test_chunks(spark):
    parts = ["a b c", "d e f", "g h", "i j k l m n o p q", "r"]
    assert value(spark, segment.chunk_words(F.col("p"), size=6, overlap=2, least=0), p=parts) == ["a b c\n\nd e f", "e f\n\ng h", "g h\n\ni j k l m n o p q", "p q\n\nr"]
    assert value(spark, segment.chunk_words(F.col("p"), least=50), p=["short"]) == []


def test_sections(spark):
    text = "gone\n[SEKSI 1] One\nbody\n[seksi 2] Two"
    assert [tuple(s) for s in value(spark, segment.sections(F.col("t")), t=text)] == [("1", "One", "One\nbody"), ("2", "Two", "Two")]
    assert [tuple(s) for s in value(spark, segment.sections(F.col("t")), t="plain")] == [("0", "Dokumen Stunting", "plain")]
    assert [tuple(s) for s in value(spark, segment.subsections(F.col("t")), t="lead\nA. x\nbody\nB. y\n")] == [("Pendahuluan", "lead"), ("A. x", "body")]
    assert [tuple(s) for s in value(spark, segment.subsections(F.col("t")), t="plain")] == [("Umum", "plain")]


@pytest.mark.parametrize("raw,expected", [("7", "000007"), ("ab", "0000ab"), ("R123456789", "R123456789")])
def test_reference_id(spark, raw, expected):
    assert value(spark, enrich.padded_id(F.col("t")), t=raw) == expected


def test_expand_query(spark):
    assert value(spark, search.expand_query(F.col("t"), {"t": ["s1", "s2"]}), t="x s1 y") == "x s1 y s2"
    assert value(spark, search.expand_query(F.col("t"), {"q": ["s1"]}), t="other") == "other"


def test_index(spark):
    docs = spark.createDataFrame([(1, "a  b A")], "doc_id long, text string")
    assert sorted(r["term"] for r in postings.postings(docs).collect()) == ["", "a", "a", "b"]
    assert {r["term"]: r["doc_ids"] for r in postings.inverted_index(docs).collect()} == {"": [1], "a": [1], "b": [1]}
    assert value(spark, postings.intersect(F.col("a"), F.col("b")), a=["1", "2", "3"], b=["2", "3", "9"]) == ["2", "3"]
    assert postings.boolean_and(docs, "a", "zzz").count() == 0


@pytest.mark.parametrize("n,out,mode", [(0, "presiden", "OUT OF SCOPE"), (0, "gizi", "GENERAL KNOWLEDGE"), (1, "presiden", "DATABASE RAG")])
def test_route(spark, n, out, mode):
    assert value(spark, answer.route(F.col("n"), answer.out_of_scope(F.col("q"), lexicon.OUT_OF_SCOPE, lexicon.IN_SCOPE)), n=n, q=out) == mode


GAINS = [("001", {"NDCG@3": 0.5, "MRR": 1 / 3}), ("011", {"NDCG@3": 0.6934264}), ("101", {"NDCG@3": 0.9197208}), ("10110", {"NDCG@5": 0.9060254}), ("00011", {"NDCG@5": 0.5012658}), ("00000000001", {"MRR": 1 / 11}), ("111", {"R@3": 3.0, "P@3": 1.0})]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(q, k + 1, g == "1") for q, (gains, _) in enumerate(GAINS) for k, g in enumerate(gains)], "query_id int, rank int, hit boolean")
    found = {r["query_id"]: r for r in metrics.ranking_metrics(ranked, spark.createDataFrame([(q, 1) for q in range(len(GAINS))], "query_id int, n_relevant int")).collect()}
    for q, (_, expected) in enumerate(GAINS):
        for k, v in expected.items():
            assert found[q][k] == pytest.approx(v, abs=1e-6)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<float>")
    q = df.filter("item_id < 9").withColumnRenamed("item_id", "query_id")
    for blocks in ({}, {"query_block": 4, "corpus_block": 13}):
        found = {(r["query_id"], r["rank"]): r["item_id"] for r in search.vector_topk(q, df, 5, **blocks).collect()}
        for i in range(9):
            s = x.astype(float) @ x[i].astype(float)
            assert [found[i, k + 1] for k in range(5)] == sorted(range(60), key=lambda j: (-s[j], j))[:5]
    assert search.vector_topk(q.limit(0), df, 5).count() == 0


def test_neighbours_and_filter(spark):
    order = spark.createDataFrame([(f"c{i}", i) for i in range(6)], "chunk_id string, ordinal int")
    hits = spark.createDataFrame([(1, "c1", 0.9, 1), (1, "c3", 0.8, 2)], "query_id int, chunk_id string, score double, place int")
    found = {r["chunk_id"]: (round(r["score"], 4), r["is_context"]) for r in search.with_neighbours(hits, order).collect()}
    assert found == {"c1": (0.9, False), "c3": (0.8, False), "c0": (0.63, True), "c2": (0.63, True), "c4": (0.56, True)}
    tagged = hits.withColumn("keywords", F.array(F.col("chunk_id")))
    assert search.keyword_filter(tagged, ["c3"]).count() == 1
    assert search.keyword_filter(tagged, ["none"]).count() == 2


def test_context_budget(spark):
    parts = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "y" * 200), (1, 3, "z" * 10), (2, 1, "w" * 120), (2, 2, "v" * 120)], "query_id int, place int, part string")
    found = [(r["query_id"], r["place"], len(r["part"])) for r in answer.context_budget(parts, max_chars=160).orderBy("query_id", "place").collect()]
    assert found == [(1, 1, 50), (1, 2, 113), (2, 1, 120)]


def test_pairs_and_moments(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id int, label int, embedding array<double>")
    s = x @ x.T
    i, j = np.triu_indices(30, 1)
    one = metrics.pair_extremes(df, id_col="vec_id", block=7).first()
    assert one["n_pairs"] == 435 and one["cosine_max"] == pytest.approx(s[i, j].max())
    assert one["uniformity_loss"] == pytest.approx(math.log(np.exp(-2 * (2 - 2 * s[i, j])).mean()))
    same = (i % 3) == (j % 3)
    c = metrics.coherence(df).first()
    assert c["intra_mean"] == pytest.approx(s[i, j][same].mean()) and c["inter_std"] == pytest.approx(s[i, j][~same].std())
    assert {(r["a"], r["b"]) for r in metrics.near_duplicate_pairs(df, 0.8, id_col="vec_id", block=7).collect()} == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if s[a, b] >= 0.8}
    assert metrics.pair_extremes(df.limit(1), id_col="vec_id").first()["uniformity_loss"] is None
    none = df.limit(0)
    assert metrics.coherence(none).count() == metrics.section_coherence(none).count() == metrics.pca_geometry(none).count() == 0
    assert metrics.near_duplicate_pairs(none, id_col="vec_id").count() == 0
    lone = metrics.section_coherence(df.limit(1)).first()
    assert lone["avg_sim"] is None and lone["std_sim"] is None
    p = metrics.pca_geometry(df).first()
    assert sum(p["top5"]) == pytest.approx(1.0) and p["dims_95"] <= 4


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.norm(F.col("a")).alias("n"), vectors.l2_normalize(F.col("a")).alias("u"), vectors.l2_normalize(F.col("b")).alias("z")).first()
    assert r["n"] == 5.0 and r["u"] == [0.6, 0.8] and r["z"] == [0.0, 0.0]


def test_words(spark):
    assert value(spark, tokens.words(F.col("t")), t=" a b c\n") == ["a", "b", "c"]


def test_inline_markup(spark):
    out = value(spark, present.inline_markup(F.col("t")), t="**b** *e* `c` <i> (Sumber: " + "s" * 60 + ")")
    assert out.startswith("<strong>b</strong> <em>e</em> <code>c</code> &lt;i&gt;<span ") and ">Sumber: " + "s" * 52 + "…<" in out


def test_blocks(spark):
    text = "## H\n1. Top\n\n1. a\n2. b\n- x\n  - y\nz"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = [(r["kind"], r["html"]) for r in present.blocks(df, ["id"]).orderBy("block").collect()]
    assert [k for k, _ in found] == ["heading", "heading", "gap", "ordered", "bullet", "text"]
    assert found[4][1] == '<ul class="bul"><li>x</li><li class="sub">y</li></ul>'


def test_embedders(spark):
    with pytest.raises(ValueError):
        embed.load_embedder("nothing")
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    found = {r["id"]: r["embedding"] for r in embed.embed(df, embed.load_embedder("hashing", dim=8), F.col("text")).collect()}
    assert sum(x * x for x in found[1]) == pytest.approx(1.0, abs=1e-6) and found[2] == [0.0] * 8
    assert value(spark, embed.embed_text(F.col("s"), F.col("u"), F.col("t")), s="", u="", t="x") == "x"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("satu\ndua")
    assert [tuple(r) for r in corpus.read_corpus(spark, f"{tmp_path}/a.txt").collect()] == [("a.txt", "satu\ndua")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_corpus(spark, f"{tmp_path}/none.txt").count()
    assert corpus.read_references(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"references": [{"id": 7, "judul": "J", "penulis": ["A", "B"], "poin_kunci": ["p"]}]}))
    ref = enrich.reference_chunks(corpus.read_references(spark, f"{tmp_path}/r.json")).first()
    assert ref["chunk_id"] == "ref_000007" and ref["text"].endswith("Poin Kunci:\n- p") and ref["section"] == "Referensi Ilmiah - Umum"
    chunks = spark.createDataFrame([("c1", 0, "x", [1.0]), ("c1", 1, "y", [2.0])], "chunk_id string, ordinal int, text string, embedding array<float>")
    corpus.write_chunks(chunks, f"{tmp_path}/c", settings={"chunk_size_target": 200})
    assert corpus.read_chunks(spark, f"{tmp_path}/c").count() == 2
    assert spark.read.parquet(f"{tmp_path}/c/manifest").first()["total_chunks"] == 2
    corpus.write_vectors(chunks, f"{tmp_path}/v", model="m")
    assert corpus.read_vectors(spark, f"{tmp_path}/v", precision="double").dtypes[1][1] == "array<double>"
    assert tuple(corpus.chunk_map(chunks).select("ordinal", "text").first()) == (0, "y")


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([(1, "[SEKSI 1] Gizi\n\nGizi anak penting untuk tumbuh kembang anak dan ibu hamil di rumah.", "a.txt")], "doc_id long, text string, source string")
    refs = spark.createDataFrame([("1", "J", "2020", ["A"], "k", "r", ["p"], ["t"], None, None)], "id string, judul string, tahun string, penulis array<string>, kategori string, ringkasan string, poin_kunci array<string>, relevansi_topik array<string>, doi string, url string")
    chunks = ingest(docs, source_col="source", references=refs)
    assert chunks.count() == 2
    engine = Engine.build(chunks, embed.HashingEmbedder(64), answer.ExtractiveGenerator())
    engine.save(f"{tmp_path}/v")
    asked = spark.createDataFrame([(1, "gizi anak penting untuk tumbuh"), (2, "harga bitcoin"), (3, "")], "query_id long, query string")
    found = {r["query_id"]: r for r in Engine.load(spark, f"{tmp_path}/v", engine.embedder, engine.generator).answer(asked).collect()}
    assert found[1]["mode"] == "DATABASE RAG" and found[2]["mode"] == "OUT OF SCOPE" and found[3]["mode"] == "GENERAL KNOWLEDGE"
    assert all(r["ok"] for r in found.values())
    none = Engine(engine.chunks, engine.embedder).answer(asked).collect()
    assert not any(r["ok"] for r in none) and "not set up" in none[0]["response"]


def test_stream(spark, tmp_path):
    from corpusloom.streaming.ingest import chunk_stream

    spark.createDataFrame([(1, "x y z " * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    q = chunk_stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("chunks").start()
    try:
        q.processAllAvailable()
        assert spark.table("chunks").count() == 1
    finally:
        q.stop()


BIG = 2**53 + 1


def test_ids_beside_a_null_stay_whole(spark):
    df = spark.createDataFrame([(BIG, "a b", [1.0, 0.0]), (None, "c", [0.0, 1.0]), (3, None, [1.0, 0.1])], "id long, text string, embedding array<double>").coalesce(1)
    assert {r["id"] for r in embed.embed(df.drop("embedding"), embed.HashingEmbedder(4), F.col("text")).collect()} == {BIG, None, 3}
    assert {r["id"] for r in answer.generate(df.withColumn("prompt", F.lit("p")), answer.ExtractiveGenerator()).collect()} == {BIG, None, 3}
    hits = search.vector_topk(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id"), 5).collect()
    assert {(r["query_id"], r["item_id"]) for r in hits} == {(a, b) for a in (BIG, 3) for b in (BIG, 3)}
    assert {(r["a"], r["b"]) for r in metrics.near_duplicate_pairs(df, 0.5, id_col="id").collect()} == {(3, BIG)}


ODD = [(10, None), (11, []), (12, [float("nan"), 1.0]), (13, [float("inf"), 1.0]), (14, [None, 1.0]), (15, [1.0])]


def test_unusable_vectors_take_no_part(spark):
    good = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    clean = spark.createDataFrame(good, schema).withColumn("label", F.col("vec_id") % 2)
    dirty = spark.createDataFrame(good + ODD, schema).withColumn("label", F.col("vec_id") % 2).repartition(3)
    q = clean.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    for f in (lambda d: search.vector_topk(q, d, 3, item_id="vec_id"), lambda d: search.all_scores(q, d, item_id="vec_id"), lambda d: metrics.near_duplicate_pairs(d, 0.5, id_col="vec_id"), lambda d: metrics.pair_extremes(d, id_col="vec_id")):
        assert sorted(map(str, f(dirty).collect())) == sorted(map(str, f(clean).collect()))
    short = dirty.filter("vec_id <> 15")
    for f in (metrics.coherence, metrics.section_coherence, metrics.pca_geometry):
        assert sorted(map(str, f(short).collect())) == sorted(map(str, f(clean).collect()))
        with pytest.raises(ValueError, match="several lengths"):
            f(dirty)
    only = spark.createDataFrame([(15, [1.0]), (16, [2.0])], schema).withColumn("label", F.lit(0))
    assert search.vector_topk(q, only, 3, item_id="vec_id").count() == 0
    empty = metrics.pair_extremes(spark.createDataFrame(ODD[:5], schema), id_col="vec_id").first()
    assert (empty["n_pairs"], empty["uniformity_loss"], empty["cosine_max"]) == (0, None, 0.0)


def test_geometry_equals_numpy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = np.stack([r["embedding"] for r in rows.collect()]).astype(float)
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    share = values / values.sum()
    p = metrics.pca_geometry(rows).first()
    assert [p["dims_80"], p["dims_90"], p["dims_95"]] == [int((np.cumsum(share) < t).sum()) + 1 for t in (0.8, 0.9, 0.95)]
    assert p["top5"] == pytest.approx(share[:5].tolist()) and p["isotropy"] == pytest.approx(values[-1] / values[0], rel=1e-6) and p["compression"] == p["dims_90"] / 64


def test_ranks_over_many_tasks(spark):
    rng = np.random.default_rng(8)
    rows = [(int(q), i, float(s)) for q in (1, 2) for i, s in enumerate(rng.integers(0, 9, 400))]
    got = metrics.rank(spark.createDataFrame(rows, "query_id long, item_id long, score double").repartition(7)).collect()
    for q in (1, 2):
        order = [r[1] for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))]
        assert [r["item_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == order


def test_index_blocks(spark):
    docs = spark.createDataFrame([(i, f"all t{i % 3}") for i in range(10)], "doc_id long, text string")
    found = {(r["term"], r["block"]): r["doc_ids"] for r in postings.index_blocks(docs, span=4).collect()}
    assert found["all", 0] == [0, 1, 2, 3] and found["all", 2] == [8, 9] and found["t1", 1] == [4, 7]
    assert {r["term"]: r["doc_ids"] for r in postings.inverted_index(docs).collect()}["all"] == list(range(10))


def test_composition(spark):
    for text in ("é", "각", "Å K", "q̣̇ ﬁ", "plain • – ä"):
        import unicodedata

        assert value(spark, clean.nfc(F.col("t")), t=text) == unicodedata.normalize("NFC", text)
    import sys
    import unicodedata

    kept = clean.re.compile(clean.COMPOSABLE.replace(r"\x{0}", r"\x00").replace(r"\x{", r"\u").replace("}", "").replace(r"\u2ff", r"˿"))
    assert all(kept.match(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c) or 0x1100 <= c <= 0x11FF)


def test_generators(spark):
    class Fussy:
        def generate(self, prompts):
            if "bad" in prompts:
                raise ValueError("no")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, prompt string").coalesce(1)
    got = {r["id"]: (r["response"], r["ok"]) for r in answer.generate(df, Fussy()).collect()}
    assert got == {1: ("A", True), 2: ("No answer: no", False), 3: ("C", True)}
    said = []
    chat = answer.ChatGenerator(lambda: lambda messages, **options: said.append((messages, options)) or "fine", "m", system="Be brief.")
    assert chat.generate(["q"]) == ["fine"] and said[0][0][0] == {"role": "system", "content": "Be brief."} and said[0][1] == {"model": "m", "temperature": 0.5, "max_tokens": 4096}
    prompts = spark.createDataFrame([(m,) for m in answer.MODES], "mode string").select("mode", answer.build_prompt(F.col("mode"), F.lit("why?"), F.lit("\n\nctx"), system="Rules.").alias("p")).collect()
    assert all(r["p"].startswith("Rules.\n\n[MODE: " + r["mode"]) and "Question: why?" in r["p"] and ("ctx" in r["p"]) == (r["mode"] == answer.MODES[2]) for r in prompts)


def test_masked_mean():
    x = embed.masked_mean(np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]] * 3]), np.array([[1, 1, 0], [0, 0, 0]]))
    assert x.tolist() == [[2.0, 3.0], [0.0, 0.0]]
    assert embed.load_embedder("sentence", model="/models/x", dim=384, device="cpu").max_length == 512


@pytest.fixture(scope="module")
def engine(spark):
    chunks = spark.createDataFrame([("c1", "gizi anak penting untuk tumbuh kembang", "Gizi", "Umum", "a.txt"), ("c2", "air bersih dan sanitasi", "Air", "Umum", "a.txt")], "chunk_id string, text string, section string, subsection string, source_file string")
    return Engine.build(chunks, embed.HashingEmbedder(64), answer.ExtractiveGenerator())


def test_chat(spark, engine, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from corpusloom.plans.engine import shared_engine
    from corpusloom.streaming import chat

    written = engine.written(f"{tmp_path}/index")
    assert shared_engine(spark, "e", lambda: written) is shared_engine(spark, "e", lambda: None)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"query_id": "7", "query": "gizi anak penting untuk tumbuh"}\n{"query_id": "8"}\n')
    chat.answer_stream(spark, written, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", available_now=True).awaitTermination()
    got = {r["query_id"]: r["response"] for r in spark.read.schema("query_id string, response string").json(f"{tmp_path}/out/batch=0").collect()}
    assert got == {"7": "gizi anak penting untuk tumbuh kembang", "8": "[MODE: GENERAL KNOWLEDGE]"}
    server = chat.chat_server(written, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    post = lambda path, body: json.loads(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=body, method="POST"), timeout=60).read())
    try:
        assert post("/chat", b'{"query": "harga bitcoin"}') == {"response": "[MODE: OUT OF SCOPE]"}
        assert post("/chat", b"{}") == {"response": "[MODE: GENERAL KNOWLEDGE]"}
        for path, body in (("/none", b"{}"), ("/chat", b"[not json")):
            with pytest.raises(urllib.error.HTTPError):
                post(path, body)
    finally:
        server.shutdown()
    said = []
    assert chat.converse(written, ["  ", "harga bitcoin\n", "exit", "gizi"], said.append) == 1 and said == ["[MODE: OUT OF SCOPE]"]


def test_report_command(spark, tmp_path, capsys):
    from corpusloom.plans import evaluation

    np.savez(tmp_path / "v.npz", embeddings=np.eye(3), chunk_ids=np.array(["c1", "c2", "c3"]))
    rows = [{"chunk_id": f"c{i}", "text": f"kata {i} gizi", "section": f"s{i % 2}", "keywords": ["k"]} for i in (1, 2, 3)]
    (tmp_path / "m.json").write_text(json.dumps({"metadata": {}, "chunks": rows}))
    (tmp_path / "t.json").write_text(json.dumps({"query": "kata 1", "relevant_sections": ["s1"], "relevant_chunk_ids": ["c1"]}))
    evaluation.main(["--npz", f"{tmp_path}/v.npz", "--meta", f"{tmp_path}/m.json", "--report", f"{tmp_path}/r", "--truth", f"{tmp_path}/t.json"], spark)
    lines = capsys.readouterr().out.splitlines()
    assert "coherence: cosine_max = 0.0000" in lines and "retrieval: P@1 = 1.0000" in lines and "retrieval: chunk_hit@3 = 1.0000" in lines and "coverage: total = 3.0000" in lines
    report = corpus.read_report(spark, f"{tmp_path}/r")
    assert {r["part"] for r in report.select("part").distinct().collect()} == set(evaluation.PARTS)
    body = {r["part"]: json.loads(r["body"]) for r in evaluation.report_json(report).collect()}
    assert body["coverage_sections"] == {"s0/n_chunks": 1.0, "s1/n_chunks": 2.0} and body["scorecard"]["MRR"] == {"value": 1.0, "note": "BAIK"}
    assert [tuple(r) for r in corpus.read_npz(spark, f"{tmp_path}/v.npz").filter("ordinal = 1").collect()] == [("c2", 1, [0.0, 1.0, 0.0])]
    (tmp_path / "none.json").write_text("{}")
    assert corpus.read_chunk_file(spark, f"{tmp_path}/none.json").count() == 0
    empty = evaluation.evaluate(spark.createDataFrame([], "chunk_id string, embedding array<double>, section string"), spark.createDataFrame([], "item_id long, text string, keywords array<string>, section string"), spark.createDataFrame([], "query_id long, query string"), spark.createDataFrame([], "query_id long, sections array<string>, ids array<long>"))
    assert {r["metric"]: r["value"] for r in empty.filter("part = 'coverage'").collect()} == {"total": 0.0, "main": 0.0, "reference": 0.0, "sections": 0.0}


def test_a_failed_answer_counts_and_leaves_the_time(spark):
    from corpusloom.operators import session

    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string, time string, elapsed string")
    asked = spark.createDataFrame([(1, " satu ", "2024-01-01 09:05:59"), (2, "  ", "2024-01-01 09:00:00"), (3, "tiga", None)], "conv_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    said = spark.createDataFrame([(1, "jawab", None, 1.5, "2024-01-01 09:06:01"), (3, None, "boom", 2.0, None)], "conv_id long, response string, error string, took double, at string").withColumn("at", F.to_timestamp("at"))
    once = session.process(empty, asked, said)
    again = session.process(once, asked.filter("conv_id = 1"), said.filter("conv_id = 3").withColumn("conv_id", F.lit(1).cast("long")))
    rows = [tuple(r) for r in again.orderBy("conv_id", "turn").collect()]
    assert rows[:2] == [(1, 0, "user", "satu", "09:05", ""), (1, 1, "assistant", "jawab", "09:06", "1.5")]
    assert rows[3] == (1, 3, "assistant", session.FAILED.format("boom"), "09:05", "") and rows[5][4:] == (None, "")
    stats = {r["conv_id"]: tuple(r)[1:] for r in session.latency_stats(again, F.col("conv_id") == 1).collect()}
    assert stats == {1: (2, 2, "1.5", "OK"), 3: (1, 1, session.NO_TIME, "ERR")}
    html = session.timed_transcript(again.filter("conv_id = 1")).first()["html"]
    assert "09:06 · 1.5s" in html and html.count("·") == 1
