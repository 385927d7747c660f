"""The pipeline's stages, each on its own input and all in a row."""

import corpus_pipeline
import pytest
import test_operators as plain
from pyspark.sql import functions as F

from corpusloom.llm import catalog, langid, secrets

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = "A line that is certainly longer than forty characters, and shared by many."
BODY = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, f"{LONG}\nthe first text of its own kind", "en", "s", 1),
    (2, f"{LONG}\nthe second of them all is here", "en", "s", 1),
    (3, f"{LONG}\nand a third one follows closely", "en", "s", 1),
    (4, f"{LONG}\nfour texts have it up to now", "en", "s", 1),
    (5, LONG, "en", "s", 1),
    (6, f"{LONG}\nsix comes last and may keep it", None, "s", 1),
    (7, BODY, "en", "s", 1),
    (8, f"{BODY} tail", "en", "s", 1),
    (9, 'the token = "0123456789abcdef0123456789abcdef" stays hidden', "en", "s", 1),
    (10, "12 34 .. !!", "en", "s", 1),
    (11, None, "en", "s", 1),
    (None, "nobody numbered this text but it has words", "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_the_columns(spark, docs):
    taken = docs.withColumns({c: F.lit(c) for c in ("score", "lang_pred", "n_lines", "kept", "kept_id", "base_spans", "id")})
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, taken, SF)
        assert out.columns == taken.columns, name
        assert {r["score"] for r in out.select("score").collect()} <= {"score"}, name
    assert corpus_pipeline.STAGES[-1][1](spark, taken, SF).count() >= len(ROWS)


def test_empty_table(spark, docs):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0, name


def test_language_id(spark, docs):
    kept = {r["doc_id"]: r["lang"] for r in stage("language_id")(spark, docs, SF).collect()}
    assert set(kept) == {k for k, *_ in ROWS} - {10, 11} and kept[6] == "en"


def test_line_dedup(spark, docs):
    kept = {r["doc_id"]: r for r in stage("line_dedup")(spark, docs, SF).collect()}
    assert 5 not in kept and set(kept) == {k for k, *_ in ROWS} - {5}
    assert kept[1]["text"] == "the first text of its own kind" and kept[1]["n_chars"] == 30
    assert kept[6]["text"].startswith(LONG)


def test_near_dedup(spark, docs):
    kept = {r["doc_id"] for r in stage("minhash_near_dedup")(spark, docs, SF).collect()}
    assert kept == {k for k, *_ in ROWS} - {8}


def test_secrets(spark, docs):
    kept = {r["doc_id"]: r["text"] for r in stage("secret_scans")(spark, docs, SF).collect()}
    assert len(kept) == len(ROWS) and kept[9] == 'the [SECRET]" stays hidden' and kept[7] == BODY


def test_packing(spark, docs):
    rows = stage("best_fit_packing")(spark, docs, SF).collect()
    plain.check_packing(rows, [(k, t) for k, t, *_ in ROWS])


def plain_mask(text, model):
    base = plain.plain_spans(text)
    out, at = "", 0
    for a, _, b in sorted([*base, *plain.plain_markov(text, model, base)]):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_whole_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.filter(~langid.fold()))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(k, t) for k, t in rows if any(c.isalpha() for c in t) and plain.plain_language(model, t)[1] >= corpus_pipeline.MIN_SCORE]
    rows = [(k, t) for k, _, lost, t in plain.plain_line_dedup(rows) if not lost or t.split()]
    component = plain.plain_components(rows, plain.plain_sets(rows), 80)
    rows = [r for r, c in zip(rows, component, strict=True) if r[0] == c]
    markov = secrets.train_on(spark.createDataFrame(rows, "doc_id long, text string"))
    rows = [(k, plain_mask(t, markov)) for k, t in rows]
    assert 0.7 * docs.count() < len(rows) < docs.count()
    plain.check_packing(corpus_pipeline.run(spark, SF).collect(), rows)


def test_catalogue_names():
    numbers = [int(n[2:].split("_")[0]) for n in catalog.QUERIES]
    assert sorted(numbers) == list(range(1, 13))


def test_near_dedup_joins_the_ids_that_go(spark, monkeypatch):
    """They are fewer than those that stay, so that texts meet them without an exchange for longer."""
    written, materialize = {}, corpus_pipeline.materialize

    def counted(df, name):
        table = materialize(df, name)
        written[name] = table.count()
        return table

    monkeypatch.setattr(corpus_pipeline, "materialize", counted)
    rows = [(i, " ".join(f"lone{i}x{j}" for j in range(20))) for i in range(30)] + [(50, "the same few words"), (51, "the same few words"), (51, "the same few words"), (None, "the same few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(x for x in left if x is not None) == [*range(30), 50] and left.count(None) == 1
    assert sum(written.values()) == 1
