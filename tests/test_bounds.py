"""What a task holds, or a stage makes, stays bounded as tables grow."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import clean
from corpusloom.operators import metrics, search


def test_blocks_of_vector_search_are_small():
    """A task holds a block of queries and one of the corpus, in double precision, and 64 rows of scores."""
    held = 8 * (64 * (search.QUERY_BLOCK + search.CORPUS_BLOCK) + 3 * 64 * search.CORPUS_BLOCK)
    assert held < 50e6


def test_vector_topk_over_several_blocks_equals_one_product(spark):
    x = np.random.default_rng(5).integers(-3, 4, (20_000, 4)).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    asked = rows.filter(F.col("id") % 1000 == 0).withColumnRenamed("id", "query_id")
    got = search.vector_topk(asked, rows.withColumnRenamed("id", "item_id"), 3)
    scores = x[::1000] @ x.T
    want = {(q * 1000, int(i), rank) for q, row in enumerate(scores) for rank, i in enumerate(np.argsort(-row, kind="stable")[:3], 1)}
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got.collect()} == want


def test_pairs_are_added_up_without_a_row_for_one(spark):
    x = np.random.default_rng(6).standard_normal((2_500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    s = (x @ x.T)[np.triu_indices(len(x), 1)]
    for block in (700, 8192):
        got = metrics.pair_extremes(rows, id_col="id", block=block, near=0.3).first()
        assert (got["n_pairs"], got["n_near"]) == (len(s), (s >= 0.3).sum())
        assert np.allclose([got["uniformity_loss"], got["cosine_max"]], [np.log(np.exp(4 * s - 4).mean()), s.max()], rtol=1e-9)


def test_guards_of_cleaning_change_no_text(spark):
    """Rules run one after another on what came before, and composition on all that it changes."""
    table = [("ab", "cd"), ("cd", "ef"), ("s", "T")]
    texts = ["", None, "xab ab", "AB cd", "ſ K", "nothing", "é a˿", "Å", "ä ñ — “x”", "가", "\U0001d15e"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for wrong, right in table:
        plain = F.regexp_replace(plain, rf"(?iU)\b{wrong}\b", right)
    got = rows.select("t", clean.fix_typos(F.col("t"), table), plain, clean.nfc(F.col("t"))).collect()
    assert all(a == b for _, a, b, _ in got)
    assert all(n == (t if t is None else unicodedata.normalize("NFC", t)) for t, _, _, n in got)


def test_typo_terms_are_looked_for_before_any_rule(spark, capsys):
    spark.range(1).select(clean.fix_typos(F.col("id").cast("string"), [("ab", "x"), ("cd", "y")]).alias("t")).explain()
    plan = capsys.readouterr().out
    assert 0 < plan.index("Contains") < plan.index("regexp_replace") and plan[: plan.index("regexp_replace")].count("Contains(") > 2
