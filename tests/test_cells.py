"""Vectors by cell against brute force, with ties, copies, odd rows and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cells, metrics, search

SCHEMA = "vec_id long, embedding array<float>"


def _clustered(n=900, dim=12, groups=30, seed=4):
    """Tight groups, a third of all rows equal, and norms that differ."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: n // 3] = x[0]
    return x.astype(np.float32)


def _frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def _odd(spark):
    nan = float("nan")
    return spark.createDataFrame([(None, [1.0] * 12), (10_001, None), (10_002, []), (10_003, [nan] * 12), (10_004, [None] * 12), (10_005, [float("inf")] * 12)], SCHEMA)


@pytest.mark.parametrize("threshold", [0.95, 0.6])
def test_near_classes(spark, threshold):
    x = _clustered()
    got = cells.near_classes(_frame(spark, x).unionByName(_odd(spark)).repartition(5), threshold, id_col="vec_id", block=64).collect()
    distinct, first, n = np.unique(x, axis=0, return_index=True, return_counts=True)
    s = distinct.astype(np.float64) @ distinct.astype(np.float64).T
    want = {}
    for i, j in zip(*np.nonzero(s >= threshold), strict=True):
        if first[i] < first[j] or (i == j and n[i] > 1):
            want[int(first[i]), int(first[j])] = (int(n[i]), int(n[j]))
    assert {(r["a"], r["b"]): (r["n_a"], r["n_b"]) for r in got} == want and len(got) == len(want)
    assert any(a == b for a, b in want) and len(want) > 1000
    links = sum(r["n_a"] * (r["n_a"] - 1) // 2 if r["a"] == r["b"] else r["n_a"] * r["n_b"] for r in got)
    assert links == metrics.near_duplicate_pairs(_frame(spark, x), threshold, id_col="vec_id").count()


@pytest.mark.parametrize("threshold", [0.95, 0.6])
def test_near_links(spark, threshold):
    x = _clustered()
    df = _frame(spark, x).unionByName(_odd(spark)).repartition(5)
    s = x.astype(np.float64) @ x.astype(np.float64).T >= threshold
    _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
    want = [(i, int(first[inverse[i]]), int(s[i].sum() - s[i, i])) for i in range(len(x))]
    assert sorted(map(tuple, cells.near_links(df, threshold, id_col="vec_id", block=64).collect())) == want
    assert cells.near_links(df.limit(0), id_col="vec_id").count() == 0


def test_near_classes_skips_and_takes_any_norm(spark):
    x = _clustered() * np.random.default_rng(1).uniform(0.5, 2.0, 900)[:, None].astype(np.float32)
    df = _frame(spark, x)
    want = {(r["a"], r["b"]) for r in metrics.near_duplicate_pairs(df, 1.5, id_col="vec_id").collect()}
    got = cells.near_classes(df, 1.5, id_col="vec_id", cells=40).filter("a < b").collect()
    assert {(r["a"], r["b"]) for r in got} == want and want
    rows = df.select(F.col("vec_id").alias("__id"), F.col("embedding").alias("__v"))
    unit = _frame(spark, _clustered()).select(F.col("vec_id").alias("__id"), F.col("embedding").alias("__v"))
    centres = cells.fit_centres(unit, 900, 40)
    assert cells.visits(unit, centres, 0.95, 1.0).count() < 0.1 * 900 * len(centres)
    assert cells.visits(rows.limit(0), centres, 0.95, 1.0).count() == 0


def test_near_classes_without_rows(spark):
    none = _frame(spark, _clustered()).limit(0)
    assert cells.near_classes(none, id_col="vec_id").count() == 0
    assert cells.near_classes(_frame(spark, _clustered(1)), id_col="vec_id").count() == 0
    with pytest.raises(ValueError, match="several lengths"):
        cells.near_classes(spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0])], SCHEMA), id_col="vec_id")


@pytest.mark.parametrize("k", [1, 7, 2000])
def test_topk(spark, tmp_path, k):
    """Ties of 300 equal rows, a corpus of fewer than k rows, zero vectors, several blocks."""
    x = np.concatenate([_clustered(), np.zeros((3, 12), np.float32), 3 * _clustered(50, seed=9)])
    corpus = _frame(spark, x).unionByName(_odd(spark))
    asked = np.concatenate([_clustered(60, seed=4), np.zeros((1, 12), np.float32), -_clustered(9, seed=2)])
    queries = _frame(spark, asked).unionByName(_odd(spark)).withColumnRenamed("vec_id", "query_id")
    cells.write_cells(corpus, f"{tmp_path}/cells", id_col="vec_id")
    key = lambda df: sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    got = key(cells.topk(queries, f"{tmp_path}/cells", k))
    assert got == key(search.vector_topk(queries, corpus, k, item_id="vec_id").withColumnRenamed("vec_id", "item_id"))
    assert len(got) == 70 * min(k, len(x))


def test_topk_reads_few_cells_and_none(spark, tmp_path):
    corpus = _frame(spark, _clustered())
    cells.write_cells(corpus, f"{tmp_path}/some", id_col="vec_id", cells=30)
    queries = corpus.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    best = cells.topk(queries, f"{tmp_path}/some", 5)
    assert best.count() == 45 * 5
    plan = best._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    cells.write_cells(corpus.limit(0), f"{tmp_path}/none", id_col="vec_id")
    assert cells.topk(queries, f"{tmp_path}/none", 5).count() == 0
    assert cells.topk(queries.limit(0), f"{tmp_path}/some", 5).count() == 0
