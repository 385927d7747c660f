"""Packed moments against NumPy: long vectors, many groups, a group that holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import metrics, moments


def _frame(spark, x, labels, parts):
    rows = [(i, None if g is None else str(g), v.tolist()) for i, (g, v) in enumerate(zip(labels, x, strict=True))]
    return spark.createDataFrame(rows, "vec_id int, label string, embedding array<double>").repartition(parts)


def _plain(x):
    n, s, g = len(x), x.sum(axis=0), x.T @ x
    n2 = (x * x).sum(axis=1)
    return n, (n2 > 0).sum(), (s @ s - n2.sum()) / 2, ((g * g).sum() - (n2 * n2).sum()) / 2


def test_pack_and_unpack():
    x = np.random.default_rng(0).normal(size=(5, 6))
    packed = moments.pack(x)
    assert len(packed) == moments.length(6)
    n, s, g = moments.unpack(packed, 6)
    assert n == 5 and np.allclose(s, x.sum(axis=0)) and np.allclose(g, x.T @ x)


@pytest.mark.parametrize("dim", [1, 2, 7, 130])
def test_pair_sums_by_group(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(90, dim))
    x[3] = 0
    labels = [None if i % 9 == 4 else 0 if i < 60 else i % 7 for i in range(90)]
    each = moments.moments(_frame(spark, x, labels, 5), "embedding", "label", dim)
    found = {r["g"]: tuple(r)[1:] for r in moments.pair_sums(each, dim).collect()}
    assert set(found) == {None if g is None else str(g) for g in labels}
    for g, row in found.items():
        assert row == pytest.approx(_plain(x[[(None if h is None else str(h)) == g for h in labels]]), abs=1e-7)
    assert tuple(moments.pair_sums(moments.whole(each), dim).first())[1:] == pytest.approx(_plain(x), abs=1e-7)


def test_long_vectors_travel_in_pieces(spark):
    dim = 1024
    x = np.random.default_rng(4).normal(size=(40, dim))
    df = _frame(spark, x, [i % 2 for i in range(40)], 4)
    pieces = moments.moments(df, "embedding", None, dim)
    sizes = [r["n"] for r in pieces.select(F.length("m").alias("n")).collect()]
    assert max(sizes) <= 8 * moments.PIECE and sum(sizes) == 8 * moments.length(dim)
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    p = metrics.pca_geometry(df).first()
    assert p["top5"] == pytest.approx((values / values.sum())[:5].tolist())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, (i, j) = u @ u.T, np.triu_indices(40, 1)
    c = metrics.coherence(_frame(spark, u, [k % 2 for k in range(40)], 4)).first()
    same = i % 2 == j % 2
    assert c["intra_mean"] == pytest.approx(s[i, j][same].mean()) and c["inter_std"] == pytest.approx(s[i, j][~same].std())


def test_sums_given_away_early(spark, monkeypatch):
    monkeypatch.setattr(moments, "HELD_BYTES", 1)
    x = np.random.default_rng(5).normal(size=(50, 3))
    each = moments.moments(_frame(spark, x, [i % 11 for i in range(50)], 3), "embedding", "label", 3)
    assert each.count() == 11
    assert tuple(moments.pair_sums(moments.whole(each), 3).first())[1:] == pytest.approx(_plain(x))
