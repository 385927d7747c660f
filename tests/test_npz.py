"""Row ranges of NumPy archives against NumPy itself."""

import numpy as np
import pytest

from corpusloom.sources import corpus, npz


def _held(df):
    return {r["chunk_id"]: (r["ordinal"], r["embedding"]) for r in df.collect()}


@pytest.mark.parametrize("kind", ["stored", "compressed", "columns"])
def test_ranges_equal_numpy(spark, tmp_path, kind):
    x = np.random.default_rng(3).normal(size=(9001, 7)).astype(np.float32)
    ids = np.array([f"bagian_{i}ü" for i in range(len(x))])
    save = np.savez_compressed if kind == "compressed" else np.savez
    save(tmp_path / "v.npz", other=np.arange(5), embeddings=np.asfortranarray(x) if kind == "columns" else x, chunk_ids=ids)
    df = npz.read_rows(spark, f"{tmp_path}/v.npz", vectors="embeddings", ids="chunk_ids", range_bytes=40_000)
    assert df.rdd.getNumPartitions() == (7 if kind == "stored" else 1)
    held = _held(df)
    assert held == {n: (i, v) for i, (n, v) in enumerate(zip(ids.tolist(), x.astype(np.float64).tolist()))}
    assert _held(corpus.read_npz(spark, f"file://{tmp_path}/v.npz")) == held
    assert _held(corpus._read_npz_whole(spark, f"{tmp_path}/v.npz", "embeddings", "chunk_ids")) == held


def test_folders_and_empty_matrices(spark, tmp_path):
    for k in range(3):
        np.savez(tmp_path / f"{k}.npz", m=np.full((k, 2), k), n=np.array([f"{k}-{i}" for i in range(k)], dtype="U4"))
    (tmp_path / "note.txt").write_text("no archive")
    got = corpus.read_npz(spark, str(tmp_path), vectors="m", ids="n")
    assert _held(got) == {"1-0": (0, [1.0, 1.0]), "2-0": (0, [2.0, 2.0]), "2-1": (1, [2.0, 2.0])}
    assert corpus.read_npz(spark, f"{tmp_path}/0.npz", vectors="m", ids="n").count() == 0


@pytest.mark.parametrize("fault", ["cut", "rows", "objects", "member", "missing", "bytes"])
def test_faults_are_named(spark, tmp_path, fault):
    path, x, ids = tmp_path / "v.npz", np.eye(4), np.array(list("abcd"))
    np.savez_compressed(path, embeddings=x, chunk_ids=ids) if fault == "bytes" else np.savez(path, embeddings=x, chunk_ids=ids)
    raw = path.read_bytes()
    if fault == "cut":
        path.write_bytes(raw[: len(raw) // 2])
    elif fault == "bytes":
        at = raw.index(b"embeddings.npy") + 60
        path.write_bytes(raw[:at] + bytes(b ^ 255 for b in raw[at : at + 8]) + raw[at + 8 :])
    elif fault == "rows":
        np.savez(path, embeddings=x, chunk_ids=ids[:3])
    elif fault == "objects":
        np.savez(path, embeddings=x, chunk_ids=ids.astype(object))
    elif fault == "member":
        np.savez(path, vectors=x, chunk_ids=ids)
    else:
        path.unlink()
    with pytest.raises(Exception, match=r"v\.npz"):
        corpus.read_npz(spark, str(path)).collect()
