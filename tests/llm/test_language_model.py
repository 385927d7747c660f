"""Language-model scores and token alignment against plain versions, and on rows at the edge."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import alignment, attention

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string"
EDGE = [
    (1, None, None),
    (None, "a text without a number", "en"),
    (2, "", "en"),
    (3, " \t\n\x0b\x0c\r", "en"),
    (4, "word " * 20_000, "en"),
    (5, "x" * 20_000, "fr"),
    (6, "the same text", "en"),
    (6, "the same text", "en"),
    (7, "the same text and İ É \x85 more", "en"),
    (8, "▁ mark", "es"),
    (9, "<s> </s> <|endoftext|> <unk> [MASK]", "es"),
    (10, "a  b\n\nc \n d\r\ne\tf \n", "de"),
    (11, "\U0001f600\U0001f600 ﬁ ａ \x00 \x7f \x1c", "de"),
    (12, "end ", "de"),
    (13, " ", "de"),
    (14, "\n", "de"),
    (15, "don't we'll '' 12,345.6 ...--- 你好 привет", "de"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


# --- language-model scores


def plain_base(rows):
    """n_tokens, n_known, N and the base score by row, from the contract's words."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter()
    for i, t in rows:
        if not out(i):
            c.update([*split(t), None])
    n, d = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    return [(i, out(i), len(split(t)) + 1, sum(c[w] > 0 for w in [*split(t), None]), n, sum(math.log10((c[w] + 0.5) / d) for w in [*split(t), None])) for i, t in rows]


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def check_base(rows, scored):
    got = sorted_rows((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in scored)
    want = sorted_rows(plain_base(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


@pytest.mark.parametrize("most_words", [200_000, 50, 0])
def test_base_scores_are_the_contracts(docs, most_words):
    scored = attention.score_texts(docs, WORDS, epochs=1, most_words=most_words).collect()
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], scored)


def test_border_of_frequent_words_changes_no_score(docs):
    few, many = ({r["doc_id"]: r["score"] for r in attention.score_texts(docs, WORDS, epochs=1, most_words=n).collect()} for n in (40, 200_000))
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-4 * max(1, -many[k]) for k in few)


def test_edge_rows_are_scored(edge):
    scored = attention.score_texts(edge.withColumns({c: F.lit("taken") for c in ("t", "o", "word", "row", "score", "rest", "id", "h", "every", "learnt")}), WORDS, epochs=1)
    assert scored.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = scored.collect()
    check_base([r[:2] for r in EDGE], rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 6]
    assert abs(same[0] - same[1]) < 1e-6


def test_no_rows_and_nothing_to_learn_from(spark):
    assert attention.score_texts(spark.createDataFrame([], SCHEMA), WORDS, epochs=1).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = attention.score_texts(spark.createDataFrame([(held, "some words", "en")], SCHEMA), WORDS, epochs=1).first()
    assert row["held_out"] and row["n_known"] == 0 and row["train_tokens"] == 0 and math.isfinite(row["score"])


def a_model(n_ids=300, windows=40, epochs=1, seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, n_ids)
    stream = np.append(rng.integers(0, n_ids, windows * attention.STRIDE - 1), n_ids)
    cells = attention._windows(stream, np.array([0, len(stream)]), n_ids)
    return attention.build_model(counts, 3, *cells, epochs), stream, n_ids


def test_probabilities_of_all_ids_sum_to_one():
    model, stream, end = a_model()
    seen, target, real, first = attention._windows(stream[:40], np.array([0, 40]), end)
    total = np.zeros(2)
    for i in range(end + 1):
        changed = target.copy()
        changed[:, 5] = i
        total += np.exp(model.log_probabilities(seen, changed, first).astype(float))[:, 5]
    assert np.allclose(total, 1, atol=1e-4)


def test_windows_score_each_id_once_and_see_no_later_one():
    model, stream, end = a_model()
    bounds = np.array([0, 1, 70, 70 + 32, 200])
    seen, target, real, first = attention._windows(stream[:200], bounds, end)
    assert target[real].tolist() == stream[:200].tolist()
    logs = model.log_probabilities(seen, target, first)[real]
    for a, b in zip(bounds[:-1], bounds[1:]):
        for at in range(a, b, 9):  # one id at a time, from what stands before it in its text
            begin = a + (at - a) // attention.STRIDE * attention.STRIDE
            context = [end, *stream[a:at]][-(at - begin) - attention.BEFORE - 1 :]
            x = model.weights["embed"][model.entry[context]]
            here, keys = x[-1], x @ model.weights["key"]
            back = np.arange(len(context))[::-1]
            p = np.exp(keys @ (here @ model.weights["query"]) + model.weights["distance"][back])
            both = np.append(here, (p / p.sum()) @ (x @ model.weights["value"]))
            logits = np.maximum(both @ model.weights["inner"] + model.weights["inner_bias"], 0) @ model.weights["outer"] + model.weights["outer_bias"]
            want = logits[model.unit[stream[at]]] - np.log(np.exp(logits).sum()) + model.share[stream[at]]
            assert abs(want - logs[at]) < 1e-3


def test_gradients_are_those_of_differences():
    model, stream, end = a_model(windows=6)
    seen, target, real, first = attention._windows(stream, np.array([0, len(stream)]), end)
    w = {n: a.astype(np.float64) for n, a in model.weights.items()}
    entries, wanted = model.entry[seen], model.unit[target]

    def loss():
        logits = attention._forward(w, entries, first, attention._mask(w["distance"]).astype(float))["logits"]
        logs = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return -logs[np.arange(len(logs)), wanted.reshape(-1)][real.reshape(-1)].mean()

    grads = attention._gradients(w, entries, first, wanted, real)
    rng = np.random.default_rng(3)
    for name, a in w.items():
        for k in rng.permutation(np.flatnonzero(grads[name].reshape(-1)))[:4]:
            old, e = a.reshape(-1)[k], 1e-4
            a.reshape(-1)[k] = old + e
            up = loss()
            a.reshape(-1)[k] = old - e
            down = loss()
            a.reshape(-1)[k] = old
            assert abs((up - down) / (2 * e) - grads[name].reshape(-1)[k]) < 2e-4 + 0.02 * abs(grads[name].reshape(-1)[k]), name


def test_batches_reuse_their_arrays():
    """Fresh pages for every batch cost more than the products that fill them."""
    model, stream, end = a_model(windows=128)
    seen, target, real, first = attention._windows(stream, np.array([0, len(stream)]), end)
    steps = {
        "train": lambda: attention._gradients(model.weights, model.entry[seen], first, model.unit[target], real),
        "score": lambda: model.log_probabilities(seen, target, first),
    }
    for name, step in steps.items():
        before = step()
        tracemalloc.start()
        after = step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1.6e6, (name, peak)
        same = zip(before.values(), after.values()) if name == "train" else [(before, after)]
        assert all(np.array_equal(a, b) for a, b in same)


def test_sums_of_rows_by_number():
    rng = np.random.default_rng(0)
    rows, values = rng.integers(0, 70, 500), rng.standard_normal((500, 16))
    want = np.zeros((100_000, 16))
    np.add.at(want, rows, values)
    assert np.allclose(attention._sum_by(rows, values, 100_000), want) and np.allclose(attention._sum_by(rows, values, 70), want[:70])


def test_held_out_texts_are_likelier_than_by_counts_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = attention.score_texts(docs, WORDS).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1]


# --- token alignment


def plain_alignment(tool, text):
    """(A ids, B ids, groups as text, links) by comparing all tokens of both sides."""
    a = tool.a.encode(f" {text}", add_special_tokens=False).ids if text else []
    b = tool.b.encode(text) if text else []
    sides = [[tool.a_bytes[i] for i in a], [tool.b_bytes[i] for i in b]]
    if not text or any(b"".join(s) != f" {text}".encode() for s in sides):
        return 0, 0, "", []
    ends = [np.cumsum([len(x) for x in s]) for s in sides]
    begins = [e - [len(x) for x in s] for e, s in zip(ends, sides)]
    links = [(a[i], b[j]) for i in range(len(a)) for j in np.flatnonzero((begins[1] < ends[0][i]) & (ends[1] > begins[0][i]))]
    groups, lo = [], 0
    for hi in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, side) if lo < e <= hi) for ids, side in zip((a, b), ends)))
        lo = hi
    return len(a), len(b), ";".join(groups), links


def check_alignment(rows, got):
    tool = alignment.Aligner(BYTES, PIECES)
    plain = [(i, *plain_alignment(tool, t)) for i, t in rows]
    n = collections.Counter(p for row in plain for p in set(row[4]))
    top = collections.defaultdict(int)
    for (a, _), k in n.items():
        top[a] = max(top[a], k)
    want = [
        (i, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, n_a, n_b, groups, links in plain
    ]
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)


@pytest.mark.parametrize("most_pairs", [500_000, 300, 0])
def test_alignment_equals_comparing_all_tokens(docs, most_pairs):
    some = docs.filter(F.length("text") < 3_000)
    got = alignment.alignments(some, BYTES, PIECES, most_pairs=most_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    check_alignment([(r["doc_id"], r["text"]) for r in some.collect()], got.collect())


def test_alignment_of_edge_rows(edge):
    clash = edge.withColumns({c: F.lit("taken") for c in ("k", "t", "id", "row", "pairs", "times", "n_a", "best", "total", "pair", "n")})
    some = clash.filter(F.coalesce(F.length("text"), F.lit(0)) < 5_000)
    check_alignment([r[:2] for r in EDGE if len(r[1] or "") < 5_000], alignment.alignments(some, BYTES, PIECES).collect())
    long = alignment.alignments(clash.filter("length(text) >= 5000"), BYTES, PIECES).collect()
    assert {r["doc_id"]: r["n_a"] for r in long}[4] == 20_001 and len(long) == 2


def test_alignment_of_no_rows(spark):
    assert alignment.alignments(spark.createDataFrame([], SCHEMA), BYTES, PIECES).collect() == []


def test_stretches_that_end_in_white_space_stand_alone():
    tool = alignment.Aligner(BYTES, PIECES)
    texts = ["end ", "two  ", "x\n", "tab\t", *(r[1] for r in EDGE if r[1] and len(r[1]) < 5_000)]
    for text, got in zip(texts, tool.texts(texts)):
        n_a, n_b, groups, links = plain_alignment(tool, text)
        assert got[:2] == (n_a, n_b) and got[4] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert np.repeat(got[5], got[6]).tolist() == sorted(a * alignment.B_IDS + b for a, b in links)
