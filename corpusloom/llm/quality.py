"""Quality scores from weak labels.

Overlapping heuristics vote good, bad or nothing on each text. Expectation
maximisation over the counts of all vote patterns of the whole corpus estimates how
each heuristic votes on good and on bad texts; the posterior of a pattern is the soft
label that trains a logistic scorer of hashed character n-grams. The scorer learns
from at most ``TRAIN_ROWS`` rows, those of the least hashes of id and text; counts
cover all rows.

Defined results: a null text is empty; an empty text gets score 0; a null doc_id
passes through; repeated rows each count and get their result, and teach once; a score
of exactly ``KEEP`` is kept, and a pattern whose votes tie starts from even odds; texts
of any length are read whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import draw
from .features import code_points, letter_table, ngram_counts, unit
from .scratch import column, drop_scratch, materialize, small_batches

BITS, ORDERS = 13, (1, 2, 3)
TRAIN_ROWS = 3_000
KEEP = 0.5
LABELLERS = ("length", "word_length", "symbols", "digits", "repeated_lines", "short_words", "capitals", "repeated_words", "marks")


def _band(value: float, bad_low: float, good_low: float, good_high: float, bad_high: float) -> int:
    """1 within the good band, -1 outside the bad limits, else 0."""
    return 1 if good_low <= value <= good_high else -1 if value < bad_low or value > bad_high else 0


def votes(text: str) -> list[int]:
    """What each labeller says: 1 good, -1 bad, 0 nothing."""
    points = code_points(text)
    n = max(1, len(points))
    letters = letter_table()[points]
    digits = (points >= 48) & (points <= 57)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    capital = ((points >= 65) & (points <= 90)).sum()
    symbols = n - int(letters.sum()) - int(digits.sum()) - int(blank.sum()) if len(points) else 0
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(words))
    marks = sum(text.count(c) for c in "#$%&*|<>{}")
    return [
        _band(len(words), 12, 40, 20_000, 200_000),
        _band(int(letters.sum()) / m, 2.5, 3.5, 9.0, 12.0),
        _band(symbols / n, -1, 0, 0.05, 0.10),
        _band(int(digits.sum()) / n, -1, 0, 0.02, 0.10),
        _band(len(set(lines)) / max(1, len(lines)), 0.7, 0.95, 1, 1),
        _band(sum(len(w) <= 3 for w in words) / m, 0.08, 0.2, 0.7, 0.85),
        _band(capital / max(1, int(letters.sum())), -1, 0, 0.1, 0.3),
        _band(len(set(words)) / m * math.log(m + math.e), 0.8, 1.5, 99, 99),
        _band(marks / m, -1, 0, 0.01, 0.1),
    ]


def pattern_number(v: list[int]) -> int:
    return sum((x + 1) * 3**k for k, x in enumerate(v))


def pattern_votes(number: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([number // 3**k % 3 for k in range(labellers)], axis=1) - 1


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, accuracy of each labeller when it votes).

    Votes are independent given the class; the start is the majority vote, which also
    fixes which of the two classes is the good one."""
    if not len(counts):
        return np.zeros(0), np.zeros(patterns.shape[1])
    share = np.clip(0.5 + 0.45 * np.sign(patterns.sum(axis=1)), 0.05, 0.95)
    hit = np.stack([patterns == v for v in (-1, 0, 1)])
    for _ in range(rounds):
        tables = []
        for belief in (1 - share, share):
            weight = counts * belief
            tables.append(((hit * weight[None, :, None]).sum(axis=1) + 1.0) / (weight.sum() + 3.0))
        prior = float(np.clip((counts * share).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        logs = [np.log(p) + (hit * np.log(t)[:, None, :]).sum(axis=(0, 2)) for p, t in ((1 - prior, tables[0]), (prior, tables[1]))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
        done = np.abs(new - share).max() < 1e-9
        share = new
        if done:
            break
    right = (1 - prior) * tables[0][0] + prior * tables[1][2]
    wrong = (1 - prior) * tables[0][2] + prior * tables[1][0]
    return share, right / (right + wrong)


def text_vector(text: str) -> np.ndarray:
    return unit(ngram_counts(code_points(text), BITS, ORDERS))


def train_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 8.0, decay: float = 1e-4) -> np.ndarray:
    """Weights, the last one the bias, of a logistic scorer on soft labels; in single
    precision throughout, as its rows are."""
    w, bias, y = np.zeros(x.shape[1], np.float32), np.float32(0), y.astype(np.float32)
    for k in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        g = (p - y) / np.float32(len(y))
        step = np.float32(rate / (1 + k / 100))
        w -= step * (g @ x + np.float32(decay) * w)
        bias -= step * g.sum()
    return np.append(w, bias)


def scored(text: str, weights: np.ndarray) -> float:
    """0 for an empty text, else the logistic function of its weighted n-grams."""
    if not text:
        return 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(text_vector(text) @ weights[:-1] + weights[-1])))))


def score_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """id_col, n_votes, posterior, score and kept for each row. Two passes over the
    texts; pattern counts (3 to the number of labellers at most) and the bounded
    sample are what comes to the driver."""
    small_batches(docs.sparkSession)
    labellers = len(LABELLERS)
    key, text = column(id_col), column(text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(0)]
            found = [pattern_number(votes(t)) for t in texts]
            vectors = [text_vector(t).astype("<f2").tobytes() if s else None for t, s in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(1), pa.array(vectors, pa.binary())], names=["pattern", "h", "v"])

    h = F.xxhash64(key, F.lit(5), text)
    voted = docs.select(text.alias("t"), h.alias("h"), draw.part(h, draw.share(rows, docs.count())).alias("s"))
    voted = materialize(voted.mapInArrow(vote, "pattern long, h long, v binary"), "votes")
    table = sorted((r["pattern"], r["count"]) for r in voted.groupBy("pattern").count().collect())
    numbers = np.array([k for k, _ in table], np.int64)
    posterior, _ = estimate(pattern_votes(numbers, labellers), np.array([c for _, c in table], float))
    belief = dict(zip(numbers.tolist(), posterior.tolist(), strict=True))
    sample = sorted((bytes(r["v"]), r["pattern"]) for r in draw.least(voted.filter(F.col("v").isNotNull()), "h", rows).collect())
    drop_scratch(voted)
    x = np.stack([np.frombuffer(v, "<f2") for v, _ in sample]).astype(np.float32) if sample else np.zeros((0, 1 << BITS), np.float32)
    weights = train_scorer(x, np.array([belief[k] for _, k in sample]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            found = [votes(t) for t in texts]
            said, scores = [sum(x != 0 for x in v) for v in found], [scored(t, weights) for t in texts]
            columns = [pa.array(said, pa.int32()), pa.array([belief[pattern_number(v)] for v in found], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= KEEP for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_votes", T.IntegerType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return docs.select(key.alias("k"), text.alias("t")).mapInArrow(score, schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
