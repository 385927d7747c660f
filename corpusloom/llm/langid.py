"""Language identification in two steps: a linear classifier picks the family, then
one-versus-one linear support vector machines tell the languages in it apart.

Families are learned: languages whose mean n-gram profiles are most alike are joined
until about the square root of their number is left. All machines are trained here,
by dual coordinate descent, on at most ``TRAIN_ROWS`` labelled rows, as many for each
language, those of the least hashes of id and text. The ``MOST_LANGUAGES`` most frequent
values of the label are learned. Predictions read nothing but the text, whole.

Defined results: a null text or one without a letter is ``und`` with score 0; rows
without a language teach nothing; with no labelled row all texts are ``und``; with
one language it gets every other text; a null doc_id passes through and counts as the
empty string for the fold; repeated rows each get their result, and teach once; of
languages with equal votes the first by name wins, of labels of equal count the first
ones are learned; texts of any length are read whole; an empty table gives an empty
result. ``identify`` keeps other columns, but for ``lang_pred`` and ``score``, which the
result's own replace; the query ignores them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import draw
from .features import code_points, letter_table, ngram_counts, unit
from .scratch import column, small_batches

BITS, ORDERS = 13, (1, 2, 3)
TRAIN_ROWS, MOST_LANGUAGES = 2_000, 250
UND = "und"
SHARPNESS = 4.0


def text_vector(text: str | None) -> np.ndarray | None:
    """Unit vector of a text's letters in words, or None if it has no letter."""
    points = code_points((text or "").lower())
    letters = letter_table()[points]
    if not letters.any():
        return None
    points = np.where(letters, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letters[1:] | letters[:-1]
    return unit(ngram_counts(points[keep], BITS, ORDERS))


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20, seed: int = 3) -> np.ndarray:
    """Weights, the last one the bias, of a linear SVM (dual coordinate descent)."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(x.shape[1], np.float64), 0.0
    alpha = np.zeros(len(y))
    square = (x * x).sum(axis=1) + 1.0
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (x[i] @ w + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w += step * x[i]
                bias += step
                alpha[i] = new
    return np.append(w, bias)


def learn_families(centres: np.ndarray, wanted: int) -> list[list[int]]:
    """Average-linkage groups of rows by cosine."""
    c = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    alike = c @ c.T
    groups = [[i] for i in range(len(c))]
    while len(groups) > wanted:
        _, a, b = max((float(alike[np.ix_(g, h)].mean()), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups[:i]))
        groups[b] += groups.pop(a)
    return [sorted(g) for g in groups]


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]
    weights: np.ndarray  # a column a machine: families against the rest, then pairs in families
    pairs: list[tuple[int, int]]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.languages:
            return UND, 0.0
        margins = x @ self.weights[:-1] + self.weights[-1]
        n = len(self.families) if len(self.families) > 1 else 0
        best = int(np.argmax(margins[:n])) if n else 0
        sure = _sigmoid(float(margins[best])) if n else 1.0
        family = self.families[best]
        votes, least = {k: 0.0 for k in family}, {k: math.inf for k in family}
        for (a, b), m in zip(self.pairs, margins[n:], strict=True):
            if a in votes:
                votes[a] += (m >= 0) + _sigmoid(float(m)) * 1e-3
                votes[b] += (m < 0) + _sigmoid(float(-m)) * 1e-3
                least[a], least[b] = min(least[a], float(m)), min(least[b], float(-m))
        winner = max(family, key=lambda k: (votes[k], -k))
        return self.languages[winner], min(sure, _sigmoid(least[winner]))


def _sigmoid(margin: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, SHARPNESS * margin))))


def train_languages(x: np.ndarray, labels: list[str]) -> LanguageModel:
    languages = sorted(set(labels))
    y = np.array([languages.index(k) for k in labels], int)
    if len(languages) < 2:
        return LanguageModel(languages, [[0]] if languages else [], np.zeros((1 << BITS) + 1)[:, None][:, :0], [])
    centres = np.stack([x[y == k].mean(axis=0) for k in range(len(languages))])
    families = learn_families(centres, max(1, round(math.sqrt(len(languages)))))
    columns, pairs = [], []
    if len(families) > 1:
        columns += [train_svm(x, np.where(np.isin(y, f), 1.0, -1.0)) for f in families]
    for f in families:
        for i, a in enumerate(f):
            for b in f[i + 1 :]:
                some = (y == a) | (y == b)
                columns.append(train_svm(x[some], np.where(y[some] == a, 1.0, -1.0)))
                pairs.append((a, b))
    return LanguageModel(languages, families, np.stack(columns, axis=1), pairs)


def fit(labelled: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, most: int = MOST_LANGUAGES) -> LanguageModel:
    """A model from rows with text and language. Counting reads the languages alone;
    the sample's hashed vectors are what comes to the driver, at most ``rows`` (or one a
    language), and the counts of ``most`` languages."""
    key, text = column(key_col), column(text_col)
    rated = labelled.filter(column(lang_col).isNotNull() & text.isNotNull()).select(column(lang_col).alias("lang"), key.alias("key"), text.alias("t"))
    counts = {r["lang"]: r["count"] for r in rated.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    if not counts:
        return train_languages(np.zeros((0, 1 << BITS), np.float32), [])
    per = max(1, rows // len(counts))
    rate = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, draw.share(per, n))])[F.col("lang")]
    h = F.xxhash64("key", "lang", "t")
    drawn = rated.filter(rate.isNotNull()).withColumn("h", h).filter(F.pmod("h", F.lit(10**9)) < rate * 1e9)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # Two keys for each row to come, so their number is bounded by ``rows``.
    few = drawn.select("lang", "h").distinct().withColumn("place", place).filter(F.col("place") <= per).drop("place")
    drawn = drawn.join(F.broadcast(few), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(lang, v) for lang, text in zip(batch["lang"], batch["t"], strict=True) if (v := text_vector(text)) is not None]
            if found:
                yield pd.DataFrame({"lang": [k for k, _ in found], "v": [v.astype("<f2").tobytes() for _, v in found]})

    sample = drawn.select("lang", "t").mapInPandas(vectors, "lang string, v binary").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    x = np.stack([np.frombuffer(r["v"], "<f2") for r in sample]).astype(np.float32) if sample else np.zeros((0, 1 << BITS), np.float32)
    return train_languages(x, [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; no exchange, one pass."""

    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(UND, 0.0) if (v := text_vector(t.as_py())) is None else model.predict(v) for t in batch.column(at)]
            added = [pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema=pa.schema([*batch.schema, ("lang_pred", pa.string()), ("score", pa.float64())]))

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[column(f.name) for f in kept]).mapInArrow(run, schema)


def fold(key: str = "doc_id"):
    """The documents held out from training."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~fold()))
    return identify(docs.select("doc_id", fold().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
