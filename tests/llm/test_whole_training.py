"""The model of op 11 learns from every row to learn from, whatever windows it starts from."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from corpusloom.llm import attention

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_weights_are_learnt_from_all_rows(spark, monkeypatch):
    kept, learn = [], attention.learn_weights

    def learn_weights(*given):
        start = given[-1].weights
        kept[:] = given[-1], start, *learn(*given)
        return kept[2:]

    monkeypatch.setattr(attention, "learn_weights", learn_weights)
    monkeypatch.setattr(attention, "TRAIN_DOCS", 20)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert attention.score_texts(docs, WORDS, epochs=1).count() == docs.count()
    model, start, weights, n = kept
    streams = attention.Streams(WORDS, [], len(model.unit) - 1)
    texts = docs.select(attention.held_out("doc_id").alias("held"), F.coalesce("text", F.lit("")).cast("binary").alias("t")).collect()
    assert n == sum(len(streams.of([r["t"]])[3]) for r in texts if not r["held"])
    held = [streams.of([r["t"]])[3] for r in texts if r["held"]][:60]

    def fit(w):  # of texts held out
        cells = [attention._windows(ids, np.array([0, len(ids)]), streams.end) for ids in held]
        return sum(attention.Model(model.unit, model.share, model.entry, w).log_probabilities(seen, target, first)[real].sum() for seen, target, real, first in cells)

    print(fit(weights), fit(start))
    assert fit(weights) > fit(start)
