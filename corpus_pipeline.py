"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of ``docs``, but for the last, which returns pieces in sequences.

1. Documents that language identification can't place go (no letter, or a confidence
   under ``MIN_SCORE``); a missing language is filled in.
2. Lines that many documents share go, but for one document; documents go that this
   leaves without a word.
3. Of each group of near duplicates the document with the least id stays.
4. Secrets are replaced by a mark; every document stays.
5. What is left is tokenised and packed.

Null texts are empty texts; an n_chars column follows the text; documents with a null
doc_id pass all stages (as near duplicates they link with nothing); rows that repeat
a doc_id stay or go together; other columns pass through to the last stage, whatever
their names, and those an operator adds stay out of the next one's sight. An empty table
passes all stages and gives no pieces. Texts of any length are read whole by each stage and
cut by packing alone. A confidence of just ``MIN_SCORE`` and a line in just as many documents
as count decide as their operators say; of near duplicates that tie the least id stays.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, line_dedup, minhash, packing, secrets
from corpusloom.llm.scratch import drop_scratch, materialize

MIN_SCORE = 0.4
SIMILARITY = 0.8
TOKENIZER = "word_bpe_49k.json"
#: Workers that other stages use as well keep smaller word tables than packing alone would.
KEPT_WORDS = 60_000
#: Not expressible in SQL: trained models, signatures, and tokenizers. Tests hold the stages against plain versions.
ORACLE_SQL = None


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _shielded(stage):
    """``stage`` with columns beyond the usual ones out of its sight, whatever their names."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c not in CORE}
        out = stage(spark, docs.withColumnsRenamed(hidden), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in hidden.items()})

    return run


def _with_text(docs: DataFrame, text, like: list[str]) -> DataFrame:
    new = docs.withColumn("text", text)
    if "n_chars" in like:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*[f"`{c}`" for c in like])


@_shielded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(~langid.fold()))
    found = langid.identify(docs, model)
    kept = found.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*[f"`{c}`" for c in docs.columns])


@_shielded
def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(docs)
    left = left.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left, F.col("text"), docs.columns)


@_shielded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs, threshold=SIMILARITY)
    # The ids that go are fewer than those that stay, so the texts needn't be exchanged as soon.
    gone = materialize(found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    # Rows without a number join nothing, so that they don't meet under one key.
    return docs.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


@_shielded
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(docs)
    spans = F.array_sort(F.concat("base_spans", "markov_spans"))
    return _with_text(found, secrets.redact(F.coalesce("text", F.lit("")), spans), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), kept_words=KEPT_WORDS)


STAGES = [("language_id", language_id), ("line_dedup", drop_shared_lines), ("minhash_near_dedup", near_dedup), ("secret_scans", mask_secrets), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop_scratch(last)
    return STAGES[-1][1](spark, docs, sf_dir)
