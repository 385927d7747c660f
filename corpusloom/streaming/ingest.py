"""Extension: documents that arrive as files are cleaned and cut as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import clean
from corpusloom.operators import segment


def chunk_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", *, size: int = 200, overlap: int = 50, least: int = 50) -> DataFrame:
    """(doc_id, chunk, text) of all documents under ``path``; stateless."""
    docs = spark.readStream.schema(schema).parquet(path)
    text = clean.normalize_text(clean.clean_text(F.col("text"), compose=False), abbreviations=lexicon.ABBREVIATIONS, units=lexicon.UNITS, typos=lexicon.TYPOS)
    parts = segment.chunk_words(segment.paragraphs(text, "\n"), size=size, overlap=overlap, least=least)
    return docs.select("doc_id", F.posexplode(parts).alias("chunk", "text"))
