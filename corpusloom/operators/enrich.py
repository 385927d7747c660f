"""Keywords, metadata, reference chunks and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.clean import strip
from corpusloom.functions.tokens import names_found, word_count


def keyword_tags(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Sorted categories of which any term stands in the lower-cased text."""
    return names_found(F.lower(text), lexicon)


def chunk_metadata(text: Column, section: Column, subsection: Column, *, place: str = "kendari", near: str = "kendari_sultra", far: str = "nasional", language: str = "id", domain: str = "stunting_health") -> Column:
    return F.struct(
        text.rlike(r"\d").alias("has_numbers"),
        text.rlike(r"(?mdU)^\s*-\s").alias("has_list"),
        word_count(text).alias("word_count"),
        F.length(text).alias("char_count"),
        F.lit(language).alias("language"),
        F.lit(domain).alias("domain"),
        F.when(F.contains(F.lower(text), F.lit(place)), near).otherwise(far).alias("location"),
        F.concat(F.lit("[Sumber: "), section, F.lit(" | "), subsection, F.lit("]\n"), text).alias("display_text"),
    )


def enrich_chunks(chunks: DataFrame, lexicon: Mapping[str, Sequence[str]]) -> DataFrame:
    return chunks.withColumn("keywords", keyword_tags(F.col("text"), lexicon)).withColumn("metadata", chunk_metadata(F.col("text"), F.col("section"), F.col("subsection")))


def padded_id(value: Column, width: int = 6) -> Column:
    """Zeros on the left, never cut."""
    text = value.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def reference_chunks(refs: DataFrame, *, source_file: str = "stunting_references.json") -> DataFrame:
    """One chunk for each reference (id, judul, tahun, penulis, kategori, ringkasan,
    poin_kunci, relevansi_topik, doi, url); missing parts are empty."""
    empty = F.array().cast("array<string>")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    points = F.array_join(F.transform(F.coalesce("poin_kunci", empty), lambda p: F.concat(F.lit("- "), p)), "\n")
    text = F.concat(F.lit("Referensi: "), part("judul"), F.lit(" ("), part("tahun"), F.lit(")\nPenulis: "), F.array_join(F.coalesce("penulis", empty), ", "), F.lit("\nKategori: "), part("kategori"), F.lit("\nRingkasan: "), part("ringkasan"), F.lit("\nPoin Kunci:\n"), points)
    return refs.withColumn("__t", text).select(
        F.concat(F.lit("ref_"), padded_id(F.col("id"))).alias("chunk_id"),
        strip(F.col("__t")).alias("text"),
        F.concat(F.lit("Referensi Ilmiah - "), F.coalesce(F.col("kategori"), F.lit("Umum"))).alias("section"),
        part("kategori").alias("subsection"),
        F.lit(source_file).alias("source_file"),
        F.lit(0).alias("char_start"),
        F.length("__t").alias("char_end"),
        word_count(F.col("__t")).alias("token_count"),
        F.coalesce("relevansi_topik", empty).alias("keywords"),
        F.struct(F.col("id").cast("string").alias("ref_id"), part("tahun").alias("tahun"), F.col("doi"), F.col("url"), F.lit("id").alias("language"), F.lit("scientific_reference").alias("domain")).alias("metadata"),
    )


def union_chunks(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    n = F.col("token_count")
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg(n).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(F.length("text")).alias("avg_chars"), F.sum(F.length("text")).alias("total_chars"))


def section_histogram(chunks: DataFrame, width: int = 40) -> DataFrame:
    return chunks.groupBy(F.substring(F.coalesce(F.col("section"), F.lit("?")), 1, width).alias("section")).agg(F.count("*").alias("n_chunks"))
