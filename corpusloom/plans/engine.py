"""The retrieval engine: ingest once, answer batches of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import clean, embed
from corpusloom.operators import answer, enrich, search, segment
from corpusloom.sources import corpus


def ingest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str | None = None, references: DataFrame | None = None, expand: bool = True, size: int = 200, overlap: int = 50, least: int = 50) -> DataFrame:
    """Clean, normalise, cut, tag; then the references' chunks behind the documents'."""
    text = clean.normalize_text(clean.clean_text(F.col("text")), abbreviations=lexicon.ABBREVIATIONS if expand else (), units=lexicon.UNITS, typos=lexicon.TYPOS)
    chunks = segment.chunk_documents(docs.withColumn("text", text), id_col=id_col, source_col=source_col, size=size, overlap=overlap, least=least)
    chunks = enrich.enrich_chunks(chunks.withColumn("chunk_id", F.concat_ws("_", F.col(id_col).cast("string"), "chunk_id")), lexicon.DOMAIN_KEYWORDS)
    if references is None:
        return chunks
    refs = enrich.reference_chunks(references)
    have = {f.name: f for f in chunks.schema["metadata"].dataType.fields} | {f.name: f for f in refs.schema["metadata"].dataType.fields}
    level = lambda df: df.withColumn("metadata", F.struct(*[(F.col(f"metadata.{n}") if n in df.schema["metadata"].dataType.names else F.lit(None).cast(f.dataType)).alias(n) for n, f in have.items()]))
    return enrich.union_chunks(level(chunks), level(refs))


_SHARED: dict = {}


def shared_engine(spark: SparkSession, name: str, make: Callable[[], Engine]) -> Engine:
    """The engine of this name for the session, made when it is first asked for."""
    key = (id(spark), name)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


@dataclass
class Engine:
    """What answering needs: vectors of chunks, a model, and a generator."""

    chunks: DataFrame
    embedder: embed.Embedder
    generator: answer.Generator | None = None
    system: str = ""
    lexicons: dict = field(default_factory=lambda: {"synonyms": lexicon.QUERY_SYNONYMS, "stopwords": lexicon.STOPWORDS, "out": lexicon.OUT_OF_SCOPE, "in": lexicon.IN_SCOPE})

    @classmethod
    def build(cls, chunks: DataFrame, embedder: embed.Embedder, generator: answer.Generator | None = None) -> Engine:
        text = embed.embed_text(F.col("section"), F.col("subsection"), F.col("text"))
        return cls(embed.embed(chunks, embedder, text), embedder, generator)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: embed.Embedder, generator: answer.Generator | None = None) -> Engine:
        return cls(spark.read.parquet(path), embedder, generator)

    def save(self, path: str) -> None:
        corpus.write_vectors(self.chunks, path, model=self.embedder.name)

    def written(self, path: str) -> Engine:
        """This engine over its saved index: texts are embedded once, not by each reader."""
        self.save(path)
        return replace(self, chunks=self.chunks.sparkSession.read.parquet(path))

    def retrieve(self, queries: DataFrame, *, k: int = search.TOP_K, least: float = search.MIN_SCORE, wanted=()) -> DataFrame:
        """Queries (query_id, query) are embedded as expanded and reranked as asked."""
        vectors = embed.embed(queries, self.embedder, search.expand_query(F.col("query"), self.lexicons["synonyms"]))
        return search.retrieve(vectors, self.chunks, stopwords=self.lexicons["stopwords"], k=k or search.TOP_K, least=least, wanted=wanted)

    def answer(self, queries: DataFrame, *, k: int = search.TOP_K) -> DataFrame:
        """(query_id, query, mode, prompt, response, ok) for each query."""
        relevant = self.retrieve(queries, k=k).filter(F.col("similarity_score") >= answer.RELEVANT)
        parts = relevant.withColumn("part", answer.context_part(F.col("place"), F.col("source_label"), F.col("similarity_score"), F.col("text")))
        context = answer.format_context(answer.context_budget(parts))
        counts = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
        full = queries.select("query_id", "query").join(counts, "query_id", "left").join(context, "query_id", "left")
        mode = answer.route(F.coalesce("n_relevant", F.lit(0)), answer.out_of_scope(F.col("query"), self.lexicons["out"], self.lexicons["in"]))
        full = full.withColumn("mode", mode).withColumn("prompt", answer.build_prompt(F.col("mode"), F.col("query"), F.col("context"), system=self.system))
        return answer.generate(full.select("query_id", "query", "mode", "prompt"), self.generator)
