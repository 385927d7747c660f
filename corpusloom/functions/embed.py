"""Embedding of texts by a pluggable model.

``Embedder`` is what an engine needs of a model. ``HashingEmbedder`` stands in where no
neural model can be loaded; its vectors have no meaning beyond shared words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One row of ``dim`` numbers for each text; called on the executors."""
        ...


class HashingEmbedder:
    """Signed counts of lower-cased words, by checksum."""

    def __init__(self, dim: int = 64) -> None:
        self.name, self.dim = f"hashing-{dim}", dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                row[h % self.dim] += 1.0 if h & 0x80000000 else -1.0
        return out


class SentenceEmbedder:
    """A sentence-embedding model of the library ``sentence_transformers``, from a local
    path or by name. It is loaded where it first encodes, once to a Python worker."""

    def __init__(self, model: str, *, dim: int, device: str | None = None, max_length: int = 512) -> None:
        self.name, self.dim, self.device, self.max_length = model, dim, device, max_length

    def encode(self, texts: list[str]) -> np.ndarray:
        return _sentence_model(self.name, self.device, self.max_length).encode(texts, batch_size=len(texts) or 1, show_progress_bar=False)


@cache
def _sentence_model(name: str, device: str | None, max_length: int):
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(name, device=device)
    model.max_seq_length = max_length
    return model


class TokenEmbedder:
    """A model of the library ``transformers`` whose token vectors are averaged under the
    attention mask; loaded where it first encodes, once to a Python worker."""

    def __init__(self, model: str, *, dim: int, device: str | None = None, max_length: int = 512) -> None:
        self.name, self.dim, self.device, self.max_length = model, dim, device, max_length

    def encode(self, texts: list[str]) -> np.ndarray:
        tokenizer, model, torch = _token_model(self.name, self.device)
        taken = tokenizer(texts, padding=True, truncation=True, max_length=self.max_length, return_tensors="pt").to(model.device)
        with torch.no_grad():
            vectors = model(**taken).last_hidden_state.cpu().numpy()
        return masked_mean(vectors, taken["attention_mask"].cpu().numpy())


@cache
def _token_model(name: str, device: str | None):
    import torch
    from transformers import AutoModel, AutoTokenizer

    return AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name).to(device or "cpu").eval(), torch


def masked_mean(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(texts, dim) from token vectors (texts, tokens, dim) and their mask."""
    weight = mask[:, :, None].astype(np.float64)
    return (vectors * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


MODELS = {"hashing": HashingEmbedder, "sentence": SentenceEmbedder, "token": TokenEmbedder}


def load_embedder(kind: str, **options) -> Embedder:
    """A model by kind; its library is looked for only where it is used."""
    if kind not in MODELS:
        raise ValueError(f"unknown embedding model: {kind}")
    return MODELS[kind](**options)


def embed_text(section: Column, subsection: Column, text: Column) -> Column:
    """What a chunk is embedded by: its headings, if it has any, and its text."""
    parts = F.concat(F.coalesce(section, F.lit("")), F.lit(" "), F.coalesce(subsection, F.lit("")))
    return F.trim(F.concat(F.trim(parts), F.lit(" "), F.coalesce(text, F.lit(""))))


def embed(df: DataFrame, embedder: Embedder, text: Column, *, batch_size: int = 32, normalize: bool = True, out_col: str = "embedding") -> DataFrame:
    """``df`` with its vectors, batch by batch, in one Arrow pass; a null text is empty."""
    fields = [f for f in df.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = [np.asarray(embedder.encode(texts[k : k + batch_size])) for k in range(0, len(texts), batch_size)]
            x = np.concatenate(found) if found else np.zeros((0, embedder.dim))
            if normalize:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=schema.names)

    schema = T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])
    return df.select(text, *[f"`{f.name}`" for f in fields]).mapInArrow(run, schema)


def mean_pool(df: DataFrame, keys: list[str], vector_col: str, mask_col: str | None = None) -> DataFrame:
    """Mask-weighted mean of a group's vectors, by position, combined map-side."""
    mask = F.col(mask_col).cast("double") if mask_col else F.lit(1.0)
    rows = df.select(*keys, mask.alias("__m"), F.posexplode(vector_col).alias("__i", "__x"))
    sums = rows.groupBy(*keys, "__i").agg((F.sum(F.col("__x").cast("double") * F.col("__m")) / F.greatest(F.sum("__m"), F.lit(1e-9))).alias("__v"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda s: s["__v"]).alias(vector_col))
