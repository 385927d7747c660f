"""Sums of vectors and of their outer products by group, as packed binary partials.

The moments of a group are one array of doubles: the number of vectors, the sums of the
second and fourth powers of their norms, the number of those not zero, their sum, and the
upper triangle of their Gram matrix. It travels in pieces of ``PIECE`` doubles, (g, c, m), that are
added up in two levels, so that neither a task nor a row grows with the number of
rows, groups or tasks, and a group that holds most rows is spread over salts and pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of sums that a task holds at once before it gives them away.
HELD_BYTES = 64 << 20
#: Doubles to a piece, and salts of the first level of adding up.
PIECE, SALTS = 4096, 32
HEAD = 4
SCHEMA = "g string, c int, m binary"
_ARROW = pa.schema([("g", pa.string()), ("c", pa.int32()), ("m", pa.binary())])


def length(dim: int) -> int:
    return HEAD + dim + dim * (dim + 1) // 2


def pack(x: np.ndarray) -> np.ndarray:
    """The moments of the rows of ``x``."""
    n2 = (x * x).sum(axis=1)
    head = [len(x), n2.sum(), (n2 * n2).sum(), np.count_nonzero(n2)]
    return np.concatenate([head, x.sum(axis=0), (x.T @ x)[np.triu_indices(x.shape[1])]])


def unpack(m: np.ndarray, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sum, Gram matrix) of a group's moments."""
    gram = np.zeros((dim, dim))
    gram[np.triu_indices(dim)] = m[HEAD + dim :]
    return m[0], m[HEAD : HEAD + dim], gram + np.triu(gram, 1).T


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one key, which lie beside each other, added up; one sum is held."""
    key, held = None, None
    given = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([held.tobytes()], pa.binary())], schema=_ARROW)
    for batch in batches:
        for g, c, m in zip(batch["g"], batch["c"], batch["m"], strict=True):
            new, at = np.frombuffer(m.as_buffer()), (g.as_py(), c.as_py())
            if at == key:
                held += new
                continue
            if key is not None:
                yield given()
            key, held = at, new.copy()
    if key is not None:
        yield given()


def merge(parts: DataFrame) -> DataFrame:
    """One row for each (g, c): first by salts of the task that gave a piece, then whole."""
    salted = parts.select("g", "c", "m", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("__s"))
    first = salted.repartition("g", "c", "__s").sortWithinPartitions("g", "c", "__s").select("g", "c", "m").mapInArrow(_added, SCHEMA)
    return first.repartition("g", "c").sortWithinPartitions("g", "c").mapInArrow(_added, SCHEMA)


def moments(df: DataFrame, vector_col: str, group_col: str | None, dim: int) -> DataFrame:
    """(g, c, m) of usable vectors of length ``dim``; without ``group_col`` one group, null."""
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    most = max(1, HELD_BYTES // (8 * length(dim)))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def given() -> pd.DataFrame:
            rows = [(g, c, m[at : at + PIECE].tobytes()) for g, m in held.items() for c, at in enumerate(range(0, len(m), PIECE))]
            return pd.DataFrame(rows, columns=["g", "c", "m"])

        for batch in batches:
            for g, part in batch.groupby("g", dropna=False):
                key = None if g is None or g != g else g
                new = pack(np.stack(part["v"]).astype(np.float64))
                held[key] = held[key] + new if key in held else new
                if len(held) >= most:
                    yield given()
                    held.clear()
        if held:
            yield given()

    return merge(df.select(group.alias("g"), F.col(vector_col).alias("v")).mapInPandas(partial, SCHEMA))


def whole(each: DataFrame) -> DataFrame:
    """The moments of all groups taken together, as the group null."""
    return merge(each.withColumn("g", F.lit(None).cast("string")))


def pair_sums(each: DataFrame, dim: int) -> DataFrame:
    """(g, n, some, s, q): vectors, those not zero, and over pairs i < j the sum of inner
    products and that of their squares. Squares add up over pieces, so none is put together."""
    diagonal = HEAD + dim + np.cumsum([0, *range(dim, 1, -1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, m in zip(batch["c"].to_pylist(), batch["m"], strict=True):
                x, start = np.frombuffer(m.as_buffer()), c * PIECE
                square = x * x
                at = np.arange(start, start + len(x))
                on = diagonal[(diagonal >= start) & (diagonal < start + len(x))] - start
                of_sum = square[(at >= HEAD) & (at < HEAD + dim)].sum()
                of_gram = 2 * square[at >= HEAD + dim].sum() - square[on].sum()
                n, n2, n4, some = x[:HEAD] if c == 0 else np.zeros(HEAD)
                out.append((n, some, (of_sum - n2) / 2, (of_gram - n4) / 2))
            columns = np.array(out, np.float64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch["g"], *map(pa.array, columns)], names=["g", "n", "some", "s", "q"])

    return each.mapInArrow(run, "g string, n double, some double, s double, q double").groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "some", "s", "q")])


def joined(each: DataFrame) -> DataFrame:
    """(g, ms): the pieces of each group in order, together as long as the square of the
    dimension."""
    pieces = F.array_sort(F.collect_list(F.struct("c", "m")))
    return each.groupBy("g").agg(F.transform(pieces, lambda p: p["m"]).alias("ms"))
