"""Vectors by cell: exact search and exact near pairs that skip what bounds rule out.

Each vector belongs to the cell of its nearest centre. Centres come from a bounded sample
and decide what is skipped, never what is found. There are at most ``MOST_CELLS`` cells, so
centres and figures of cells may be broadcast; a cell of many rows is dealt to blocks of
bounded size. Null ids, and vectors that are null, empty or hold a null or a non-finite
element, take no part; vectors of several lengths are an error; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions import vectors
from corpusloom.functions.frozen import frozen

from .search import CORPUS_BLOCK, QUERY_BLOCK, best_of, pair_schema

#: Cells at most; vectors that centres are fitted on, and rounds of it.
MOST_CELLS, SAMPLE, ROUNDS = 4096, 16_384, 8
#: Rows to a side of a block of near pairs.
PAIR_BLOCK = 4096
#: Share by which bounds are widened, far above any rounding.
SLACK = 1e-9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0.0)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.filter(F.col(id_col).isNotNull() & vectors.usable(F.col(vector_col))).select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v"))


def _size(rows: DataFrame) -> tuple[int, float]:
    """(rows, greatest norm)."""
    n = F.size("__v")
    found = rows.agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.max(vectors.norm(F.col("__v"))).alias("norm")).first()
    if found["least"] != found["most"]:
        raise ValueError(f"vectors of several lengths, {found['least']} to {found['most']}")
    return found["n"], found["norm"] or 0.0


def fit_centres(rows: DataFrame, n: int, cells: int | None = None) -> np.ndarray:
    """Centres for ``n`` vectors ``__v``: about the root of n, of a sample chosen by hash."""
    cells = min(cells or max(1, math.isqrt(n)), MOST_CELLS)
    sample = rows.select("__v").orderBy(F.xxhash64("__v")).limit(min(SAMPLE, 64 * cells)).toArrow()
    x = np.unique(_matrix(sample["__v"].combine_chunks()), axis=0)
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = np.concatenate([_distances(x[at : at + 1024], c).argmin(axis=1) for at in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(c))
        c = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], c)
    return np.unique(c, axis=0)


def _dealt(asking: DataFrame, held: DataFrame, ask_block: int, held_block: int):
    """Rows that ask for a cell beside the rows that the cell holds, by blocks of both."""
    asked = asking.groupBy("cell").agg(F.ceil(F.count("*") / ask_block).cast("int").alias("__as"))
    sizes = F.broadcast(held.groupBy("cell").agg(F.ceil(F.count("*") / held_block).cast("int").alias("__hs")).join(asked, "cell"))
    part = lambda n: F.pmod(F.xxhash64("__id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asking.join(sizes, "cell").select(*asking.columns, part("__as").alias("__a"), each("__hs").alias("__h"))
    # New names for columns that both sides may have from one table.
    h = held.join(sizes, "cell").select(*[F.col(c).alias(c) for c in held.columns], each("__as").alias("__a"), part("__hs").alias("__h"))
    return a.groupBy("cell", "__a", "__h").cogroup(h.groupBy("cell", "__a", "__h"))


def visits(rows: DataFrame, centres: np.ndarray, threshold: float, most: float) -> DataFrame:
    """``rows`` (__id, __v, ...) with their own cell ``__home``, one for each ``cell`` that
    may hold a vector of an inner product of at least ``threshold``, for norms up to ``most``:
    the own one, and of the others those of a greater number.

    A partner lies within d, d² = |x|² + most² - 2 threshold, and on the far side of the plane
    between both centres, so a row further than d from that plane has none there."""
    apart, names = np.sqrt(_distances(centres, centres)), [*rows.columns, "__home", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1))
                d = _distances(x, centres)
                home = d.argmin(axis=1)
                own = d[np.arange(len(x)), home]
                reach = np.sqrt(np.maximum((x * x).sum(axis=1) + most * most - 2 * threshold, 0.0))
                near = d - own[:, None] <= 2 * apart[home] * reach[:, None] + SLACK * (1 + most * most)
                near &= np.arange(len(centres)) > home[:, None]
                near[np.arange(len(x)), home] = True
                row, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(home[row].astype(np.int32)), pa.array(cell.astype(np.int32))], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__home", T.IntegerType()), T.StructField("cell", T.IntegerType())]))


def _classes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(__id, __v, __n): different vectors with the least id and the number of their rows."""
    return frozen(_usable(df, id_col, vector_col).groupBy("__v").agg(F.min("__id").alias("__id"), F.count("*").alias("__n")).select("__id", "__v", "__n"))


def _near(asking: pa.Table, held: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row that asks, row held, inner product) of near classes, each two of them once and
    a class of several rows also with itself."""
    x, y = _matrix(asking["__v"].combine_chunks()), _matrix(held["__v"].combine_chunks())
    mine, theirs = (t["__id"].to_numpy() for t in (asking, held))
    at_home, many = asking["__home"].to_numpy() == asking["cell"].to_numpy(), asking["__n"].to_numpy() > 1
    for at in range(0, len(x), 256):
        part = x[at : at + 256] @ y.T
        p, q = np.nonzero(part >= threshold)
        a, b = mine[p + at], theirs[q]
        keep = ~at_home[p + at] | (a < b) | ((a == b) & many[p + at])
        yield p[keep] + at, q[keep], part[p[keep], q[keep]]


def _meet(classes: DataFrame, threshold: float, cells: int | None, block: int, run, schema: T.StructType) -> DataFrame:
    """``run`` over blocks of classes that ask and classes that are held, by cell."""
    n, most = _size(classes)
    if not n:
        return classes.sparkSession.createDataFrame([], schema)
    placed = visits(classes, fit_centres(classes, n, cells), threshold, most)
    homes = placed.filter(F.col("__home") == F.col("cell")).drop("__home")
    return _dealt(placed, homes, block, block).applyInArrow(run, schema)


def near_classes(df: DataFrame, threshold: float = 0.95, *, id_col: str, vector_col: str = "embedding", cells: int | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b, cosine, n_a, n_b) of classes of equal vectors, named by their least id, whose
    inner product is at least ``threshold``: a < b, and a = b for a class of several rows
    that reaches it with itself. All links of the rows follow, without a row for each; where
    many vectors that differ are near each other, ``near_links`` gives fewer rows."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("cosine", T.DoubleType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asking) or not len(held):
            return arrow.empty_table()
        i, j, s = (np.concatenate(z) for z in zip(*_near(asking, held, threshold), strict=True))
        swap = asking["__id"].to_numpy()[i] > held["__id"].to_numpy()[j]
        ids = asking["__id"].combine_chunks().take(pa.array(i)), held["__id"].combine_chunks().take(pa.array(j))
        counts = asking["__n"].to_numpy()[i], held["__n"].to_numpy()[j]
        pick = lambda first: pc.if_else(pa.array(swap), ids[1 - first], ids[first])
        return pa.table([pick(0), pick(1), pa.array(s), pa.array(np.where(swap, counts[1], counts[0])), pa.array(np.where(swap, counts[0], counts[1]))], schema=arrow)

    return _meet(_classes(df, id_col, vector_col), threshold, cells, block, run, schema)


def near_links(df: DataFrame, threshold: float = 0.95, *, id_col: str, vector_col: str = "embedding", cells: int | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """(id, class_id, n_links) of each row that takes part: the least id of the rows with its
    vector, and how many other rows it has an inner product of at least ``threshold`` with.
    Blocks give counts by class, so no pair is a row, however many vectors are near."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("__id", kind), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)
    classes = _classes(df, id_col, vector_col)

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asking) or not len(held):
            return arrow.empty_table()
        mine, theirs, n_a, n_h = (t[c].to_numpy() for c in ("__id", "__n") for t in (asking, held))
        a, h = np.zeros(len(mine), np.int64), np.zeros(len(theirs), np.int64)
        for i, j, _ in _near(asking, held, threshold):
            itself = mine[i] == theirs[j]
            np.add.at(a, i, n_h[j] - itself)
            np.add.at(h, j[~itself], n_a[i[~itself]])
        ids = pa.chunked_array([t["__id"].combine_chunks().filter(pa.array(c > 0)) for t, c in ((asking, a), (held, h))])
        return pa.table([ids, pa.array(np.concatenate([a[a > 0], h[h > 0]]))], schema=arrow)

    counts = _meet(classes, threshold, cells, block, run, schema).groupBy("__id").agg(F.sum("n").alias("n"))
    found = classes.join(counts, "__id", "left").select("__v", F.col("__id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
    return _usable(df, id_col, vector_col).join(found, "__v").select(F.col("__id").alias(id_col), "class_id", "n_links")


def write_cells(df: DataFrame, path: str, *, id_col: str, vector_col: str = "embedding", cells: int | None = None) -> None:
    """Store vectors in a folder for each cell, and beside them a row for each cell: its centre,
    rows, and of its vectors the span along the centre and the most they leave it by."""
    spark, rows = df.sparkSession, _usable(df, id_col, vector_col)
    n, _ = _size(rows)
    c = fit_centres(rows, n, cells) if n else np.zeros((0, 0))
    length = np.linalg.norm(c, axis=1)
    unit = c / np.where(length > 0, length, 1.0)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1))
                cell = _distances(x, c).argmin(axis=1)
                along = (x * unit[cell]).sum(axis=1)
                off = np.linalg.norm(x - along[:, None] * unit[cell], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(along), pa.array(off), pa.array(cell.astype(np.int32))], names=["__id", "__v", "along", "off", "cell"])

    schema = T.StructType([*rows.schema.fields, T.StructField("along", T.DoubleType()), T.StructField("off", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    placed = rows.mapInArrow(run, schema).hint("rebalance", "cell")
    out = placed.write.mode("overwrite")
    (out.partitionBy("cell") if n else out).parquet(f"{path}/vectors")
    centres = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "cell int, centre array<double>")
    figures = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("off").alias("off"))
    figures.join(F.broadcast(centres), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def topk(queries: DataFrame, path: str, k: int, *, query_id: str = "query_id", item_id: str = "item_id", vector_col: str = "embedding", first_only: bool = False) -> DataFrame:
    """The k best stored items of each query by inner product, as ``vector_topk`` gives them.

    A query first meets its nearest cells that hold k rows. Of the others it meets those
    whose bound isn't under the k-th score so far: a vector's share along the centre lies
    in the cell's span, and what leaves the centre counts at most with its length.
    ``first_only`` keeps to the first step, which is no exact answer."""
    spark = queries.sparkSession
    stored = spark.read.parquet(f"{path}/vectors")
    asked = _usable(queries, query_id, vector_col)
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    held = stored.select("__id", "__v", "cell")
    kind = pair_schema(asked.withColumnRenamed("__id", query_id), held.withColumnRenamed("__id", item_id), query_id, item_id, "score")
    if not len(cells):
        return spark.createDataFrame([], kind).withColumn("rank", F.lit(0))
    c = _matrix(cells["centre"].combine_chunks())
    number, n, low, high, off = (cells[name].to_numpy() for name in ("cell", "n", "low", "high", "off"))
    length = np.linalg.norm(c, axis=1)
    unit = c / np.where(length > 0, length, 1.0)[:, None]
    most = float(np.hypot(np.maximum(abs(low), abs(high)), off).max())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                order = np.argsort(-(_matrix(part.column(1)) @ c.T), axis=1)
                enough = (np.cumsum(n[order], axis=1) < k).sum(axis=1) + 1
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([number[o[:e]].tolist() for o, e in zip(order, enough, strict=True)], pa.list_(pa.int32()))], names=["__id", "__v", "first"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1))
                z, square = x @ unit.T, (x * x).sum(axis=1)
                bound = np.maximum(z * low, z * high) + np.sqrt(np.maximum(square[:, None] - z * z, 0.0)) * off
                may = bound >= (part.column(3).to_numpy(zero_copy_only=False) - SLACK * (1 + np.sqrt(square) * most))[:, None]
                seen = part.column(2)
                may[np.repeat(np.arange(len(x)), pc.list_value_length(seen).to_numpy()), np.searchsorted(number, pc.list_flatten(seen).to_numpy())] = False
                row, cell = np.nonzero(may)
                yield pa.RecordBatch.from_arrays([*part.select(["__id", "__v"]).take(pa.array(row)).columns, pa.array(number[cell].astype(np.int32))], names=["__id", "__v", "cell"])

    def scored(asking: DataFrame) -> DataFrame:
        found = _dealt(asking, held, QUERY_BLOCK, CORPUS_BLOCK).applyInArrow(best_of(k, to_arrow_schema(kind)), kind)
        order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(item_id))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    begun = frozen(asked.mapInArrow(first, T.StructType([*asked.schema.fields, T.StructField("first", T.ArrayType(T.IntegerType()))])))
    near = frozen(scored(begun.select("__id", "__v", F.explode("first").alias("cell"))))
    if first_only:
        return near
    floor = near.filter(F.col("rank") == k).select(F.col(query_id).alias("__id"), F.col("score").alias("floor"))
    open_cells = begun.join(floor, "__id", "left").select("__id", "__v", "first", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    rest = scored(open_cells.mapInArrow(others, T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())])))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(item_id))
    return near.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
