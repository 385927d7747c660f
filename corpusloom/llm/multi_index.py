"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of cells. A vector
lies in the cell of its two nearest centroids and visits cells in the order of the
multi-sequence algorithm, by the squared distance to their borders in both halves,
until the target recall: the distance within which that share of vectors just at the
threshold stays, measured on the codebook sample by random rotation to the threshold
and on the linked pairs among ``CALIBRATE`` of its vectors. Found pairs are verified by
cosine in double precision.

Codebooks grow with the square root of the number of vectors, so that a cell's mean
load stays the same up to ``MOST_CENTROIDS`` squared cells; beyond, cells are larger,
and nothing else changes. They are fitted on at most ``PER_CENTROID`` vectors for each
centroid and ``SAMPLE`` at least, those of the least hashes; every vector is indexed.
Equal vectors form a class, combined on the map side; cells too large for one task are
cut into blocks; a task emits sums of links and a spanning forest, never pairs in a
group. As every link is counted, the distinct vectors of one dense cell are all compared.

Defined results: a null id or label, and a vector that is null, empty, zero, or holds a
null or a non-finite component, link with nothing; so do vectors of different lengths;
rows that repeat an id are vectors of their own under one component; a cosine of just
the threshold links; of equal distances to centroids the first one counts; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import draw
from .components import components
from .scratch import column, drop_scratch, materialize
from .skew import heavy_keys, spread_join

THRESHOLD, TARGET_RECALL = 0.98, 0.9999
SAMPLE, PER_CENTROID, CALIBRATE, ROUNDS, BLOCK = 4096, 8, 2048, 12, 1024
MOST_CENTROIDS = 4096
#: Share by which visits reach further than links are counted, far above any rounding.
MARGIN = 1e-9


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0.0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_square(x[at : at + 4096], c).argmin(axis=1) for at in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return np.unique(c, axis=0)


@dataclass
class Grid:
    """Two codebooks and the squared border distance up to which cells are visited."""

    books: tuple[np.ndarray, np.ndarray]
    reach: float = 0.0

    @property
    def cut(self) -> int:
        return self.books[0].shape[1]

    def borders(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cells (n x 2), and for each half the squared distances to the borders
        between the own cell and all others."""
        own, far = [], []
        for half, c in zip((x[:, : self.cut], x[:, self.cut :]), self.books, strict=True):
            d = _square(half, c)
            a = d.argmin(axis=1)
            apart = np.sqrt(_square(c[a], c))
            gap = np.where(apart > 0, (d - d[np.arange(len(d)), a][:, None]) / (2 * np.where(apart > 0, apart, 1)), 0.0)
            own.append(a)
            far.append(np.maximum(gap, 0.0) ** 2)
        return np.stack(own, axis=1), far

    def number(self, cells: np.ndarray) -> np.ndarray:
        return cells[:, 0] * len(self.books[1]) + cells[:, 1]

    def visits(self, far1: np.ndarray, far2: np.ndarray) -> list[int]:
        """Cells of one vector, nearest first, out to the reach and a margin."""
        limit = self.reach * (1 + MARGIN) + MARGIN**2
        first, second = np.argsort(far1, kind="stable"), np.argsort(far2, kind="stable")
        width, out, heap, seen = len(far2), [], [(0.0, 0, 0)], {(0, 0)}
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > limit:
                break
            out.append(int(first[i]) * width + int(second[j]))
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(far1) and q < width and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (float(far1[first[p]] + far2[second[q]]), p, q))
        return out

    def border(self, x: np.ndarray, home: np.ndarray, cell: int) -> np.ndarray:
        """Squared distance of each row, of cell ``home``, to the border of one other cell;
        row by row, so that the result doesn't depend on the rows beside it."""
        total = np.zeros(len(x))
        for half, c, own, other in zip((x[:, : self.cut], x[:, self.cut :]), self.books, np.divmod(home, len(self.books[1])), divmod(cell, len(self.books[1])), strict=True):
            mine, theirs = c[own], c[other]
            apart = np.sqrt(((mine - theirs) ** 2).sum(axis=1))
            gap = (((half - theirs) ** 2).sum(axis=1) - ((half - mine) ** 2).sum(axis=1)) / (2 * np.where(apart > 0, apart, 1))
            total += np.where(apart > 0, np.maximum(gap, 0.0), 0.0) ** 2
        return total


def fit_grid(sample: np.ndarray, cells: int, threshold: float, recall: float, seed: int = 5) -> Grid:
    """Codebooks of ``cells`` centroids, and the reach for the target recall."""
    cut = sample.shape[1] // 2
    grid = Grid((kmeans(sample[:, :cut], cells), kmeans(sample[:, cut:], cells)))
    some = sample[:: max(1, len(sample) // CALIBRATE)][:CALIBRATE]
    own, far = grid.borders(some)
    rng = np.random.default_rng(seed)
    rows, needs = np.arange(len(some)), []
    for _ in range(max(1, math.ceil(20_000 / len(some)))):
        noise = rng.normal(size=some.shape)
        noise -= (noise * some).sum(axis=1, keepdims=True) * some
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        moved = threshold * some + math.sqrt(max(0.0, 1 - threshold**2)) * noise / np.where(length > 0, length, 1)
        there, _ = grid.borders(moved)
        needs.append(far[0][rows, there[:, 0]] + far[1][rows, there[:, 1]])
    reach = float(np.quantile(np.concatenate(needs), recall))
    needs = []
    for at in range(0, len(some), 256):
        i, j = np.nonzero(some[at : at + 256] @ some.T >= threshold)
        i, j = i[i + at != j] + at, j[i + at != j]
        needs.append((far[0][i, own[j, 0]] + far[1][i, own[j, 1]]).astype(np.float32))
    if len(needs := np.concatenate(needs)):
        reach = max(reach, float(np.quantile(needs, recall)))
    grid.reach = reach * 1.05 + 1e-12
    return grid


def _vectors(column: pa.Array, width: int, code: str) -> np.ndarray:
    """Vectors of any length up to ``width``, the rest zero, in double precision."""
    out = np.zeros((len(column), width))
    for k, raw in enumerate(column.to_pylist()):
        v = np.frombuffer(raw, code)
        out[k, : len(v)] = v
    return out


def _pack(code: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.asarray(v.values.to_numpy(zero_copy_only=False), code).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary()), batch.column(2)], names=["id", "v", "r"])

    return run


def place(classes: DataFrame, grid: Grid, width: int, code: str) -> DataFrame:
    """A row for each class in its own cell (role 0) and in all that it visits (1), with
    its own cell as ``home``."""
    names = [*classes.columns, "cell", "role", "home"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = unit_rows(_vectors(part.column(1), width, code))
                own, far = grid.borders(x)
                home = grid.number(own)
                seen = [grid.visits(far[0][k], far[1][k]) for k in range(len(x))]
                index = np.repeat(np.arange(len(x)), [len(cells) + 1 for cells in seen])
                cell = [c for k, cells in enumerate(seen) for c in (int(home[k]), *cells)]
                role = [r for cells in seen for r in (0, *[1] * len(cells))]
                taken = part.take(pa.array(index))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int64()), pa.array(role, pa.int32()), pa.array(home[index].astype(np.int64))], names=names)

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("cell", T.LongType()), T.StructField("role", T.IntegerType()), T.StructField("home", T.LongType())]))


def _compare(ids, w, x, role, home, cell: int, grid: Grid, threshold: float) -> tuple[list, list, list]:
    """(a, b, n): sums of linked rows for each id (b null), and links that span."""
    r, p = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    if not len(r) or not len(p):
        return [], [], []
    linked = x[p] @ x[r].T >= threshold
    # Either side may have found the pair: in one cell the lesser id counts, in two the
    # lesser cell, unless only one side reaches the other. Both tasks decide by the same
    # two numbers, each from one row, its home and one cell.
    reaches = grid.border(x[p], home[p], cell) <= grid.reach
    linked &= reaches[:, None] & (ids[p][:, None] != ids[r][None, :])
    for there in np.unique(home[p[linked.any(axis=1)]]).tolist():
        some = np.flatnonzero(home[p] == there)
        if there == cell:
            linked[some] &= ids[p[some]][:, None] < ids[r][None, :]
        elif cell > there:
            linked[some] &= ~(grid.border(x[r], home[r], there) <= grid.reach)[None, :]
    i, j = np.nonzero(linked)
    u, v = p[i], r[j]
    if not len(u):
        return [], [], []
    names, both = np.unique(np.concatenate([ids[u], ids[v]]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    sums = np.bincount(a, weights=w[v], minlength=len(names)) + np.bincount(b, weights=w[u], minlength=len(names))
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(names)))
    return [*names, *names[tied]], [*[None] * len(names), *names[label[tied]]], [*sums.astype(np.int64), *[0] * len(tied)]


def search(rows: DataFrame, grid: Grid, width: int, code: str, threshold: float) -> DataFrame:
    """Compare each cell's own classes with its visitors; rows (id, v, w, cell, role,
    home, tag) come sorted by tag, the cell and block in its label and length."""
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tag = None

        def flush() -> tuple[list, list, list]:
            ids, w, x, role, home = (np.concatenate([h[k] for h in held]) for k in range(5))
            return _compare(ids, w, x, role, home, tag[0], grid, threshold)

        target = None
        for batch in batches:
            if not batch.num_rows:
                continue
            target = batch.column(0).type
            ids, w, cell, role, home, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5, 6))
            x = unit_rows(_vectors(batch.column(1), width, code))
            change = np.flatnonzero((tags[1:] != tags[:-1]) | (cell[1:] != cell[:-1])) + 1
            out: tuple[list, list, list] = ([], [], [])
            for begin, end in zip([0, *change], [*change, len(tags)], strict=True):
                now = (int(cell[begin]), tags[begin])
                if held and now != tag:
                    for o, f in zip(out, flush(), strict=True):
                        o.extend(f)
                    held = []
                tag = now
                held.append((ids[begin:end], w[begin:end], x[begin:end], role[begin:end], home[begin:end]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], target), pa.array(out[1], target), pa.array(out[2], pa.int64())], names=["a", "b", "n"])
        if held:
            out = flush()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], target), pa.array(out[1], target), pa.array(out[2], pa.int64())], names=["a", "b", "n"])

    return rows.select("id", "v", "w", "cell", "role", "home", "tag").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType())]))


def centroids(n: int) -> int:
    """The size of a codebook for ``n`` vectors."""
    return min(MOST_CENTROIDS, max(8, 1 << round(math.log2(math.sqrt(n / 256) + 1))))


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """A row for each of ``df``: id_col, n_links, component_id and kept."""
    v = column(vector_col)
    code, kind = ("<f4", "array<float>") if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else ("<f8", "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = column(id_col).isNotNull() & column(label_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))
    base = df.select(column(id_col).alias("id"), F.when(good, v.cast(kind)).alias("x"), column(label_col).alias("label"))
    usable = base.filter(F.col("x").isNotNull()).withColumn("d1", F.xxhash64("label", "x")).withColumn("d2", F.xxhash64(F.lit(1), "label", "x"))
    digest, by = ["d1", "d2"], ["label", "dim", "cell"]
    # Equal vectors are combined where they lie: what is exchanged is a row for each task and class.
    classes = usable.groupBy(*digest).agg(F.min("id").alias("id"), F.first("x").alias("x"), F.first("label").alias("label"), F.count("*").alias("w"))
    packed = classes.select("id", "x", F.struct(*digest, "label", F.size("x").alias("dim"), "w").alias("r"))
    schema = T.StructType([packed.schema["id"], T.StructField("v", T.BinaryType()), packed.schema["r"]])
    packed = materialize(packed.mapInArrow(_pack(code), schema).select("id", "v", "r.*"), "vectors")
    size = packed.agg(F.count("*").alias("n"), F.max("dim").alias("width")).first()
    alone = base.filter(F.col("x").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if size["n"]:
        width = max(2, size["width"])
        cells = centroids(size["n"])
        most = max(SAMPLE, PER_CENTROID * cells)
        h = F.xxhash64("d1", "d2")
        drawn = draw.least(packed.select("v", h.alias("h")).filter(draw.part(h, draw.share(most, size["n"]))), "h", most).select("v").collect()
        grid = fit_grid(unit_rows(_vectors(pa.array(sorted(bytes(r["v"]) for r in drawn)), width, code)), cells, threshold, recall)

        placed = materialize(place(packed.select("id", "v", "label", "dim", "w"), grid, width, code), "cells")
        sizes = placed.groupBy(*by).agg(F.ceil(F.sum(1 - F.col("role")) / block).cast("int").alias("nr"), F.ceil(F.sum("role") / block).cast("int").alias("np"), F.count("*").alias("n"))
        sizes = materialize(sizes.filter((F.col("nr") > 0) & (F.col("np") > 0)), "sizes")
        rows = spread_join(placed, sizes.drop("n"), by, heavy_keys(sizes, by, "n"), F.xxhash64("id", "role"))
        mine, others = F.when(F.col("role") == 0, F.col("nr")).otherwise(F.col("np")), F.when(F.col("role") == 0, F.col("np")).otherwise(F.col("nr"))
        rows = rows.withColumn("at", F.pmod(F.xxhash64("id"), mine)).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        rows = rows.withColumn("tag", F.xxhash64(*by, F.when(F.col("role") == 0, F.col("at")).otherwise(F.col("other")).cast("long"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("at")).cast("long")))
        dealt = rows.repartition("tag").sortWithinPartitions("tag", "cell", "role", "id")
        found = materialize(search(dealt, grid, width, code, threshold), "found")
        drop_scratch(placed, sizes)
        sums = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
        # An id with several vectors joins their classes.
        several = usable.groupBy("id").agg(*[f(d).alias(f"{f.__name__}_{d}") for f in (F.min, F.max) for d in digest]).filter("min_d1 <> max_d1 or min_d2 <> max_d2")
        joined = usable.select("id", *digest).join(several.select("id"), "id", "left_semi").join(packed.select(F.col("id").alias("b"), *digest), digest).select(F.col("id").alias("a"), "b")
        labels = components(found.filter(F.col("b").isNotNull()).select("a", "b").union(joined), "a", "b").withColumnRenamed("node", "id")
        named = packed.select(*digest, "id", "w").join(sums, "id", "left").join(labels, "id", "left")
        links = (F.col("w") - 1 + F.coalesce("linked", F.lit(0))).cast("long")
        named = named.select(*digest, links.alias("n_links"), F.coalesce("component", "id").alias("component"))
        whole = spread_join(usable.select("id", *digest), named, digest, heavy_keys(packed, digest, "w"), F.xxhash64("id"))
        # Rows that link with nothing join nothing, so that they don't meet under one key.
        alone = alone.unionByName(whole.select("id", "n_links", "component"))
    return alone.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, d.vec_id = m.component_id AS kept
FROM embeddings d JOIN m ON m.id = d.vec_id LEFT JOIN n ON n.a = d.vec_id
"""

QUERIES = {"op8_multi_index": op8_multi_index}
ORACLES = {"op8_multi_index": ORACLE}
