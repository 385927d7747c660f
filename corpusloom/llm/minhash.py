r"""Near duplicates by word shingles: MinHash bands propose pairs, sequential Bayesian
verification drops those that can hardly be similar enough, and exact sets decide.

Words are runs of ``[^\x20\x09-\x0D]`` with A-Z lower-cased; a document's set is that
of its distinct five-word shingles, or its whole word sequence if that is shorter.

1. Documents with equal sets form a class, combined on the map side; only classes go on.
2. In each bucket of equal bands all members are paired with one of them, the one
   whose own buckets are largest: as many pairs as rows, whatever the bucket's size.
   Pairs of a member that many share are dealt to several tasks.
3. Pairs are compared by batches of signature slots. After each batch the posterior
   of the similarity (uniform prior) is bounded, and the pair dropped when similarity
   over the threshold has a probability below ``miss``. Survivors are verified exactly.
4. In buckets whose members are not all in one component yet (large ones are cut by
   further bands first), members are compared block by block, across components alone,
   in the same sequential way, each pair in the bucket of its first common band. Members
   with a survivor meet once more, with their texts, and are verified on the spot, so
   pairs are never rows. In buckets of up to ``WIDE_BLOCKS`` blocks no candidate between
   different components is left untried; in larger ones members meet within the further
   bands alone, which miss a pair at the threshold with a probability of ``MISS`` at most.

Defined results: a null or empty text, or one without words, has an empty set and
links with nothing; a null doc_id links with nothing; rows that repeat a doc_id are
one node, whatever their texts; a similarity of just the threshold links, and of equal
ids for a component the least stands; texts of any length are read whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import column, drop_scratch, materialize, small_batches
from .skew import heavy_keys, spread_join

WIDTH, SLOTS, BATCH, THRESHOLD = 5, 128, 32, 0.8
#: Probability, for a pair at the threshold, that the bands or the posterior bound miss it.
MISS = 1e-6
#: Members of a bucket, and shingles in their sets, that a task holds twice at once.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Buckets of more blocks are cut into smaller ones by further bands first.
WIDE_BLOCKS = 16
PRIME = np.uint64(0x9E3779B97F4A7C15)


def band_rows(threshold: float, slots: int = SLOTS, miss: float = MISS) -> int:
    """The most slots to a band that keep the chance of sharing no band under ``miss``."""
    fits = [r for r in range(1, 17) if (1 - threshold**r) ** (slots // r) <= miss]
    return max(fits, default=1)


KEPT_WORDS = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS:  # the first to come are the frequent ones
            self[word] = value
        return value


_HASHES = _WordHashes()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    w = min(n, width)
    h = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        h ^= ids[i : n - w + 1 + i]
        h *= PRIME
        h ^= h >> np.uint64(29)
    h *= PRIME
    h ^= h >> np.uint64(32)
    return np.unique(h)


@cache
def _maps(slots: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, (slots, 1), dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, (slots, 1), dtype=np.uint32)


def signature(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    a, b = _maps(slots)
    least = np.full(slots, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (a * x[at : at + 1024] + b).min(axis=1), out=least)
    return least


def band_keys(rows: int, slots: int = SLOTS) -> Column:
    """The keys of a signature's bands: each a hash of the band's number and its slots."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 2 * rows * k + 1, 2 * rows)) for k in range(slots // rows)])


def sketch(docs: DataFrame, id_col: str, text_col: str, *, width: int = WIDTH, slots: int = SLOTS) -> DataFrame:
    """id, n (size of the set), d1 and d2 (digest of the set), and sig: the low 16 bits of
    each slot, of which the bands are made as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sigs = [], [], [], []
            for text in batch.column(1):
                x = shingle_set(text.as_py(), width)
                raw = x.tobytes()
                n.append(len(x))
                d1.append(xxhash.xxh64_intdigest(raw, 1))
                d2.append(xxhash.xxh64_intdigest(raw, 2))
                sigs.append(signature(x, slots).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.array(sigs, pa.binary())], names=["id", "n", "d1", "d2", "sig"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")), T.StructField("sig", T.BinaryType())])
    return docs.select(column(id_col).alias("id"), column(text_col).alias("t")).mapInArrow(run, schema)


def least_matches(threshold: float, slots: int = SLOTS, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each batch end, the least matching slots with which similarity over the
    threshold keeps a posterior probability of ``miss``: under a uniform prior the
    posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    found = []
    for n in range(batch, slots + 1, batch):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        found.append(m)
    return found


def _sequential(a: np.ndarray, b: np.ndarray, bounds: list[int], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of b (against those of a, or one) stay through all batches, and their matches."""
    some = np.arange(len(b))
    matches = np.zeros(len(b), np.int32)
    for k, least in enumerate(bounds):
        part = slice(k * batch, (k + 1) * batch)
        left = a[part] if a.ndim == 1 else a[some, part]
        matches[some] += (left == b[some, part]).sum(axis=1, dtype=np.int32)
        some = some[matches[some] >= least]
    return some, matches[some]


def _matrix(column: pa.Array, slots: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, slots)


def bayes_filter(pairs: DataFrame, bounds: list[int], slots: int = SLOTS) -> DataFrame:
    """The (a, b) of pairs with signatures sa and sb that no bound rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_sequential(_matrix(batch.column(2), slots), _matrix(batch.column(3), slots), bounds)[0]) if batch.num_rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    kind = pairs.schema["a"].dataType
    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


class _Group:
    """Members of one bucket's block, or of two, as they stream in."""

    COLUMNS = ("id", "comp", "at", "n", "sig", "t")

    def __init__(self, tag: tuple, columns: tuple[str, ...], rows: int) -> None:
        self.band, self.key, self.lo, self.hi = tag
        self.rows = rows
        self.tag, self.parts = tag, {c: [] for c in columns}

    def close(self) -> None:
        for c, parts in self.parts.items():
            setattr(self, c, np.concatenate(parts))
        _, self.comp_no = np.unique(self.comp, return_inverse=True)

    def candidates(self, bounds: list[int], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each member and those others, of other components at that time, whose pairs
        with it belong here and that no bound rules out."""
        left = np.flatnonzero(self.at == self.lo)
        right = left if self.lo == self.hi else np.flatnonzero(self.at == self.hi)
        for k, i in enumerate(left.tolist()):
            others = right[k + 1 :] if self.lo == self.hi else right
            n, mine = self.n[others], self.n[i]
            others = others[(self.comp_no[others] != self.comp_no[i]) & (100 * np.minimum(n, mine) >= percent * np.maximum(n, mine))]
            others = others[_sequential(self.sig[i], self.sig[others], bounds)[0]]
            # A pair in several buckets belongs to the one of its first common band.
            if len(others):
                equal = self.sig[others] == self.sig[i]
                banded = equal[:, : equal.shape[1] // self.rows * self.rows].reshape(len(others), -1, self.rows)
                others = others[banded.all(axis=2).argmax(axis=1) == self.band]
            if len(others):
                yield i, others

    def members(self, bounds: list[int], percent: int) -> np.ndarray:
        """The members with a candidate."""
        hit = np.zeros(len(self.id), bool)
        for i, others in self.candidates(bounds, percent):
            hit[i] = True
            hit[others] = True
        return np.flatnonzero(hit)

    def links(self, bounds: list[int], percent: int, width: int) -> list[tuple]:
        """Verified links that join components, as far as they are known here."""
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(self.t[i], width)
            return sets[i]

        found = []
        for i, others in self.candidates(bounds, percent):
            mine = of(i)
            flat = np.concatenate([of(j) for j in others.tolist()])
            at_mine = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            shared = np.add.reduceat((mine[at_mine] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(self.n[others])[:-1]]))
            for j in others[100 * shared >= percent * (self.n[i] + self.n[others] - shared)].tolist():
                if self.comp_no[i] != self.comp_no[j]:
                    self.comp_no[self.comp_no == self.comp_no[j]] = self.comp_no[i]
                    found.append((self.id[i], self.id[j]))
        return found


BLOCK_COLUMNS = ("band", "key", "lo", "hi", "id", "comp", "at", "n", "sig", "t")


def _groups(batches: Iterator[pa.RecordBatch], rows: int, slots: int, with_text: bool) -> Iterator[_Group]:
    """Whole groups of rows that come sorted by band, key, lo and hi."""
    group: _Group | None = None
    names = _Group.COLUMNS if with_text else _Group.COLUMNS[:-1]
    for batch in batches:
        if not batch.num_rows:
            continue
        band, key, lo, hi, ids, comp, at, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
        values = [ids, comp, at, n, _matrix(batch.column(8), slots)]
        if with_text:
            values.append(batch.column(9).to_numpy(zero_copy_only=False))
        change = np.flatnonzero((key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        for begin, end in zip([0, *change], [*change, len(key)], strict=True):
            tag = (band[begin], key[begin], lo[begin], hi[begin])
            if group is not None and group.tag != tag:
                group.close()
                yield group
                group = None
            group = group or _Group(tag, names, rows)
            for c, v in zip(names, values, strict=True):
                group.parts[c].append(v[begin:end])
    if group is not None:
        group.close()
        yield group


def block_members(members: DataFrame, bounds: list[int], percent: int, rows: int, slots: int = SLOTS) -> DataFrame:
    """Those of the members (BLOCK_COLUMNS without the text) that have a candidate."""
    arrow = {f.name: f.dataType for f in members.schema.fields}
    columns = BLOCK_COLUMNS[:-1]
    schema = T.StructType([T.StructField(c, arrow[c]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [f.type for f in batch.schema]
                yield batch

        for group in _groups(seen(), rows, slots, False):
            some = group.members(bounds, percent)
            if len(some):
                tags = [np.full(len(some), x) for x in group.tag]
                plain = [group.id[some], group.comp[some], group.at[some], group.n[some]]
                arrays = [pa.array(v, k) for v, k in zip([*tags, *plain], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([s.tobytes() for s in group.sig[some]], pa.binary())], names=list(columns))

    return members.select(*columns).mapInArrow(run, schema)


def block_links(members: DataFrame, bounds: list[int], percent: int, rows: int, *, width: int = WIDTH, slots: int = SLOTS) -> DataFrame:
    """Links (a, b) that join components, from members (BLOCK_COLUMNS) sorted by bucket
    and blocks: signatures first, then the exact sets."""
    kind = members.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.int64()

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal target
            for batch in batches:
                target = batch.column(4).type
                yield batch

        for group in _groups(seen(), rows, slots, True):
            if found := group.links(bounds, percent, width):
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], target) for k in (0, 1)], names=["a", "b"])

    return members.select(*BLOCK_COLUMNS).mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _texts(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t) of these ids; written once, as they are read more than once."""
    ids = materialize(ids.select("id").distinct(), "ids")
    texts = materialize(docs.select(column(id_col).alias("id"), column(text_col).alias("t")).join(ids, "id", "left_semi"), "texts")
    drop_scratch(ids)
    return texts


def verify(pairs: DataFrame, texts: DataFrame, percent: int, heavy: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose full sets, from texts (id, t), have
    100 |A and B| >= percent |A or B|. The text of ``a`` travels with its pair to that of
    ``b``, which may stand in many pairs: the ``heavy`` ones are dealt to several tasks."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    both = spread_join(both, texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), ["b"], heavy, F.xxhash64("a"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
                if last is None or tb != last:
                    last, held = tb, shingle_set(tb, width)
                x = shingle_set(ta, width)
                shared = len(np.intersect1d(x, held, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(held) - shared))
            if any(keep):
                yield batch.loc[keep, ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(run, pairs.schema)


@cache
def shuffled_bands(rows: int, slots: int = SLOTS) -> list[list[int]]:
    """Bands of slots in another order than that of ``band_keys``."""
    order = np.random.default_rng(20240301).permutation(slots)
    return order[: slots // rows * rows].reshape(-1, rows).tolist()


def reband(wide: DataFrame, signatures: DataFrame, rows: int) -> DataFrame:
    """Members (key, band, id, comp) of buckets too large for a few blocks, in the smaller
    buckets of those that share a shuffled band as well: (key, band, id, comp, size,
    shingles). Given one common band, a pair at the threshold shares no further one with
    a probability under that of sharing no band at all. Buckets of one component go."""
    key = F.explode(F.array(*[F.xxhash64(F.lit(j), "key", *[F.substring("sig", 2 * s + 1, 2) for s in band]) for j, band in enumerate(shuffled_bands(rows))]))
    members = wide.select("key", "band", "id", "comp").join(signatures, "id").select(key.alias("key"), "band", "id", "comp", "n")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    sizes = materialize(sizes.filter(F.col("x") != F.col("y")).drop("x", "y"), "sizes")
    return spread_join(members.drop("n"), sizes, ["key"], heavy_keys(sizes, ["key"], "size"), F.xxhash64("id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, wide_blocks: int = WIDE_BLOCKS) -> DataFrame:
    """A row for each of ``docs``: id_col, n_shingles, component_id and kept."""
    small_batches(docs.sparkSession)
    percent = round(100 * threshold)
    rows, bounds = band_rows(threshold, SLOTS, miss), least_matches(threshold, SLOTS, BATCH, miss)
    by, digest, tie = ["key"], ["d1", "d2"], F.xxhash64("id")
    sketches = materialize(sketch(docs, id_col, text_col), "sketches")
    usable = (F.col("n") > 0) & F.col("id").isNotNull()
    known = sketches.filter(usable)
    # Copies are combined where they lie: what is exchanged is a row for each task and class.
    classes = known.groupBy(*digest).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first(F.struct("n", "sig")).alias("r"))
    classes = materialize(classes.select(*digest, "rep", "copies", "r.*"), "classes")
    signatures = classes.select(F.col("rep").alias("id"), "n", "sig")
    # An id with several sets joins their classes.
    several = known.groupBy("id").agg(*[f(d).alias(f"{f.__name__}_{d}") for f in (F.min, F.max) for d in digest]).filter("min_d1 <> max_d1 or min_d2 <> max_d2")
    links = [materialize(known.select("id", *digest).join(several.select("id"), "id", "left_semi").join(classes.select(*digest, "rep"), digest).filter(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "links")]

    # A key holds its band's number, so it names a bucket alone.
    banded = signatures.select("id", F.posexplode(band_keys(rows)).alias("band", "key"))
    sizes = materialize(banded.groupBy(*by).agg(F.count("*").alias("size")).filter(F.col("size") > 1), "sizes")
    heavy = heavy_keys(sizes, by, "size")
    buckets = materialize(spread_join(banded, sizes, by, heavy, tie), "buckets")
    # All signatures are exchanged once; what follows joins those that share a bucket alone.
    signatures = materialize(signatures.join(buckets.select("id").distinct(), "id", "left_semi"), "signatures")
    weight = buckets.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = buckets.join(weight, "id").groupBy(*by).agg(F.max_by("id", F.struct("weight", F.xxhash64("id"), "id")).alias("b"))
    star = spread_join(buckets.select(*by, F.col("id").alias("a")), hubs, by, heavy, F.xxhash64("a"))
    # Of a pair, b is the hub: a stands in no more pairs than there are bands, b in any number.
    star = star.filter(F.col("a") != F.col("b")).groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.max(F.struct("b", "a")).alias("p"))
    proposed = materialize(star.select("p.a", "p.b"), "proposed")
    loads = materialize(proposed.groupBy("b").agg(F.count("*").alias("size")), "hubs")
    heavy_hubs = heavy_keys(loads, ["b"], "size")
    star = materialize(bayes_filter(_signed(proposed, signatures, percent, heavy_hubs), bounds), "pairs")
    drop_scratch(proposed)
    texts = _texts(star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))), docs, id_col, text_col)
    links.append(materialize(verify(star, texts, percent, heavy_hubs), "links"))
    drop_scratch(texts, star, loads)

    labels = components(links[0].union(links[1]), "a", "b")
    labelled = buckets.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    mixed = labelled.groupBy(*by).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter(F.col("x") != F.col("y")).select(*by)
    rest = spread_join(labelled, mixed, by, heavy, tie).join(classes.select(F.col("rep").alias("id"), "n"), "id")
    mixed = materialize(rest.select(*by, "band", "id", "comp", "size", "n"), "mixed")
    drop_scratch(buckets)
    loads = mixed.groupBy(*by).agg(F.sum("n").alias("shingles"))
    rest = spread_join(mixed.drop("n"), loads, by, heavy, tie)
    n_blocks = F.ceil(F.greatest(F.col("size") / block, F.col("shingles") / block_shingles)).cast("int")
    wide = n_blocks > wide_blocks
    rest = rest.filter(~wide).unionByName(reband(rest.filter(wide), signatures, rows))
    rest = rest.select(*by, "band", "id", "comp", n_blocks.alias("n_blocks")).withColumn("at", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    rest = rest.select(*by, "band", "id", "comp", "at", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    rest = rest.select(*by, "band", "id", "comp", "at", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"))
    bucketed = lambda df: df.repartition(*by, "lo", "hi").sortWithinPartitions(*by, "lo", "hi", "id")
    members = materialize(block_members(bucketed(rest.join(signatures, "id")), bounds, percent, rows), "members")
    drop_scratch(mixed, sizes, signatures)
    texts = _texts(members, docs, id_col, text_col)
    links.append(materialize(block_links(bucketed(members.join(texts, "id")), bounds, percent, rows), "links"))
    drop_scratch(texts, members)
    labels = components(links[0].union(links[1]).union(links[2]), "a", "b")
    drop_scratch(*links)

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*digest, F.coalesce("component", "rep").alias("component"))
    whole = spread_join(known.select("id", "n", *digest), named, digest, heavy_keys(classes, digest, "copies"), F.xxhash64("id"))
    # Rows without a set join nothing, so that they don't meet under one key.
    whole = whole.select("id", "n", "component").unionByName(sketches.filter(~usable).select("id", "n", F.col("id").alias("component")))
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _signed(pairs: DataFrame, signatures: DataFrame, percent: int, heavy: DataFrame) -> DataFrame:
    one = lambda c: signatures.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    return spread_join(pairs.join(one("a"), "a"), one("b"), ["b"], heavy, F.xxhash64("a")).filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, threshold=0.85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(list_slice(ws, i, i + 4), ' '))) WHEN len(ws) > 0 THEN [md5(len(ws) || ':' || array_to_string(ws, ' '))] ELSE [] END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
ORACLES = {"op7_minhash_near_dedup": ORACLE}
