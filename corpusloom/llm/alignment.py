r"""Alignment of the tokens that two tokenizers make of the same texts.

Tokenizer A is byte-level BPE, B a piece model with byte fallback; A gets a space before
the text, as B adds one. The byte ranges of B's tokens are a static index of intervals:
for each token of A two bisections find the tokens of B that it overlaps, which are its
links, and a gap between two tokens of B that no token of A spans ends a group.

No token of either runs from a character that is no white space into a space or line feed,
so a text falls into stretches cut there, whose tokens are those of the whole text; each
distinct stretch is tokenised and aligned once for all its places in a batch of texts, and
frequent ones are kept. A pair of ids is one number; each text's distinct pairs go to a
table, from which the number of texts that hold a pair is counted over all rows. The
frequent pairs (at most ``MOST_PAIRS``) are sent to the tasks that sum over the links, the
counts of the others are joined.

Defined results: a null or empty text, and one whose tokens' bytes are not those of a space
and the text, has no tokens: zeros and an empty digest column; a null id passes through;
repeated rows count as texts of their own; pairs that tie for the highest count of their A
id are all best; a text of any length is aligned whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import column, drop_scratch, materialize, small_batches

#: A pair is the number of its A id times this and its B id.
B_IDS = 1 << 15
#: Stretches kept by a worker, of at most so many characters; bytes of text at once.
MOST_KEPT, LONGEST, TEXT_BYTES = 150_000, 40, 2 << 20
#: Stretches tokenised at once.
AT_ONCE = 1_000
#: Frequent pairs sent to the tasks; pairs counted at once.
MOST_PAIRS, PAIRS_AT_ONCE = 500_000, 2_000_000
STRETCH = re.compile(r"[ \n][^ \n]+")
#: White space before a space or line feed, or at the end; a cut of texts that hold some.
UNEVEN, CUT = re.compile(r"\s(?:[ \n]|\Z)"), re.compile(r"(?<=\S)(?=[ \n])")


def stretches(text: str) -> list[str]:
    """``text``, which begins with a space, cut before each space or line feed behind a
    character that is no white space."""
    return CUT.split(text) if UNEVEN.search(text) else STRETCH.findall(text)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the B ranges that each A range overlaps; the ranges of either
    side lie end to end from 0 on, and this bisects those of B."""
    a_starts, b_starts = np.append(0, a_ends)[:-1], np.append(0, b_ends)[:-1]
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")


def group_ends(first: np.ndarray, behind: np.ndarray, n_b: int) -> np.ndarray:
    """The B ranges, by number, behind which no A range reaches on."""
    spanned = np.bincount(first, minlength=n_b + 1) - np.bincount(behind - 1, minlength=n_b + 1)
    return np.flatnonzero(np.cumsum(spanned[:n_b]) == 0)


def _byte_level() -> dict[str, int]:
    """The bytes that the characters of byte-level pieces stand for: printable ones for
    themselves, the others, in order, for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Aligner:
    """Both tokenizers with the bytes of their tokens, and the stretches aligned so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        level = _byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(level[c] for c in piece) if all(c in level for c in piece) else piece.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        if len(self.b_bytes) > B_IDS or len(self.a_bytes) * B_IDS > 1 << 31:
            raise ValueError("ids too large for a pair in 31 bits")
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.a_names = np.array([[f"{i},", f"{i}|"] for i in range(len(self.a_bytes))], object)
        self.b_names = np.array([[f"{i},", f"{i};"] for i in range(len(self.b_bytes))], object)
        self.kept: dict[str, tuple | None] = {}

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both, if their bytes are those of ``text``."""
        raw = text.encode()
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:] if text[0] == " " else text, num_threads=1) if text != " " else [self.b.piece_to_id("▁")]
        if text[0] != " ":  # the space that B adds is no token of a stretch that has none
            b = b[1:] if b and self.b_bytes[b[0]] == b" " else []
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def align(self, texts: list[str]) -> list[tuple | None]:
        """(A tokens, B tokens, groups as text, each with a semicolon behind, their number,
        pairs of all links) of each stretch; None where bytes differ. Some are tokenised at
        once as one text, which is cut at the same places."""
        if len(texts) > AT_ONCE or not texts:
            return list(chain.from_iterable(self.align(texts[k : k + AT_ONCE]) for k in range(0, len(texts), AT_ONCE)))
        both = self._tokens("".join(texts))
        if both is None:
            half = len(texts) // 2
            return [None] if not half else self.align(texts[:half]) + self.align(texts[half:])
        a, b = both
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        first, behind = overlaps(a_ends, b_ends)
        times = behind - first
        a_of = np.repeat(np.arange(len(a)), times)
        b_of = np.arange(len(a_of)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        pairs = (a[a_of] * B_IDS + b[b_of]).astype(np.int32)
        stops_b = group_ends(first, behind, len(b)) + 1
        stops_a = np.searchsorted(a_ends, b_ends[stops_b - 1]) + 1
        # in the text of the groups a token stands behind all tokens of earlier groups, and
        # one of B behind those that A has in its own group
        group_a, group_b = np.searchsorted(stops_a, np.arange(len(a)), "right"), np.searchsorted(stops_b, np.arange(len(b)), "right")
        names = np.empty(len(a) + len(b), object)
        names[np.arange(len(a)) + np.append(0, stops_b)[group_a]] = self.a_names[a, np.isin(np.arange(1, len(a) + 1), stops_a).astype(int)]
        names[np.arange(len(b)) + stops_a[group_b]] = self.b_names[b, np.isin(np.arange(1, len(b) + 1), stops_b).astype(int)]
        names = names.tolist()
        text_ends = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        cuts_a, cuts_b = (np.searchsorted(e, text_ends) + 1 for e in (a_ends, b_ends))
        cuts_g, cuts_p = np.searchsorted(stops_b, cuts_b) + 1, np.append(0, np.cumsum(times))[cuts_a]
        out, i, j, g, p = [], 0, 0, 0, 0
        for x, y, z, q in zip(cuts_a.tolist(), cuts_b.tolist(), cuts_g.tolist(), cuts_p.tolist(), strict=True):
            out.append((x - i, y - j, "".join(names[i + j : x + y]), z - g, pairs[p:q].copy()))
            i, j, g, p = x, y, z, q
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(A tokens, B tokens, groups, links, digest of the groups, distinct pairs,
        times of each) of each text."""
        split = [stretches(f" {t}") if t else [] for t in texts]
        kept = self.kept
        new = {s for s in chain.from_iterable(split) if s not in kept}
        ended = [s for s in new if not s[-1].isspace()]
        found = dict(zip(ended, self.align(ended), strict=True)) | {s: self.align([s])[0] for s in new.difference(ended)}
        if len(kept) < MOST_KEPT:
            kept |= {s: x for s, x in found.items() if len(s) <= LONGEST}
        nothing = np.empty(0, np.int32)
        for some in split:
            parts = [kept[s] if s in kept else found[s] for s in some]
            if not parts or None in parts:
                yield 0, 0, 0, 0, "", nothing, nothing
                continue
            n_a, n_b, groups, n_groups, pairs = zip(*parts, strict=True)
            links = np.concatenate(pairs)
            distinct, times = np.unique(links, return_counts=True)
            yield sum(n_a), sum(n_b), sum(n_groups), len(links), hashlib.sha256("".join(groups)[:-1].encode()).hexdigest(), distinct, times.astype(np.int32)


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One to a Python worker."""
    return Aligner(a_path, b_path)


def align_texts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 of each row, and its distinct pairs
    and their times as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for batch in batches:
            texts, at, held = batch.column(1).to_pylist(), 0, 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held >= TEXT_BYTES or k + 1 == len(texts):
                    n_a, n_b, n_groups, n_links, digest, pairs, times = zip(*tool.texts([x or "" for x in texts[at : k + 1]]), strict=True)
                    counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                    raw = [pa.array([x.astype("<i4").tobytes() for x in y], pa.binary()) for y in (pairs, times)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k + 1 - at), *counts, pa.array(digest, pa.string()), *raw], names=schema.names)
                    at, held = k + 1, 0

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])
    return docs.select(column(id_col).alias("k"), column(text_col).alias("t")).mapInArrow(run, schema)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many texts hold each pair, and whether no other pair of its A
    id has more; the highest counts are a row for each A id, so no more than its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def drained() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate([np.empty(0, "<i4"), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw, "<i4"))
                size += len(held[-1])
                if size >= PAIRS_AT_ONCE:
                    yield drained()
                    size = 0
        yield drained()

    table = materialize(aligned.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a_id = F.floor(F.col("pair") / B_IDS).cast("int").alias("a_id")
    highest = table.groupBy(a_id).agg(F.max("n").alias("highest"))
    out = materialize(table.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "counted")
    drop_scratch(table)
    return out


def sum_links(pairs: np.ndarray, times: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[int, int, np.ndarray]:
    """(links that are best, sum of their counts, which pairs are in the sorted table)."""
    keys, counts, best = table
    at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
    hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
    at, n = at[hit], times[hit].astype(np.int64)
    return int(n[best[at]].sum()), int((n * counts[at]).sum()), hit


def alignments(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """A row for each text: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    aligned = materialize(align_texts(docs, a_path, b_path, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counted = count_pairs(aligned)

    level = F.floor(F.log2("n") * 64).cast("int")  # at most 64 levels for each doubling
    kept, border = 0, 1 << 30
    for b, n in sorted((tuple(r) for r in counted.groupBy(level.alias("b")).count().collect()), reverse=True):
        if (kept := kept + n) > most_pairs:
            break
        border = b
    frequent = counted.filter(level >= border).orderBy("pair").toArrow()
    sent: Broadcast = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            best, sums, rest, rest_times, sizes = [], [], [], [], [0]
            for raw, raw_times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs, times = np.frombuffer(raw, "<i4"), np.frombuffer(raw_times, "<i4")
                n_best, total, hit = sum_links(pairs, times, table)
                best.append(n_best)
                sums.append(total)
                rest.append(pairs[~hit])
                rest_times.append(times[~hit])
                sizes.append(sizes[-1] + len(rest[-1]))
            some = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, "<i4"), *x]).astype(np.int32)) for x in (rest, rest_times)], ["pair", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), some)], names=["row", "best", "total", "rest"])

    summed = materialize(aligned.select("row", "pairs", "times").mapInArrow(run, "row long, best long, total long, rest array<struct<pair:int,times:int>>"), "summed")
    rare = summed.select("row", F.inline("rest")).join(counted.filter(level < border), "pair")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_total"))
    sums = summed.select("row", "best", "total").unionByName(more.select("row", F.col("more_best").alias("best"), F.col("more_total").alias("total"))).groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
