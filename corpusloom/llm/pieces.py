"""Sampled SentencePiece segmentations, and exact decoding.

A text is encoded over the lattice of all pieces of a vocabulary: forward filtering
sums the weights of all ways to each position, and backward sampling draws one whole
segmentation from the posterior. Draws depend on the row's key, the seed, and the
place in the text alone, so any partitioning and any retry gives the same pieces.

No piece of the vocabulary runs from a word into white space, or into marks that it
only has in front, so the lattice falls into one for each stretch of spaces, marks and
word; each distinct stretch is filtered once and drawn for all its places at once. A piece of merge rank r weighs
(r + 2) to the power of -alpha: ranks follow frequencies, and frequencies Zipf's law.
Characters that no piece covers, and the space mark itself, become byte pieces, at the
weight of the last rank, which makes decoding lossless for every text.

Defined results: a null or empty text has no pieces and decodes to the empty text; a
null key draws as key 0; repeated rows draw the same pieces; ties don't arise, as
draws fall between bounds; a text of any length is encoded whole, a long stretch
without being kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import column, small_batches

MARK = "▁"
ALPHA, SEED = 1.0, 1
#: Shares are kept to so many parts, which a double holds exactly beside any node number.
GRAIN = float(1 << 24)
#: Stretches of at most so many characters are kept; so many lattice nodes at most.
LONGEST, MOST_NODES = 32, 2_500_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Known(dict):
    """End nodes of stretches; unknown ones get a negative number and are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        number = self[stretch] = -1 - len(self.new)
        self.new.append(stretch)
        return number


class _Table:
    """Ids of texts by length and hash; lookups of all places of a text at once."""

    def __init__(self, texts: dict[str, int]) -> None:
        self.longest = max(map(len, texts))
        self.by_length = []
        for n in range(1, self.longest + 1):
            some = [t for t in texts if len(t) == n]
            hashes = np.zeros(len(some), np.uint64)
            if some:
                points = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(-1, n)
                for k in range(n):
                    hashes = hashes * GOLD + mix(points[:, k].astype(np.uint64) + np.uint64(1))
            order = np.argsort(hashes)
            seen = np.zeros(1 << 18, bool)
            seen[(hashes >> np.uint64(46)).astype(np.int64)] = True
            self.by_length.append((hashes[order], np.array([texts[t] for t in some], np.int64)[order], seen))
            if len(np.unique(hashes)) != len(hashes):
                raise ValueError("two pieces share a hash")

    def matches(self, points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every text within ``room`` characters of each place."""
        single = mix(points.astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero(room > 0)
        running = np.zeros(len(at), np.uint64)
        starts, sizes, ids = [], [], []
        for n, (hashes, numbers, seen) in enumerate(self.by_length, 1):
            more = room[at] >= n
            at, running = at[more], running[more]
            if not len(at):
                break
            running = running * GOLD + single[at + n - 1]
            maybe = np.flatnonzero(seen[(running >> np.uint64(46)).astype(np.int64)])
            if len(hashes) and len(maybe):
                k = np.minimum(np.searchsorted(hashes, running[maybe]), len(hashes) - 1)
                hit = hashes[k] == running[maybe]
                starts.append(at[maybe[hit]])
                ids.append(numbers[k[hit]])
                sizes.append(np.full(int(hit.sum()), n))
        empty = [np.empty(0, np.int64)]
        return np.concatenate(starts or empty), np.concatenate(sizes or empty), np.concatenate(ids or empty)


def loose_marks(pieces: list[str]) -> str:
    """ASCII marks that no piece has behind anything but such marks or spaces: a text
    may be cut before each run of them."""
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    marks = {chr(i) for i in range(33, 127) if not chr(i).isalnum()}
    while bad := {b for a, b in pairs if b in marks and a not in marks and a != " "}:
        marks -= bad
    return "".join(sorted(marks))


class Lattice:
    """The filtered lattices of stretches, in flat tables of arcs by end node.

    An arc's bound is its end node's number plus the summed share of the node's arcs
    up to it; a draw u at node k takes the first arc whose bound is over k + u.
    """

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        names = [self.lib.id_to_piece(i) for i in range(n)]
        special = [self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i) for i in range(n)]
        plain = [i for i in range(n) if not special[i]]
        if any(MARK in names[i].lstrip(MARK) or "\n" in names[i] for i in plain):
            raise ValueError("a piece of this vocabulary runs over the end of a word")
        rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: -self.lib.get_score(i)))}
        self.weights = np.zeros(n)
        for i in plain:
            self.weights[i] = -alpha * math.log(rank[i] + 2)
        texts = {names[i].replace(MARK, " "): i for i in plain}
        self.table = _Table(texts)
        marks = re.escape(loose_marks(list(texts)))
        self.stretch = re.compile(f" *(?:[^ \n{marks}]+|[{marks}]+[^ \n{marks}]*)| +|\n" if marks else " *[^ \n]+| +|\n")
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_weight = -alpha * math.log(len(plain) + 2)
        self.id_bytes = [bytes([int(names[i][3:5], 16)]) if self.lib.is_byte(i) else names[i].replace(MARK, " ").encode() if not special[i] else b"" for i in range(n)]
        # Piece groups: one for each piece, then one for each character that needs bytes.
        self.groups: list[tuple] = [(i,) for i in range(n)]
        self.char_group: dict[int, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known = _Known()
        self.nodes = self.arcs = 0
        self.bound, self.source, self.group = np.empty(1 << 18), np.empty(1 << 18, np.int32), np.empty(1 << 18, np.int32)
        self.first = np.empty(1 << 17, bool)

    def lattice_arcs(self, joined: str, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All arcs: start, end, group, log weight; ``room`` is the number of characters
        from each place to the end of its stretch."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        start, size, group = self.table.matches(points, room)
        covered = room == 0
        covered[start[size == 1]] = True
        bare = np.flatnonzero(~covered)
        kinds, at = np.unique(points[bare], return_inverse=True)
        own = np.empty(len(kinds), np.int64)
        for k, c in enumerate(kinds.tolist()):
            if (g := self.char_group.get(c)) is None:
                g = self.char_group[c] = len(self.groups)
                self.groups.append(tuple(self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")))
            own[k] = g
        n = np.array([len(self.groups[g]) for g in own.tolist()], np.float64)
        return np.concatenate([start, bare]), np.concatenate([start + size, bare + 1]), np.concatenate([group, own[at]]), np.concatenate([self.weights[group], n[at] * self.byte_weight])

    def add(self, stretches: list[str]) -> list[int]:
        """Filter stretches; the number of the node at the end of each."""
        joined = "\n".join(stretches)
        sizes = np.array([len(s) for s in stretches], np.int64)
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        stops = begins + sizes
        room = np.zeros(len(joined), np.int64)
        place = np.repeat(np.arange(len(stretches)), sizes + 1)[: len(joined)]
        room[:] = stops[place] - np.arange(len(joined))
        start, end, group, weight = self.lattice_arcs(joined, room)
        by = np.argsort(end, kind="stable")  # few sorted runs
        start, end, group, weight = start[by], end[by], group[by], weight[by]
        depth = end - begins[place[start]]
        level = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")
        alpha, share = np.zeros(len(joined) + 1), np.empty(len(start))
        edges = np.flatnonzero(np.diff(depth[level], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(level)], strict=True):
            now = level[a:b]
            into = end[now]
            heads = np.flatnonzero(np.diff(into, prepend=-1))
            runs = np.diff(heads, append=b - a)
            logs = alpha[start[now]] + weight[now]
            top = np.maximum.reduceat(logs, heads)
            raw = np.exp(logs - np.repeat(top, runs))
            total, part = np.zeros(len(heads)), np.empty(b - a)
            for k in range(int(runs.max())):  # sums within a node alone, so that nothing else in the batch can touch them
                own = np.flatnonzero(runs > k)
                total[own] += raw[heads[own] + k]
                part[heads[own] + k] = total[own]
            alpha[into[heads]] = top + np.log(total)
            part = np.round(part / np.repeat(total, runs) * GRAIN) / GRAIN
            part[heads + runs - 1] = 1.0
            share[now] = part
        end, start, group, share = np.concatenate([end, begins]), np.concatenate([start, begins]), np.concatenate([group, np.full(len(begins), -1)]), np.concatenate([share, np.ones(len(begins))])
        by = np.argsort(end, kind="stable")
        n, base = len(end), self.nodes
        while self.arcs + n > len(self.bound):
            self.bound, self.source, self.group = (np.concatenate([x, np.empty_like(x)]) for x in (self.bound, self.source, self.group))
        to = slice(self.arcs, self.arcs + n)
        self.bound[to] = base + end[by] + np.minimum(share[by], 1.0)
        self.source[to], self.group[to] = base + start[by], group[by]
        while base + len(joined) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
        self.first[base : base + len(joined) + 1] = False
        self.first[base + begins] = True
        self.arcs, self.nodes = self.arcs + n, base + len(joined) + 1
        return (base + stops).tolist()

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
        """Piece ids of each text, drawn by its key."""
        if self.nodes > MOST_NODES:
            self.clear()
        # A leading space, as SentencePiece adds one; a line feed is a byte piece, so it ends a stretch.
        found = [self.stretch.findall(" " + text) if text else [] for text in texts]
        counts = np.array([len(part) for part in found], np.int64)
        if not counts.sum():
            return [np.empty(0, np.uint32) for _ in texts]
        known = self.known
        node = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        if new := known.new:
            known.new = []
            ends = np.array(self.add(new), np.int64)
            fresh = node < 0
            node[fresh] = ends[-1 - node[fresh]]
            for s, end in zip(new, ends.tolist(), strict=True):
                if len(s) <= LONGEST:
                    known[s] = end
                else:
                    del known[s]
        row = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
        state = mix(mix(keys.astype(np.uint64) + np.uint64(seed * int(GOLD) & (1 << 64) - 1))[row] + place.astype(np.uint64) * GOLD)
        near = np.argsort(node)  # equal stretches read the same part of the tables
        node, state = node[near], state[near]
        bound, live = self.bound[: self.arcs], np.arange(len(node))
        drawn, owner = [], []
        for step in range(1, self.nodes + 1):
            turn = np.uint64(step * int(GOLD) & (1 << 64) - 1)
            u = ((mix(state[live] + turn) >> np.uint64(40)).astype(np.float64) + 0.5) / GRAIN
            arc = np.searchsorted(bound, node[live] + u, side="right")
            drawn.append(self.group[arc])
            owner.append(live)
            node[live] = self.source[arc]
            live = live[~self.first[node[live]]]
            if not len(live):
                break
        # Steps run from the end of a stretch to its start.
        steps = np.zeros(len(node), np.int64)
        for part in owner:
            steps[near[part]] += 1
        begin = np.cumsum(steps) - steps
        group = np.empty(int(steps.sum()), np.int64)
        for k, (part, g) in enumerate(zip(owner, drawn, strict=True), 1):
            at = near[part]
            group[begin[at] + steps[at] - k] = g
        sizes = np.array([len(g) for g in self.groups], np.int64)
        flat = np.fromiter(chain.from_iterable(self.groups), np.int64, int(sizes.sum()))
        n = sizes[group]
        total = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[group] - (total - n), n) + np.arange(int(total[-1]))
        last = np.cumsum(counts)[:-1]  # stretches before each following text
        before = np.concatenate([[0], total])[np.concatenate([begin, [len(group)]])[last]]
        return np.split(flat[at].astype(np.uint32), before)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join([self.id_bytes[i] for i in ids.tolist()])
        return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


@cache
def lattice(path: str, alpha: float = ALPHA) -> Lattice:
    """One to a Python worker."""
    return Lattice(path, alpha)


def encode_sampled(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = SEED, digests: bool = False) -> DataFrame:
    """id_col and ids (or, with ``digests``, their number and checksum and those of the
    text that they decode to). No exchange; one pass."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, alpha)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t.as_py() or "" for t in part.column(2)]
                found = model.sample(texts, part.column(1).to_numpy().view(np.uint64), seed)
                if digests:
                    decoded = [model.decode(x) for x in found]
                    columns = [
                        pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded], pa.string()), pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()),
                    ]
                else:
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    kinds = {"n_pieces": T.LongType(), "ids_crc32": T.LongType(), "decoded_sha256": T.StringType(), "lossless": T.BooleanType()} if digests else {"ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, k) for c, k in kinds.items())])
    key = column(id_col)
    drawn_by = F.when(key.isNull(), F.lit(0)).otherwise(F.xxhash64(key.cast("string"))).cast("long")
    return docs.select(key.alias("k"), drawn_by.alias("h"), column(text_col).alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text that its piece ids stand for."""

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        model = lattice(path)
        return pd.Series([model.decode(np.asarray(x)) if x is not None else "" for x in ids])

    return encoded.withColumn(text_col, text(ids_col))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
