"""Scores of whole texts by a small causal self-attention model.

Words are counted over all rows, and with them the subword ids they consist of. The
model predicts the unit of the next id: the most frequent ids are units of their own, the
others fall into clusters of ids that stand in like places; the share of an id in its unit
comes from the counts of the whole corpus, so that every id of every text has a
probability and all of them sum to 1. Attention runs over windows of ``BEFORE`` ids that
are context alone and ``STRIDE`` ids that are scored, so each id is scored once; windows
are batched over texts, and a mask hides later ids and those of other texts.

Counts, clusters and weights are learnt from all rows to learn from. Weights start from
those trained on at most ``TRAIN_WINDOWS`` windows, those of the least hashes, of about
``TRAIN_DOCS`` texts; each task then goes on from them over all windows of its rows, and the
tasks' weights are averaged by the ids they saw. So weights depend on how the rows are
split over tasks, and no other figure does.

A token's probability is half that of its ids by attention and half its share in the counts
of the whole corpus, as the base score has it; tokens never seen share what the counts
leave to them by their ids, so that words that no id spells out alone count for nothing.

Words that are frequent in the corpus (at most ``MOST_WORDS``) go to the scoring tasks with
their counts and ids; the counts of all others are joined by word, hot ones spread.

Defined results: a null text is empty, and an empty one is the end alone; a row with a null
id passes through and is learnt from; repeated rows each count and get their score; words
of equal counts share a side of the frequent ones' border, which changes no result; ids
of equal counts are ranked by number; a text of any length is scored whole; an empty
table gives an empty result, and with no rows to learn from all units are equally likely;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import draw
from .scratch import column, drop_scratch, materialize, small_batches
from .skew import heavy_keys, spread_join
from .words import tokenizer

#: Ids that a window scores, ids before them that it sees, windows multiplied at once.
STRIDE, BEFORE, AT_ONCE = 32, 16, 64
#: Units: the end, ids of their own, clusters; ids with an input vector of their own; widths.
OWN, CLUSTERS, INPUTS, WIDTH, HIDDEN = 90, 36, 2048, 16, 32
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS, BATCH, RATE = 1_500, 16_000, 4, 128, 0.01
#: Step over all rows; numbers of a piece of the weights that tasks hand on; pairs a task counts before it does.
WHOLE_RATE, PIECE, PAIRS = 0.002, 4096, 2_000_000
#: Frequent words sent to the tasks; words a task counts before it hands them on; bytes of text at once.
MOST_WORDS, COUNTED, TEXT_BYTES = 200_000, 300_000, 2 << 20
#: Words whose ids the library's wrapper keeps.
KEPT_WORDS = 50_000
FAR = np.float32(-1e4)
LOG10_E = math.log10(math.e)


def held_out(id_col: str) -> Column:
    """Rows not learnt from: crc32 of the id as text is 1 modulo 5."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _words(text: bytes | None) -> list[bytes]:
    """The words of a text: bytes know of white space and capitals in ASCII alone."""
    return text.lower().split() if text else []


def count_words(docs: DataFrame, text_col: str, held: Column) -> DataFrame:
    """(word, learnt, every): occurrences in the rows to learn from and in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, other = Counter(), Counter()

        def drained() -> pa.RecordBatch:
            keys = pa.array([*learnt, *other], pa.binary())
            columns = [pa.array([*learnt.values(), *[0] * len(other)], pa.int64()), pa.array([*learnt.values(), *other.values()], pa.int64())]
            learnt.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([keys, *columns], names=["word", "learnt", "every"])

        for batch in batches:
            for text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (other if out else learnt).update(_words(text))
                if len(learnt) + len(other) > COUNTED:
                    yield drained()
        yield drained()

    part = docs.select(column(text_col).cast("binary").alias("t"), held.alias("o")).mapInArrow(run, "word binary, learnt long, every long")
    return part.groupBy("word").agg(F.sum("learnt").alias("learnt"), F.sum("every").alias("every"))


def _ids_of(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one behind the other, and how many each has."""
    texts = [w.decode("utf-8", "replace") for w in words]
    found = tokenizer(path, KEPT_WORDS).of_words(texts)
    raw = [found[t] for t in texts]
    return np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


@cache
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def count_ids(words: DataFrame, path: str, size: int) -> np.ndarray:
    """Occurrences of each id in the words learnt from; what comes to the driver is a
    number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, sizes = _ids_of(batch.column(0).to_pylist(), path)
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(), sizes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    part = words.filter(F.col("learnt") > 0).select("word", "learnt").mapInArrow(run, "id int, n long")
    for i, n in part.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[i] = n
    return counts


def _windows(stream: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose ids, end included, lie between ``bounds`` in ``stream``: the ids a
    window sees (windows x BEFORE + STRIDE), the ids it predicts (windows x STRIDE),
    whether they exist, and which windows begin a text."""
    size = np.diff(bounds)
    each = -(-size // STRIDE)
    text = np.repeat(np.arange(len(size)), each)
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    begin = bounds[:-1][text] + nth * STRIDE
    at = begin[:, None] + np.arange(STRIDE)
    real = at < bounds[1:][text][:, None]
    target = stream[np.minimum(at, len(stream) - 1)]
    at = begin[:, None] + np.arange(-BEFORE - 1, STRIDE - 1)
    seen = stream[np.clip(at, 0, len(stream) - 1)]
    first = nth == 0
    seen[first, BEFORE] = end
    return seen, target, real, first


@dataclass
class Model:
    """Weights and tables; ``unit``, ``share`` and ``entry`` are by id, the end being the last."""

    unit: np.ndarray
    share: np.ndarray
    entry: np.ndarray
    weights: dict[str, np.ndarray]

    def log_probabilities(self, seen: np.ndarray, target: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The natural logarithm of each predicted id's probability."""
        out, mask = np.empty(target.shape, np.float32), _mask(self.weights["distance"])
        for a in range(0, len(target), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            logits = _forward(self.weights, self.entry[seen[part]], first[part], mask)["logits"]
            chosen = logits.reshape(-1).take(np.arange(len(logits)) * logits.shape[1] + self.unit[target[part]].reshape(-1))
            np.exp(logits, out=logits)
            out[part] = (chosen - np.log(_sums(logits))).reshape(-1, STRIDE) + self.share[target[part]]
        return out


def _mask(distance: np.ndarray) -> np.ndarray:
    """A bias by distance from each place to those before it; later ones are out of sight."""
    back = np.arange(STRIDE)[:, None] + BEFORE - np.arange(BEFORE + STRIDE)
    return np.where(back >= 0, distance[np.maximum(back, 0)], FAR).astype(np.float32)


_SPACE: dict[str, np.ndarray] = {}


def _space(name: str, like: np.ndarray, *shape: int) -> np.ndarray:
    """Room for a step's array, the same from batch to batch: fresh pages for each cost more
    than the products that fill them. What it held before is overwritten."""
    size = math.prod(shape)
    held = _SPACE.get(name)
    if held is None or held.size < size or held.dtype != like.dtype:
        held = _SPACE[name] = np.empty(size, like.dtype)
    return held[:size].reshape(shape)


def _product(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.matmul(a, b, out=_space(name, a, *a.shape[:-1], b.shape[-1]))


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def _sums(a: np.ndarray) -> np.ndarray:
    return a @ np.ones(a.shape[-1], a.dtype)


def _forward(w: dict[str, np.ndarray], entries: np.ndarray, first: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """All places of a batch of windows at once, in arrays that the next call overwrites.
    Scores and logits are kept below 60, so that their exponentials need no maximum taken
    out. A column of ones carries both biases, and the mixture is divided by its weights'
    sum, which takes fewer passes than dividing the weights."""
    n = len(entries)
    x = w["embed"].take(entries, 0, out=_space("x", w["embed"], *entries.shape, WIDTH), mode="clip")
    kv = _product("kv", _flat(x), np.concatenate([w["key"], w["value"]], 1)).reshape(n, -1, 2 * WIDTH)
    k, v = kv[..., :WIDTH], kv[..., WIDTH:]
    both = _space("both", x, n, STRIDE, 2 * WIDTH + 1)
    both[..., :WIDTH], both[..., -1] = x[:, BEFORE:], 1
    q = _product("q", _flat(both)[:, :WIDTH], w["query"]).reshape(n, STRIDE, WIDTH)
    p = _product("p", q, k.transpose(0, 2, 1))
    p += mask
    p[first, :, :BEFORE] = FAR
    np.exp(np.minimum(p, 60, out=p), out=p)
    scale = 1 / _sums(_flat(p)).reshape(n, STRIDE, 1)
    np.multiply(_product("mixture", p, v), scale, out=both[..., WIDTH:-1])
    h = _product("h", _flat(both), _with_bias(w["inner"], w["inner_bias"], True))
    np.maximum(h, 0, out=h)
    logits = _product("logits", h, _with_bias(w["outer"], w["outer_bias"], False))
    return {"x": x, "kv": kv, "q": q, "p": p, "scale": scale, "both": both, "h": h, "logits": np.clip(logits, -60, 60, out=logits)}


def _with_bias(matrix: np.ndarray, bias: np.ndarray, handed_on: bool) -> np.ndarray:
    """The matrix with its bias as a last row; and a column that hands on the ones it meets."""
    out = np.concatenate([matrix, bias[None]])
    return np.concatenate([out, np.eye(len(out), dtype=out.dtype)[:, -1:]], 1) if handed_on else out


def _sum_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that share a number."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")
    rows = rows[order]
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    out[rows[begins]] = np.add.reduceat(values.take(order, 0, out=_space("sorted", values, *values.shape), mode="clip"), begins)
    return out


def _gradients(w: dict[str, np.ndarray], entries: np.ndarray, first: np.ndarray, wanted: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over the real places."""
    f = _forward(w, entries, first, _mask(w["distance"]))
    g = np.exp(f["logits"], out=f["logits"])
    weight = real.reshape(-1) / g.dtype.type(max(1, real.sum()))
    g *= (weight / _sums(g))[:, None]
    g.reshape(-1)[np.arange(len(g)) * g.shape[1] + wanted.reshape(-1)] -= weight
    outer = f["h"].T @ g
    out = {"outer": outer[:-1], "outer_bias": outer[-1]}
    h = _product("dh", g, w["outer"].T)
    h *= f["h"][:, :-1] > 0
    inner = _flat(f["both"]).T @ h
    out |= {"inner": inner[:-1], "inner_bias": inner[-1]}
    both = _product("dboth", h, w["inner"].T).reshape(*f["q"].shape[:2], 2 * WIDTH)
    k, v, p = f["kv"][..., :WIDTH], f["kv"][..., WIDTH:], f["p"]
    # The weights p are divided by their sum nowhere: what they meet is.
    mixed = np.multiply(both[..., WIDTH:], f["scale"], out=_space("mixed", both, *f["q"].shape))
    dkv = _space("dkv", both, *f["kv"].shape)
    np.matmul(p.transpose(0, 2, 1), mixed, out=dkv[..., WIDTH:])
    ds = _product("ds", mixed, v.transpose(0, 2, 1))
    ds -= np.einsum("ijk,ijk->ij", mixed, f["both"][..., WIDTH:-1])[..., None]
    ds *= p
    dq = _flat(_product("dq", ds, k))
    np.matmul(ds.transpose(0, 2, 1), f["q"], out=dkv[..., :WIDTH])
    back_by = (np.arange(STRIDE)[:, None] + BEFORE - np.arange(BEFORE + STRIDE)).reshape(-1)
    seen = back_by >= 0
    by_place = np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)
    out["distance"] = np.bincount(back_by[seen], by_place[seen], BEFORE + STRIDE).astype(np.float32)
    both_kv = _flat(f["x"]).T @ _flat(dkv)
    out |= {"query": _flat(f["both"])[:, :WIDTH].T @ dq, "key": both_kv[:, :WIDTH], "value": both_kv[:, WIDTH:]}
    dx = _product("dx", _flat(dkv), np.concatenate([w["key"], w["value"]], 1).T)
    here = dx.reshape(f["x"].shape)[:, BEFORE:]
    here += both[..., :WIDTH]
    here += _product("dhere", dq, w["query"].T).reshape(here.shape)
    out["embed"] = _sum_by(entries.reshape(-1), dx, len(w["embed"]))
    return out


def _initial(units: int, entries: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(1)
    draw_ = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": (rng.standard_normal((entries, WIDTH)) * 0.3).astype(np.float32), "query": draw_(WIDTH, WIDTH), "key": draw_(WIDTH, WIDTH), "value": draw_(WIDTH, WIDTH),
        "distance": np.zeros(BEFORE + STRIDE, np.float32), "inner": draw_(2 * WIDTH, HIDDEN), "inner_bias": np.zeros(HIDDEN, np.float32),
        "outer": np.zeros((HIDDEN, units), np.float32), "outer_bias": np.zeros(units, np.float32),
    }


class _Adam:
    """Adam's steps on weights that are changed in place."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.w, self.step = w, 0
        self.state = {n: (np.zeros_like(a), np.zeros_like(a)) for n, a in w.items()}

    def take(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        rate *= math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for n, (m, s) in self.state.items():
            m += np.float32(0.1) * (g[n] - m)
            s += np.float32(0.01) * (g[n] * g[n] - s)
            self.w[n] -= np.float32(rate) * m / (np.sqrt(s) + np.float32(1e-8))


def train_weights(units: int, entries: int, seen: np.ndarray, wanted: np.ndarray, real: np.ndarray, first: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy of units, over windows in a drawn order."""
    w, rng = _initial(units, entries), np.random.default_rng(2)
    adam, total = _Adam(w), epochs * -(-len(seen) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(seen))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            g = _gradients(w, seen[some], first[some], wanted[some], real[some])
            adam.take(g, RATE * (1 - 0.95 * (adam.step + 1) / total))
    return w


def _marks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur, most frequent first; and the number of each id as a neighbour, or -1."""
    size = len(counts)
    rank = np.lexsort((np.arange(size), -counts))
    rank = rank[counts[rank] > 0]
    marks = np.full(size + 1, -1)
    marks[rank[:255]] = np.arange(len(rank[:255]))
    marks[size] = 255
    return rank, marks


def _neighbours(marks: np.ndarray, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """id * 512 + neighbour, of each id and a marked one before it or, from 256, behind it."""
    out = []
    for a, b, shift in ((now, before, 0), (before, now, 256)):
        ok = (a < len(marks) - 1) & (marks[b] >= 0)
        out.append(a[ok] * 512 + marks[b[ok]] + shift)
    return np.concatenate(out)


def cluster_ids(counts: np.ndarray, pairs: np.ndarray, times: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The unit of each id, the end (unit 0) being the last: the ``OWN`` most frequent ones
    have their own; the others are clustered by what stands before and behind them, which
    ``times`` counts of ``pairs`` (``_neighbours``), and those without share the last unit."""
    size = len(counts)
    unit = np.full(size + 1, OWN + CLUSTERS + 1)
    unit[size] = 0
    rank, _ = _marks(counts)
    unit[rank[:OWN]] = np.arange(1, 1 + len(rank[:OWN]))
    number = np.full(size, -1)
    members = np.setdiff1d(np.unique(pairs // 512), rank[:OWN])
    if not len(members):
        return unit
    number[members] = np.arange(len(members))
    ok = number[pairs // 512] >= 0
    table = np.zeros((len(members), 512), np.float32)
    table[number[pairs[ok] // 512], pairs[ok] % 512] = times[ok]
    weight = table.sum(1) + 1
    table = np.sqrt(table / weight[:, None])
    heads = np.argsort(-counts[members], kind="stable")[:CLUSTERS]
    centre = table[heads].copy()
    for _ in range(rounds):
        near = np.argmax(table @ centre.T - 0.5 * (centre * centre).sum(1), axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, table * weight[:, None])
        mass = np.bincount(near, weight, len(centre))
        centre = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1)[:, None], centre).astype(np.float32)
    unit[members] = OWN + 1 + near
    return unit


def build_model(counts: np.ndarray, ends: int, seen: np.ndarray, target: np.ndarray, real: np.ndarray, first: np.ndarray, epochs: int = EPOCHS, near: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """A model from corpus counts and training windows of ids, the end being the last id;
    ``near`` has the corpus's neighbours and their counts, or those of the windows are taken."""
    size, units = len(counts), OWN + CLUSTERS + 2
    unit = cluster_ids(counts, *(near or np.unique(_neighbours(_marks(counts)[1], seen[:, BEFORE:][real], target[real]), return_counts=True)))
    mass = np.append(counts, ends) + 1.0
    share = np.log(mass / np.bincount(unit, mass, units)[unit]).astype(np.float32)
    entry = INPUTS + unit
    rank = np.lexsort((np.arange(size), -counts))[:INPUTS]
    entry[rank] = np.arange(len(rank))
    weights = train_weights(units, INPUTS + units, entry[seen], unit[target], real, first, epochs)
    return Model(unit, share, entry, weights)


class _Codes(dict):
    """Numbers of frequent words; others get numbers behind them and are noted."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.size, self.new = len(words), []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = self.size + len(self.new)  # the end has the number between
        return number

    def forget(self, words: list[bytes]) -> None:
        for word in words:
            del self[word]


class Streams:
    """A worker's table of frequent words with their ids, that turns texts into ids."""

    def __init__(self, path: str, words: list[bytes], end: int) -> None:
        self.path, self.codes, self.end = path, _Codes(words), end
        ids, sizes = _ids_of(words, path)
        self.ids, self.sizes = np.append(ids, end), np.append(sizes, 1)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """The numbers of all tokens; how many each text has; where the ids of each token
        begin, and the last one's end; the ids; the words that aren't frequent."""
        codes, end = self.codes, self.codes.size
        split = [_words(t) for t in texts]
        sizes = np.array([len(s) + 1 for s in split], np.int64)
        behind = np.cumsum(sizes)
        token = np.full(int(sizes.sum()), end)  # the end stands behind each text's words
        word = np.ones(len(token), bool)
        word[behind - 1] = False
        token[word] = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), np.int64, int(word.sum()))
        new, codes.new = codes.new, []
        codes.forget(new)
        more, more_sizes = _ids_of(new, self.path)
        ids, lengths = np.append(self.ids, more), np.append(self.sizes, more_sizes)
        begins = np.cumsum(lengths) - lengths
        bounds = np.append(0, np.cumsum(lengths[token]))
        stream = ids[np.arange(bounds[-1]) + np.repeat(begins[token] - bounds[:-1], lengths[token])]
        return token, sizes, bounds, stream, new


class Scorer:
    """A worker's tables: frequent words with their ids, counts and log probabilities by
    counts; ``divisor`` turns counts into probabilities."""

    def __init__(self, model: Model, path: str, words: list[bytes], counts: list[int], ends: int, divisor: float) -> None:
        self.model, self.end = model, len(model.unit) - 1
        self.streams = Streams(path, words, self.end)
        self.known = np.array([*counts, ends]) > 0
        self.logs = np.log((np.array([*counts, ends], float) + 0.5) / divisor)

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each text: tokens; how many of them are known, their base logarithms' sum and
        their score, without words that aren't frequent; those, each with its spelling's
        log probability. Logarithms are natural."""
        token, sizes, bounds, stream, new = self.streams.of(texts)
        end, behind = self.streams.codes.size, np.cumsum(sizes)
        seen, target, real, first = _windows(stream, np.append(0, bounds[behind]), self.end)
        sums = np.append(0, np.cumsum(self.model.log_probabilities(seen, target, first)[real], dtype=np.float64))
        attended = sums[bounds[1:]] - sums[bounds[:-1]]

        text = np.repeat(np.arange(len(texts)), sizes)
        rare = token > end
        t, a = token[~rare], attended[~rare]
        known = self.known[t]
        mixed = math.log(0.5) + np.logaddexp(a, np.where(known, self.logs[t], self.logs[t] + a))
        total = lambda x: np.bincount(text[~rare], x, len(texts))
        offsets = np.append(0, np.cumsum(np.bincount(text[rare], minlength=len(texts)))).astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.array([new[k - end - 1] for k in token[rare].tolist()], pa.binary()), pa.array(attended[rare])], ["word", "attended"])
        return sizes, total(known).astype(np.int64), total(self.logs[t]), total(mixed), pa.ListArray.from_arrays(offsets, rest)


_TABLES: dict[str, Scorer | Streams] = {}


def _kept(name: str, make) -> Scorer | Streams:
    """The worker's tables of this name; one is kept from task to task."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = make()
    return _TABLES[name]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts of a batch, about ``TEXT_BYTES`` at once, with the row of the first."""
    texts, at, part, held_bytes = batch.column(column).to_pylist(), 0, [], 0
    for k, t in enumerate(texts):
        part.append(t)
        held_bytes += len(t or b"")
        if held_bytes >= TEXT_BYTES or k + 1 == len(texts):
            yield at, part
            at, part, held_bytes = k + 1, [], 0


def count_neighbours(docs: DataFrame, text: Column, path: str, sent: Broadcast, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_neighbours`` over all texts, and how often each occurs: at most 512 for each id of
    the vocabulary come to the driver. ``sent`` has the frequent words."""
    name, end = uuid.uuid4().hex, len(marks) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = _kept(name, lambda: Streams(path, sent.value, end))
        held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in _parts(batch, 0):
                stream = streams.of(texts)[3]
                pairs, n = np.unique(_neighbours(marks, np.append(end, stream[:-1]), stream), return_counts=True)
                both, at = np.unique(np.concatenate([held, pairs]), return_inverse=True)
                held, times = both, np.bincount(at, np.concatenate([times, n]), len(both)).astype(np.int64)
                if len(held) > PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(times)], names=["pair", "n"])
                    held, times = held[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(times)], names=["pair", "n"])

    part = docs.select(text.cast("binary").alias("t")).mapInArrow(run, "pair int, n long")
    got = part.groupBy("pair").agg(F.sum("n").alias("n")).toArrow().sort_by("pair")
    return got["pair"].to_numpy().astype(np.int64), got["n"].to_numpy()


def learn_weights(docs: DataFrame, text: Column, path: str, sent: Broadcast, model: Model) -> tuple[dict[str, np.ndarray], int]:
    """Weights learnt from all windows of all texts, and how many ids those hold.

    Each task goes on from the weights of ``model``; the means of the tasks' weights are
    made by pieces, and one set of weights comes to the driver."""
    name, end = uuid.uuid4().hex, len(model.unit) - 1
    tables = docs.sparkSession.sparkContext.broadcast((model.unit, model.entry, model.weights))
    order = list(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = _kept(name, lambda: Streams(path, sent.value, end))
        unit, entry, start = tables.value
        w, rng, n = {k: a.copy() for k, a in start.items()}, np.random.default_rng(3), 0
        adam = _Adam(w)
        for batch in batches:
            for _, texts in _parts(batch, 0):
                _, sizes, bounds, stream, _ = streams.of(texts)
                seen, target, real, first = _windows(stream, np.append(0, bounds[np.cumsum(sizes)]), end)
                n += len(stream)
                drawn = rng.permutation(len(seen))
                for a in range(0, len(drawn), BATCH):
                    some = drawn[a : a + BATCH]
                    adam.take(_gradients(w, entry[seen[some]], first[some], unit[target[some]], real[some]), WHOLE_RATE)
        flat = np.concatenate([w[k].reshape(-1) for k in order]).astype(np.float64)
        pieces = [(flat[a : a + PIECE] * n).tobytes() for a in range(0, len(flat), PIECE)] if n else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], names=["piece", "n", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(b) for b in sorted(table["sums"].to_pylist())], axis=0)
        return pa.table([table["piece"].slice(0, 1), pa.array([sum(table["n"].to_pylist())], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["piece", "n", "sums"])

    kind = "piece int, n long, sums binary"
    got = docs.select(text.cast("binary").alias("t")).mapInArrow(run, kind).groupBy("piece").applyInArrow(added, kind).orderBy("piece").collect()
    tables.unpersist()
    if not got:
        return model.weights, 0
    flat, out = np.concatenate([np.frombuffer(r["sums"]) / r["n"] for r in got]).astype(np.float32), {}
    for k in order:
        size = model.weights[k].size
        out[k], flat = flat[:size].reshape(model.weights[k].shape), flat[size:]
    return out, got[0]["n"]


def score_texts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS, epochs: int = EPOCHS) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")  # a task has one core
    held = held_out(id_col)
    words = materialize(count_words(docs, text_col, held), "words")
    rows = docs.agg(F.count(F.lit(1)).alias("every"), F.count(F.when(~held, 1)).alias("learnt")).first()
    sums = words.agg(F.sum("learnt").alias("n"), F.count(F.when(F.col("learnt") > 0, 1)).alias("v")).first()
    train_tokens, distinct = (sums["n"] or 0) + rows["learnt"], sums["v"] + (rows["learnt"] > 0)
    divisor = train_tokens + 0.5 * (distinct + 1)

    size = vocabulary_size(path)
    counts = count_ids(words, path, size)
    level = F.floor(F.log2("every") * 64).cast("int")  # at most 64 levels for each doubling
    kept, border = 0, 1 << 30
    for b, n in sorted((tuple(r) for r in words.filter(F.octet_length("word") <= 64).groupBy(level.alias("b")).count().collect()), reverse=True):
        if (kept := kept + n) > most_words:
            break
        border = b
    is_frequent = (level >= border) & (F.octet_length("word") <= 64)
    frequent = sorted((bytes(r["word"]), r["learnt"]) for r in words.filter(is_frequent).select("word", "learnt").collect())
    spelt = spark.sparkContext.broadcast([w for w, _ in frequent])
    learnt, text = docs.filter(~held), column(text_col)
    near = count_neighbours(learnt, text, path, spelt, _marks(counts)[1])
    model = build_model(counts, rows["learnt"], *_training_windows(learnt, text, path, rows["learnt"], size), epochs, near)
    model.weights, _ = learn_weights(learnt, text, path, spelt, model)
    sent = spark.sparkContext.broadcast((model, path, [w for w, _ in frequent], [n for _, n in frequent], rows["learnt"], divisor))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _kept(name, lambda: Scorer(*sent.value))
        for batch in batches:
            for at, part in _parts(batch, 2):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns[:2]), *map(pa.array, scorer.score(part))], names=schema.names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("held_out", "boolean").add("n_tokens", "long").add("known", "long").add("base", "double").add("score", "double").add("rest", T.ArrayType(T.StructType().add("word", "binary").add("attended", "double")))
    taken = docs.select(column(id_col).alias("id"), held.alias("held_out"), column(text_col).cast("binary").alias("t"))
    scored = materialize(taken.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")

    others = materialize(words.filter(~is_frequent), "rare")
    heavy = heavy_keys(others, ["word"], "every")
    found = spread_join(scored.select("row", F.inline("rest")), others.select("word", "learnt"), ["word"], heavy, F.xxhash64("row", "attended"))
    by_count, known = F.log((F.col("learnt") + 0.5) / divisor), F.col("learnt") > 0
    other = F.when(known, by_count).otherwise(by_count + F.col("attended"))
    mixed = math.log(0.5) + F.greatest(other, "attended") + F.log1p(F.exp(-F.abs(other - F.col("attended"))))
    more = found.groupBy("row").agg(F.count(F.when(known, 1)).alias("m_known"), F.sum(by_count).alias("m_base"), F.sum(mixed).alias("m_score"))
    out = scored.drop("rest").join(more, "row", "left")
    drop_scratch(words)
    both = lambda name, log: ((F.col(name) + F.coalesce(f"m_{name}", F.lit(0.0))) * log).alias(f"{name}_score" if name == "base" else name)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("m_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), both("base", LOG10_E), both("score", LOG10_E),
    )


def _training_windows(docs: DataFrame, text: Column, path: str, rows: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """At most ``TRAIN_WINDOWS`` windows, those of the least hashes, of about twice
    ``TRAIN_DOCS`` whole texts."""
    width = BEFORE + STRIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids = np.append(_ids_of(_words(t), path)[0], end)
                seen, target, real, first = _windows(ids, np.array([0, len(ids)]), end)
                cells = np.concatenate([seen, target, real, first[:, None]], axis=1).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells], pa.binary())], names=["cells"])

    few = docs.select(text.cast("binary").alias("t")).filter(draw.part(F.xxhash64(text, F.lit(11)), draw.share(TRAIN_DOCS, rows)))
    cut = materialize(few.mapInArrow(run, "cells binary").withColumn("h", F.xxhash64("cells")), "windows")
    got = sorted(bytes(r["cells"]) for r in draw.least(cut, "h", TRAIN_WINDOWS).select("cells").collect())
    drop_scratch(cut)
    cells = np.frombuffer(b"".join(got), "<i4").reshape(-1, width + 2 * STRIDE + 1).astype(np.int64)
    return cells[:, :width], cells[:, width : width + STRIDE], cells[:, width + STRIDE : -1] > 0, cells[:, -1] > 0


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op11_lm_scoring": op11_lm_scoring}
ORACLES: dict[str, str] = {}
