"""Exact token ids of whole texts for tokenizers whose tokens never span white space.

Texts are split at spaces and line feeds and each word's ids kept, so that the
library runs once a distinct word, not once an occurrence. Plain Latin words are
kept by their lower-cased letters, apart from one mark of punctuation behind them,
and encoded many at a time; all others go to the library as they are.
"""

from __future__ import annotations

import re
from collections import ChainMap
from functools import cache
from itertools import chain

import numpy as np

PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]?)")
#: Longest plain word; about how many words, and letters of words, are kept by default.
LONGEST, MOST = 48, 1_000_000


class _Kept(dict):
    """The kept words; others are looked up among those of the texts at hand."""

    new: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.new[word]


class WordTokenizer:
    """``most`` bounds the tables, some 350 bytes an entry: the first words to come, which
    are the frequent ones, stay."""

    def __init__(self, path: str, most: int = MOST) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.words = _Kept({"": b""})
        self.cores: dict[str, bytes] = {"": b""}
        self.most, self.seen, self.missed = most, 0, 0

    def _ids(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_cores(self, cores: list[str]) -> list[bytes]:
        ids = np.array(self.lib.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) and ids.max() < len(self.ends) else []
        if len(stops) != len(cores) or stops[-1] != len(ids):
            return [self._ids(c) for c in cores]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def of_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't kept, and of those the ones there is room for are."""
        plain = {w: (m[1].lower(), m[2]) for w in words if len(w) <= LONGEST and (m := PLAIN.fullmatch(w))}
        cores = self.cores
        if new := [c for c in {c for pair in plain.values() for c in pair} if c not in cores]:
            found = dict(zip(new, self._of_cores(new), strict=True))
            if len(cores) < self.most:
                cores.update(found)
            else:
                cores = ChainMap(found, cores)
        out = {w: cores[a] + cores[b] for w, (a, b) in plain.items()}
        if other := [w for w in words if w not in plain]:
            found = self.lib.encode_batch_fast(other, add_special_tokens=False)
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, found, strict=True))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        kept = self.words
        new = self.of_words([w for w in set(chain.from_iterable(split)) if w not in kept])
        self.seen += sum(map(len, split))
        self.missed += len(new)
        if len(kept) < self.most:
            kept.update(new)
            new = {}
        kept.new = new
        out = [b"".join(map(kept.__getitem__, words)) for words in split]
        kept.new = {}
        if self.seen > 1_000_000:
            if self.missed > 0.4 * self.seen:  # words of another kind have come
                self.words, self.cores = _Kept({"": b""}), {"": b""}
            self.seen = self.missed = 0
        return out

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@cache
def tokenizer(path: str, most: int = MOST) -> WordTokenizer:
    """One to a Python worker."""
    return WordTokenizer(path, most)
