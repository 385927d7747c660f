"""Hashed character n-gram counts of whole texts."""

from __future__ import annotations

from functools import cache

import numpy as np

MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def ngram_counts(points: np.ndarray, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Counts, by hash, of the n-grams of these orders."""
    total = np.zeros(1 << bits, np.float32)
    hashed = None
    for order in range(1, max(orders) + 1):
        n = len(points) - order + 1
        if n <= 0:
            break
        part = points[order - 1 :] * np.uint32(MULTIPLIERS[order - 1])
        hashed = part if hashed is None else (hashed[:n] ^ (hashed[:n] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + part
        if order in orders:
            mixed = (hashed ^ (hashed >> np.uint32(16))) * np.uint32(0x7FEB352D + 2 * order)
            total += np.bincount(mixed >> np.uint32(32 - bits), minlength=1 << bits)
    return total


def unit(counts: np.ndarray) -> np.ndarray:
    """Square-rooted and scaled to length 1 (zeros stay)."""
    x = np.sqrt(counts)
    norm = float(np.sqrt((x * x).sum()))
    return x / np.float32(norm) if norm else x
