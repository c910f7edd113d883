"""Word-shingle sets and circulant MinHash signatures, by numpy, of one text at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from finspan.llm.common import mix64, word_hashes

_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(raw: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text with A-Z lower-cased.

    Fewer words than a shingle takes make one shingle; no words, none.
    """
    h, _, _ = word_hashes(np.frombuffer(raw, np.uint8))
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MULT[i % len(_MULT)]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


@lru_cache(4)
def _circle(bits: int, k: int) -> np.ndarray:
    """The second permutation's table, with its first k entries again at the end."""
    table = np.random.default_rng(977).permutation(1 << bits).astype(np.uint32)
    return np.concatenate([table, table[:k]])


def signature(hashes: np.ndarray, k: int = 80, bits: int = 20) -> np.ndarray:
    """k coordinates from two permutations.

    The first permutation is the hash's top bits; coordinate i is the least value of the second, circularly
    shifted by i, over the set. An empty set has the largest values.
    """
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(_circle(bits, k), k)
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    for i in range(0, len(at), 4096):
        np.minimum(least, windows[at[i : i + 4096]].min(0), out=least)
    return least


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 63-bit key for each band of so many rows, different for each band."""
    bands = sig[: len(sig) // rows * rows].reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(0x51ED270B)
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return (key >> np.uint64(1)).astype(np.int64)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits for a set of hashes, as two signed numbers; equal sets have equal keys."""
    a = mix64(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
    b = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(hashes)))
    return int(np.sum(a, dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(b).astype(np.int64) if len(b) else 0)
