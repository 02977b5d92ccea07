"""Words, shingles and hashes shared by the near-duplicate operators (NumPy, whole Arrow batches at a time)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_VOCABULARY: dict[str, int] = {}
_VOCABULARY_MAX = 1 << 20
_P = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words(text: str) -> list[str]:
    """Longest runs of letters and digits after NFKC and lower-casing."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hash of each word; a bounded per-worker dictionary holds those already computed."""
    known = _VOCABULARY
    if len(known) > _VOCABULARY_MAX:
        known.clear()
    for w in set(tokens).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def shingle_hashes(tokens: list[str], k: int) -> np.ndarray:
    """Hashes of the runs of k words, in text order (with repeats); empty if there are fewer words."""
    if len(tokens) < k:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(tokens)
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _P[i]
    return mix(out)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted arrays of distinct shingle hashes; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's BIGINT."""
    return h.view(np.int64)


def batch_shingles(token_lists: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of many texts at once: all values, and the offsets (one more than texts) of each text's own."""
    lengths = np.fromiter(map(len, token_lists), dtype=np.int64, count=len(token_lists))
    counts = np.maximum(lengths - k + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    flat = [w for ts in token_lists for w in ts]
    if len(flat) < k:
        return np.empty(0, dtype=np.uint64), offsets
    h = word_hashes(flat)
    run = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        run += h[i : len(h) - k + 1 + i] * _P[i]
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    at = np.repeat(starts - offsets[:-1], counts) + np.arange(offsets[-1])
    return mix(run[at]), offsets


def distinct_shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; empty for null and for texts of under k words."""
    return np.unique(shingle_hashes(words(text), k)) if text else np.empty(0, dtype=np.uint64)
