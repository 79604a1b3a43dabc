"""Numpy helpers for tasks that fingerprint the words of many documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words hashed together in one numpy call; bounds the memory of a task, not the length of a text.
CHUNK_WORDS = 200_000


@dataclass
class Chunk:
    """Whole documents, one after another. rows: their places in the batch; bounds: len(rows) + 1 word offsets."""

    rows: list[int]
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.bounds))


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def chunks(texts: Iterable[str | None], split: Callable[[str], list[bytes]]) -> Iterator[Chunk]:
    """Hash the words of texts, in chunks of whole documents. A null text has no words."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0
    digest = xxhash.xxh3_64_intdigest
    for i, text in enumerate(texts):
        words = split(text) if text else []
        rows.append(i)
        parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        held += len(words)
        if held >= CHUNK_WORDS:
            yield Chunk(rows, np.cumsum([0, *map(len, parts)]), np.concatenate(parts))
            rows, parts, held = [], [], 0
    if rows:
        yield Chunk(rows, np.cumsum([0, *map(len, parts)]), np.concatenate(parts))


def grams(hashes: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of each k consecutive words (across documents too; the caller masks those)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + hashes[j : n + j]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the low bits of a polynomial hash over the word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value in each window of w values."""
    least, place, span = values, np.arange(len(values)), 1
    if len(values) < w:
        return place[:0]
    while span < w:
        step = min(span, w - span)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    return place


def range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of the words [start, end) of each pair; depends on those words alone."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    n = len(hashes)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:n])])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
    return mix((sums[end] - sums[start]) * back[start] ^ ((end - start).astype(np.uint64) * BASE2))
