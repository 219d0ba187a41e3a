"""Vectorised words and word shingles: ASCII letters (lower-cased), digits and all non-ASCII bytes
make words; everything else parts them."""

from __future__ import annotations

import numpy as np

from gneiss.llm.base import span_hashes, splitmix

_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 0 for b in range(256))
_MIXED = splitmix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the len(texts) + 1 offsets of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"\0".join([*raw, b""]).translate(_FOLD), np.uint8)
    inside = np.concatenate([[False], data != 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    offset = np.searchsorted(start, np.append(begin, len(data)))
    return span_hashes(_MIXED[data], start, end), offset


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of n words; a shorter text is one run of all its words."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total *= _STEP
        total += words[i : len(words) - k + 1 + i]
    return np.unique(splitmix(total + np.uint64(k)))
