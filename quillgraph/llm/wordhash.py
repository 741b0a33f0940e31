"""Words and word shingles of many texts at once, on the UTF-8 bytes of an Arrow column.

A word is a run of ASCII letters (lower-cased), digits and characters beyond ASCII. Each word gets a 64-bit
polynomial hash over random byte values, so no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLAB = 1 << 21
_LOWER = np.zeros(256, np.uint8)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWER[_c] = _c
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[0] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) < n:
        size = max(n, SLAB + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit touches all output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """starts, ends: byte places of each word in `low`; hashes; first: index of each row's first word (rows + 1)."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, k: int) -> bytes:
        return self.low[self.starts[k] : self.ends[k]].tobytes()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[:-1][(offsets[:-1] < len(low)) & (np.diff(offsets) > 0)]
    begins[edges] = inside[1:-1][edges]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    stops[tails] = inside[1:-1][tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        at = starts[k]
        last = max(int(np.searchsorted(ends, at + SLAB, "right")), k + 1)
        up, down = _powers(int(ends[last - 1] - at))
        part = _VALUE[low[at : ends[last - 1]]]
        part *= up[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[k:last] - at, ends[k:last] - at
        hashes[k:last] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        k = last
    return Words(low, starts, ends, mix(hashes), np.searchsorted(starts, offsets).astype(np.int64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; the last n - 1 places are left out. Runs may cross rows."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    step = np.uint64(0x2545F4914F6CDD1D)
    for j in range(n):
        out *= step
        out += hashes[j : j + count]
    return mix(out + np.uint64(n))


def gram_rows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (index of the first word) and rows of the runs of n words that stay in one row."""
    counts = np.maximum(words.counts() - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    shift = np.cumsum(counts) - counts
    return np.arange(len(rows)) - np.repeat(shift, counts) + np.repeat(words.first[:-1], counts), rows
