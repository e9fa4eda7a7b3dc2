"""Words and their hashes, computed on the UTF-8 bytes of whole Arrow columns.

A word is a run of bytes other than space and 0x09-0x0D. All functions run inside Python workers,
on one batch of rows at a time; temporary arrays are bounded by ``BLOCK`` bytes, not by a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_BYTES_BARE = _BYTES_LOWER.copy()
_BYTES_BARE[_PUNCTUATION] = 0
_POWERS: list[np.ndarray] = []


class Words(NamedTuple):
    """The words of a column: bytes of all texts, first and end byte, row and hash of each word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base modulo 2^64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _POWERS[:] = tables
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """A string column in runs of rows of at most ``size`` bytes, or of one larger text, with each run's first row."""
    _, offsets = text_bytes(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        yield low, texts.slice(low, high - low)
        low = high


def split(column: pa.Array | pa.ChunkedArray, lower: bool = False, bare: bool = False) -> Words:
    """Words of every row, hashed; ``lower`` hashes A-Z as a-z, ``bare`` also ignores ASCII punctuation after a word."""
    data, offsets = text_bytes(column)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, row, _hash(data, start, end, _BYTES_BARE if bare else _BYTES_LOWER if lower else _BYTES))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        low, high = start[i], end[j - 1]
        power, inverse = powers(int(high - low))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * power, out=total[1:])
        s = start[i:j] - low
        out[i:j] = (total[end[i:j] - low] - total[s]) * inverse[s]
        i = j
    return mix(out)


def window_hashes(hashes: np.ndarray, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from each position in ``at``; ``seed`` makes independent hashes."""
    if not len(at):
        return np.zeros(0, np.uint64)
    values = mix(hashes + np.uint64(seed)) if seed else hashes
    power, inverse = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power, out=total[1:])
    return mix((total[at + length] - total[at]) * inverse[at])
