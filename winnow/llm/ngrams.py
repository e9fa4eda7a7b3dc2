"""Hashed n-gram indicators of whole texts, for the linear classifiers.

A text becomes the set of its n-grams, each hashed to one of ``2**bits`` columns. Work goes text by
text in pieces of bounded size, so a long text costs time but no more memory than its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

BITS = 18
COLUMNS = 1 << BITS
_PIECE = 1 << 16
_SHIFT = np.uint64(64 - BITS)
_ODD = np.random.default_rng(8).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

Features = Callable[[str | None], np.ndarray]


class Indicator:
    """Collects column numbers and gives back each once."""

    def __init__(self) -> None:
        self._seen = np.zeros(COLUMNS, bool)

    def distinct(self, pieces: Iterator[np.ndarray]) -> np.ndarray:
        found = []
        for piece in pieces:
            new = piece[~self._seen[piece]]
            if len(new):
                self._seen[new] = True
                found.append(np.unique(new))
        out = np.concatenate(found) if found else np.zeros(0, np.int64)
        self._seen[out] = False
        return out


def grams(symbols: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Columns of all runs of ``size`` small integers (below 256); ``kind`` keeps alphabets apart."""
    n = len(symbols) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for i in range(size):
        packed = packed << np.uint64(8) | symbols[i : i + n]
    return ((packed + np.uint64(1)) * _ODD[kind * 8 + size] >> _SHIFT).astype(np.int64)


def character_ngrams(sizes: tuple[int, ...] = (4, 5, 6)) -> Features:
    """Byte n-grams of the text between two spaces; A-Z count as a-z, all white space as a space."""
    indicator = Indicator()

    def features(text: str | None) -> np.ndarray:
        data = _LOWER[np.frombuffer(f" {text or ''} ".encode(), np.uint8)].astype(np.uint64)
        return indicator.distinct(
            grams(data[low : low + _PIECE + size - 1], size, 0) for low in range(0, len(data), _PIECE) for size in sizes
        )

    return features


def shape_ngrams(byte_sizes: tuple[int, ...] = (1, 2, 3), word_sizes: tuple[int, ...] = (1, 2, 3)) -> Features:
    """Byte n-grams as written, and n-grams of word shapes.

    A word's shape holds its case, its length up to 7 bytes, what kind of byte ends it, and whether
    it repeats the word before, so runs of shouting, symbols, tables and repetition are n-grams.
    """
    indicator = Indicator()

    def pieces(data: np.ndarray, shapes: np.ndarray) -> Iterator[np.ndarray]:
        for kind, symbols, sizes in ((1, data, byte_sizes), (2, shapes, word_sizes)):
            for low in range(0, len(symbols), _PIECE):
                for size in sizes:
                    yield grams(symbols[low : low + _PIECE + size - 1], size, kind)

    def features(text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        data = np.frombuffer(raw, np.uint8)
        return indicator.distinct(pieces(data.astype(np.uint64), _shapes(raw)))

    return features


def _shapes(raw: bytes) -> np.ndarray:
    words = raw.split()
    out = np.empty(len(words), np.uint64)
    last = None
    for i, word in enumerate(words):
        case = 0 if word.islower() else 1 if word.isupper() else 2 if word[:1].isupper() else 3
        end = word[-1]
        tail = 0 if end >= 128 or chr(end).isalpha() else 1 if end in b".,;:" else 2 if chr(end).isdigit() else 3
        out[i] = (word == last) << 7 | case << 5 | tail << 3 | min(len(word), 7)
        last = word
    return out
