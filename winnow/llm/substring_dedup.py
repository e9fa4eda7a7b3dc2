"""Substring dedup with difference-cover anchors.

A window is ``length`` consecutive words of one document; a word goes if a window over it has the
same words as a window that starts earlier (smaller id, or same document and earlier start).

{0, 1, 3, 9} is a difference cover modulo 13: every alignment of two equal windows has a shift
below 13 at which both stand on a cover position of their own document. So only windows of
``length - 12`` words at cover positions, 4 of 13, are hashed and counted over the corpus
(*anchors*). Where an anchor occurs once, no match can pass through it that way; only windows around
anchors that occur again are extended to the full length, and compared by a 96-bit hash.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from winnow.llm import chunks as C
from winnow.llm import words as W
from winnow.llm.shipping import ship

PERIOD = 13
COVER = np.isin(np.arange(PERIOD), (0, 1, 3, 9))
LENGTH = 20

_KEYS = "bucket int, chunk long, keys binary"
_ANSWERS = "bucket int, chunk long, stage int, bits binary"


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Remove repeated passages; returns the input's columns, with ``text`` cut, plus n_words, n_removed, kept_sha256.

    A text that loses nothing stays as it is; another becomes its kept words joined by one space.
    ``kept_sha256`` is always of the joined words. Null and empty texts have no words and stay.
    Rows that share an id are ordered by their text; a null id is the smallest. Input columns named
    like a result column are replaced. ``length`` must be at least 13.
    """
    if length < PERIOD:
        raise ValueError(f"length must be at least {PERIOD}")
    ship(docs.sparkSession)
    results = ("n_words", "n_removed", "kept_sha256", C.CHUNK)
    docs = docs.select(*[c for c in docs.columns if c not in results])
    n_chunks, n_buckets = C.sizes(docs, text)
    dealt = C.chunked(docs, key, n_chunks)

    def anchors(table: pa.Table) -> pa.Table:
        part = _Part(table, key, text, length)
        return _send(part.chunk, *part.anchor_keys()[:1], n_buckets)

    def shared(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        every = np.sort(np.concatenate(sent))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        return _answer(table, 1, [np.isin(k, again, assume_unique=True) for k in sent])

    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        part = _Part(table, key, text, length)
        return _send(part.chunk, *part.window_keys(part.windows(answers))[:2], n_buckets)

    def repeated(table: pa.Table) -> pa.Table:
        sent = [_unpack(k) for k in table["keys"].to_pylist()]
        low, high, doc = (np.concatenate([s[i] for s in sent]) for i in range(3))
        order = np.lexsort((doc, high, low))
        again = np.zeros(len(order), bool)
        low, high = low[order], high[order]
        again[order[1:]] = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
        return _answer(table, 2, np.split(again, np.cumsum([len(s[0]) for s in sent])[:-1]))

    fields = [*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    schema = T.StructType([*fields, T.StructField("kept_sha256", T.StringType())])

    def kept(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.drop_columns([C.CHUNK])
        part = _Part(table, key, text, length)
        return part.result(part.covered(answers), text)

    first = dealt.groupBy(C.CHUNK).applyInArrow(anchors, _KEYS)
    first = first.groupBy("bucket").applyInArrow(shared, _ANSWERS)
    second = dealt.groupBy(C.CHUNK).cogroup(first.groupBy("chunk")).applyInArrow(candidates, _KEYS)
    second = second.groupBy("bucket").applyInArrow(repeated, _ANSWERS)
    answers = first.unionByName(second)
    return dealt.groupBy(C.CHUNK).cogroup(answers.groupBy("chunk")).applyInArrow(kept, schema)


class _Part:
    """One chunk of documents in the order of their ids."""

    def __init__(self, table: pa.Table, key: str, text: str, length: int):
        order = pc.sort_indices(table, [(key, "ascending"), (text, "ascending")], null_placement="at_start")
        self.table, self.length = table.take(order), length
        self.chunk = table[C.CHUNK][0].as_py() if table.num_rows else 0
        self.words = W.split(self.table[text])
        ids = self.table[key]
        null = ids.is_null().to_numpy()
        self.ids = np.where(null, np.iinfo(np.int64).min, pc.fill_null(ids, 0).to_numpy())
        self.n_words = self.words.counts(table.num_rows)
        first = np.cumsum(self.n_words) - self.n_words
        row = self.words.row
        self.place = np.arange(len(row)) - first[row]
        self.left = self.n_words[row] - self.place

    def anchor_keys(self) -> tuple[np.ndarray, ...]:
        """Distinct anchors, their positions, the anchor number of each, and how often each occurs here."""
        size = self.length - PERIOD + 1
        at = np.flatnonzero(COVER[self.place % PERIOD] & (self.left >= size) & (self.place + self.left >= self.length))
        keys, number, count = np.unique(
            W.window_hashes(self.words.hash, at, size), return_inverse=True, return_counts=True
        )
        return keys, at, number, count

    def windows(self, answers: pa.Table) -> np.ndarray:
        """Starts of the windows that hold an anchor that occurs again."""
        _, at, number, count = self.anchor_keys()
        again = _read(answers, 1, len(count)) | (count > 1)
        marks = np.zeros(len(self.place) + self.length + 1, np.int32)
        marks[at[again[number]] + 1] = 1
        np.cumsum(marks, out=marks)
        start = np.flatnonzero(self.left >= self.length)
        return start[marks[start + PERIOD] > marks[start]]

    def window_keys(self, start: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """First windows of each word sequence here, sorted by hash: hash, (more hash, id); their starts; starts of the others."""
        low = W.window_hashes(self.words.hash, start, self.length)
        high = (W.window_hashes(self.words.hash, start, self.length, seed=0x5851F42D4C957F2D) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((high, low))
        low, high, start = low[order], high[order], start[order]
        first = np.ones(len(low), bool)
        first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return low[first], (high[first], self.ids[self.words.row[start[first]]]), start[first], start[~first]

    def covered(self, answers: pa.Table) -> np.ndarray:
        """For each word, whether a window over it repeats an earlier one."""
        _, _, firsts, others = self.window_keys(self.windows(answers))
        starts = np.concatenate([others, firsts[_read(answers, 2, len(firsts))]])
        change = np.zeros(len(self.place) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.subtract.at(change, starts + self.length, 1)
        return np.cumsum(change[:-1]) > 0

    def result(self, gone: np.ndarray, text: str) -> pa.Table:
        words, rows = self.words, self.table.num_rows
        removed = np.bincount(words.row, weights=gone, minlength=rows).astype(np.int64)
        ends = np.cumsum(self.n_words)
        texts, digests = self.table[text].to_pylist(), []
        raw = words.data.tobytes()
        for i, (end, count, lost) in enumerate(zip(ends.tolist(), self.n_words.tolist(), removed.tolist(), strict=True)):
            keep = np.arange(end - count, end)
            if lost:
                keep = keep[~gone[keep]]
            joined = b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
            digests.append(hashlib.sha256(joined).hexdigest())
            if lost:
                texts[i] = joined.decode("utf-8", "replace")
        table = self.table.drop_columns([C.CHUNK])
        at = table.column_names.index(text)
        table = table.set_column(at, text, pa.array(texts, table.schema.field(text).type))
        for name, values in (("n_words", self.n_words), ("n_removed", removed), ("kept_sha256", digests)):
            table = table.append_column(name, pa.array(values))
        return table


def _send(chunk: int, keys: np.ndarray, *more) -> pa.Table:
    """One row per bucket that gets keys: the keys alone, or with more hash bits and ids."""
    *extra, buckets = more
    filled, cuts = C.slices(keys, buckets)
    packed = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = slice(low, high)
        packed.append(_pack(keys[part], *[x[part] for x in extra[0]]) if extra else keys[part].tobytes())
    return pa.table(
        {
            "bucket": pa.array(filled, pa.int32()),
            "chunk": pa.array([chunk] * len(filled), pa.int64()),
            "keys": pa.array(packed, pa.binary()),
        }
    )


def _pack(low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> bytes:
    """Ids are kept as distances from the smallest, in four bytes where they fit."""
    base = int(ids.min())
    width = np.uint32 if int(ids.max()) - base < 1 << 32 else np.uint64
    distance = (ids.astype(np.uint64) - np.uint64(base % (1 << 64))).astype(width)
    head = np.array([base, len(low), width().itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, low, high, distance))


def _unpack(value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base, n, size = (int(x) for x in np.frombuffer(value, np.int64, 3))
    low = np.frombuffer(value, np.uint64, n, 24)
    high = np.frombuffer(value, np.uint32, n, 24 + 8 * n)
    distance = np.frombuffer(value, np.uint32 if size == 4 else np.uint64, n, 24 + 12 * n)
    return low, high, (distance.astype(np.uint64) + np.uint64(base % (1 << 64))).astype(np.int64)


def _answer(table: pa.Table, stage: int, flags: list[np.ndarray]) -> pa.Table:
    return pa.table(
        {
            "bucket": table["bucket"],
            "chunk": table["chunk"],
            "stage": pa.array([stage] * table.num_rows, pa.int32()),
            "bits": pa.array([len(f).to_bytes(4, "little") + np.packbits(f).tobytes() for f in flags], pa.binary()),
        }
    )


def _read(answers: pa.Table, stage: int, size: int) -> np.ndarray:
    """The flags of a chunk's sorted keys, put together from the answers of all buckets."""
    rows = [row for row in answers.to_pylist() if row["stage"] == stage]
    flags = [np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=int.from_bytes(b[:4], "little")) for b in C.in_order(rows, "bits")]
    out = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
    if len(out) != size:
        raise RuntimeError(f"answers for {len(out)} of {size} keys")
    return out
