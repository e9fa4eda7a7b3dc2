"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, edit verification.

Texts are compared as words, A-Z lower-cased and ASCII punctuation after a word ignored. An item is
found in a document if some run of its words is within ``floor(max_edits * n)`` word edits of the
item's ``n`` words.

The CGK embedding walks over a window: step ``j`` writes the word at hand and moves on if a random bit
of (step, word) says so. Windows at a small edit distance fall into step again and agree at most
steps. Each repetition has bits of its own and samples a few steps as its key; a window whose key is
that of an item of its length is a candidate. Windows of ``n`` words run past the end of a document, on
padding words that no text has, where a copy of ``n - edits`` words could end it. The number of repetitions
is what reaches the target recall at the largest distance allowed, however many that are. It is measured per length
on copies of the items themselves, edited ones and ones that only lost words, inside a text and at its end, over some of the windows that meet a copy. Candidates are aligned exactly.

A document barely longer than an item offers few windows. There every item of the length that shares enough
word pairs with it is aligned, without keys. Items of fewer than five words allow no edit and are looked up whole.

Before it is embedded a window must hold the ``n - 1 - 2 * edits`` word pairs and ``n - 2 - 3 * edits``
word triples that every window within the distance shares with its item; that drops no match. Items are sent to the documents in blocks of
bounded size, one pass over the documents for each block, so a large benchmark costs passes, not memory.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import words as W
from winnow.llm.shipping import ship

MAX_EDITS = 0.2
RECALL = 0.99
SAMPLES = 2
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8_000_000
_SLICE_BYTES = 4_000_000
_TRIALS = 200
_STARTS = 5  # windows tried of those that meet a trial copy


def matches(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    max_edits: float = MAX_EDITS,
    recall: float = RECALL,
) -> DataFrame:
    """``(key, item, start, edits)`` for each row of ``docs`` and item found in it: the best place, first among equals.

    ``start`` counts words from 0. Null and empty texts hold nothing. Items without words or
    without an id are not looked for; items that repeat an id or a text are
    looked for each, and rows that repeat a document report each.
    """
    fields = [docs.schema[key], T.StructField(item, items.schema[item].dataType)]
    schema = T.StructType([*fields, T.StructField("start", T.LongType()), T.StructField("edits", T.IntegerType())])
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(items, item, item_text, max_edits, recall):

        def run(batches: Iterator[pa.RecordBatch], index: _Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, part in W.runs(batch.column(1), _SLICE_BYTES):
                    rows = index.search(part)
                    at = pa.array([low + r[0] for r in rows], pa.int64())
                    columns = [batch.column(0).take(at), pa.array([index.ids[r[1]] for r in rows], _arrow(schema[1].dataType))]
                    columns += [pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        found = found.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return found


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    max_edits: float = MAX_EDITS, recall: float = RECALL,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns as they are."""
    for index in _blocks(items, item, item_text, max_edits, recall):

        def run(batches: Iterator[pa.RecordBatch], index: _Index = index, at: int = docs.columns.index(text)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for low, part in W.runs(batch.column(at), _SLICE_BYTES):
                    clean[[low + r[0] for r in index.search(part)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


class _Index:
    """Embedded items of one block, by length."""

    def __init__(self, ids: list, hashes: list[np.ndarray], max_edits: float):
        self.ids, self.items = ids, hashes
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for i, words in enumerate(hashes):
            self.by_length[len(words)].append(i)
        edits = {n: math.floor(max_edits * n) for n in self.by_length}
        self.whole = {n: self._whole(n) for n, e in edits.items() if not e}
        self.edits = {n: e for n, e in edits.items() if e}
        self.least = {n: max(1, n - edits) for n, edits in self.edits.items()}
        self.bits = max(16, math.ceil(math.log2(sum(map(len, hashes)))) + 7)
        self.runs = {}
        for size in (2, 3):
            self.runs[size] = np.zeros(1 << self.bits, bool)
            self.runs[size][self._slot(np.concatenate([_runs(w, size) for w in hashes if len(w) >= size] or [np.zeros(0, np.uint64)]))] = True
        self.twice = {size: self._twice(size) for size in (2, 3)}
        self.pairs = {n: self._pairs(n) for n in self.edits}
        self.repetitions: dict[int, int] = {}
        self.keys: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def complete(self, repetitions: dict[int, int]) -> None:
        """Keys of the items, for the repetitions that each length takes."""
        self.repetitions = repetitions
        self.keys = {n: self._item_keys(n) for n in self.edits}

    def _whole(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the items of a length as they stand, sorted, and whose they are."""
        owners = np.array(self.by_length[n])
        keys = np.array([W.window_hashes(self.items[i], np.zeros(1, np.int64), n)[0] for i in owners], np.uint64)
        order = np.argsort(keys, kind="stable")
        return keys[order], owners[order]

    def _pairs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word pairs of the items of a length, sorted, and whose they are."""
        found = [np.unique(_runs(self.items[i], 2)) for i in self.by_length[n]]
        owners = np.repeat(self.by_length[n], [len(f) for f in found])
        pairs = np.concatenate(found)
        order = np.argsort(pairs, kind="stable")
        return pairs[order], owners[order]

    def _slot(self, runs: np.ndarray) -> np.ndarray:
        return (runs >> np.uint64(64 - self.bits)).astype(np.int64)

    def _twice(self, size: int) -> np.ndarray:
        """Runs that stand in some item right after themselves, as in one word many times over."""
        runs = [_runs(w, size) for w in self.items if len(w) >= size]
        return np.unique(np.concatenate([r[1:][r[1:] == r[:-1]] for r in runs] or [np.zeros(0, np.uint64)]))

    def _shared(self, n: int, size: int) -> int:
        """Runs of ``size`` words that an ``n``-word window within the distance shares with its item, at least.

        A run like the one before it is counted only if some item has it so. The first run of a window
        may look like one, which costs one.
        """
        return n - size - size * self.edits[n]

    def _marks(self, words: W.Words, size: int) -> np.ndarray:
        """How many runs of ``size`` words before each position stand in some item."""
        count = len(words.hash)
        marks = np.zeros(count + 1, np.int32)
        if count < size:
            return marks
        runs = _runs(words.hash, size)
        found = self.runs[size][self._slot(runs)] & (words.row[size - 1 :] == words.row[: count - size + 1])
        again = 1 + np.flatnonzero(found[1:] & (runs[1:] == runs[:-1]))
        found[again[~np.isin(runs[again], self.twice[size])]] = False
        np.cumsum(found, out=marks[1 : len(found) + 1])
        marks[len(found) + 1 :] = marks[len(found)]
        return marks

    def _padded(self, words: W.Words, length: np.ndarray) -> W.Words:
        """The words with padding behind each row, as many as windows that hold enough of its words can run past it."""
        lengths = sorted(self.edits)
        least = np.array([self.least[n] for n in lengths])
        longest = np.append(0, np.maximum.accumulate([n - self.least[n] for n in lengths]))
        pads = longest[np.searchsorted(least, length, side="right")]
        rows, last = np.arange(len(length)), np.cumsum(length)
        behind = _padding(int(pads.max(initial=0)))[np.arange(pads.sum()) - np.repeat(np.cumsum(pads) - pads, pads)]
        at = np.repeat(last, pads)
        return words._replace(row=np.insert(words.row, at, np.repeat(rows, pads)), hash=np.insert(words.hash, at, behind))

    def _starts(self, words: W.Words, last: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length of items the starts of windows that hold enough words, and runs of some item.

        Lengths that must share a triple are tried only where the longest window holds any as many.
        """
        count = len(words.hash)
        pairs, triples = self._marks(words, 2), self._marks(words, 3)
        need = [self._shared(n, 3) for n in self.edits if self._shared(n, 3) > 0]
        reach = np.minimum(np.arange(count) + max(self.edits), count)
        dense = np.flatnonzero(triples[reach] - triples[:-1] >= min(need)) if need else np.zeros(0, np.int64)
        for n in self.edits:
            start = dense if self._shared(n, 3) > 0 else np.arange(count)
            start = start[start + self.least[n] <= last[words.row[start]]]
            for size, marks in ((3, triples), (2, pairs)):
                start = start[marks[start + n - size + 1] - marks[start] >= self._shared(n, size)]
            yield n, start

    def _item_keys(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted keys of the items of a length, and whose they are, for each repetition."""
        table, owners = np.concatenate([self.items[i] for i in self.by_length[n]]), np.array(self.by_length[n])
        every = cgk_keys(table, np.arange(len(owners)) * n, n, self.repetitions[n])
        orders = [np.argsort(keys, kind="stable") for keys in every]
        return [(keys[order], owners[order]) for keys, order in zip(every, orders, strict=True)]

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, start, edits) for every item found in every row of a column."""
        words = W.split(texts, lower=True, bare=True)
        length = words.counts(len(texts))
        last = np.cumsum(length)
        first = last - length
        out = self._exact(words, first)
        if not self.edits or length.max(initial=0) < min(self.least.values()):
            return sorted(out)
        padded = self._padded(words, length)
        begin = np.searchsorted(padded.row, np.arange(len(texts)), side="left")
        candidates: dict[tuple[int, int], set[int]] = defaultdict(set)
        for n, start in self._starts(padded, begin + length):
            rows = padded.row[start]
            short = length[rows] < n + self.edits[n]
            for row in np.unique(rows[short]).tolist():
                for owner in self._sharing(words.hash[first[row] : last[row]], n):
                    candidates[row, owner].add(0)
            start = start[~short]
            if not len(start):
                continue
            found = cgk_keys(padded.hash, start, n, self.repetitions[n])
            for own, (keys, owners) in zip(found, self.keys[n], strict=True):
                low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                for i in np.flatnonzero(high > low):
                    for owner in owners[low[i] : high[i]]:
                        row = int(padded.row[start[i]])
                        candidates[row, int(owner)].add(int(start[i] - begin[row]))
        for (row, owner), starts in sorted(candidates.items()):
            best = self._verify(words.hash[first[row] : last[row]], owner, sorted(starts))
            if best:
                out.append((row, owner, best[1], best[0]))
        return sorted(out)

    def _exact(self, words: W.Words, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """First places of the items that allow no edit."""
        out: dict[tuple[int, int], int] = {}
        for n, (keys, owners) in self.whole.items():
            start = np.arange(max(0, len(words.hash) - n + 1))
            start = start[words.row[start] == words.row[start + n - 1]]
            own = W.window_hashes(words.hash, start, n)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for i in np.flatnonzero(high > low):
                at, row = int(start[i]), int(words.row[start[i]])
                for owner in owners[low[i] : high[i]].tolist():
                    if np.array_equal(words.hash[at : at + n], self.items[owner]):
                        out.setdefault((row, owner), at - int(first[row]))
        return [(row, owner, start, 0) for (row, owner), start in out.items()]

    def _sharing(self, document: np.ndarray, n: int) -> list[int]:
        """Items of a length that share as many word pairs with a document as a copy in it must."""
        pairs, owners = self.pairs[n]
        if len(document) < 2:
            return []
        own = _runs(document, 2)
        low, high = np.searchsorted(pairs, own, "left"), np.searchsorted(pairs, own, "right")
        sizes = high - low
        at = np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
        found, count = np.unique(owners[at], return_counts=True)
        return found[count >= max(1, self._shared(n, 2))].tolist()

    def _verify(self, document: np.ndarray, owner: int, starts: list[int]) -> tuple[int, int] | None:
        """Fewest edits and where, over the runs around all candidate windows; overlapping windows are one."""
        words, edits = self.items[owner], self.edits[len(self.items[owner])]
        spans: list[list[int]] = []
        for start in starts:
            low, high = max(0, start - edits), min(len(document), start + len(words) + edits)
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        # An edit takes away one word of the item at most, so this many of them must be there.
        held = [(low, high) for low, high in spans if np.isin(words, document[low:high]).sum() >= len(words) - edits]
        found = [(distance, low + at) for low, high in held for distance, at in [align(words, document[low:high])]]
        best = min(found, default=(edits + 1, 0))
        return best if best[0] <= edits else None


def cgk_keys(words: np.ndarray, start: np.ndarray, n: int, repetitions: int, first: int = 0) -> np.ndarray:
    """For each repetition from ``first`` on the key of each ``n``-word window: what its CGK walk writes at the sampled steps."""
    sampled = np.array([np.random.default_rng([first + r, n]).integers(0, 2 * n, SAMPLES) for r in range(repetitions)])
    longest = np.argsort(sampled.max(axis=1), kind="stable")
    sampled = sampled[longest]
    ends = sampled.max(axis=1)
    # the walk moves on by the top bit of word times an odd number of the repetition and step
    odd = W.mix(longest.astype(np.uint64) + np.uint64(first + 1)) | np.uint64(1)
    at = np.zeros((repetitions, len(start)), np.int64)
    keys = np.zeros((repetitions, len(start)), np.uint64)
    for step in range(int(ends[-1]) + 1):
        left = slice(int(np.searchsorted(ends, step)), None)
        here = at[left]
        word = words[start + np.minimum(here, n - 1)]
        word[here >= n] = 0
        for i in np.flatnonzero((sampled[left] == step).any(axis=1)):
            keys[left][i] = W.mix(keys[left][i] ^ word[i])
        factor = W.mix(odd[left] + np.uint64(step)) | np.uint64(1)
        here += (word * factor[:, None] >> np.uint64(63)).astype(np.int64)
    out = np.empty_like(keys)
    out[longest] = keys
    return out


def align(item: np.ndarray, document: np.ndarray) -> tuple[int, int]:
    """Fewest word edits that turn a run of the document into the item, and the first start of such a run."""
    width = len(document) + 1
    column = np.arange(width, dtype=np.int64)
    # cost * (width + 1) + start, so that the least value has the least cost, then the first start
    scale = width + 1
    row = column.copy()
    for i, word in enumerate(item):
        new = np.empty(width, np.int64)
        new[0] = (i + 1) * scale
        np.minimum(row[:-1] + scale * (document != word), row[1:] + scale, out=new[1:])
        row = np.minimum.accumulate(new - column * scale) + column * scale
    best = int(row.min())
    return best // scale, best % scale


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    return W.window_hashes(words, np.arange(len(words) - size + 1), size)


def _repetitions(index: _Index, n: int, recall: float) -> int:
    """Repetitions that reach the recall for each kind of copies with the most edits allowed, counted on trial copies."""
    draw = np.random.default_rng(n)
    owners = draw.choice(index.by_length[n], _TRIALS)
    originals = np.stack([index.items[o] for o in owners])
    found = [_first_hits(n, originals, *_trials(index, n, owners, kind, draw), (1 - recall) / 2) for kind in (_edited, _shortened, _ending)]
    return max(found)


def _first_hits(n: int, originals: np.ndarray, windows: np.ndarray, passed: np.ndarray, most_missed: float) -> int:
    """Repetitions after which no larger share of the trials is without a window that shares a key with its item."""
    allowed = int(most_missed * len(windows))
    open_, done, more = np.arange(len(windows)), 0, 16
    while True:
        keys = cgk_keys(originals[open_].ravel(), np.arange(len(open_)) * n, n, more, done)[:, :, None]
        part = windows[open_]
        own = cgk_keys(part.ravel(), np.arange(part[..., 0].size) * n, n, more, done).reshape(more, *part.shape[:2])
        missed = np.cumprod(~((own == keys) & passed[open_]).any(axis=2), axis=0).astype(bool)
        enough = np.flatnonzero(missed.sum(axis=1) <= allowed)
        if len(enough):
            return done + int(enough[0]) + 1
        open_, done, more = open_[missed[-1]], done + more, 2 * more


def _trials(index: _Index, n: int, owners: np.ndarray, kind, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows over trial copies, a few for each, and whether each holds the runs that are asked of it."""
    windows = []
    for owner in owners:
        text, starts = kind(index.items[owner], index.edits[n], draw)
        windows.append([text[s : s + n] for s in starts])
    windows = np.array(windows, np.uint64)
    passed = np.ones(windows.shape[:2], bool)
    for size in (2, 3):
        for i, owner in enumerate(owners):
            item = _runs(index.items[owner], size)
            shared = [np.isin(_runs(w, size), item).sum() for w in windows[i]]
            passed[i] &= np.array(shared) >= index._shared(n, size)
    return windows, passed


def _edited(words: np.ndarray, edits: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A copy with random replaced, dropped and added words inside a text, and where windows over it start."""
    out = words.tolist()
    for _ in range(edits):
        at, kind, word = int(draw.integers(len(out))), int(draw.integers(3)), int(draw.integers(1 << 62))
        out[at : at + (kind != 1)] = [] if kind == 0 else [word]
    around = draw.integers(1 << 62, size=2 * len(words)).astype(np.uint64)
    text = np.concatenate([around[: len(words)], np.array(out, np.uint64), around[len(words) :]])
    return text, len(words) + np.linspace(-edits / 2, edits / 2, _STARTS).astype(np.int64)


def _shortened(words: np.ndarray, edits: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A copy that lost random words inside a text, and where windows over it start."""
    kept = np.sort(draw.choice(len(words), len(words) - edits, replace=False))
    around = draw.integers(1 << 62, size=2 * edits).astype(np.uint64)
    text = np.concatenate([around[:edits], words[kept], around[edits:]])
    return text, np.linspace(0, edits, _STARTS).astype(np.int64)


def _ending(words: np.ndarray, edits: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The same at the end of a text."""
    text, starts = _shortened(words, edits, draw)
    text[-edits:] = _padding(edits)
    return text, starts


def _counted(spark: SparkSession, index: _Index, recall: float) -> dict[int, int]:
    """Repetitions of each length that allows edits, counted in tasks."""
    lengths = sorted(index.edits, reverse=True)
    if not lengths:
        return {}
    known = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_repetitions(known.value, n, recall) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["n", "repetitions"])

    table = spark.createDataFrame([(n,) for n in lengths], "n int").repartition(min(len(lengths), 64))
    return {r.n: r.repetitions for r in table.mapInArrow(count, "n int, repetitions int").collect()}


def _padding(count: int) -> np.ndarray:
    """Hashes of distinct words that no text has, for the places past a document's end."""
    return W.mix(np.arange(1, count + 1, dtype=np.uint64) << np.uint64(40))


def _blocks(items: DataFrame, item: str, text: str, max_edits: float, recall: float) -> Iterator[_Index]:
    """The items in blocks of bounded number and size."""
    ship(items.sparkSession)
    items = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text)
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    blocks = max(math.ceil(size.n / BLOCK_ITEMS), math.ceil((size.bytes or 0) / BLOCK_BYTES))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64(item, text), F.lit(blocks)) == block).orderBy(item, text).toArrow()
        if not part.num_rows:
            continue
        words = W.split(part[text], lower=True, bare=True)
        cuts = np.cumsum(words.counts(part.num_rows))[:-1]
        known = [(i, w) for i, w in zip(part[item].to_pylist(), np.split(words.hash, cuts), strict=True) if len(w)]
        if known:
            index = _Index([i for i, _ in known], [w for _, w in known], max_edits)
            index.complete(_counted(items.sparkSession, index, recall))
            yield index


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
