"""Spelling variant grouping over a variable-length gram index.

Words of the whole corpus are near if one inserted, deleted or replaced code point turns one into the
other. A frequent gram is one that occurs more than ``T`` times in the words; the gram that begins at a
place of a word is the shortest of at least two code points that is not frequent, so common
beginnings are prolonged and no list of words under a gram is long. That dictionary is pruned by frequency
and sent out as its frequent grams alone, whose number has a bound.

A gram is decided by the letters it covers (or by the word's end, where it stops short of that), so one
edit can change only the grams over its place. The largest number of grams over one place is the word's
bound ``b`` of affected grams. Two near words share all but ``b`` of the grams of each, so the rarest
gram they share is among the ``b + 1`` rarest of both: only these lists are merged, by gram, place
and length. Grams are no longer than a word can spare, so at least one is always left. Pairs in a list
are verified letter by letter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import words as W
from winnow.llm.shipping import ship
from winnow.session import stage

MIN_LENGTH = 5
MIN_COUNT = 3
ONE_IN = 97
SHORTEST = 2  # code points of a gram
LONGEST = 8
FREQUENT = 1024  # occurrences beyond which a gram is prolonged
DICTIONARY = 1_000_000  # frequent grams at most; beyond, the threshold rises
BUCKET_ROWS = 250_000
_PAIRS = 4_000_000  # bytes compared at once
_SLICE_BYTES = 4_000_000
_BASE = 91  # 26 letters, 64 of U+00C0 to U+00FF, 0 for none
_CRC_AT_ONCE = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[0x80:0xC0] = np.arange(27, 91)
_LIST = "bucket int, list long, own boolean, word string, n long"
_PAIR = "word string, near string, near_n long"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of a table of documents; see :func:`group`."""
    return group(count_words(docs, key, text), frequent)


def count_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> DataFrame:
    """``(word, n)``: words of at least ``min_length`` code points that occur ``min_count`` times or more.

    Words are maximal runs of ``[A-Za-z]`` and U+00C0 to U+00FF in whole texts, A-Z lower-cased. Where 97
    divides the CRC-32 ``h`` of ``id:run``, the run's code point ``h % length`` goes. A null id is written
    as nothing. Null and empty texts hold no words; rows that repeat count each time.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.string()).fill_null("").to_pylist()
            for low, part in W.runs(batch.column(1), _SLICE_BYTES):
                found = pc.value_counts(_damaged(ids[low : low + len(part)], part))
                words, n = found.field(0), found.field(1)
                long = pc.greater_equal(pc.utf8_length(words), min_length)
                yield pa.RecordBatch.from_arrays([words.filter(long), n.filter(long)], ["word", "n"])

    counted = docs.select(key, text).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _damaged(ids: list[str], texts: pa.Array) -> pa.Array:
    """Every run of letters in a column of texts, after the damage."""
    data, offsets = W.text_bytes(texts)
    if not len(data):
        return pa.array([], pa.string())
    data = _LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3  # U+00C0 to U+00FF are 0xC3 and one byte more
    letter = ((data >= 97) & (data <= 122)) | (data == 0xC3) | after
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | starts[1:-1]
    end = letter.copy()
    end[:-1] &= ~letter[1:] | starts[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, begin, side="right") - 1
    h = _crc(ids, data, begin, end, row)
    keep = letter
    for at in np.flatnonzero(h % ONE_IN == 0):
        low, high = begin[at], end[at]
        points = low + np.flatnonzero(~after[low:high])
        i = int(h[at]) % len(points)
        keep[points[i] : points[i + 1] if i + 1 < len(points) else high] = False
    total = np.append(0, np.cumsum(keep))
    places = np.append(total[begin], total[end[-1]] if len(end) else 0).astype(np.int64)
    buffers = [None, pa.py_buffer(places), pa.py_buffer(data[keep])]
    return pa.Array.from_buffers(pa.large_string(), len(begin), buffers).cast(pa.string())


def _crc(ids: list[str], data: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """CRC-32 of ``id:run`` for each run, byte by byte over all runs at once; long runs on their own."""
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    state = ~heads[row]
    length = end - begin
    for step in range(min(int(length.max(initial=0)), _CRC_AT_ONCE)):
        at = np.flatnonzero(length > step) if step else slice(None)
        state[at] = _CRC[(state[at] ^ data[begin[at] + step]) & 0xFF] ^ (state[at] >> 8)
    state = ~state
    for at in np.flatnonzero(length > _CRC_AT_ONCE):
        state[at] = zlib.crc32(data[begin[at] : end[at]].tobytes(), int(heads[row[at]]))
    return state.astype(np.int64)


def group(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a table of distinct words and their counts ``n``.

    ``form`` is the near word of largest ``n``, the first in code-point order among equals, if that is at
    least twice the word's own; ``root`` is where the forms from the word on end, the word itself where
    there is none. ``n_near`` counts near words. ``words`` are made of the letters of
    :func:`count_words` and of five code points at least; no words, no rows.
    """
    ship(words.sparkSession)
    words = stage(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, frequent)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    close = -F.col("best.n") >= 2 * F.col("n")
    rows = stage(
        joined.select(
            "word",
            F.when(close, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(close, -F.col("best.n")).alias("form_n"),
        )
    )
    found = rows.join(_roots(rows), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(rows: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form, by jumps of doubled length.

    Counts double with each form, so a chain has at most 62 and six rounds reach every end.
    """
    links = stage(rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    for _ in range(6):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stage(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        links = jumped.select("word", "root")
        if not jumped.where("on").limit(1).count():
            break
    return links


def near_words(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``(word, near, near_n)``: every ordered pair of near words of a staged table of words, once."""
    spark = words.sparkSession
    sizes = words.agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("letters")).first()
    if not sizes.words:
        return spark.createDataFrame([], _PAIR)
    grams = spark.sparkContext.broadcast(_frequent_grams(words, frequent, sizes.letters))
    # each word goes to about six lists, three times
    buckets = max(1, math.ceil(18 * sizes.words / BUCKET_ROWS))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in W.runs(batch.column(0), _SLICE_BYTES // 8):
                yield _post(part, batch.column(1).slice(low, len(part)), grams.value, buckets)

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table)

    lists = words.select("word", "n").mapInArrow(post, _LIST)
    return lists.groupBy("bucket").applyInArrow(merge, _PAIR).dropDuplicates(["word", "near"])


def _frequent_grams(words: DataFrame, frequent: int, letters: int) -> np.ndarray:
    """Sorted codes and counts of the grams that occur more than ``frequent`` times.

    Every letter begins at most one gram of a length, so their number is at most lengths * letters /
    threshold, and the threshold rises with the letters so that it stays below ``DICTIONARY``.
    """
    lengths = range(SHORTEST, LONGEST)
    least = max(frequent, len(lengths) * letters // DICTIONARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in W.runs(batch.column(0), _SLICE_BYTES):
                letters = _Letters(part)
                codes, n = np.unique(np.concatenate([letters.codes(size) for size in lengths]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["gram", "n"])

    counted = words.select("word").mapInArrow(count, "gram long, n long")
    kept = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
    order = np.argsort(kept["gram"].to_numpy())
    return np.stack([kept["gram"].to_numpy()[order], kept["n"].to_numpy()[order]])


class _Letters:
    """The letters of a column of words as small numbers, one after the other."""

    def __init__(self, words: pa.Array):
        data, offsets = W.text_bytes(words)
        kept = data != 0xC3
        total = np.append(0, np.cumsum(kept))
        self.code = _CODE[data[kept]]
        self.first = total[offsets[:-1]]
        self.length = total[offsets[1:]] - self.first
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(self.code)) - self.first[self.word]
        self.left = self.length[self.word] - self.place

    def codes(self, size: int) -> np.ndarray:
        """One number for each gram of ``size`` letters."""
        out = self._rolled(size)
        return out[self.left[: len(out)] >= size]

    def _rolled(self, size: int) -> np.ndarray:
        count = max(0, len(self.code) - size + 1)
        out = np.zeros(count, np.int64)
        for i in range(size):
            out = out * _BASE + self.code[i : i + count]
        return out

    def grams(self, most: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
        """At each place with two letters or more: place, code, letters and count of its gram.

        ``most`` has the letters of a gram at most, for each word; the count is 0 if not frequent.
        """
        at = np.flatnonzero(self.left >= SHORTEST)
        room = np.minimum(self.left[at], most[self.word[at]])
        size = np.full(len(at), SHORTEST)
        code = self.code[at].astype(np.int64) * _BASE + self.code[at + 1]
        count = _counts(code, frequent)
        for longer in range(SHORTEST + 1, LONGEST + 1):
            grow = np.flatnonzero((count > 0) & (size == longer - 1) & (room >= longer))
            if not len(grow):
                break
            code[grow] = code[grow] * _BASE + self.code[at[grow] + longer - 1]
            size[grow] = longer
            count[grow] = _counts(code[grow], frequent)
        return at, code, size, count

    def affected(self, at: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The most grams that one edit can change, for each word."""
        over = np.zeros(len(self.code) + 1, np.int64)
        np.add.at(over, at, 1)
        np.subtract.at(over, at + size, 1)
        most = np.maximum.reduceat(np.cumsum(over[:-1]), self.first)
        # a letter put behind the word prolongs frequent grams that its end has cut
        ends = (self.left[at] == size) & (count > 0)
        return np.maximum(most, np.bincount(self.word[at], weights=ends, minlength=len(self.first)).astype(np.int64))


def _counts(codes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    known, counts = frequent
    if not len(known):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, counts[at], 0)


def spare(length: np.ndarray) -> np.ndarray:
    """Letters of a gram at most in lists for words of a length and one less, so that one edit leaves a gram."""
    return np.clip(length - 3, 3, LONGEST)


def _post(words: pa.Array, n: pa.Array, frequent: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The lists of each word: as one of its own length, and as one letter shorter than others."""
    letters = _Letters(words)
    rows, lists, own = [], [], []
    for longer in (0, 1):
        length = letters.length + longer
        at, code, size, count = letters.grams(spare(length), frequent)
        word, place = letters.word[at], letters.place[at]
        order = np.lexsort((place, code, count, word))
        bound = letters.affected(at, size, count)
        first = np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))
        rank = np.arange(len(at)) - first[word[order]]
        chosen = order[rank <= bound[word[order]]]
        # the word with a letter more has the gram at the same place, or one further
        for shift in range(longer + 1):
            key = W.mix(code[chosen].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            key = W.mix(key ^ ((length[word[chosen]] << 32) + place[chosen] + shift).astype(np.uint64))
            rows.append(word[chosen])
            lists.append(key)
            own.append(np.full(len(chosen), not longer))
    at, key = np.concatenate(rows), np.concatenate(lists)
    columns = [
        pa.array((key >> np.uint64(33)).astype(np.int64) % buckets, pa.int32()),
        pa.array(key.view(np.int64)),
        pa.array(np.concatenate(own)),
        words.take(pa.array(at)),
        n.take(pa.array(at)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "list", "own", "word", "n"])


def _merge(table: pa.Table) -> pa.Table:
    """Near pairs in the lists of a bucket, both ways."""
    table = table.combine_chunks()
    names = table["word"].combine_chunks().dictionary_encode()
    name, known = names.indices.to_numpy(), names.dictionary
    letters = _Letters(known)
    counts = np.zeros(len(known), np.int64)
    counts[name] = table["n"].to_numpy()
    lists, own = table["list"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
    # lists one after the other; in each, words of its own length before shorter ones
    order = np.lexsort((name, ~own, lists))
    lists, own, name = lists[order], own[order], name[order]
    start = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
    end = np.append(start[1:], len(lists))
    which = np.repeat(np.arange(len(start)), end - start)
    # each word of a list's own length meets all that stand after it
    here = np.flatnonzero(own)
    after = end[which[here]] - here - 1
    here, after = here[after > 0], after[after > 0]
    width = letters.length[name[here]]
    left, right = [], []
    for part, skip, many in _portions(after, width):
        a = np.repeat(name[here[part]], many)
        offset = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(skip, many)
        b = name[np.repeat(here[part], many) + 1 + offset]
        hit = _one_edit(letters, a, b)
        pairs = np.unique((a[hit].astype(np.int64) << 32) + b[hit])
        left.append(pairs >> 32)
        right.append(pairs & 0xFFFFFFFF)
    pairs = np.unique((np.concatenate(left) << 32) + np.concatenate(right)) if left else np.zeros(0, np.int64)
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    word, near = np.concatenate([a, b]), np.concatenate([b, a])
    return pa.table({"word": known.take(pa.array(word)), "near": known.take(pa.array(near)), "near_n": pa.array(counts[near])})


def _portions(after: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words in portions of a bounded number of letters to compare: which, and from and how many after each.

    Words of one length share a portion; a word with very many after it is cut into several.
    """
    order = np.argsort(width, kind="stable")
    low = 0
    while low < len(order):
        size = int(width[order[low]])
        same = int(np.searchsorted(width[order], size, side="right"))
        most = max(1, _PAIRS // size)
        total = np.cumsum(after[order[low:same]])
        high = low + max(1, int(np.searchsorted(total, most, side="right")))
        part = order[low:high]
        if len(part) == 1:
            for skip in range(0, int(after[part[0]]), most):
                yield part, np.array([skip]), np.minimum(after[part] - skip, most)
        else:
            yield part, np.zeros(len(part), np.int64), after[part]
        low = high


def _one_edit(letters: _Letters, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where word ``b``, of the length of ``a`` or one letter less, is one edit from ``a``; all ``a`` are of one length."""
    size = int(letters.length[a[0]])
    whole = letters.code[letters.first[a][:, None] + np.arange(size)]
    equal = letters.length[b] == size
    out = np.zeros(len(a), bool)
    places = np.flatnonzero(equal)
    other = letters.code[letters.first[b[places]][:, None] + np.arange(size)]
    out[places] = (whole[places] != other).sum(axis=1) == 1
    places = np.flatnonzero(letters.length[b] == size - 1)
    other = letters.code[letters.first[b[places]][:, None] + np.arange(size - 1)]
    before = np.logical_and.accumulate(whole[places, :-1] == other, axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((whole[places, 1:] == other)[:, ::-1], axis=1).sum(axis=1)
    out[places] = before + behind >= size - 1
    return out
