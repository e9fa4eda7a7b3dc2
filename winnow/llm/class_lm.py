"""Language-model scores from a Brown class bigram model.

Exchange clustering puts words into classes so that class bigrams are as likely as possible. The
*core*, the most frequent words, is clustered by the sequential exchange algorithm on the bigram
counts of core words, a table of fixed size that Spark sums over all training texts. Every other word
of the vocabulary is then exchanged once, in parallel, against the core: its counts next to each core
class, gathered over all training texts, decide the class in which they are most likely.

``P(word | before) = P(class | class before) * P(word | class)``, both smoothed. A class keeps a share
for words not seen in training, by its number of words seen once; an unseen word is any of these, and
the class most likely to have made it stands before the next word. Texts begin and end at a boundary
that is a class of its own. All counts cover all training texts; scores cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import chunks as C
from winnow.llm import words as W
from winnow.llm.classifier import held_out
from winnow.llm.shipping import ship
from winnow.session import stage

MODULUS, REMAINDER = 7, 2
CORE = 1024
CLASSES = 64
PASSES = 12
CHUNK_BYTES = 6_000_000
SLICE_BYTES = 6_000_000
STRENGTH = 20.0
_NONE = 255


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", core: int = CORE, classes: int = CLASSES
) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row, scores in log10.

    Words are lower-cased (A-Z). Texts whose id has CRC-32 remainder 2 modulo 7 are held out of
    training; a null id is not. Null and empty texts have one token, their end. Rows that repeat an
    id are texts of their own. Without training texts all words are unseen and score as one event.
    Words are told apart by a 64-bit hash. At most 254 classes.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    n_chunks, n_buckets = C.sizes(docs, "text", CHUNK_BYTES)
    held = held_out("id", MODULUS, REMAINDER)
    training = docs.where(~held)
    training_texts = training.count()
    core_words = _core(training, core, n_buckets)
    core_classes, around = _cluster(_core_bigrams(training, core_words), len(core_words), classes)
    vocabulary = stage(_vocabulary(training, core_words, core_classes, around, n_buckets))
    emission = _Emission(vocabulary, classes, training_texts)
    read = stage(_class_texts(docs.select(held.alias("held"), "id", "text"), vocabulary, emission, n_chunks, n_buckets))
    transitions = _transitions(read.where(~F.col("held")), classes)
    return _scores(read, transitions, emission).withColumnRenamed("id", key)


# -- classes ---------------------------------------------------------------------------------------


def _core(training: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Hashes of the most frequent words, ascending: all words are counted by hash range, each sends its top ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in W.runs(batch.column(0), SLICE_BYTES):
                hashes, n = np.unique(W.split(part, lower=True).hash, return_counts=True)
                filled, cuts = C.slices(hashes, buckets)
                packed = [[v[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for v in (hashes, n.astype(np.uint32))]
                yield pa.record_batch([pa.array(filled, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "words", "n"])

    def merge(table: pa.Table) -> pa.Table:
        words, n = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("words", np.uint64), ("n", np.uint32)))
        words, number = np.unique(words, return_inverse=True)
        counts = np.bincount(number, weights=n, minlength=len(words)).astype(np.int64)
        names = words.view(np.int64)
        top = np.lexsort((names, -counts))[:size]
        return pa.table({"word": names[top], "n": counts[top]})

    parts = training.select("text").mapInArrow(count, "bucket int, words binary, n binary")
    counted = parts.groupBy("bucket").applyInArrow(merge, "word long, n long")
    top = counted.orderBy(F.desc("n"), "word").limit(size).toArrow()
    return np.sort(top["word"].to_numpy().view(np.uint64))


def _core_bigrams(training: DataFrame, core: np.ndarray) -> np.ndarray:
    """Counts of adjacent core words; the last row and column are the boundary."""
    size = len(core) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, part in W.runs(batch.column(0), SLICE_BYTES):
                names, _ = _with_boundaries(W.split(part, lower=True), len(part), core, np.arange(size), size - 1)
                pair = names[:-1] * size + names[1:]
                total += np.bincount(pair[(names[:-1] >= 0) & (names[1:] >= 0)], minlength=size * size)
        found = np.flatnonzero(total)
        yield _batch(pair=found, n=total[found])

    summed = training.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    out = out.reshape(size, size)
    out[-1, -1] = 0
    return out


def _with_boundaries(words: W.Words, rows: int, core: np.ndarray, names: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words with a boundary before each text and after the last, -1 for others; where words stand."""
    at = np.searchsorted(core, words.hash)
    known = core[np.minimum(at, len(core) - 1)] == words.hash if len(core) else np.zeros(len(at), bool)
    place = np.arange(len(words.hash)) + words.row + 1
    out = np.full(len(words.hash) + rows + 1, boundary, np.int64)
    out[place] = np.where(known, names[np.minimum(at, len(names) - 1)], -1) if len(core) else -1
    return out, place


def _cluster(bigrams: np.ndarray, words: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Exchange clustering of the core: the class of each word, and the counts between classes and boundary.

    Words start in classes by turns, most frequent first, and move one after another to the class that
    raises the likelihood of the class bigrams most, until a pass moves none.
    """
    order = np.argsort(-bigrams[:words].sum(axis=1), kind="stable")
    of = np.empty(words + 1, np.int64)
    of[order] = np.arange(words) % classes
    of[words] = classes
    member = np.eye(classes + 1)[of]
    between = member.T @ bigrams @ member
    for _ in range(PASSES):
        moved = 0
        for w in order:
            alone = bigrams[w, w]
            after, before = bigrams[w] @ member, bigrams[:, w] @ member
            old = of[w]
            after[old] -= alone
            before[old] -= alone
            _shift(between, old, after, before, alone, -1)
            new = int(np.argmax(_gains(between, after, before, alone)[:classes]))
            _shift(between, new, after, before, alone, 1)
            if new != old:
                member[w, old], member[w, new], of[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    return of[:words], between


def _shift(between: np.ndarray, to: int, after: np.ndarray, before: np.ndarray, alone: float, sign: int) -> None:
    between[to] += sign * after
    between[:, to] += sign * before
    between[to, to] += sign * alone


def _gains(between: np.ndarray, after: np.ndarray, before: np.ndarray, alone: float) -> np.ndarray:
    """Change of the log likelihood when a word with these neighbour counts joins each class."""
    rows, columns = _xlogx(between + after) - _xlogx(between), _xlogx(between + before[:, None]) - _xlogx(between)
    diagonal = np.diagonal(between)
    both = _xlogx(diagonal + after + before + alone) - _xlogx(diagonal)
    left, right = between.sum(axis=1), between.sum(axis=0)
    n_left, n_right = after.sum() + alone, before.sum() + alone
    own = _xlogx(left + n_left) - _xlogx(left) + _xlogx(right + n_right) - _xlogx(right)
    return rows.sum(axis=1) - np.diagonal(rows) + columns.sum(axis=0) - np.diagonal(columns) + both - own


def _xlogx(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x * np.log(np.where(x > 0, x, 1))


# -- vocabulary ------------------------------------------------------------------------------------


def _vocabulary(
    training: DataFrame, core: np.ndarray, core_classes: np.ndarray, around: np.ndarray, buckets: int
) -> DataFrame:
    """``(bucket, words, counts, classes)``: every training word by hash range, with its count and class."""
    boundary = len(around) - 1
    slots = 2 * (boundary + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in W.runs(batch.column(0), SLICE_BYTES):
                words = W.split(part, lower=True)
                named, place = _with_boundaries(words, len(part), core, core_classes, boundary)
                hashes, number, n = np.unique(words.hash, return_inverse=True, return_counts=True)
                seen = []
                for side, beside in enumerate((named[place - 1], named[place + 1])):
                    use = (named[place] < 0) & (beside >= 0)
                    seen.append(number[use] * slots + side * (boundary + 1) + beside[use])
                pair, times = np.unique(np.concatenate(seen), return_counts=True)
                filled, cuts = C.slices(hashes, buckets)
                ends = np.searchsorted(pair, np.arange(len(hashes) + 1) * slots)
                rows = []
                for b, low, high in zip(filled, cuts[:-1], cuts[1:], strict=True):
                    near = slice(ends[low], ends[high])
                    values = (hashes[low:high], n[low:high].astype(np.uint32), np.diff(ends[low : high + 1]).astype(np.uint16))
                    values += ((pair[near] % slots).astype(np.uint16), times[near].astype(np.uint32))
                    rows.append((b, *(v.tobytes() for v in values)))
                yield pa.record_batch(
                    [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6))],
                    ["bucket", "words", "n", "degree", "slot", "times"],
                )

    def merge(table: pa.Table) -> pa.Table:
        def column(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        words, number = np.unique(column("words", np.uint64), return_inverse=True)
        counts = np.bincount(number, weights=column("n", np.uint32), minlength=len(words)).astype(np.int64)
        owner = np.repeat(number, column("degree", np.uint16))
        order = np.argsort(owner, kind="stable")
        owner, slot, times = owner[order], column("slot", np.uint16)[order], column("times", np.uint32)[order]
        classes = np.empty(len(words), np.uint8)
        gains = _slot_gains(around)
        for low in range(0, len(words), 1 << 15):
            high = min(low + (1 << 15), len(words))
            part = slice(*np.searchsorted(owner, (low, high)))
            beside = np.bincount((owner[part] - low) * slots + slot[part], weights=times[part], minlength=(high - low) * slots)
            classes[low:high] = np.argmax(beside.reshape(-1, slots) @ gains, axis=1)
        at = np.searchsorted(words, core)
        here = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == core)
        classes[at[here]] = core_classes[here]
        return pa.table(
            {"bucket": table["bucket"].slice(0, 1), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("words", words), ("counts", counts), ("classes", classes))}}
        )

    packed = "bucket int, words binary, n binary, degree binary, slot binary, times binary"
    parts = training.select("text").mapInArrow(count, packed)
    return parts.groupBy("bucket").applyInArrow(merge, "bucket int, words binary, counts binary, classes binary")


def _slot_gains(around: np.ndarray) -> np.ndarray:
    """For each neighbour class, before then after, its log likelihood beside each class; a word without any goes to the largest."""
    smooth = around + 0.5
    after = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    before = np.log(smooth / smooth.sum(axis=0, keepdims=True))
    classes = len(around) - 1
    favour = 1e-9 * np.argsort(np.argsort(around.sum(axis=1)[:classes]))
    return np.vstack([before[:, :classes], after[:classes].T]) + favour


class _Emission:
    """Totals of the vocabulary and of its classes."""

    def __init__(self, vocabulary: DataFrame, classes: int, training_texts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((3, classes), np.int64)
            for batch in batches:
                for counts, of in zip(batch.column(0), batch.column(1), strict=True):
                    n, of = np.frombuffer(counts.as_py(), np.int64), np.frombuffer(of.as_py(), np.uint8)
                    for i, weights in enumerate((n, n > 0, n == 1)):
                        totals[i] += np.bincount(of, weights=weights, minlength=classes).astype(np.int64)
            yield _batch(**{"class": np.arange(classes), "n": totals[0], "words": totals[1], "once": totals[2]})

        part = vocabulary.select("counts", "classes").mapInArrow(run, "class long, n long, words long, once long")
        rows = part.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("n", "words", "once")]).toArrow().sort_by("class")
        n, words, once = (rows[c].to_numpy() if rows.num_rows else np.zeros(classes, np.int64) for c in ("n", "words", "once"))
        self.texts = training_texts
        self.tokens = int(n.sum()) + training_texts
        self.distinct = int(words.sum()) + (training_texts > 0)
        self.unseen = (once + 0.5) / (n + once + 1.0)
        self.unseen[n == 0] = 1.0
        with np.errstate(divide="ignore"):
            self.seen = np.where(n > 0, np.log10((1 - self.unseen) / np.maximum(n, 1)), -np.inf)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


# -- texts -----------------------------------------------------------------------------------------


def _class_texts(docs: DataFrame, vocabulary: DataFrame, emission: _Emission, chunks: int, buckets: int) -> DataFrame:
    """Per text: token counts, base score, log10 of P(word | class) of its known words, and its classes (255: unseen)."""
    dealt = C.chunked(docs, "id", chunks)

    def ask(table: pa.Table) -> pa.Table:
        hashes = np.unique(W.split(table["text"], lower=True).hash)
        filled, cuts = C.slices(hashes, buckets)
        return pa.table(
            {
                "bucket": pa.array(filled, pa.int32()),
                "chunk": pa.array([table[C.CHUNK][0].as_py()] * len(filled), pa.int64()),
                "words": pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        words, counts, classes = (
            np.frombuffer(known[name][0].as_py() if known.num_rows else b"", kind)
            for name, kind in (("words", np.uint64), ("counts", np.int64), ("classes", np.uint8))
        )
        packed = []
        for value in asked["words"].to_pylist():
            wanted = np.frombuffer(value, np.uint64)
            at = np.minimum(np.searchsorted(words, wanted), max(len(words) - 1, 0))
            found = words[at] == wanted if len(words) else np.zeros(len(wanted), bool)
            n = np.where(found, counts[at], 0) if len(words) else np.zeros(len(wanted), np.int64)
            of = np.where(found, classes[at], _NONE) if len(words) else np.full(len(wanted), _NONE)
            packed.append(n.astype(np.int64).tobytes() + of.astype(np.uint8).tobytes())
        return pa.table({"bucket": asked["bucket"], "chunk": asked["chunk"], "answer": pa.array(packed, pa.binary())})

    def read(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = table.num_rows
        words = W.split(table["text"], lower=True)
        hashes, number = np.unique(words.hash, return_inverse=True)
        values = C.in_order(answers.to_pylist(), "answer")
        n = np.concatenate([np.frombuffer(v, np.int64, len(v) // 9) for v in values] or [np.zeros(0, np.int64)])
        of = np.concatenate([np.frombuffer(v, np.uint8, offset=len(v) // 9 * 8) for v in values] or [np.zeros(0, np.uint8)])
        if len(n) != len(hashes):
            raise RuntimeError(f"answers for {len(n)} of {len(hashes)} words")
        known = n > 0
        inside = np.where(known, np.log10(np.maximum(n, 1)) + emission.seen[np.where(known, of, 0)], 0.0)
        total = words.counts(rows)
        sums = [np.bincount(words.row, weights=v[number], minlength=rows) for v in (known, emission.base(n), inside)]
        cuts = np.append(0, np.cumsum(total))
        packed = of[number].tobytes()
        return pa.table(
            {
                "held": table["held"],
                "id": table["id"],
                "n_tokens": pa.array(total + 1),
                "n_known": pa.array(sums[0].astype(np.int64) + (emission.texts > 0)),
                "base_score": pa.array(sums[1] + emission.base(np.array(emission.texts))),
                "inside": pa.array(sums[2]),
                "classes": pa.array([packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
            }
        )

    asked = dealt.groupBy(C.CHUNK).applyInArrow(ask, "bucket int, chunk long, words binary")
    answers = asked.groupBy("bucket").cogroup(vocabulary.groupBy("bucket"))
    answers = answers.applyInArrow(answer, "bucket int, chunk long, answer binary")
    out = docs.select("held", "id", *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known")])
    out = out.select("*", *[F.lit(0.0).alias(c) for c in ("base_score", "inside")], F.lit(b"").alias("classes"))
    return dealt.groupBy(C.CHUNK).cogroup(answers.groupBy("chunk")).applyInArrow(read, out.schema)


def _transitions(training: DataFrame, classes: int) -> np.ndarray:
    """P(class | class before) with the boundary last, from the class texts of all training rows."""
    size = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for value in batch.column(0):
                line = np.full(len(value.as_py()) + 2, classes, np.int64)
                line[1:-1] = np.frombuffer(value.as_py(), np.uint8)
                total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        found = np.flatnonzero(total)
        yield _batch(pair=found, n=total[found])

    summed = training.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size * size)
    counts[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    counts = counts.reshape(size, size)
    share = (counts.sum(axis=0) + 1) / (counts.sum() + size)
    return (counts + STRENGTH * share) / (counts.sum(axis=1, keepdims=True) + STRENGTH)


def _scores(read: DataFrame, transitions: np.ndarray, emission: _Emission) -> DataFrame:
    boundary = len(transitions) - 1
    steps = np.log10(transitions)
    unseen = transitions[:, :boundary] * emission.unseen
    unseen_step, unseen_class = np.log10(unseen.sum(axis=1)), np.argmax(unseen, axis=1)

    def of(value: bytes) -> float:
        line = np.full(len(value) + 2, boundary, np.int64)
        line[1:-1] = np.frombuffer(value, np.uint8)
        new = line == _NONE
        new[[0, -1]] = False
        for i in np.flatnonzero(new):
            line[i] = unseen_class[line[i - 1]]
        return float(np.where(new[1:], unseen_step[line[:-1]], steps[line[:-1], line[1:]]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-1], pa.array([of(v.as_py()) for v in batch.column(batch.num_columns - 1)], pa.float64())], [*batch.schema.names[:-1], "steps"])

    schema = read.drop("classes").withColumn("steps", F.lit(0.0)).schema
    return read.mapInArrow(run, schema).select(
        "id",
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(emission.tokens).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("steps") + F.col("inside")).alias("score"),
    )


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(c).astype(np.int64)) for c in columns.values()], list(columns))
