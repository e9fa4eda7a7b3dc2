"""Linear text classifiers whose n-gram indicators are scaled by class log-count ratios.

Counts of every n-gram in both classes come from all labelled rows outside the held-out fold, summed
before and after a shuffle. The linear fit then takes a bounded, documented sample of those rows,
the ``sample`` of each class whose hashed ids are smallest, in one task. Scores need one pass and no
shuffle: a model is at most ``2**18`` weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import ngrams as N
from winnow.llm.shipping import ship
from winnow.session import stage

SAMPLE = 4096
MIN_COUNT = 5
SIGNIFICANCE = 3.0
BROADCAST_LABELS = 2_000_000

Fit = Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float]]


@dataclass(frozen=True)
class Model:
    """Weights per n-gram column with the ratios multiplied in, and the line from margin to log odds.

    ``learnt`` is whether any n-gram tells the classes apart; without one every text has the same score.
    """

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    @property
    def learnt(self) -> bool:
        return bool(self.weights.any())

    def score(self, columns: np.ndarray) -> float:
        margin = float(self.weights[columns].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.intercept, -700, 700))))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text has the fold's remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    held: Column,
    features: Callable[[], N.Features],
    fit: Fit,
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
) -> Model:
    """Fit a classifier for ``label`` (0 or 1) on the labelled rows of ``docs`` outside the fold ``held``.

    Null and other labels teach nothing, nor do ids labelled both ways. Where a class has no row, the
    model knows no n-gram and scores every text with the smoothed share of class 1.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held)
    known = known.groupBy(key).agg(F.min(label).alias("__y"), F.max(label).alias("__max")).where("__y = __max")
    known = known.select(F.col(key), F.col("__y").cast("int").alias("__y"))
    small = known.count() <= BROADCAST_LABELS
    counts = stage(_counts(_with_labels(docs.select(key, text), known, key, small).select("__y", text), features))
    totals = counts.where("column < 0").first()
    negative, positive = (totals.zeros, totals.ones) if totals else (0, 0)
    if not negative or not positive:
        share = (positive + 1) / (positive + negative + 2)
        return Model(np.zeros(N.COLUMNS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = _ratios(counts, negative, positive)
    picked = [
        known.where(F.col("__y") == y).orderBy(F.xxhash64(key), key).limit(sample).select(key, "__y") for y in (0, 1)
    ]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    # of the rows that repeat an id the first by text
    rows = docs.select(key, text).join(chosen, key).groupBy(key).agg(F.min("__y").alias("__y"), F.min(text).alias(text)).select("__y", text)
    return _fitted(rows, features, ratio, fit, (negative, positive), sample)


def scored(
    docs: DataFrame, model: Model, features: Callable[[], N.Features], text: str, columns: list[str], name: str = "score"
) -> DataFrame:
    """``columns`` of every row and its score, from the whole text; null and empty texts are scored too."""
    kept = [c for c in columns if c != name]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.DoubleType())])
    at = kept.index(text) if text in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for batch in batches:
            scores = [model.score(of(t.as_py())) for t in batch.column(at)]
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(scores, pa.float64())], [*kept, name])

    return docs.select(*kept, *([] if text in kept else [text])).mapInArrow(run, schema)


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log odds of class 1 on the margin: logistic regression by Newton steps."""
    slope, intercept = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + intercept, -500, 500)))
        error, h = (p - y) * weight, p * (1 - p) * weight + 1e-9
        gradient = np.array([(error * margins).sum() + 1e-2 * slope, error.sum()])
        cross = (h * margins).sum()
        hessian = np.array([[(h * margins * margins).sum() + 1.0, cross], [cross, h.sum() + 1e-2]])
        step = np.linalg.solve(hessian, gradient)
        slope, intercept = slope - step[0], intercept - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(slope), float(intercept)


def _with_labels(docs: DataFrame, known: DataFrame, key: str, small: bool) -> DataFrame:
    """Labels are sent to the texts up to a checked number of rows, and shuffled with them beyond it."""
    return docs.join(F.broadcast(known) if small else known, key)


def _counts(rows: DataFrame, features: Callable[[], N.Features]) -> DataFrame:
    """``(column, zeros, ones)``: texts of either class with each n-gram; column -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, totals = features(), np.zeros(2, np.int64)
        seen = np.zeros((2, N.COLUMNS), np.int64)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals[y] += 1
                seen[y, of(t.as_py())] += 1
        found = np.flatnonzero(seen.any(axis=0))
        columns = [np.append(found, -1).astype(np.int32), *(np.append(seen[y, found], totals[y]) for y in (0, 1))]
        yield pa.record_batch([pa.array(c) for c in columns], ["column", "zeros", "ones"])

    part = rows.mapInArrow(run, "column int, zeros long, ones long")
    return part.groupBy("column").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def _ratios(counts: DataFrame, negative: int, positive: int) -> np.ndarray:
    """Log-count ratio per column: zero where it is rare or within its own sampling error."""
    one, zero = F.col("ones") + 1.0, F.col("zeros") + 1.0
    ratio = F.log(one / (positive + 2.0)) - F.log(zero / (negative + 2.0))
    clear = F.abs(F.col("ratio")) > SIGNIFICANCE * F.sqrt(1 / one + 1 / zero)
    kept = counts.where((F.col("column") >= 0) & (F.col("ones") + F.col("zeros") >= MIN_COUNT))
    found = kept.withColumn("ratio", ratio).where(clear).select("column", "ratio").toArrow()
    out = np.zeros(N.COLUMNS, np.float32)
    out[found["column"].to_numpy()] = found["ratio"].to_numpy()
    return out


def _fitted(rows: DataFrame, features: Callable, ratio: np.ndarray, fit: Fit, totals: tuple[int, int], sample: int) -> Model:
    kept = ratio != 0

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column(1)]
            packed = [np.sort(c[kept[c]]).astype(np.int32).tobytes() for c in found]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], ["y", "columns"])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("columns", "ascending")])
        y = table["y"].to_numpy().astype(np.float64)
        texts = [np.frombuffer(c.as_py(), np.int32) for c in table["columns"]]
        share = np.array([totals[0] / max(1, (y == 0).sum()), totals[1] / max(1, (y == 1).sum())])
        weights, bias = fit(texts, y, ratio, share[y.astype(int)])
        scaled = (weights * ratio).astype(np.float32)
        margins = np.array([scaled[c].sum(dtype=np.float64) for c in texts]) + bias
        slope, intercept = calibrate(margins, y, share[y.astype(int)])
        return pa.table(
            {"weights": pa.array([scaled.tobytes()]), "bias": [float(bias)], "slope": [slope], "intercept": [intercept]}
        )

    part = rows.mapInArrow(columns, "y int, columns binary").groupBy(F.lit(0).alias("all"))
    model = part.applyInArrow(solve, "weights binary, bias double, slope double, intercept double").first()
    return Model(np.frombuffer(bytes(model.weights), np.float32), model.bias, model.slope, model.intercept)
