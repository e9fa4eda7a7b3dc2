"""Quality: naive Bayes support vectors, a hinge-loss model of ratio-scaled n-gram indicators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import classifier as L
from winnow.llm import ngrams as N

MODULUS, REMAINDER = 4, 2
THRESHOLD = 0.7
COST = 0.01
PASSES = 20


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = L.SAMPLE) -> L.Model:
    """Learn ``labels.quality`` from the rows outside the held-out fold; see :func:`classifier.train`."""
    held = L.held_out(key, MODULUS, REMAINDER)
    return L.train(docs, labels, "quality", held, N.shape_ngrams, dual_coordinate_descent, key, text, sample)


def score(docs: DataFrame, model: L.Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` per row; repeated rows keep a row each."""
    found = L.scored(docs, model, N.shape_ngrams, text, [key])
    good = F.col("score") >= THRESHOLD
    return found.select(key, L.held_out(key, MODULUS, REMAINDER).alias("held_out"), "score", good.cast("int").alias("predicted"))


def dual_coordinate_descent(
    texts: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, share: np.ndarray
) -> tuple[np.ndarray, float]:
    """Minimise half the squared weights plus ``COST`` times the hinge losses, one text's multiplier at a time.

    The bias is the weight of a column that every text has.
    """
    weights, bias = np.zeros(len(ratio), np.float64), 0.0
    sign, multiplier = 2 * y - 1, np.zeros(len(texts))
    values = [ratio[at].astype(np.float64) for at in texts]
    norm = np.array([1 + v @ v for v in values])
    order = np.random.default_rng(8)
    for _ in range(PASSES):
        largest = 0.0
        for i in order.permutation(len(texts)):
            at, v = texts[i], values[i]
            slope = sign[i] * (float(weights[at] @ v) + bias) - 1
            new = min(max(multiplier[i] - slope / norm[i], 0.0), COST)
            step = (new - multiplier[i]) * sign[i]
            if step:
                weights[at] += step * v
                bias += step
                multiplier[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3 * COST:
            break
    return weights, float(bias)
