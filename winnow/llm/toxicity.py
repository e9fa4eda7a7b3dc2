"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import classifier as L
from winnow.llm import ngrams as N

MODULUS, REMAINDER = 5, 0
THRESHOLD = 0.5


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = L.SAMPLE) -> L.Model:
    """Learn ``labels.toxic`` from the rows outside the held-out fold; see :func:`classifier.train`."""
    held = L.held_out(key, MODULUS, REMAINDER)
    return L.train(docs, labels, "toxic", held, N.character_ngrams, logistic, key, text, sample)


def score(docs: DataFrame, model: L.Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` per row; repeated rows keep a row each.

    A model that learnt nothing to tell the classes apart, as from no labels or those of one class, scores every row alike.
    """
    found = L.scored(docs, model, N.character_ngrams, text, [key])
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return found.select(key, L.held_out(key, MODULUS, REMAINDER).alias("held_out"), "score", predicted.alias("predicted"))


def keep_clean(docs: DataFrame, model: L.Model, text: str = "text") -> DataFrame:
    """The rows that score below the threshold, columns as they are (an input column ``__toxicity`` goes).

    All rows, where the model learnt nothing to tell the classes apart.
    """
    found = L.scored(docs, model, N.character_ngrams, text, docs.columns, "__toxicity")
    return found.where(~(F.lit(model.learnt) & (F.col("__toxicity") >= THRESHOLD))).drop("__toxicity")


def logistic(texts: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators: regularised logistic loss, five passes of adaptive gradient steps."""
    weights, squares = np.zeros(len(ratio), np.float32), np.full(len(ratio), 1e-6, np.float32)
    bias, bias_squares, rate, shrink = 0.0, 1e-6, 0.1, 1e-4
    sign, order = 2 * y - 1, np.random.default_rng(7)
    for _ in range(5):
        for i in order.permutation(len(texts)):
            at = texts[i]
            values = ratio[at]
            margin = sign[i] * (float(weights[at] @ values) + bias)
            slope = -sign[i] / (1 + np.exp(min(margin, 30.0)))
            gradient = slope * values + shrink * weights[at]
            squares[at] += gradient * gradient
            weights[at] -= rate * gradient / np.sqrt(squares[at])
            bias_squares += slope * slope
            bias -= rate * slope / np.sqrt(bias_squares)
    return weights, float(bias)
