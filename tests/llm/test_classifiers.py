"""Toxicity and quality: held-out accuracy, folds, odd rows."""

import random
import zlib

import numpy as np
import pytest

from winnow.llm import classifier, ngrams, quality, toxicity

SYLLABLES = ["ba", "ne", "ti", "ro", "su", "ke", "mo", "la"]


def text(draw, n=60):
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(n))


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        found = text(draw, draw.randint(10, 120)).split()
        toxic, good = int(i % 9 == 0), int(i % 4 != 1)
        if toxic:
            for _ in range(draw.randint(1, 4)):
                found.insert(draw.randrange(len(found)), draw.choice(["grumpface", "Dolthead", "snarlmuck"]))
        if not good:
            kind = i % 3
            found = [w.upper() + "!!" for w in found] if kind == 0 else [w for w in found for _ in range(5)] if kind == 1 else [w + "***" for w in found]
        rows.append((i, " ".join(found)))
        if i % 10 != 3:
            labels.append((i, good, toxic))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ODD_LABELS = [(1, None, None), (2, 5, 7), (None, 1, 1), (12, 0, 0), (12, 1, 1), (99_999, 1, 1)]


def test_held_out_accuracy(spark, docs_of, corpus):
    rows, labels = corpus
    odd = [(2000, None), (2001, ""), (None, "ba ne"), (5, rows[5][1]), (2002, "Grumpface " * 20_000)]
    docs = docs_of([*rows, *odd], extra=True)
    known = labels_of(spark, [x for x in labels if x[0] not in (1, 2, 12)] + ODD_LABELS)
    truth = {i: (g, t) for i, g, t in labels}
    for module, at, modulus, remainder, limit in ((toxicity, 1, 5, 0, 0.5), (quality, 0, 4, 2, 0.7)):
        got = module.score(docs, module.train(docs, known)).collect()
        assert len(got) == len(rows) + len(odd)
        assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id) % modulus == remainder) for r in got)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in got)
        tested = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(tested) > 100
        assert sum(r.predicted == truth[r.doc_id][at] for r in tested) >= 0.97 * len(tested)
    kept = toxicity.keep_clean(docs, toxicity.train(docs, known))
    assert kept.columns == docs.columns and 700 < kept.count() < len(rows)


def test_held_out_labels_and_other_columns_teach_nothing(spark, docs_of, corpus):
    rows, labels = corpus
    docs = docs_of(rows)
    one = toxicity.train(docs, labels_of(spark, labels))
    flipped = [(i, g, 1 - t if crc(i) % 5 == 0 else t) for i, g, t in labels]
    two = toxicity.train(docs.withColumn("lang", docs.source), labels_of(spark, flipped))
    assert np.array_equal(one.weights, two.weights) and (one.bias, one.slope) == (two.bias, two.slope)


def test_shuffled_labels_give_the_same_counts(spark, docs_of, corpus, monkeypatch):
    rows, labels = corpus
    docs, known = docs_of(rows), labels_of(spark, labels)
    one = toxicity.train(docs, known)
    monkeypatch.setattr(classifier, "BROADCAST_LABELS", 10)
    assert np.array_equal(one.weights, toxicity.train(docs, known).weights)


def test_nothing_to_learn_from(spark, docs_of):
    docs = docs_of([(1, "ba"), (2, None)])
    got = toxicity.score(docs, toxicity.train(docs, labels_of(spark, []))).collect()
    assert {r.score for r in got} == {0.5}
    only = labels_of(spark, [(i, 1, 0) for i in (1, 2) if crc(i) % 5])
    assert all(r.predicted == int(r.score >= 0.5) for r in toxicity.score(docs, toxicity.train(docs, only)).collect())
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.train(none, labels_of(spark, []))).count() == 0


def test_indicators_of_long_texts_come_once(monkeypatch):
    features = ngrams.character_ngrams((4,))
    short = features("abc abc abc")
    assert len(short) == len(set(short.tolist())) == 4
    monkeypatch.setattr(ngrams, "_PIECE", 3)
    assert sorted(ngrams.character_ngrams((4,))("abc abc abc").tolist()) == sorted(short.tolist())
    assert len(features(None)) == len(features("")) == 0


def test_hinge_fit_separates():
    draw = np.random.default_rng(0)
    y = draw.integers(0, 2, 200).astype(float)
    texts = [np.array([int(t), 2 + int(draw.integers(5))]) for t in y]
    ratio = np.array([2.0, -2.0, 0.1, -0.1, 0.1, 0.0, 0.0], np.float32)
    weights, bias = quality.dual_coordinate_descent(texts, y, ratio, np.ones(200))
    margins = np.array([(weights * ratio)[t].sum() + bias for t in texts])
    assert ((margins > 0) == (y == 1)).all()
