"""Class language model: counts against brute force, proper probabilities, better than the base on held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest_llm import words

from winnow.llm import class_lm
from winnow.llm import words as W


def tokens(text):
    return words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def corpus():
    draw = random.Random(6)
    tongues = [[f"{a}{i}" for i in range(60)] for a in "xy"]
    rows = []
    for i in range(240):
        tongue = tongues[i % 2]
        text = " ".join(draw.choices(tongue, [1 / (j + 1) for j in range(60)], k=draw.randint(5, 80)))
        rows.append((i, text.replace("x1 ", "X1 ") + f" only{i}"))
    return rows + [(500, None), (501, ""), (None, "x1 y1 never"), (502, "Äa äa"), (502, "x1"), (503, "x2 " * 20_000)]


def test_counts_and_gain(docs_of):
    rows = corpus()
    got = class_lm.score(docs_of(rows, extra=True), core=40, classes=8).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        found = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in found)
        want.append((-1 if i is None else i, held(i), len(found), sum(counts[t] > 0 for t in found), total, round(base, 6)))
    seen = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(seen) == sorted(want)
    tested = [r for r in got if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested) + 0.1 * sum(r.n_tokens for r in tested)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_probabilities_of_one_token_texts_sum_to_one(docs_of):
    """All known words, any unseen word and the end, each after the boundary."""
    rows = [(i, t) for i, t in corpus() if t and len(t) < 1000]
    vocabulary = sorted({t for i, text in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text)[:-1]})
    ids = [i for i in range(10_000, 100_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    probes = list(zip(ids, [*vocabulary, "unseen-word"], strict=False))
    empty = ids[len(probes)]
    got = {r.doc_id: 10**r.score for r in class_lm.score(docs_of([*rows, *probes, (empty, "")]), core=40, classes=8).collect()}
    # a text of one word also holds its end, whose share differs by class; so the sum is bounded, not one
    assert sum(got[i] for i, _ in probes) + got[empty] <= 1.0 + 1e-9
    assert got[empty] > 0


def test_core_counts_rare_words_whole(docs_of):
    """More than 50,000 words about as rare, and one that each text holds once."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    docs = docs_of([(i, "Often " + " ".join(f"w{i}-{j}" for j in range(60_000))) for i in ids])
    for core in (40, 0):
        got = class_lm.score(docs, core=core, classes=8).collect()
        assert [r.n_tokens for r in got] == [60_002] * 3 and all(math.isfinite(r.score) for r in got)
    assert class_lm._core(docs, 1, 4).tolist() == W.split(pa.array(["often"])).hash.tolist()


def test_exchange_raises_the_likelihood():
    draw = np.random.default_rng(0)
    groups = draw.integers(0, 3, 30)
    bigrams = np.zeros((31, 31))
    for a in range(30):
        for b in range(30):
            bigrams[a, b] = draw.poisson(20 if (groups[a] + 1) % 3 == groups[b] else 0.2)
    of, between = class_lm._cluster(bigrams, 30, 3)
    assert len({(g, c) for g, c in zip(groups, of, strict=True)}) == 3
    member = np.eye(4)[np.append(of, 3)]
    assert np.allclose(between, member.T @ bigrams @ member)


def test_nothing_to_learn_from(docs_of):
    assert class_lm.score(docs_of([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = class_lm.score(docs_of([(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)
