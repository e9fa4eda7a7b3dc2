"""Temperature mixing: weights, limits, budgets, order."""

import math
from collections import defaultdict

import pytest

from winnow.llm import mixing


def mixed(docs, **options):
    return mixing.mix(docs, **options).collect()


def corpus(docs_of, sizes, extra=False):
    rows, n = [], 0
    for source, count in enumerate(sizes):
        for _ in range(count):
            rows.append((n * 2 + source % 2, " ".join(["w"] * (3 + n % 5))))
            n += 1
    return docs_of(rows, extra)


def test_weights_meet_the_target_entropy(docs_of):
    docs = corpus(docs_of, [900, 100])
    rows = mixed(docs, evenness=0.5)
    weights = {r.source: r.weight for r in rows}
    tokens = defaultdict(int)
    for r in docs.collect():
        tokens[r.source] += len(r.text.split())
    shares = [t / sum(tokens.values()) for t in tokens.values()]
    entropy = lambda p: -sum(x * math.log(x) for x in p)
    assert sum(weights.values()) == pytest.approx(1, abs=1e-8)
    assert entropy(weights.values()) == pytest.approx((entropy(shares) + math.log(2)) / 2, abs=1e-6)
    got = defaultdict(int)
    for r in rows:
        got[r.source] += r.n_tokens
    for source, weight in weights.items():
        assert 0 <= got[source] - weight * sum(tokens.values()) < 8


def test_passes_are_whole_and_in_order(docs_of):
    docs = corpus(docs_of, [300, 20], extra=True)
    rows = mixed(docs, evenness=1.0, max_repeats=100.0)
    epochs = defaultdict(list)
    for r in rows:
        epochs[r.source, r.epoch].append(r.doc_id)
    small = [ids for (s, e), ids in sorted(epochs.items()) if s == "s1"]
    assert len(small) > 5 and all(sorted(ids) == sorted(small[0]) for ids in small[:-1]) and len(small[-1]) <= 20
    assert all(len(ids) == len(set(ids)) for ids in epochs.values())
    assert all(0 <= r.position < 1 for r in rows)
    assert [r.epoch for r in sorted((r for r in rows if r.source == "s1"), key=lambda r: r.position)] == sorted(r.epoch for r in rows if r.source == "s1")
    assert mixing.mix(docs).columns == [*docs.columns, "n_tokens", "weight", "epoch", "position"]


def test_every_stretch_has_the_weights(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rows = sorted(mixed(corpus(docs_of, [700, 300])), key=lambda r: r.position)
    weights = {r.source: r.weight for r in rows}
    for part in (0.25, 0.5, 0.75):
        stretch = [r for r in rows if r.position < part]
        total = sum(r.n_tokens for r in stretch)
        for source, weight in weights.items():
            assert sum(r.n_tokens for r in stretch if r.source == source) / total == pytest.approx(weight, abs=0.02)


def test_repetition_limit_and_budget(docs_of):
    docs = corpus(docs_of, [300, 20])
    per_source = defaultdict(int)
    for r in docs.collect():
        per_source[r.source] += len(r.text.split())
    total = sum(per_source.values())
    for options, limit in (({"max_repeats": 2.0}, 2.0), ({"max_repeats": 1.0}, 1.0), ({"budget": 3 * total, "max_repeats": 2.0}, 2.0)):
        rows = mixed(docs, evenness=1.0, **options)
        got = defaultdict(int)
        for r in rows:
            got[r.source] += r.n_tokens
        assert all(got[s] <= limit * per_source[s] + 8 for s in got)
    assert sum(r.n_tokens for r in mixed(docs, budget=100)) in range(100, 117)


def test_odd_rows(docs_of, spark):
    assert mixed(docs_of([])) == []
    assert mixed(docs_of([(1, None), (2, "")])) == []
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "c", None), (3, "", "none here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixed(docs, evenness=0.0)
    assert sum(r.n_tokens for r in found) == 5 and {r.source for r in found} == {"x", None}
    assert sorted(r.doc_id for r in found if r.n_tokens == 2) == [1, 1]


def test_plan_has_no_python(docs_of):
    plan = mixing.mix(corpus(docs_of, [30, 20]))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
