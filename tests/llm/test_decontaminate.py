"""Decontamination against an exact alignment of every item with every text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import words

from winnow.llm import decontaminate as D
from winnow.llm import words as W


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(item, edits, draw):
    out = list(item)
    for _ in range(edits):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [f"new{draw.random()}"]
    return out


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def test_finds_what_is_within_the_distance(spark, docs_of):
    draw = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    items = [[draw.choice(common) if draw.random() < 0.4 else f"i{n}-{i}" for i in range(draw.randint(12, 45))] for n in range(25)]
    rows, planted = [], 0
    for i in range(200):
        text = draw.choices(common, k=draw.randint(0, 80))
        if i % 2 == 0:
            item = draw.choice(items)
            text[len(text) // 2 : len(text) // 2] = edited(item, draw.randint(0, len(item) // 4), draw)
            planted += 1
        rows.append((i, " ".join(text)))
    rows += [(300, None), (301, ""), (302, " ".join(items[0]).upper() + "."), (303, "\n".join(f"{w}," for w in items[1])), (304, "c1 " * 50_000)]
    table = items_of(spark, [(n, " ".join(i), 0) for n, i in enumerate(items)] + [(50, None, 0), (51, "too short", 0), (None, "a b c d e f", 0)])
    got = {(r.doc_id, r.item_id): r.edits for r in D.matches(docs_of(rows, extra=True), table).collect()}
    bare = lambda text: [w.lower().rstrip(",.") for w in words(text)]
    want = {}
    for i, text in rows[:-1]:
        for n, item in enumerate(items):
            edits = fewest_edits([w.lower() for w in item], bare(text))
            if edits <= len(item) // 5:
                want[i, n] = edits
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.97 * len(want) > 50
    assert {k for k, edits in want.items() if edits == 0} <= set(got)
    kept = {r.doc_id for r in D.drop_contaminated(docs_of(rows, extra=True), table).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}


def test_copies_that_lost_words_at_the_end_of_a_document(spark, docs_of):
    draw = random.Random(12)
    items = [[f"i{n}-{i}" for i in range(length)] for n, length in enumerate([59] * 120 + [5] * 10)]
    rows = []
    for n, item in enumerate(items):
        for at, lost in enumerate((1, len(item) // 5)):
            kept = [item[i] for i in sorted(draw.sample(range(len(item)), len(item) - lost))]
            rows += [(8 * n + 2 * at, " ".join(kept)), (8 * n + 2 * at + 1, " ".join([f"x{i}" for i in range(90)] + kept))]
    table = items_of(spark, [(n, " ".join(i), 0) for n, i in enumerate(items)])
    got = {(r.doc_id, r.item_id) for r in D.matches(docs_of(rows), table).collect()}
    assert got <= {(i, i // 8) for i, _ in rows}
    for kind in range(4):
        asked = {i for i, _ in rows if i % 4 == kind}
        assert len({i for i, _ in got} & asked) >= 0.97 * len(asked)
    alone = items_of(spark, [(1, "a b c d e", 0)])
    assert [tuple(r) for r in D.matches(docs_of([(1, "a b d e")]), alone).collect()] == [(1, 1, 0, 1)]


@pytest.mark.parametrize(("length", "count"), [(15, 100), (59, 100), (150, 100), (400, 15)])
def test_recall_of_shortened_copies(length, count):
    """Copies that lost as many words as they may: alone, behind other words at the end, and inside."""
    draw = random.Random(length)
    items = [[f"i{n}-{i}" for i in range(length)] for n in range(count)]
    index = D._Index(list(range(count)), [W.split(pa.array([" ".join(i)]), lower=True, bare=True).hash for i in items], D.MAX_EDITS)
    index.complete({n: D._repetitions(index, n, D.RECALL) for n in index.edits})
    around = [f"x{i}" for i in range(length)]
    for before, after in (([], []), (around, []), (around, around)):
        texts = []
        for item in items:
            kept = sorted(draw.sample(range(length), length - length // 5))
            texts.append(" ".join([*before, *[item[i] for i in kept], *after]))
        found = {(row, owner) for row, owner, _, _ in index.search(pa.array(texts))}
        assert found <= {(n, n) for n in range(count)} and len(found) >= (count if not before else 0.97 * count)


def test_items_of_few_words_are_found_whole(spark, docs_of):
    table = items_of(spark, [(1, "alpha", 0), (2, "beta gamma", 0), (3, "a b c d", 0), (4, "...", 0), (5, "", 0), (6, "beta gamma", 0)])
    docs = docs_of([(1, "x Alpha, y alpha"), (2, "beta delta gamma"), (3, "Beta gamma."), (4, "a b c x d"), (5, "z a b c d e"), (6, "alphabet"), (7, "beta"), (8, "gamma")])
    got = sorted(tuple(r) for r in D.matches(docs, table).collect())
    assert got == [(1, 1, 1, 0), (3, 2, 0, 0), (3, 6, 0, 0), (5, 3, 1, 0)]


def test_blocks_of_items_give_the_same(spark, docs_of, monkeypatch):
    items = [f"{a} " + " ".join(f"{a}{i}" for i in range(10)) for a in ("p", "q", "r", "s", "t")]
    docs = docs_of([(1, "x " + items[0] + " y " + items[3]), (2, items[1]), (2, items[1]), (3, "nothing of that kind at all")])
    table = items_of(spark, [(n, t, 0) for n, t in enumerate(items)])
    whole = sorted(map(tuple, D.matches(docs, table).collect()))
    assert whole == [(1, 0, 1, 0), (1, 3, 13, 0), (2, 1, 0, 0), (2, 1, 0, 0)]
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    assert sorted(map(tuple, D.matches(docs, table).collect())) == whole
    assert [r.doc_id for r in D.drop_contaminated(docs, table).collect()] == [3]


def test_empty_tables(spark, docs_of):
    table = items_of(spark, [(1, "a b c d e f g", 0)])
    assert D.matches(docs_of([]), table).count() == 0
    assert D.matches(docs_of([(1, "a b c d e f g")]), table.limit(0)).columns == ["doc_id", "item_id", "start", "edits"]
    assert D.drop_contaminated(docs_of([(1, "a b c d e f g")]), table.limit(0)).count() == 1


def test_align():
    item, text = np.arange(5, dtype=np.uint64), np.array([9, 0, 1, 7, 3, 4, 0, 1, 2, 3, 4], np.uint64)
    assert D.align(item, text) == (0, 6)
    assert D.align(item, text[:6]) == (1, 1)
    assert D.align(item, text[:0]) == (5, 0)
