"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from winnow.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    found = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def edited(word, draw, letters):
    at = draw.randrange(len(word))
    kind = draw.randrange(3)
    return word[:at] + ("" if kind == 0 else draw.choice(letters)) + word[at + (kind != 2) :]


def made(draw, letters, size):
    words = ["".join(draw.choices(letters, k=draw.randint(4, 12))) for _ in range(size)]
    for _ in range(2 * size):
        words.append(edited(draw.choice(words), draw, letters) or "x")
    return words


def test_counts_and_groups_like_brute_force(spark, docs_of):
    draw = random.Random(3)
    letters = "abceé÷ÿ"
    words = made(draw, letters, 60)
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "Straße STRASSE straße, straße-straßeĀstraße 99 x"), (7, "a" * 100_000), (8, "ÀÉÎ àéî ××××× " * 3)]
    rows += [(i, " ".join(f"{a}{b}common" for a in "abcdef" for b in "abcdef")) for i in range(600, 640)]
    want = counted(rows)
    docs = docs_of(rows, extra=True)
    assert {r.word: r.n for r in S.count_words(docs).collect()} == want
    for frequent in (2, 20, 1024):
        assert {tuple(r) for r in S.variants(docs, frequent=frequent).collect()} == grouped(want)


def test_damage_takes_the_code_point_of_the_hash(spark, docs_of):
    rows = [(i, "Éclairs") for i in range(97 * 12)]
    got = {r.word: r.n for r in S.count_words(docs_of(rows)).collect()}
    assert got == counted(rows) and "éclairs" not in got
    assert len(counted([(i, "éclairs") for i in range(97 * 60)])) > 1


def test_chains_ties_and_words_alone(spark):
    table = spark.createDataFrame([("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("caaaa", 6), ("zzzzzzz", 9), ("bbbbbbbb", 5), ("bbbbbbb", 9)], "word string, n int")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in S.group(table).collect()}
    assert got["aaaaa"] == ("aaaab", "aabbb", 2, 6)
    assert got["aabbb"] == (None, "aabbb", 1, None)
    assert got["caaaa"] == (None, "caaaa", 1, None)
    assert got["zzzzzzz"] == (None, "zzzzzzz", 0, None)
    assert got["bbbbbbbb"] == (None, "bbbbbbbb", 1, None)


def test_a_chain_as_long_as_counts_allow(spark):
    rows = [("a" * i + "b" * (70 - i), 3 * 2**i) for i in range(45)]
    got = {r.word: r.root for r in S.group(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got.values()) == {rows[-1][0]}


def test_one_edit_leaves_a_shared_gram_in_the_lists(monkeypatch):
    """Every near pair meets in a list, whatever the dictionary."""
    draw = random.Random(9)
    for letters, frequent in (("ab", 1), ("abc", 4), ("abcdefgh", 2)):
        words = sorted({w for w in made(draw, letters, 120) if len(w) >= 5})
        column = pa.array(words)
        codes, n = np.unique(np.concatenate([S._Letters(column).codes(k) for k in range(S.SHORTEST, S.LONGEST)]), return_counts=True)
        known = np.stack([codes[n > frequent], n[n > frequent]])
        table = pa.Table.from_batches([S._post(column, pa.array(range(len(words)), pa.int64()), known, 1)])
        pairs = S._merge(table)
        got = set(zip(pairs["word"].to_pylist(), pairs["near"].to_pylist()))
        want = {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
        assert got == want and len(want) > 50
        monkeypatch.setattr(S, "_PAIRS", 30)
        assert set(zip(*[c.to_pylist() for c in S._merge(table).select(["word", "near"]).columns])) == want
        monkeypatch.undo()


def test_no_documents_and_no_words(spark, docs_of):
    for rows in ([], [(1, None)], [(1, "a b c 1 2 3")]):
        result = S.variants(docs_of(rows))
        assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"] and result.count() == 0
