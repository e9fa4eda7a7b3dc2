"""Substring dedup against a search over all windows."""

import hashlib
import random

import numpy as np
import pytest
from conftest_llm import words

from winnow.llm import chunks as C
from winnow.llm import substring_dedup
from winnow.llm import words as W


def brute(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        found = words(text)
        gone = [False] * len(found)
        for s in range(len(found) - length + 1):
            window = tuple(found[s : s + length])
            if window in seen:
                gone[s : s + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(found, gone, strict=True) if not g)
        out.setdefault(doc_id, []).append((len(found), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def found(docs, length=20):
    out = {}
    for r in substring_dedup.deduplicate(docs, length=length).collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    return out


@pytest.mark.parametrize("length", [13, 20, 31])
def test_like_all_windows(docs_of, length):
    draw = random.Random(length)
    pool = [[draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(draw.randint(1, 4)):
            line = draw.choice(pool)
            low = draw.randint(0, 40)
            parts += line[low : low + draw.randint(5, 60)] + [f"w{draw.randint(0, 50)}"]
        rows.append((draw.randint(0, 10**12), draw.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(7, None), (8, ""), (9, " \n "), (10, "short text"), (None, rows[0][1])]
    want, got = brute(rows, length), found(docs_of(rows, extra=True), length)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(r[1] for v in got.values() for r in v) > 100


def test_repeats_inside_a_long_text_and_other_white_space(docs_of):
    once = " ".join(f"é{i}" for i in range(25))
    rows = [(1, once + " x " + once), (2, once.replace(" ", "\x0b")), (3, "y " * 30_000)]
    assert found(docs_of(rows)) == brute(rows, 20)


def test_texts_that_lose_nothing_stay_and_columns_too(docs_of):
    docs = docs_of([(1, "a  b\nc"), (2, None)], extra=True)
    out = substring_dedup.deduplicate(docs)
    assert out.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept_sha256"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a  b\nc", 2: None}


def test_empty_table_and_short_length(docs_of):
    assert substring_dedup.deduplicate(docs_of([])).count() == 0
    with pytest.raises(ValueError, match="at least 13"):
        substring_dedup.deduplicate(docs_of([]), length=12)


def test_hashes_do_not_depend_on_what_stands_around():
    import pyarrow as pa

    texts = ["alpha beta", "", None, "x" * 600_000 + " beta", " beta\talpha "]
    found = W.split(pa.array(texts))
    assert found.row.tolist() == [0, 0, 3, 3, 4, 4]
    assert found.hash[1] == found.hash[3] == found.hash[4] != found.hash[0] == found.hash[5]
    lowered = W.split(pa.array(["Ab ab AB. Äb äb"]), lower=True, bare=True).hash
    assert lowered[0] == lowered[1] == lowered[2] and lowered[3] != lowered[4]


@pytest.mark.parametrize("buckets", [1, 7, 100, 100_000, 2**31 - 1])
def test_what_a_chunk_sends_goes_by_its_keys_however_many_buckets(buckets):
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, np.uint64))
    keys = np.concatenate([[np.uint64(0)], keys, [np.uint64(2**64 - 1)]])
    filled, cuts = C.slices(keys, buckets)
    assert len(filled) == len(cuts) - 1 <= min(buckets, len(keys))
    assert (filled[0], filled[-1]) == (0, buckets - 1) and (np.diff(filled) > 0).all()
    for bucket, low, high in zip(filled.tolist(), cuts[:-1], cuts[1:], strict=True):
        assert {((int(k) >> 32) * buckets) >> 32 for k in keys[low:high]} == {bucket}
    assert C.slices(keys[:0], buckets)[0].tolist() == [] and C.slices(keys[:0], buckets)[1].tolist() == [0]
