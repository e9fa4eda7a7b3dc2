"""SimHash near-dedup against all pairs of fingerprints."""

import random
import re

import numpy as np
import xxhash
from conftest_llm import words

from winnow.llm import simhash
from winnow.llm.components import components


def fingerprint(text):
    found = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints, max_bits):
    """For each position the smallest position it reaches over links."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(docs_of):
    draw = random.Random(3)
    base = [[f"w{draw.randint(0, 500)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(120):
        text = list(draw.choice(base))
        for _ in range(draw.randint(0, 2)):
            del text[draw.randrange(len(text))]
        rows.append((1000 - i, " ".join(text).replace("w1", "W1")))
    rows += [(5, None), (6, ""), (7, "one two"), (8, "One  TWO"), (9, "ÄÖ one two three"), (10, "x " * 40_000)]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(rows, extra=True)).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    roots = reach([prints[i] for i in ids], 4)
    assert {i: r.component_id for i, r in got.items()} == {i: ids[r] for i, r in zip(ids, roots, strict=True)}
    assert len(set(roots)) < len(ids) - 30


def test_no_link_is_lost(spark):
    """Planted pairs at every distance, in dense and in sparse groups, in blocks and in one piece."""
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 1 << 63, size=80, dtype=np.uint64).tolist()
    for seed in prints[:40]:
        for bits in (1, 3, 4, 5, 6):
            prints.append(seed ^ sum(1 << int(b) for b in draw.choice(64, bits, replace=False)))
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    prints = sorted(set(prints))
    rows = [(simhash._signed(p),) for p in prints]
    for max_bits in (1, 3, 4):
        for block in (4096, 8):
            simhash.BLOCK, kept = block, simhash.BLOCK
            try:
                links = simhash.links(spark.createDataFrame(rows, "fp long"), max_bits).collect()
            finally:
                simhash.BLOCK = kept
            at = {simhash._signed(p): i for i, p in enumerate(prints)}
            assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= max_bits for u, v in links)
            root = list(range(len(prints)))

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for u, v in links:
                a, b = sorted((find(at[u]), find(at[v])))
                root[b] = a
            assert [find(i) for i in range(len(prints))] == reach(prints, max_bits)


def test_keys_of_nodes_are_sent_to_no_task(spark):
    """64 keys come of a node, which Spark does not count: a table of nodes far below the broadcast limit is one beyond it."""
    nodes = spark.createDataFrame([(i * 7919,) for i in range(50)], "fp long")
    for frame in (nodes, nodes.distinct()):
        found = simhash.links(frame)
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    odd = [(7000, 7000), (None, 3), (-5, 9000)]
    found = dict(components(spark.createDataFrame(path + star + odd, "u long, v long")).collect())
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {-5: -5, 9000: -5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_deduplicate_keeps_rows_and_columns(docs_of):
    same = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([(3, same), (2, same), (2, same), (9, "other words altogether here"), (None, "and some more words here")], extra=True)
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in out.collect())) == [0, 2, 2, 9]
    assert simhash.near_duplicates(docs_of([])).count() == 0
