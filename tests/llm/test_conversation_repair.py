"""Conversation repair against a search over whole audits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from winnow.llm import conversation_repair as R
from winnow.llm.glr import Costs, Repairer, Symbol, Tables

SCHEMA = "conv_id long, turn long, role string, text string, part string, seg int, again boolean, uid int"
# what may follow: start, after s, after u, after a
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LAST = (0, 3)


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]+$", "", text)
        kind = "B" if not re.search("[^\x20\x09-\x0d]", text) else "D" if (role, text) in seen else "-" if bare[-1] in ".!?" else "T"
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows):
    """Least (cost, audit) and the turns it leaves, by a search in that order over whole audits."""
    faults = faults_of(rows)
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, at, state, turns = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state == LAST[1] or at == len(rows) and state == 0:
            return cost, audit, list(turns)
        for c, name in (("u", "user"), ("a", "assistant")):
            if (state, c) in NEXT:
                heapq.heappush(queue, (cost + 2, audit + "I", at, NEXT[state, c], (*turns, (name, ""))))
        if at < len(rows):
            (role, text), more = rows[at], faults[at] == "T"
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, turns))
            if faults[at] in "T-":
                if (state, role[:1]) in NEXT:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, NEXT[state, role[:1]], (*turns, (role, text))))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in NEXT:
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, NEXT[state, c], (*turns, (name, text))))


def expected(table):
    """Digest rows by conversation, from (conv, turn, role, text) rows."""
    said = {}
    for conv, turn, role, text in table:
        said.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in said.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        faults = faults_of([r[1:] for r in rows])
        cost, audit, left = cheapest([r[1:] for r in rows])
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in left)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("B"), faults.count("D"), faults.count("T"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), left)
    return out


def draw_rows(draw, conversations, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "useless"]
    texts = ["Yes.", "No!", "so?", "and then", "", " \n", None, "é…", "x. ", "日本."]
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(roles[:5] if draw.random() < 0.9 else roles)
            text = draw.choice(texts) if draw.random() < 0.4 else f"text {draw.randrange(10**6)}" + draw.choice(["", ".", "?"])
            rows.append((conv, None if draw.random() < 0.03 else turn + draw.choice([0, 0, 0, 1]), role, text))
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True, 2) for r in rows], SCHEMA)


def check(spark, rows, convs=None):
    table = table_of(spark, rows)
    repaired = R.repair(table)
    want = expected(rows)
    got = {r[0]: tuple(r)[1:] for r in R.digests(repaired, convs or table).collect()}
    assert {k: v for k, v in got.items() if k in want} == {k: v[:-1] for k, v in want.items()}
    turns = {}
    for r in repaired.turns.orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for conv, (*_, audit, _, left) in want.items():
        mine = turns.pop(conv, [])
        assert [(r.role, r.text) for r in mine] == left and [r.place for r in mine] == list(range(len(left)))
        assert "".join(r.action for r in mine) == audit.replace("D", "")
    assert not turns
    return got


def test_like_a_search_over_audits(spark):
    draw = random.Random(4)
    rows = draw_rows(draw, 400, 9)
    rows += [(None, t, r, f"n{t}.") for t, r in enumerate(["user", "user", "assistant"])]
    rows += [(1000, None, "assistant", "a."), (1000, None, "user", "b."), (1001, 5, "user", "late."), (1001, 2, "assistant", "early.")]
    rows += [(1002, 3, "user", "same.")] * 6 + [(1003, 2**62, "system", "s."), (1003, -5, "user", "u")]
    check(spark, rows)


def test_conversations_over_many_segments_and_partitions(spark, monkeypatch):
    draw = random.Random(6)
    rows = draw_rows(draw, 30, 6) + [(c + 100, t, r, x) for c, t, r, x in draw_rows(draw, 3, 400)]
    rows += [(300, t, draw.choice(["user", "assistant"]), f"{draw.randrange(30)}.") for t in range(500)]
    monkeypatch.setattr(R, "SEGMENT_TURNS", 7)
    check(spark, rows)
    monkeypatch.setattr(R, "SEGMENT_CHARS", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_first_of_rows_that_are_alike_stays(spark):
    """Also where the join that tells copies apart deals the rows anew."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(200) for t in range(4) for _ in range(1 + (c + t) % 3)]
    rows += [(None, None, "user", "null.")] * 5
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        check(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cheapest_by_trying_all_edits():
    """The search that the other tests trust, against every sequence of edits of short conversations."""
    inserts = ["".join(p) for n in range(4) for p in itertools.product("ua", repeat=n)]
    for rows in itertools.product([("user", "q."), ("assistant", "a"), ("system", "s."), ("tool", " ")], repeat=2):
        faults, best = faults_of(rows), None
        for gaps in itertools.product(inserts, repeat=3):
            for acts in itertools.product("Kua-", repeat=2):
                audit, said, cost = "", "", 0
                for gap, row, kind, act in itertools.zip_longest(gaps, rows, faults, acts):
                    audit, said, cost = audit + "I" * len(gap), said + gap, cost + 2 * len(gap)
                    if row is None:
                        continue
                    if act == "-":
                        audit, cost = audit + "D", cost + 3
                    elif kind in "BD":
                        said += "!"
                    else:
                        audit += "K" if act == "K" else "R"
                        said += row[0][:1] if act == "K" else act
                        cost += (act != "K") * 2 + (kind == "T")
                if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert cheapest(list(rows))[:2] == best


def test_damage(spark):
    texts = ["One. Two!", None, "three?", "four"]
    rows = [(c, t, ["user", None, "assistant"][t % 3], texts[(c + t) % 4]) for c in range(60) for t in range(4)] + [(None, 1, "user", "x."), (3, None, "user", "y.")]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(r) for r in R.damage(table_of(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_conversations_without_turns(spark):
    convs = spark.createDataFrame([(1,), (2,), (None,)], "conv_id long")
    got = check(spark, [(2, 0, "user", " ")], convs)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {1: nothing, None: nothing, 2: (0, 1, 0, 0, 0, 3, "D", nothing[-1])}
    assert R.repair(table_of(spark, [])).turns.count() == 0
    assert R.digests(R.repair(table_of(spark, [])), convs.where("false")).count() == 0


def test_ids_that_are_no_numbers(spark):
    table = table_of(spark, [(1, 0, "user", "q."), (1, 1, "assistant", "a.")]).withColumn("conv_id", F.lit("c"))
    assert [r.audit for r in R.digests(R.repair(table), table).collect()] == ["KK"]


def test_a_long_conversation_of_long_texts(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "x" * 200_000 + ".") for t in range(40)]
    got = check(spark, rows)
    assert got[1][5:7] == (0, "K" * 40)


def test_stack_tops_of_the_role_grammar():
    repairer = Repairer(Tables(R.GRAMMAR), "ua")
    tops = repairer.tops("sua")
    accepted = {"": True, "ua": True, "suaua": True, "s": False, "u": False, "su": False}
    for said, wanted in accepted.items():
        here = [0]
        for c in said:
            here = [t for top in here for t in repairer.shift(top, c)]
        assert any(map(repairer.accepts, here)) == wanted and set(here) <= set(tops)
    assert repairer.shift(0, "a") == () and len(tops) == len(repairer.tops("sua"))


def test_a_grammar_with_two_ways_and_one_that_nests():
    # a reduction before "b" that two rules want: both stacks go on
    tables = Tables([("S", ("A", "b")), ("S", ("B", "b", "b")), ("A", ("a",)), ("B", ("a",))])
    repairer = Repairer(tables, "b", Costs())
    costs, steps = repairer.run([Symbol("a", True, 0), Symbol("b", True, 0), Symbol("b", True, 0)])
    best = min((cost + repairer.finish(top)[0], top) for top, cost in costs.items() if repairer.finish(top))
    assert best[0] == 0 and "".join(a for a, _ in repairer.trace(steps, best[1])) == "KKK"
    with pytest.raises(ValueError):
        Repairer(Tables([("S", ("x", "S", "y")), ("S", ())]), "xy").tops("xy")
