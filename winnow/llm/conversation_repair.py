"""Repair of conversations' structure: least-cost edits of turns until the roles form a dialogue.

Turns go by their role's initial and have to read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn. A turn may be kept, given another role or deleted, and empty user or assistant turns may be
inserted anywhere; blank turns and those that repeat an earlier one must go. Among the cheapest
repairs the one with the ASCII-least audit (K, R, D and I in order) is made, by generalised LR repair
(:mod:`winnow.llm.glr`).

Turns are sorted over the whole table by range, so a conversation may lie in several partitions. It is
cut into segments of bounded size. A segment that does not begin its conversation is run from every
stack top there can be; what it does to each is a small table. The tables of a conversation are put
together in order, and each segment is then repaired between the tops that this chose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from winnow.llm.glr import Repairer, Symbol, Tables
from winnow.llm.shipping import ship
from winnow.session import stage

GRAMMAR = (("S", ()), ("S", ("P",)), ("S", ("s", "P")), ("P", ("u", "a")), ("P", ("P", "u", "a")))
NAMES = {"u": "user", "a": "assistant"}
TERMINALS = "sua"
LEGAL = {"su", "ua", "au"}
TRUNCATED = 1  # what an unfinished turn costs if it stays
SEGMENT_TURNS = 4096
SEGMENT_CHARS = 4_000_000
_SPACE = " \t\n\x0b\x0c\r"

_WAYS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("begin", "end", "rank")] + [T.StructField("cost", T.LongType())]))
_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_WAY = "part int, seg int, begin int, end int, tail string, cost long"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_EDGES = ("low_turn", "high_turn")


class Repair(NamedTuple):
    """``turns``: the repaired conversations, a row for each turn; ``segments``: a row for each segment, for :func:`digests`."""

    turns: DataFrame
    segments: DataFrame


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faulty conversations for trials, by CRC-32 of ``conv:turn`` modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    kind = F.crc32(F.encode(F.concat(told[0], F.lit(":"), told[1]), "utf-8")) % 20
    rows = rows.select(conv, turn, told[2].alias(role), told[3].alias(text), kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        conv,
        turn,
        F.when(F.col("kind") == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)).alias(text),
        copies.alias("copy"),
    ).drop("copy")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of every conversation.

    Turns go by ``turn``, nulls first; those of one turn by role and text. Null roles and texts are one space;
    other columns are dropped. A row's first fault counts: blank (nothing but white space), duplicate (its role and
    text seen earlier in the conversation), truncated (no ``.!?`` at the end). A role without a
    letter of the grammar in front cannot be kept. Rows of a null ``conv`` are a conversation. Bytes that
    are not UTF-8 are read as U+FFFD. ``turns`` holds (conv, place, action, role, text) of every
    turn that is left, ``place`` counting from 0; no rows, no turns.
    """
    ship(rows.sparkSession)
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = stage(rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *told, F.monotonically_increasing_id().alias("uid")))
    sortable = ["conv", "turn", "role", F.left("text", F.lit(64))]
    # of rows that are alike the one that counts as seen first goes first, wherever the join has put it
    dealt = _flagged(rows).repartitionByRange(*sortable).sortWithinPartitions("conv", "turn", "role", "text", "again")
    kind = rows.schema["conv"].dataType
    cut = dealt.select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "text", "again")
    wide = _segment_schema(kind, rows.schema["turn"].dataType)
    segments = stage(cut.mapInArrow(lambda batches: _summaries(batches, to_arrow_schema(wide)), wide))
    narrow = segments.select("conv", "part", "seg", "ways")
    ways = _by_conversation(narrow).mapInArrow(_chosen, _WAY)
    chosen = segments.drop("ways").join(stage(ways), ["part", "seg"])
    names = ["conv", "part", "seg", *_COUNTS, *_EDGES, "first", "last", "cost", "audit", "repaired"]
    fields = {**{f.name: f for f in segments.schema}, "cost": T.StructField("cost", T.LongType()), "audit": T.StructField("audit", T.StringType())}
    schema = T.StructType([fields.get(n, T.StructField(n, _TURNS)) for n in names])
    done = stage(chosen.mapInArrow(lambda batches: _repaired(batches, to_arrow_schema(schema)), schema))
    return Repair(_places(done, conv, role, text), done)


def _flagged(rows: DataFrame) -> DataFrame:
    """The rows with ``again``: an earlier turn of the conversation has the same role and text."""
    first = rows.groupBy("conv", "role", "text").agg(F.min(F.struct("turn", "uid")).alias("first"))
    first = first.select(F.col("first.uid").alias("uid"), F.lit(False).alias("other"))
    return rows.join(first, "uid", "left").select("conv", "turn", "role", "text", F.coalesce("other", F.lit(True)).alias("again"))


def _by_conversation(segments: DataFrame) -> DataFrame:
    return segments.repartition("conv").sortWithinPartitions("conv", "part", "seg")


def _places(done: DataFrame, conv: str, role: str, text: str) -> DataFrame:
    """Turns of all segments, numbered within their conversation; the numbers of segments are summed, not of turns."""
    sizes = done.select("conv", "part", "seg", F.size("repaired").cast("long").alias("n"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = None, 0
        for batch in batches:
            out = []
            for name, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                total = total if known == (name,) else 0
                known = (name,)
                out.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.int64())], ["part", "seg", "start"])

    begun = _by_conversation(sizes).mapInArrow(starts, "part int, seg int, start long")
    acts = F.regexp_replace("audit", "D", "")
    turns = done.join(begun, ["part", "seg"]).select(F.col("conv").alias(conv), "start", acts.alias("acts"), F.posexplode("repaired").alias("i", "said"))
    action = F.col("acts").substr(F.col("i") + 1, F.lit(1))
    return turns.select(conv, (F.col("start") + F.col("i")).alias("place"), action.alias("action"), F.col("said.role").alias(role), F.col("said.text").alias(text))


def _segment_schema(conv: T.DataType, turn: T.DataType) -> T.StructType:
    fields = [("conv", conv), ("part", T.IntegerType()), ("seg", T.IntegerType())]
    fields += [(n, T.LongType()) for n in _COUNTS] + [(n, turn) for n in _EDGES]
    fields += [("first", T.StringType()), ("last", T.StringType()), ("faults", T.StringType()), ("said", _TURNS), ("ways", _WAYS)]
    return T.StructType([T.StructField(*f) for f in fields])


def _repairer() -> Repairer:
    return Repairer(Tables(GRAMMAR), "".join(NAMES))


def _texts(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in column.cast(pa.large_binary()).to_pylist()]


def _symbols(roles: list[str], faults: str) -> list[Symbol]:
    initials = [r[0] if r and r[0] in TERMINALS else None for r in roles]
    return [Symbol(c, f not in "BD", TRUNCATED * (f == "T")) for c, f in zip(initials, faults, strict=True)]


def fault(text: str, again: bool) -> str:
    """B (blank), D (duplicate), T (truncated) or - for a turn."""
    bare = text.rstrip(_SPACE)
    return "B" if not bare else "D" if again else "-" if bare[-1] in ".!?" else "T"


def _summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments of a sorted partition, with what they do to each stack top."""
    repairer = _repairer()
    every = repairer.tops(TERMINALS)
    known, seg, held, chars, opens = None, -1, [], 0, False

    def summary() -> dict:
        turns, roles, texts, again = (list(c) for c in zip(*held, strict=True))
        faults = "".join(map(fault, texts, again))
        symbols = _symbols(roles, faults)
        audits = []
        for begin in every if opens else [0]:
            costs, steps = repairer.run(symbols, begin)
            audits += [(begin, end, cost, "".join(a for a, _ in repairer.trace(steps, end))) for end, cost in costs.items()]
        rank = {a: i for i, a in enumerate(sorted({w[3] for w in audits}))}
        told = [t for t in turns if t is not None]
        pairs = [a[:1] + b[:1] for a, b in zip(roles, roles[1:], strict=False)]
        return {
            "conv": known[0], "part": known[1], "seg": seg,
            "blank": faults.count("B"), "duplicate": faults.count("D"), "truncated": faults.count("T"),
            "illegal": sum(p not in LEGAL for p in pairs), "turns": len(set(told)),
            "low_turn": told[0] if told else None, "high_turn": told[-1] if told else None,
            "first": roles[0][:1], "last": roles[-1][:1], "faults": faults,
            "said": [{"role": r, "text": t} for r, t in zip(roles, texts, strict=True)],
            "ways": [{"begin": b, "end": e, "rank": rank[a], "cost": c} for b, e, c, a in audits],
        }

    out, size = [], 0
    for batch in batches:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _texts(batch.column(3)), _texts(batch.column(4)), batch.column(5).to_pylist()]
        for part, conv, turn, role, text, again in zip(*columns, strict=True):
            new = known is None or known != (conv, part)
            if held and (new or len(held) >= SEGMENT_TURNS or chars >= SEGMENT_CHARS):
                out.append(summary())
                size += chars
                held, chars = [], 0
                if size >= SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if not held:
                # the first of a partition may go on from the partition before
                opens = known is None or not new
                known, seg = (conv, part), seg + 1
            held.append((turn, role, text, again))
            chars += len(text) + len(role)
    if held:
        out.append(summary())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment the stack tops between which it is repaired; the last has the insertions at the end, and the cost."""
    repairer = _repairer()
    repairer.tops(TERMINALS)  # numbers the tops as the segments' tables do
    rows = (r for batch in batches for r in batch.to_pylist())
    schema = pa.schema([*[(n, pa.int32()) for n in ("part", "seg", "begin", "end")], ("tail", pa.string()), ("cost", pa.int64())])
    out: list[dict] = []
    for _, run in groupby(rows, key=lambda row: row["conv"]):
        frontier, back = {0: (0, 0)}, []
        for row in run:
            best: dict[int, tuple] = {}
            for way in row["ways"]:
                if way["begin"] in frontier:
                    cost, rank = frontier[way["begin"]]
                    new = (cost + way["cost"], rank, way["rank"], way["begin"])
                    best[way["end"]] = min(best.get(way["end"], new), new)
            ranks = {a: i for i, a in enumerate(sorted({b[1:3] for b in best.values()}))}
            frontier = {end: (b[0], ranks[b[1:3]]) for end, b in best.items()}
            back.append((row["part"], row["seg"], {end: b[3] for end, b in best.items()}))
        ends = [(cost + done[0], rank, done[1], end, done[2]) for end, (cost, rank) in frontier.items() if (done := repairer.finish(end))]
        cost, _, _, end, tail = min(ends)
        path = []
        for part, seg, begins in reversed(back):
            path.append({"part": part, "seg": seg, "begin": begins[end], "end": end, "tail": None, "cost": None})
            end = begins[end]
        path[0].update(tail=tail, cost=cost)
        out += path
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each segment's audit and turns after the repair."""
    repairer = _repairer()
    repairer.tops(TERMINALS)
    for batch in batches:
        audits, turns = [], []
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("said", "faults", "begin", "end", "tail")]
        for rows, faults, begin, end, tail in zip(*columns, strict=True):
            _, steps = repairer.run(_symbols([r["role"] for r in rows], faults), begin)
            done = repairer.trace(steps, end)
            audits.append("".join(a for a, _ in done) + "I" * len(tail or ""))
            turns.append(apply(rows, done) + [_new(c) for c in tail or ""])
        kept = [batch.column(batch.schema.get_field_index(n)) for n in schema.names[:-2]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(audits, pa.string()), pa.array(turns, schema.field("repaired").type)], schema=schema)


def _new(terminal: str, text: str = "") -> dict[str, str]:
    return {"role": NAMES[terminal], "text": text}


def apply(rows: list[dict[str, str]], done: list[tuple[str, str]]) -> list[dict[str, str]]:
    """The turns that edits of rows lead to; an edit is an audit and the terminals it gives."""
    out = []
    for row, (audit, said) in zip(rows, done, strict=True):
        out += [_new(c) for c in said[: len(audit) - 1]]
        if audit[-1] == "K":
            out.append({"role": row["role"], "text": row["text"]})
        elif audit[-1] == "R":
            out.append(_new(said[-1], row["text"]))
    return out


def digests(repaired: Repair, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation of a table of ids: faults, cost, audit and a hash of the repaired turns.

    ``gaps`` are the turn numbers missing between the first and the last, ``illegal`` neighbours whose initials are not
    su, ua or au. Conversations without turns have zeros, an empty audit and the hash of nothing.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    done = repaired.segments
    schema = T.StructType(
        [T.StructField("conv", done.schema["conv"].dataType)]
        + [T.StructField(n, T.LongType()) for n in names]
        + [T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256")]
    )
    told = _by_conversation(done).mapInArrow(lambda batches: _digested(batches, to_arrow_schema(schema)), schema)
    ids = conversations.select(F.col(conv).alias("id")).distinct()
    joined = ids.join(told, F.col("id").eqNullSafe(F.col("conv")), "left")

    def filled(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value).alias(name)

    counts = [filled(n, F.lit(0).cast("long")) for n in names]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(F.col("id").alias(conv), *counts, filled("audit", F.lit("")), filled("repaired_sha256", empty))


def _digested(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments of whole conversations, in order, to one row each."""
    rows = (r for batch in batches for r in batch.to_pylist())
    out = []
    for conv, run in groupby(rows, key=lambda row: row["conv"]):
        total = dict.fromkeys((*_COUNTS, "cost"), 0)
        digest, audit, before, low, high, between = hashlib.sha256(), [], None, None, None, ""
        for row in run:
            for name in total:
                total[name] += row[name] or 0
            total["illegal"] += before is not None and before + row["first"] not in LEGAL
            before = row["last"]
            if row["low_turn"] is not None:
                total["turns"] -= high == row["low_turn"]
                low, high = row["low_turn"] if low is None else low, row["high_turn"]
            for turn in row["repaired"]:
                digest.update(f"{between}{turn['role']}:{turn['text']}".encode())
                between = "\n"
            audit.append(row["audit"])
        gaps = 0 if low is None else high - low + 1 - total.pop("turns")
        out.append({"conv": conv, "gaps": gaps, **total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)
