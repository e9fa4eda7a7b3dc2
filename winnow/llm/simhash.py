"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits link at ``max_bits`` differing bits or fewer. The bits are cut into
``max_bits + 1`` segments in a ring. If two fingerprints link, some segment starts a chain in which
the first ``l`` segments differ in at most ``l * max_bits / (max_bits + 1)`` bits together, for every
``l``. So the first segment of the chain is equal and the second differs in one bit at most: both
fingerprints share a key made of the first segment and of the second without one of its bits, 64
keys for each. Pairs that share a key are held against the budgets of the rest of the chain, then
against the full distance.

Equal fingerprints are one node. Keys that stand once go before anything is paired; the fingerprints
of a key that very many share are cut into blocks, and every pair of blocks is a group of its own,
so no link is lost and no task holds more than two blocks. A group gives back a spanning forest of
its links, not the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.components import components
from winnow.llm.shipping import ship
from winnow.session import stage

BITS = 64
SHINGLE = 4
MAX_BITS = 4
BLOCK = 4096
NODES_PER_TASK = 20_000
_ALL = (1 << BITS) - 1


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)``: the SimHash of the lower-cased (A-Z) ``shingle``-word shingles of each whole text.

    A shorter text is one shingle; a null text, or one without words, has fingerprint zero.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_simhash(t, shingle) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], [key, "fp"])

    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("fp")).schema
    return docs.select(key, text).mapInArrow(run, schema)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``(key, fingerprint, component_id)`` per row: fingerprint as 16 hex digits, smallest id it reaches.

    Null ids count for no component id; a component without any id has a null one. Rows that
    repeat an id keep a row each.
    """
    prints = stage(fingerprints(docs, key, text, shingle))
    nodes = prints.groupBy("fp").agg(F.min(key).alias("first_id"))
    roots = components(links(nodes.select("fp"), max_bits))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(smallest, "root").select("fp", "component_id")
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select(key, fingerprint.alias("fingerprint"), "component_id")


def deduplicate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; columns as they are.

    Rows without an id stay, and so do all rows that repeat a staying id.
    """
    found = near_duplicates(docs, key, text, shingle, max_bits)
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(u, v)``: links between the distinct fingerprints ``fp``, enough to join what is linked."""
    if max_bits < 1:
        return nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    masks = _masks(max_bits)
    slots = F.array(*[F.struct(F.lit(start).alias("start"), F.lit(_signed(mask)).alias("mask")) for start, mask in masks])
    # 64 keys come of each node, so the nodes are spread before, by their number.
    spread = nodes.select("fp").repartition(max(1, math.ceil(nodes.count() / NODES_PER_TASK)), "fp")
    keyed = spread.select("fp", F.explode(slots).alias("slot")).select(
        "fp",
        F.col("slot.start").alias("start"),
        F.xxhash64("slot.mask", F.col("fp").bitwiseAND(F.col("slot.mask"))).alias("key"),
    )
    # Spark takes the size of the nodes for that of their keys, 64 times as many, and would send those to every task.
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("merge")
    block = F.pmod(F.xxhash64("fp"), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    groups = (
        keyed.hint("merge").join(shared, "key")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        .select("fp", "start", "key", block.alias("block"), other.alias("other"))
        .withColumn("unit", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        .groupBy("unit")
        .agg(F.first("start").alias("start"), F.collect_set("fp").alias("fps"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for start, fps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for a, b in _forest(fps.values.to_numpy().view(np.uint64), start, max_bits):
                    u.append(a)
                    v.append(b)
            found = np.array([u, v], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(found[0]), pa.array(found[1])], ["u", "v"])

    ship(nodes.sparkSession)
    return groups.select("start", "fps").where("size(fps) > 1").mapInArrow(run, "u long, v long").distinct()


def _simhash(text: pa.Scalar, shingle: int) -> int:
    words = (text.as_py() or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = np.append(0, ends[:-1] + 1)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(starts), 1 << 14):
        part = slice(low, low + (1 << 14))
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[part], ends[part], strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * votes > len(starts)).astype(np.uint8)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def _segments(max_bits: int) -> list[int]:
    """Masks of the ring's segments."""
    edges = [i * BITS // (max_bits + 1) for i in range(max_bits + 2)]
    return [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]


def _masks(max_bits: int) -> list[tuple[int, int]]:
    """For each start of a chain, its first two segments without one bit of the second."""
    ring = _segments(max_bits)
    out = []
    for start, first in enumerate(ring):
        second = ring[(start + 1) % len(ring)]
        out += [(start, first | second & ~(1 << bit)) for bit in range(BITS) if second >> bit & 1]
    return out


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _chain(start: int, max_bits: int) -> list[tuple[np.uint64, int]]:
    """The longer prefixes of a chain and their budgets, the whole fingerprint last."""
    ring = _segments(max_bits)
    out, mask = [], 0
    for length in range(1, len(ring) + 1):
        mask |= ring[(start + length - 1) % len(ring)]
        if length > 2 or length == len(ring):
            out.append((np.uint64(mask), length * max_bits // len(ring)))
    return [*out[:-1], (np.uint64(_ALL), max_bits)]


def _forest(fps: np.ndarray, start: int, max_bits: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links among ``fps``: each one reached is held once against those not yet reached."""
    chain, rest = _chain(start, max_bits), fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            apart = rest ^ at
            near = np.ones(len(rest), bool)
            for mask, most in chain:
                near &= np.bitwise_count(apart & mask) <= most
            reached = rest[near]
            yield from ((int(at), int(x)) for x in reached)
            queue.extend(reached)
            rest = rest[~near]
