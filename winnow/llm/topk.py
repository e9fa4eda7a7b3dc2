"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows: terms are the vector's places, weights ``floor(scale * x)``. For a
block of candidate rows the weights of each term form a posting list; each term of each query row
adds its weight times the posting's weights to a dense array of scores, one per candidate of the
block. A partition selection takes the block's k best of each query, and the blocks' lists merge.

Queries and candidates are cut into blocks of bounded size, and every pair of blocks is a group of
its own, so the scores that a task holds do not grow with the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.shipping import ship
from winnow.session import stage

SCALE = 1024
QUERY_BLOCK = 2048
ROW_BLOCK = 8192
_SCORES = 1 << 20  # scores held at once


def search(
    rows: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of each row that ``queries`` picks.

    Candidates are all rows but those with the query's own id; ties go to the smaller id. Rows whose
    id or vector is null, or whose vector holds null or non-finite components, take no part. Every row
    counts, also where rows repeat an id or a whole row: each is a candidate, and each that is picked has a list of
    its own. Places past the end of a shorter vector weigh nothing. Products are
    64-bit, so weights should stay below 2^28. No rows, no result.
    """
    ship(rows.sparkSession)
    weights = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    valid = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    wide = valid.select(F.col(key).cast("long").alias("id"), weights.alias("w"), queries.alias("query"))
    # numbered and written, so that a list keeps its row
    asked = stage(wide.where("query").select("id", "w", F.monotonically_increasing_id().alias("row")))
    counts = wide.agg(F.count("*"), F.count_if("query")).first()
    row_blocks = max(1, math.ceil(counts[0] / ROW_BLOCK))
    query_blocks = max(1, math.ceil(counts[1] / QUERY_BLOCK))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    candidates = wide.select("id", "w", block(row_blocks).alias("row_block"), every(query_blocks).alias("query_block"))
    asked = asked.select("id", "w", "row", every(row_blocks).alias("row_block"), block(query_blocks).alias("query_block"))
    pair = ("row_block", "query_block")

    def best(asked: pa.Table, found: pa.Table) -> pa.Table:
        (q_ids, q_terms), q_rows = _sparse(asked), asked["row"].to_pylist()
        ids, terms = _sparse(found.sort_by("id"))
        postings = _postings(*terms, len(ids))
        lists = []
        step = max(1, _SCORES // max(1, len(ids)))
        for low in range(0, len(q_ids) if len(ids) else 0, step):
            part = slice(low, low + step)
            scores = _accumulate(q_terms, range(low, min(low + step, len(q_ids))), postings, len(ids))
            lists += [_select(q, n, row, ids, k) for q, n, row in zip(q_ids[part], q_rows[part], scores, strict=True)]
        columns = [np.concatenate(c) if lists else np.zeros(0, np.int64) for c in (zip(*lists, strict=True) if lists else [[]] * 4)]
        return pa.table(dict(zip(("query_id", "row", "vec_id", "score"), columns, strict=True)))

    local = (
        asked.groupBy(*pair).cogroup(candidates.groupBy(*pair)).applyInArrow(best, "query_id long, row long, vec_id long, score long")
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    merged = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def _sparse(table: pa.Table) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, and (row, term, weight) of every weight that is not zero."""
    ids = table["id"].to_numpy()
    lists = table["w"].combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    weight = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), sizes)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.flatnonzero(weight)
    return ids, (row[kept], term[kept], weight[kept])


def _postings(row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> dict[int, tuple]:
    """Posting list of each term; a term that every row has needs no row numbers."""
    order = np.argsort(term, kind="stable")
    names, at = np.unique(term[order], return_index=True)
    out = {}
    for name, part in zip(names.tolist(), np.split(order, at[1:]), strict=True):
        out[name] = (None if len(part) == rows else row[part], weight[part])
    return out


def _accumulate(terms: tuple, queries: range, postings: dict[int, tuple], rows: int) -> np.ndarray:
    scores = np.zeros((len(queries), rows), np.int64)
    row, term, weight = terms
    low, high = np.searchsorted(row, (queries.start, queries.stop))
    for q, t, w in zip((row[low:high] - queries.start).tolist(), term[low:high].tolist(), weight[low:high].tolist(), strict=True):
        if t in postings:
            at, values = postings[t]
            if at is None:
                scores[q] += w * values
            else:
                scores[q, at] += w * values
    return scores


def _select(query: int, row: int, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of a block, smaller ids first among equals; ``ids`` ascend."""
    own = slice(*np.searchsorted(ids, (query, query + 1)))
    others = np.ones(len(ids), bool)
    others[own] = False
    scores, ids = scores[others], ids[others]
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k)[len(ids) - k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        kept = np.concatenate([above, equal[: k - len(above)]])
        scores, ids = scores[kept], ids[kept]
    return np.full(len(ids), query), np.full(len(ids), row), ids, scores
