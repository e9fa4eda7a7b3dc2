"""Looking up what a chunk of documents asks of the whole corpus, as two shuffles of packed keys.

Documents are dealt into chunks by a hash of their id. A chunk sends each of its *distinct* keys
once, sorted and cut by hash range into one binary value per bucket; a bucket answers in the same
order, and the answers go back to the chunk. Since a chunk sends a key once however often it holds
it, a key that a third of all rows share costs its bucket one entry per chunk. Chunks and buckets
have a bounded size: their number grows with the corpus.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "__chunk"
CHUNK_BYTES = 2_000_000
BUCKET_BYTES = 16_000_000


def sizes(texts: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """Number of chunks and of buckets for a table, from the bytes of all its texts."""
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / bucket_bytes))


def chunked(docs: DataFrame, key: str, chunks: int) -> DataFrame:
    """The documents with the number of their chunk in front; rows of one id share a chunk."""
    return docs.select(F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)).alias(CHUNK), *docs.columns)


def slices(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that get any of the sorted 64-bit ``keys``, and where the keys of each begin, and the end.

    A bucket is a range of hashes. Work and result go by the keys alone, however many buckets there are.
    """
    number = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    filled, cuts = np.unique(number, return_index=True)
    return filled.astype(np.int64), np.append(cuts, len(keys))


def in_order(rows: list[dict], field: str) -> list[bytes]:
    """Answers of one chunk in the order of their buckets."""
    return [row[field] for row in sorted(rows, key=lambda row: row["bucket"])]
