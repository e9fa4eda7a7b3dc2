"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; the root is the smallest node it reaches.

    Each round joins links with the smallest neighbour of their node and writes the result, so a
    node with very many links is only ever reduced to a minimum, and lost executors cost one round.
    The number of rounds grows with the logarithm of the longest path. Self links and nulls go.
    """
    current = _staged(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    mark = _fingerprint(current)
    while True:
        current = _staged(_small_star(_large_star(current)))
        last, mark = mark, _fingerprint(current)
        if mark == last:
            break
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _staged(links: DataFrame) -> DataFrame:
    return stage(links.distinct())


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to its smallest one, or to itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))
