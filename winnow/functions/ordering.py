"""Row numbers over groups that may hold most of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    coarse: Sequence[str],
    index: str,
    name: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Number rows 1..n per ``group`` in the order of ``coarse``, then ``index``.

    A plain ``row_number()`` sends a whole group to one task. Here the rows are cut into chunks of
    ``index`` values, so a window holds at most ``chunk_rows`` rows (``index`` is a whole number,
    unique within the group). Rows are counted per chunk with a map-side aggregate; the running
    sums go over those counts only: first chunks within a coarse key, then coarse keys in a group.
    """
    group, coarse = list(group), list(coarse)
    chunk = F.floor(F.col(index) / F.lit(chunk_rows)).cast("long").alias("_chunk")
    # Keys are compared as one struct, so missing values count as equal and the join below reuses
    # the partitioning of the window.
    keyed = df.withColumn("_key", F.struct(F.struct(*group, *coarse).alias("coarse"), chunk))
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n")).select("_key", "_key.*", "_n")

    totals = counts.groupBy("coarse").agg(F.sum("_n").alias("_n"))
    groups = [F.col("coarse")[c] for c in group]
    order = [F.col("coarse")[c] for c in coarse]
    in_group = totals.select("coarse", _sum_before(Window.partitionBy(*groups).orderBy(*order)).alias("_keys"))
    in_coarse = counts.select(
        "_key", "coarse", _sum_before(Window.partitionBy("coarse").orderBy("_chunk")).alias("_chunks")
    )
    offsets = in_coarse.join(in_group, "coarse").select("_key", (F.col("_chunks") + F.col("_keys")).alias("_offset"))

    within = Window.partitionBy("_key").orderBy(index)
    local = keyed.withColumn("_local", F.row_number().over(within))
    return (
        local.join(offsets, "_key")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_key", "_local", "_offset")
    )


def _sum_before(window: WindowSpec) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(before), F.lit(0))
