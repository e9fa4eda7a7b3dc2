"""Inputs: scan documents, source trees, reviewer replies."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.schemas import REPLIES
from winnow.session import TEXTS, stage


def read_scans(spark: SparkSession, paths: str | Sequence[str], repo_id: str | None = None) -> DataFrame:
    """Scan documents, one row per JSON file: ``scan_id, repo_id, text``.

    ``scan_id`` is the file's path. Without ``repo_id`` the name of the file's folder is taken, so
    one call reads the scans of many repositories.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("scan_id"), "value")
    repo = F.lit(repo_id) if repo_id is not None else F.element_at(F.split("scan_id", "/"), -2)
    return raw.select("scan_id", repo.alias("repo_id"), F.col("value").alias("text"))


def read_scan_pieces(
    spark: SparkSession, paths: str | Sequence[str], repo_id: str | None = None, chunk_bytes: int = 1 << 20
) -> DataFrame:
    """Scan documents of any size, cut at every comma: ``scan_id, repo_id, chunk, at, piece, file_size``.

    Tasks read chunks of ``chunk_bytes`` of a file, so no task holds a document; ``chunk`` is where one begins, and
    ``at`` orders its pieces. They are written once, so that the order stands.
    """
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    raw = spark.read.option("lineSep", ",").text(paths).select(F.col("_metadata").alias("m"), F.col("value").alias("piece"))
    repo = F.lit(repo_id) if repo_id is not None else F.element_at(F.split("m.file_path", "/"), -2)
    pieces = raw.select(
        F.col("m.file_path").alias("scan_id"),
        repo.alias("repo_id"),
        F.col("m.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("at"),
        "piece",
        F.col("m.file_size").alias("file_size"),
    )
    spark.conf.set(size, str(chunk_bytes))
    try:
        return stage(pieces, TEXTS)
    finally:
        spark.conf.set(size, before)


class ReportPieces(NamedTuple):
    """``head``: run_id, json, what stands before a run's first list; ``elements``: run_id, key, order, place,
    json, a row per list element, ``place`` from 0 within its list; ``order`` is that of the document."""

    head: DataFrame
    elements: DataFrame


def read_report_documents(spark: SparkSession, path: str) -> ReportPieces:
    """Nested reports as :func:`winnow.sources.sinks.write_report_documents` leaves them, a piece per line.

    No task holds a document. A line that opens a list says what the lines behind it are; there are few. In other
    lines ``at`` goes up by one, so an element's place follows from the first of its list in the same block of the file and from
    the numbers of those in the blocks before.
    """
    raw = spark.read.text(path)
    m = F.col("_metadata")
    order = F.struct(m["file_name"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = stage(raw.select("run_id", order.alias("order"), F.col("value").alias("line")))
    opens = F.col("line").startswith("]") | (F.col("line").startswith("{") & F.col("line").endswith("["))
    opening = lines.filter(opens)
    key = F.regexp_extract("line", r'"([^"]*)":\[$', 1)
    lists = opening.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("order", key.alias("key")))).alias("lists"))
    of = F.element_at(F.filter("lists", lambda o: o["order"] < F.col("order")), -1)["key"]
    told = lines.filter(~opens).join(F.broadcast(stage(lists)), "run_id")
    told = told.select("run_id", of.alias("key"), "order", "order.file", "order.block", "order.at", F.col("line").startswith(",").alias("comma"), F.regexp_replace("line", "^,", "").alias("json"))
    whole = ["run_id", "key"]
    splits = told.groupBy(*whole, "file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*whole).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = stage(splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    placed = told.join(splits, [*whole, "file", "block"])
    place = F.col("at") - F.col("first") + F.col("before")
    # a comma stands before every element but the first
    apart = (place > 0) == F.col("comma")
    return ReportPieces(
        opening.filter("line LIKE '{%'").select("run_id", F.col("line").alias("json")),
        placed.select(*whole, "order", place.cast("int").alias("place"), F.when(apart, F.col("json")).otherwise(F.raise_error(F.lit("not valid JSON"))).alias("json")),
    )


def read_source_tree(spark: SparkSession, root: str, repo_id: str | None = None, glob: str = "*") -> DataFrame:
    """Files below ``root``: ``repo_id, path, length, text``.

    With ``repo_id`` the root is that repository. Without, each folder in the root is one, named as
    the folder, so one call reads the trees of many repositories; files beside them belong to none. The file source prunes and pushes down: a plan that only needs paths reads no content, and a
    filter on ``length`` keeps oversized files unread.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    full = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    below = F.regexp_replace(full, "^" + _quoted(_without_scheme(root)) + "/*", "")
    tree = files.withColumn("_below", below)
    if repo_id is None:
        tree = tree.where(F.contains("_below", F.lit("/")))
        repo, path = F.substring_index("_below", "/", 1), F.regexp_replace("_below", "^[^/]*/+", "")
    else:
        repo, path = F.lit(repo_id), F.col("_below")
    return tree.select(
        repo.alias("repo_id"),
        path.alias("path"),
        "length",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def read_replies(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Reviewer replies as JSON lines; ``reply`` holds the verdict object as text."""
    return spark.read.schema(REPLIES).json(path)


def _without_scheme(root: str) -> str:
    return "/" + root.split(":", 1)[-1].strip("/") if ":" in root else root.rstrip("/")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
