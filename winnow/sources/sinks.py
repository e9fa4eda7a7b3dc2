"""Outputs: requests, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON line per distinct fingerprint for the external reviewer."""
    requests.write.mode("overwrite").json(path)


def write_json_report(summary: DataFrame, rule_stats: DataFrame, triaged: DataFrame, path: str) -> None:
    """The report as JSON lines below ``run_id=.../``.

    A run can hold far more findings than one document may, so the run's summary, its rules and
    its findings are separate sets of lines instead of one nested object.
    """
    for part, rows in (("summary", summary), ("rules", rule_stats), ("findings", triaged)):
        rows.hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").json(f"{path}/{part}")


def write_report_documents(fragments: DataFrame, path: str, files: int | None = None) -> None:
    """The pieces ``run_id, part, place, json`` of nested reports as text files below ``run_id=.../``.

    As with :func:`write_markdown_report` the part files of a run, by name, make up its document.
    """
    _write_in_order(fragments.select("run_id", "part", "place", F.col("json").alias("value")), ("run_id", "part", "place"), path, files)


def write_markdown_report(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Ordered report blocks ``run_id, block_no, part, rule_no, markdown`` as text files below ``run_id=.../``.

    Rows are range-partitioned in reading order, so the name order of the part files of a run is
    the order of the report; a small report is a single file.
    """
    order = ("run_id", "block_no", "part", "rule_no")
    blank = F.when((F.col("block_no") > 0) & (F.col("part") == 0), F.lit("\n")).otherwise(F.lit(""))
    _write_in_order(lines.select(*order, F.concat(blank, "markdown").alias("value")), order, path, files)


def _write_in_order(rows: DataFrame, order: tuple[str, ...], path: str, files: int | None) -> None:
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("run_id", "value").write.mode("overwrite").partitionBy("run_id").text(path)
