"""Reports of finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators import report as P
from winnow.schemas import NOISY_MIN_FINDINGS, NOISY_MIN_FP_RATE
from winnow.session import stage
from winnow.sources import sinks


def publish(
    triaged: DataFrame,
    scan_errors: DataFrame,
    runs: DataFrame,
    path: str,
    min_findings: int = NOISY_MIN_FINDINGS,
    min_fp_rate: float = NOISY_MIN_FP_RATE,
) -> None:
    """Write the reports of all runs: JSON lines below ``path/json``, one nested document per run below ``path/document``,
    Markdown below ``path/markdown``.

    ``triaged`` and ``scan_errors`` come from a triage run, ``runs`` holds the metadata that
    :func:`winnow.operators.report.run_summary` names.
    """
    triaged = stage(triaged)
    errors = scan_errors.withColumn("run_id", F.col("scan_id"))
    summary = stage(P.run_summary(triaged, errors, runs))
    stats = stage(P.rule_stats(triaged.withColumn("verdict", F.col("verdict.verdict"))))
    rules = stage(P.run_rules(stats, min_findings, min_fp_rate))
    sinks.write_json_report(summary, rules, triaged, f"{path}/json")
    sinks.write_report_documents(P.report_fragments(summary, rules, errors, triaged), f"{path}/document")
    blocks = P.report_blocks(summary, P.finding_markdown(triaged), stats, min_findings, min_fp_rate)
    sinks.write_markdown_report(blocks, f"{path}/markdown")
