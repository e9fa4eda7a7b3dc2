"""A triage run over any number of scans, in two halves around the external reviewer.

``prepare`` goes from scan documents to the request table, ``conclude`` from the replies to the
triaged findings. What lies between them is outside Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators import exchange as X
from winnow.operators import ingest as I
from winnow.operators import reuse as R
from winnow.operators.context import build_contexts
from winnow.operators.large_scans import Scans, scan_errors
from winnow.operators.verify import verify_replies
from winnow.schemas import CONTEXT, PROMPT_VERSION, STORED, STRINGS
from winnow.session import TEXTS, stage, unstage


@dataclass
class Prepared:
    """``findings`` routed, with context, fingerprint and stored verdict; the rest beside them."""

    findings: DataFrame
    requests: DataFrame
    scan_errors: DataFrame
    scan_rejects: DataFrame
    file_rejects: DataFrame


def prepare(
    scan_docs: DataFrame | Scans,
    files: DataFrame,
    store: DataFrame | str | None = None,
    *,
    prompt_version: str = PROMPT_VERSION,
    instructions: str = X.DEFAULT_INSTRUCTIONS,
    reuse: bool = True,
    limit: int | None = None,
    on_error: str = "quarantine",
    follow_alias: bool = False,
    max_file_bytes: int | None = None,
) -> Prepared:
    """Scan documents and source files to routed findings and requests.

    Scans above the size of a string come from :func:`winnow.operators.large_scans.assemble`.

    ``store`` is a table of entries, or the path of a store, of which a run reads only the folders
    that its fingerprints fall in. ``reuse=False`` neither reads nor later writes the store. ``limit`` keeps the first so many
    processable findings of each scan.
    """
    spark = files.sparkSession
    files = single_files(files)
    if isinstance(scan_docs, Scans):
        documents = I.raise_for_documents(scan_docs.documents, on_error)
        errors, file_rejects = scan_errors(scan_docs), I.scan_file_rejects(documents)
        parsed = stage(I.parse_results(scan_docs.results), TEXTS)
    else:
        documents = stage(I.scan_documents(scan_docs, on_error), TEXTS)
        errors, file_rejects = stage(I.scan_errors(documents)), stage(I.scan_file_rejects(documents))
        parsed = stage(I.parse_results(I.raw_results(documents)), TEXTS)
        unstage(documents)
    found = I.mark_processable(I.valid_findings(parsed))
    if limit is not None:
        found = I.limit_per_scan(found, limit)
    found = stage(I.resolve_matched_code(found, files), TEXTS)
    # What findings were made of goes before their contexts are; of it only the rejects are asked for again.
    rejects = stage(I.scan_rejects(parsed))
    unstage(parsed)

    nothing = F.lit(None).cast("string")
    with_context = build_contexts(found.filter("processable"), files, follow_alias, max_file_bytes).withColumn(
        "context",
        F.when(
            F.col("context_error").isNotNull(), X.failed_context(F.col("matched_code"), F.col("context_error"))
        ).otherwise(F.col("context")),
    )
    others = found.filter("NOT processable").select(
        "*",
        X.unsupported_context(F.col("matched_code"), F.col("file_path")).alias("context"),
        nothing.alias("function_text"),
        nothing.alias("context_error"),
    )
    routed = X.route_findings(with_context.unionByName(others))
    keyed = stage(R.add_fingerprint(routed, prompt_version), TEXTS)

    if reuse and store is not None:
        # Findings without a context of their own are never looked up.
        may_reuse = F.col("route").isin("review", "degraded_context")
        asking = keyed.filter(may_reuse)
        entries = R.lookup_store(spark, store, asking) if isinstance(store, str) else R.usable_entries(store)
        looked_up = R.reuse_verdicts(asking, entries)
        none = F.lit(None).cast(looked_up.schema["stored"].dataType)
        rest = keyed.filter(~may_reuse).withColumn("stored", none).withColumn("from_cache", F.lit(False))
        findings = stage(looked_up.unionByName(rest), TEXTS)
    else:
        payload = [f for f in STORED.fields if f.name not in ("fingerprint", "stored_at")]
        none = F.lit(None).cast("struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in payload) + ">")
        findings = keyed.withColumn("stored", none).withColumn("from_cache", F.lit(False))

    work = findings.filter("route = 'review' AND NOT from_cache")
    return Prepared(
        findings=findings,
        requests=X.build_requests(work, X.instructions(spark, instructions, prompt_version)),
        scan_errors=errors,
        scan_rejects=rejects,
        file_rejects=file_rejects,
    )


def single_files(files: DataFrame) -> DataFrame:
    """One row per repository and path: of several, the first by length and text.

    The paths that stand more than once are found without reading texts; only their rows are
    merged, and where there are none the files are as they were given.
    """
    again = files.groupBy("repo_id", "path").agg(F.count("*").alias("copies")).where("copies > 1").select("repo_id", "path")
    again = stage(again)
    if again.isEmpty():
        return files
    rest = [c for c in files.columns if c not in ("repo_id", "path")]
    merged = files.join(again, ["repo_id", "path"], "left_semi").groupBy("repo_id", "path").agg(F.min(F.struct(*rest)).alias("_file"))
    once = files.join(again, ["repo_id", "path"], "left_anti")
    return once.unionByName(merged.select("repo_id", "path", "_file.*"))


def conclude(
    findings: DataFrame,
    replies: DataFrame,
    vocabulary: Sequence[str] | None = None,
    code_only: bool = False,
) -> DataFrame:
    """Triaged findings: exactly one row per finding of ``prepare``.

    Stored verdicts, fallbacks and checked replies come together here. A finding that was sent but
    got no reply falls back to human review. Findings that share a fingerprint share the reply; its
    tokens and time count once, on the first of them.
    """
    sent = F.col("route").eqNullSafe("review") & ~F.col("from_cache")
    answered = X.single_replies(X.parse_reply(replies)).withColumnRenamed("verdict", "reply_verdict")
    first = findings.filter(sent).groupBy("fingerprint").agg(F.min("finding_id").alias("first_id"))
    # Written first, so that both sides of the join below are plain scans: adaptive execution can
    # then split a fingerprint that many findings share.
    answers = stage(first.join(answered, "fingerprint", "left"))
    outgoing = (
        findings.filter(sent)
        .join(answers, "fingerprint", "left")
        .withColumn("synth_reason", F.when(F.col("reply_verdict").isNull(), F.coalesce("synth_reason", F.lit("api_error: no reply"))))
        .withColumnRenamed("reply_verdict", "verdict")
        .withColumn("original_verdict", F.lit(None).cast("string"))
        .withColumn("reviewed", F.lit(True))
    )
    charged = F.col("finding_id") == F.col("first_id")
    for name in ("duration_seconds", "input_tokens", "output_tokens"):
        outgoing = outgoing.withColumn(name, F.when(charged, F.col(name)))
    checked = verify_replies(outgoing, vocabulary, code_only).drop("first_id", "stored")

    stored = F.col("stored")
    kept = findings.filter(~sent)
    error = F.coalesce("pipeline_error", "context_error") if "pipeline_error" in findings.columns else F.col("context_error")
    fallback = X.route_fallback(F.col("route"), F.col("file_path"), error)
    rest = kept.select(
        *[c for c in findings.columns if c != "stored"],
        F.coalesce(stored["verdict"], fallback).alias("verdict"),
        F.lit(None).cast("string").alias("synth_reason"),
        stored["duration_seconds"].alias("duration_seconds"),
        stored["input_tokens"].alias("input_tokens"),
        stored["output_tokens"].alias("output_tokens"),
        stored["original_verdict"].alias("original_verdict"),
        F.lit(False).alias("reviewed"),
        F.coalesce(stored["verification_passed"], F.lit(True)).alias("verification_passed"),
        F.coalesce(stored["verification_notes"], F.array().cast(STRINGS)).alias("verification_notes"),
        F.coalesce(stored["advisory_warnings"], F.array().cast(STRINGS)).alias("advisory_warnings"),
    )
    return checked.unionByName(rest).withColumns(
        {"run_id": F.col("scan_id"), "input_idx": F.col("result_idx").cast("long"), "context": F.col("context").cast(CONTEXT)}
    )
