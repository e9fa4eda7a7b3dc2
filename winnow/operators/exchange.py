"""Requests to the external reviewer, its replies, and the fallbacks that stand in for them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import variant as V
from winnow.functions.text import no_strings
from winnow.operators.context import is_degraded
from winnow.schemas import (
    CALLED_FUNCTION,
    CONFIDENCES,
    CONTEXT,
    FP_CATEGORIES,
    NEEDS_HUMAN_REVIEW,
    PROMPT_VERSION,
    VERDICT,
    VERDICT_LABELS,
)

FENCE = "```python"
# The sentences of a request about missing parts.
NO_FUNCTION = (
    "_The match is at module level (not inside any function). No containing function context available._"
)
NOTES_INTRO = (
    "_The following could not be fully extracted. Treat these as missing context, not as facts about the code:_"
)

# Used where a run names no instructions of its own.
DEFAULT_INSTRUCTIONS = (
    "Decide for the finding below whether it is a false positive, a likely true positive, or needs human "
    "review. Rely on the code shown, quote it verbatim as evidence, name what is missing, and choose human "
    "review whenever the code alone does not settle the question."
)


def instructions(spark: SparkSession, text: str = DEFAULT_INSTRUCTIONS, version: str = PROMPT_VERSION) -> DataFrame:
    """The versioned instruction text as a one-row dimension."""
    return spark.createDataFrame([(version, text)], "prompt_version string, instructions string")


def request_text(finding: dict[str, Column] | None = None, context: Column | None = None) -> Column:
    """The per-finding part of a request; empty sections are left out."""
    f = finding or {name: F.col(name) for name in FINDING_COLUMNS}
    c = F.col("context") if context is None else context
    calls, notes = c["called_functions"], c["extraction_notes"]

    def line(label: str, value: Column, condition: Column | None = None) -> Column:
        text = F.concat(F.lit(label), value)
        return text if condition is None else F.when(condition, text)

    def section(title: Column | str, *body: Column | str, condition: Column | None = None) -> Column:
        parts = [F.lit(p) if isinstance(p, str) else p for p in ("", title, "", *body)]
        text = F.concat_ws("\n", *parts)
        return text if condition is None else F.when(condition, text)

    def filled(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) != ""

    function = c["containing_function_source"]
    has_function = filled(function)
    each_call = F.transform(
        calls,
        lambda call: F.concat_ws(
            "\n",
            F.concat(
                F.lit("### `"), call["name"], F.lit("` (from "), call["file_path"], F.lit(", "),
                call["resolution_method"], F.lit(")"),
            ),
            F.lit(""),
            F.lit(FENCE),
            call["source"],
            F.lit("```"),
            F.lit(""),
        ),
    )
    return F.concat_ws(
        "\n",
        F.lit("# The finding"),
        F.lit(""),
        line("Rule ID: ", f["rule_id"]),
        line("Rule message: ", f["message"]),
        line("Severity: ", f["severity"]),
        line("CWE: ", F.array_join(f["cwe"], ", "), F.size(f["cwe"]) > 0),
        line("OWASP: ", F.array_join(f["owasp"], ", "), F.size(f["owasp"]) > 0),
        line("Scanner's own confidence: ", f["scanner_confidence"], filled(f["scanner_confidence"])),
        line("File: ", f["file_path"]),
        F.concat(F.lit("Lines: "), f["start_line"].cast("string"), F.lit("-"), f["end_line"].cast("string")),
        section("## Matched code", FENCE, c["matched_code_with_lines"], "```"),
        section("## File imports", FENCE, c["imports"], "```", condition=filled(c["imports"])),
        section(
            F.concat(F.lit("## Containing function: `"), c["containing_function_name"], F.lit("`")),
            FENCE,
            function,
            "```",
            condition=has_function,
        ),
        section("## Containing function", NO_FUNCTION, condition=~has_function),
        section(
            F.concat(F.lit("## Called functions ("), F.size(calls).cast("string"), F.lit(" resolved)")),
            F.array_join(each_call, "\n"),
            condition=F.size(calls) > 0,
        ),
        section(
            "## Dataflow trace",
            f["dataflow_trace_summary"],
            condition=f["has_dataflow_trace"] & filled(f["dataflow_trace_summary"]),
        ),
        section(
            "## Extraction notes",
            NOTES_INTRO,
            "",
            F.array_join(F.transform(notes, lambda note: F.concat(F.lit("- "), note)), "\n"),
            condition=F.size(notes) > 0,
        ),
    )


FINDING_COLUMNS = [
    "rule_id",
    "message",
    "severity",
    "cwe",
    "owasp",
    "scanner_confidence",
    "file_path",
    "start_line",
    "end_line",
    "has_dataflow_trace",
    "dataflow_trace_summary",
]


def build_requests(work: DataFrame, instruction_rows: DataFrame) -> DataFrame:
    """One request per distinct fingerprint of the work list, with the JSON schema its reply must follow.

    Which finding speaks for a fingerprint is settled on narrow rows; only its text is rendered. The
    instruction text is one row, so its broadcast has a fixed size.
    """
    first = work.groupBy("fingerprint").agg(F.min("finding_id").alias("finding_id"))
    return (
        work.join(first, ["fingerprint", "finding_id"], "left_semi")
        .withColumn("request", request_text())
        .join(F.broadcast(instruction_rows), "prompt_version", "left")
        .select("fingerprint", "prompt_version", "instructions", "request", F.lit(REPLY_SCHEMA).alias("reply_schema"))
    )


def single_replies(parsed: DataFrame) -> DataFrame:
    """One parsed reply per fingerprint: a usable one before a failed one, then the one that cost most.

    Writers that retry leave several. What is still equal is settled by content, and an aggregate
    merges copies before the shuffle.
    """
    reply = F.struct(*[c for c in parsed.columns if c != "fingerprint"])
    order = F.struct(
        F.col("synth_reason").isNull(), "output_tokens", "input_tokens", F.xxhash64(F.to_json(reply)).alias("content")
    )
    return parsed.groupBy("fingerprint").agg(F.max_by(reply, order).alias("_reply")).select("fingerprint", "_reply.*")


def _reply_schema() -> str:
    """What :func:`parse_reply` accepts, as JSON schema text."""
    text, texts = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    properties = {
        "verdict": text | {"enum": VERDICT_LABELS},
        "confidence": text | {"enum": CONFIDENCES},
        "reasoning": text,
        "evidence_quotes": texts,
        "missing_context": texts,
        "fp_categories": {"type": "array", "items": text | {"enum": FP_CATEGORIES}},
        "suggested_action": text,
    }
    return json.dumps({"type": "object", "properties": properties, "required": list(REPLY_TEXTS)})


REPLY_TEXTS = ("verdict", "confidence", "reasoning", "suggested_action")
REPLY_LISTS = ("evidence_quotes", "missing_context", "fp_categories")
REPLY_SCHEMA = _reply_schema()


def parse_reply(replies: DataFrame) -> DataFrame:
    """Validate replies: ``verdict`` where usable, else ``synth_reason`` says why not.

    Labels must come from the vocabularies, four fields must be strings, and the three lists may
    be absent, null or ``''``, which stand for an empty list. Each step is a column of its own, so
    that a reply is parsed once.
    """

    def strings(value: Column) -> Column:
        items = V.items(value)
        return F.when(V.is_absent(value) | (V.string(value) == ""), no_strings()).when(
            items.isNotNull() & F.forall(items, V.is_string), F.try_variant_get(value, "$", "array<string>")
        )

    parsed = replies.withColumn("_reply", F.try_parse_json("reply"))
    fields = parsed.withColumns({f"_{key}": V.child(F.col("_reply"), f"$.{key}") for key in REPLY_TEXTS + REPLY_LISTS})
    typed = fields.withColumns(
        {f"_text_{key}": V.string(F.col(f"_{key}")) for key in REPLY_TEXTS}
        | {f"_list_{key}": strings(F.col(f"_{key}")) for key in REPLY_LISTS}
    )
    text = {key: F.col(f"_text_{key}") for key in REPLY_TEXTS}
    lists = {key: F.col(f"_list_{key}") for key in REPLY_LISTS}
    valid = (
        text["verdict"].isin(VERDICT_LABELS)
        & text["confidence"].isin(CONFIDENCES)
        & text["reasoning"].isNotNull()
        & text["suggested_action"].isNotNull()
        & lists["evidence_quotes"].isNotNull()
        & lists["missing_context"].isNotNull()
        & F.forall(lists["fp_categories"], lambda category: category.isin(FP_CATEGORIES))
    )
    verdict = F.struct(
        *[(text | lists)[key].alias(key) for key in VERDICT.fieldNames()],
    ).cast(VERDICT)
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("api_error: "), F.col("error")))
        .when(F.col("reply").isNull(), F.lit("no_tool_use"))
        .when(~F.coalesce(valid, F.lit(False)), F.lit("schema_validation_failed"))
    )
    return typed.withColumn("synth_reason", reason).select(
        "fingerprint",
        F.when(F.col("synth_reason").isNull(), verdict).alias("verdict"),
        "synth_reason",
        "duration_seconds",
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
    )


def review_verdict(reasoning: Column, missing: str, action: Column) -> Column:
    """The verdict of every fallback: human review, low confidence, never a false positive."""
    return F.struct(
        F.lit(NEEDS_HUMAN_REVIEW).alias("verdict"),
        F.lit("low").alias("confidence"),
        reasoning.alias("reasoning"),
        no_strings().alias("evidence_quotes"),
        F.array(F.lit(missing)).alias("missing_context"),
        no_strings().alias("fp_categories"),
        action.alias("suggested_action"),
    ).cast(VERDICT)


def reply_fallback(synth_reason: Column) -> Column:
    """Verdict for a reply that never came or cannot be used."""
    api = F.substr(synth_reason, F.lit(len("api_error: ") + 1))
    # The reasoning per cause, and what is missing and to be done.
    reasoning = (
        F.when(synth_reason.startswith("api_error: "), F.concat(F.lit("LLM call failed after retries: "), api))
        .when(synth_reason == "no_tool_use", F.lit("LLM did not call submit_verdict. Routing to human review."))
        .otherwise(F.lit("LLM returned malformed verdict. Routing to human review."))
    )
    return review_verdict(
        reasoning,
        "LLM verdict could not be obtained",
        F.lit("Review this finding manually; the LLM triage step did not complete."),
    )


def reply_note(synth_reason: Column) -> Column:
    return F.concat(F.lit("LLM call did not produce a usable verdict: "), synth_reason)


def route_findings(findings: DataFrame) -> DataFrame:
    """Add ``route``: why a finding is not sent, or ``review`` for those that are.

    Needs ``processable``, ``context`` and ``context_error``. The fallbacks are
    ``unsupported_language``, ``context_failure``, ``degraded_context`` and, for findings that a
    caller has given a ``pipeline_error``, ``pipeline_failure``.
    """
    route = F.when(~F.col("processable"), F.lit("unsupported_language")).when(
        F.col("context_error").isNotNull(), F.lit("context_failure")
    )
    if "pipeline_error" in findings.columns:
        route = route.when(F.col("pipeline_error").isNotNull(), F.lit("pipeline_failure"))
    return findings.withColumn(
        "route", route.when(is_degraded(F.col("context")), F.lit("degraded_context")).otherwise(F.lit("review"))
    )


def route_fallback(route: Column, file_path: Column, error: Column) -> Column:
    """Verdict of a finding that is not sent to the reviewer; NULL for ``review``."""
    cause = F.coalesce(error, F.lit("Error"))
    # Per route the reasoning and the suggested action.
    texts = {
        "unsupported_language": (
            F.concat(F.lit("Only Python files are reviewed; "), file_path, F.lit(" requires manual review.")),
            "Review manually.",
        ),
        "context_failure": (
            F.concat(F.lit("No context could be built: "), cause),
            "Review manually; the rule_id and file_path tell which file to look at.",
        ),
        "pipeline_failure": (
            F.concat(F.lit("Pipeline error: "), cause),
            "Run the finding again without reuse, or review it manually.",
        ),
        "degraded_context": (
            F.lit("Could not extract enough context (no containing function or called functions) to send to the LLM."),
            "Review manually; the file may be unreadable or use an unusual structure.",
        ),
    }
    reasoning, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (why, what) in texts.items():
        reasoning = F.when(route == name, why).otherwise(reasoning)
        action = F.when(route == name, F.lit(what)).otherwise(action)
    verdict = review_verdict(reasoning, "Verdict synthesized; LLM was not called.", action)
    return F.when(reasoning.isNotNull(), verdict)


def bare_context(language: str, matched_code: Column, note: Column) -> Column:
    """The context of a finding that could not be given one."""
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(language),
        matched_code,
        nothing,
        nothing,
        nothing,
        F.lit(None).cast("int"),
        F.array().cast(f"array<{CALLED_FUNCTION.simpleString()}>"),
        F.array(note),
    ).cast(CONTEXT)


def unsupported_context(matched_code: Column, file_path: Column) -> Column:
    note = F.concat(F.lit("Language not yet supported (file: "), file_path, F.lit(")."))
    return bare_context("unsupported", matched_code, note)


def failed_context(matched_code: Column, error: Column) -> Column:
    return bare_context("python", matched_code, F.concat(F.lit("Extractor crashed: "), error))
