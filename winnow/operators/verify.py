"""Checks of a reviewer's reply against the text it was shown.

All checks look at one finding at a time and stay in its row: no joins, no shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import is_blank, let, no_strings, normalize_ws, strip_line_prefixes
from winnow.functions.vocabulary import REVIEW_VOCABULARY
from winnow.schemas import FALSE_POSITIVE, NEEDS_HUMAN_REVIEW, VERDICT

_START = r"(?<![\p{L}\p{N}_])"
_END = r"(?![\p{L}\p{N}_])"

# What counts as a code reference in prose, in this order: a name in backticks, a
# name before a bracket, two dotted parts, mixed case or snake case.
TOKEN_PATTERNS = [
    r"`([A-Za-z_][A-Za-z0-9_]*)`",
    _START + r"([a-z_][a-zA-Z0-9_]*)[\s\x1c-\x1f\x85\p{Z}]*\(",
    _START + r"([a-z_][a-zA-Z0-9_]*\.[a-z_][a-zA-Z0-9_]+)",
    _START + r"([A-Z][a-zA-Z0-9]*[a-z][A-Z][A-Za-z0-9]*|[a-z]+_[a-z_0-9]+)" + _END,
]

# Issue texts.
NO_QUOTES = (
    "Verdict is false_positive but no evidence_quotes were provided. Per the prompt contract, FP verdicts "
    "require at least one verbatim code quote."
)
EMPTY_REASONING = "Reasoning field is empty."


def haystack(finding: dict[str, Column], context: Column, code_only: bool = False) -> Column:
    """Everything the reviewer was shown, without line numbers.

    ``code_only`` leaves out message, rule and path, so that quoting those is no evidence.
    """

    def filled(value: Column) -> Column:
        return F.when(value != "", value)

    about = [] if code_only else [finding["message"], finding["rule_id"], finding["file_path"]]
    calls = F.transform(
        context["called_functions"],
        lambda call: F.concat_ws("\n", strip_line_prefixes(call["source"]), call["name"]),
    )
    return F.concat_ws(
        "\n",
        finding["matched_code"],
        *about,
        strip_line_prefixes(context["matched_code_with_lines"]),
        filled(context["imports"]),
        strip_line_prefixes(filled(context["containing_function_source"])),
        filled(context["containing_function_name"]),
        F.when(F.size(calls) > 0, F.array_join(calls, "\n")),
    )


def quote_statuses(quotes: Column, hay: Column, normalized: Column | None = None) -> Column:
    """Per quote ``empty``, ``exact``, ``normalized`` or ``fabricated``.

    The text is normalized once, and only where some quote is not found as it stands; callers that have it
    normalized give it. So are quotes, and only those that the normalized text does not hold as they stand: it
    holds with a quote what is left of that one when it is normalized.
    """

    def literal(text: Column, quote: Column) -> Column:
        return F.when(is_blank(quote), F.lit("empty")).when(F.contains(text, quote), F.lit("exact"))

    def by_words(normalized: Column, quote: Column) -> Column:
        found = F.contains(normalized, quote) | F.contains(normalized, normalize_ws(quote))
        return F.when(found, F.lit("normalized")).otherwise(F.lit("fabricated"))

    first = let(
        F.struct(quotes.alias("quotes"), hay.alias("hay"), (F.lit(None).cast("string") if normalized is None else normalized).alias("normalized")),
        lambda s: F.struct(
            F.transform(
                s["quotes"],
                lambda quote: F.struct(quote.alias("quote"), literal(s["hay"], quote).alias("status")),
            ).alias("quotes"),
            s["hay"].alias("hay"),
            s["normalized"].alias("normalized"),
        ),
    )
    missed = let(
        first,
        lambda s: F.struct(
            s["quotes"].alias("quotes"),
            F.when(F.exists(s["quotes"], lambda q: q["status"].isNull()), F.coalesce(s["normalized"], normalize_ws(s["hay"]))).alias("normalized"),
        ),
    )
    checked = let(
        missed,
        lambda s: F.transform(
            s["quotes"],
            lambda q: F.when(q["status"].isNotNull(), q["status"]).otherwise(by_words(s["normalized"], q["quote"])),
        ),
    )
    return F.when(F.size(quotes) > 0, checked).otherwise(no_strings())


def quote_checks(rows: DataFrame, code_only: bool = False) -> DataFrame:
    """The evidence check quote by quote, for audits: ``finding_id, quote_no, quote, status``."""
    finding = {name: F.col(name) for name in ("matched_code", "message", "rule_id", "file_path")}
    quotes = F.col("verdict.evidence_quotes")
    statuses = quote_statuses(quotes, haystack(finding, F.col("context"), code_only))
    return rows.select(
        "finding_id", F.posexplode(F.arrays_zip(quotes.alias("quote"), statuses.alias("status"))).alias("pos", "check")
    ).select("finding_id", (F.col("pos") + 1).alias("quote_no"), "check.quote", "check.status")


def quote_issues(label: Column, quotes: Column, statuses: Column) -> Column:
    """Issue texts of the evidence check; an empty list means it passed."""
    issue = F.zip_with(
        F.transform(quotes, lambda quote, i: F.struct(quote.alias("quote"), (i + 1).cast("string").alias("no"))),
        statuses,
        lambda q, status: F.when(status == "empty", F.concat(F.lit("Evidence quote #"), q["no"], F.lit(" is empty.")))
        .when(
            status == "fabricated",
            F.concat(
                F.lit("Evidence quote #"),
                q["no"],
                F.lit(" does not appear verbatim in the code shown to the LLM. Quote: '"),
                q["quote"],
                F.lit("'"),
            ),
        ),
    )
    return F.when((label == FALSE_POSITIVE) & (F.size(quotes) == 0), F.array(F.lit(NO_QUOTES))).otherwise(
        F.filter(issue, lambda text: text.isNotNull())
    )


def cited_tokens(reasoning: Column) -> Column:
    """Identifier-like tokens of a text, in pattern order, deduped."""
    found = [F.regexp_extract_all(reasoning, F.lit(pattern), F.lit(1)) for pattern in TOKEN_PATTERNS]
    return F.array_distinct(F.concat(*found))


def token_appears(token: Column, hay: Column) -> Column:
    """The token, or the part after its last dot, is somewhere in the text."""
    return F.contains(hay, token) | (
        F.contains(token, F.lit(".")) & F.contains(hay, F.substring_index(token, ".", -1))
    )


def suspect_tokens(reasoning: Column, hay: Column, vocabulary: Sequence[str] | None = None) -> Column:
    """Cited tokens that are neither vocabulary nor anywhere in the text shown."""
    words = REVIEW_VOCABULARY if vocabulary is None else list(vocabulary)
    return let(
        F.struct(cited_tokens(reasoning).alias("tokens"), hay.alias("hay")),
        lambda s: F.filter(
            s["tokens"], lambda token: ~F.lower(token).isin(words) & ~token_appears(token, s["hay"])
        ),
    )


def grounding_issues(reasoning: Column, suspects: Column) -> Column:
    text = F.transform(
        suspects,
        lambda token: F.concat(
            F.lit("Reasoning references `"),
            token,
            F.lit("` but this token does not appear in the code or context shown to the LLM."),
        ),
    )
    return F.when(normalize_ws(reasoning) == "", F.array(F.lit(EMPTY_REASONING))).otherwise(text)


def downgrade(verdict: Column, issues: Column) -> dict[str, Column]:
    """Outcome of the evidence check.

    A reply with issues becomes human review with low confidence and no categories, and its label
    is kept as ``original_verdict``. A reply that already asks for review is only flagged.
    """
    failed = F.size(issues) > 0
    lowered = failed & (verdict["verdict"] != NEEDS_HUMAN_REVIEW)
    changed = F.struct(
        F.lit(NEEDS_HUMAN_REVIEW),
        F.lit("low"),
        verdict["reasoning"],
        verdict["evidence_quotes"],
        verdict["missing_context"],
        no_strings(),
        verdict["suggested_action"],
    ).cast(VERDICT)
    return {
        "verdict": F.when(lowered, changed).otherwise(verdict),
        "verification_passed": ~failed,
        "verification_notes": issues,
        "original_verdict": F.when(lowered, verdict["verdict"]),
    }


def verify_replies(
    rows: DataFrame, vocabulary: Sequence[str] | None = None, code_only: bool = False
) -> DataFrame:
    """Check usable replies; unusable ones (``synth_reason`` set) pass with a note.

    ``rows`` carries the finding columns, ``context``, ``verdict`` and ``synth_reason``.
    """
    from winnow.operators.exchange import reply_fallback, reply_note

    usable = F.col("synth_reason").isNull()
    finding = {name: F.col(name) for name in ("matched_code", "message", "rule_id", "file_path")}
    shown = rows.withColumn("_hay", F.when(usable, haystack(finding, F.col("context"), code_only)))
    verdict = F.col("verdict")
    issues = quote_issues(
        verdict["verdict"], verdict["evidence_quotes"], quote_statuses(verdict["evidence_quotes"], F.col("_hay"))
    )
    checked = shown.withColumn("_issues", F.when(usable, issues).otherwise(no_strings())).withColumn(
        "_warnings",
        F.when(
            usable,
            grounding_issues(verdict["reasoning"], suspect_tokens(verdict["reasoning"], F.col("_hay"), vocabulary)),
        ).otherwise(no_strings()),
    )
    outcome = downgrade(verdict, F.col("_issues"))
    reason = F.col("synth_reason")
    return (
        checked.withColumns(
            {
                "_verdict": F.when(usable, outcome["verdict"]).otherwise(reply_fallback(reason)),
                "_original": F.when(usable, outcome["original_verdict"]),
                "verification_passed": F.when(usable, outcome["verification_passed"]).otherwise(F.lit(True)),
                "verification_notes": F.when(usable, F.col("_issues")).otherwise(F.array(reply_note(reason))),
                "advisory_warnings": F.col("_warnings"),
            }
        )
        .withColumn("verdict", F.col("_verdict"))
        .withColumn("original_verdict", F.col("_original"))
        .drop("_hay", "_issues", "_warnings", "_verdict", "_original")
    )
