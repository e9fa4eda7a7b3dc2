"""Vocabularies, nested types and constants of the triage data model."""

from __future__ import annotations

from pyspark.sql import types as T

PROMPT_VERSION = "0.1.0"

# The severities a scan may carry; anything else counts as WARNING.
SEVERITIES = ["INFO", "WARNING", "ERROR", "CRITICAL"]
DEFAULT_SEVERITY = "WARNING"

# Verdict labels, confidences and false-positive categories.
FALSE_POSITIVE = "false_positive"
LIKELY_TRUE_POSITIVE = "likely_true_positive"
NEEDS_HUMAN_REVIEW = "needs_human_review"
VERDICT_LABELS = [FALSE_POSITIVE, LIKELY_TRUE_POSITIVE, NEEDS_HUMAN_REVIEW]
CONFIDENCES = ["low", "medium", "high"]
FP_CATEGORIES = [
    "test_code",
    "sanitized_input",
    "unreachable",
    "third_party",
    "not_user_input",
    "framework_handled",
    "false_pattern_match",
    "other",
]

# How a called function was found.
SAME_FILE = "same_file"
SAME_MODULE_IMPORT = "same_module_import"

# Report order, most actionable first.
VERDICT_RANK = {LIKELY_TRUE_POSITIVE: 0, NEEDS_HUMAN_REVIEW: 1, FALSE_POSITIVE: 2}
SEVERITY_RANK = {"CRITICAL": 0, "ERROR": 1, "WARNING": 2, "INFO": 3}

# Limits and thresholds.
NOISY_MIN_FINDINGS = 5
NOISY_MIN_FP_RATE = 0.8
INPUT_USD_PER_MTOK = 3.0
OUTPUT_USD_PER_MTOK = 15.0

STRINGS = T.ArrayType(T.StringType())

CALLED_FUNCTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("resolution_method", T.StringType()),
    ]
)

CONTEXT = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("matched_code_with_lines", T.StringType()),
        T.StructField("imports", T.StringType()),
        T.StructField("containing_function_name", T.StringType()),
        T.StructField("containing_function_source", T.StringType()),
        T.StructField("containing_function_start_line", T.IntegerType()),
        T.StructField("called_functions", T.ArrayType(CALLED_FUNCTION)),
        T.StructField("extraction_notes", STRINGS),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("verdict", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("evidence_quotes", STRINGS),
        T.StructField("missing_context", STRINGS),
        T.StructField("fp_categories", STRINGS),
        T.StructField("suggested_action", T.StringType()),
    ]
)

SCAN_DOCS = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("repo_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

SOURCE_FILES = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

REPLIES = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("reply", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
    ]
)

# One reviewed finding as the verdict store keeps it.
STORED = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("verdict", VERDICT),
        T.StructField("verification_passed", T.BooleanType()),
        T.StructField("verification_notes", STRINGS),
        T.StructField("advisory_warnings", STRINGS),
        T.StructField("original_verdict", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("stored_at", T.TimestampType()),
    ]
)
