"""Scan documents to findings, rejects and scan errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import variant as V
from winnow.functions.text import line_slice, text_lines
from winnow.schemas import DEFAULT_SEVERITY, SEVERITIES
from winnow.session import few

# What a scanner writes instead of code when the user is not logged in, and the
# summary of a trace without any known part.
REDACTED = "requires login"
UNKNOWN_TRACE = "Dataflow trace present (structure unrecognized)"


# The text goes into a list inside an object, so whatever follows the first value in it is parsed as
# well: another document makes the list longer, anything else makes it invalid.
WRAPPED = "documents array<struct<results array<variant>, errors array<variant>>>, end int, malformed string"


def scan_documents(docs: DataFrame, on_error: str = "quarantine") -> DataFrame:
    """Parse ``text`` into ``doc``, lists of loosely typed results and errors.

    ``doc_error`` tells why a document is unusable; ``on_error='raise'`` fails the job at the first
    such document instead. A text with anything after its document, another one included, is
    unusable as a whole. Only list elements become variants: a variant of a whole document would
    end at 128 MiB and hold parts nobody reads.
    """
    _check(on_error)
    wrapped = F.concat(F.lit('{"documents":['), "text", F.lit('],"end":1}'))
    read = docs.select("scan_id", "repo_id", wrapped.alias("text")).withColumn(
        "read", F.from_json("text", WRAPPED, {"columnNameOfCorruptRecord": "malformed"})
    )
    found = F.col("read.documents")
    parsed = read.select("scan_id", "repo_id", F.get(found, F.lit(0)).alias("doc"), F.size(found).alias("n"), "read.end", "text")
    usable = F.coalesce(F.col("doc.results").isNotNull() & (F.col("n") == 1) & (F.col("end") == 1), F.lit(False))
    # Columns of their own: an unusable text is parsed once more, not once for every question that is asked about it.
    asked = parsed.withColumn("whole", F.when(~usable, F.try_parse_json("text"))).withColumn("first", V.child(F.col("whole"), "$.documents[0]"))
    whole, first = F.col("whole"), F.col("first")
    why = (
        F.when(whole.isNull() | first.isNull() | V.child(whole, "$.end").isNull(), F.lit("not valid JSON"))
        .when(V.child(whole, "$.documents[1]").isNotNull(), F.lit("more than one JSON document"))
        .when(~V.is_object(first), F.lit("not a JSON object"))
        .when(V.child(first, "$.results").isNull(), F.lit("no top-level results"))
        .otherwise(F.lit("results is not a list"))
    )
    error = F.when(~usable, why)
    return raise_for_documents(asked.withColumn("doc_error", error).drop("text", "n", "end", "whole", "first"), on_error)


def _check(on_error: str) -> None:
    if on_error not in ("quarantine", "raise"):
        raise ValueError(f"on_error must be 'quarantine' or 'raise', got {on_error!r}")


def raise_for_documents(documents: DataFrame, on_error: str) -> DataFrame:
    """The documents; ``on_error='raise'`` fails the job that reads an unusable one."""
    _check(on_error)
    if on_error == "quarantine":
        return documents
    message = F.concat(F.lit("scan "), F.col("scan_id"), F.lit(": "), F.col("doc_error"))
    return documents.withColumn("doc_error", F.when(F.col("doc_error").isNotNull(), F.raise_error(message).cast("string")))


def scan_file_rejects(parsed: DataFrame) -> DataFrame:
    """Unusable documents with the reason; as in :func:`raw_results` no filter that would parse every text twice."""
    reasons = F.when(F.col("doc_error").isNotNull(), F.array("doc_error"))
    return parsed.select("scan_id", "repo_id", F.explode(reasons).alias("reason"))


def raw_results(parsed: DataFrame) -> DataFrame:
    """One row per entry of ``results`` with its position.

    Unusable documents have no list to explode. A filter on ``doc_error`` instead would be pushed
    below the parse and parse every document twice.
    """
    usable = F.when(F.col("doc_error").isNull(), F.col("doc.results"))
    return parsed.select("scan_id", "repo_id", F.posexplode(usable).alias("result_idx", "result"))


def scan_errors(parsed: DataFrame) -> DataFrame:
    """What the scanner could not read: ``path: first line of the message`` per error object."""
    return describe_errors(parsed.select("scan_id", "repo_id", F.posexplode("doc.errors").alias("error_idx", "error")))


def describe_errors(errors: DataFrame) -> DataFrame:
    """Path, first line of the message and both in one, for each entry that is an object."""
    errors = errors.filter(V.is_object(F.col("error")))
    path = F.coalesce(V.display(V.child(F.col("error"), "$.path")), F.lit("<unknown>"))
    message = F.coalesce(V.display(V.child(F.col("error"), "$.message")), F.lit("Unknown error"))
    return errors.select(
        "scan_id", "repo_id", "error_idx", path.alias("path"), F.substring_index(message, "\n", 1).alias("message")
    ).withColumn("summary", F.concat_ws(": ", "path", "message"))


# One read of an object gives all its members that are looked at, each as it stands.
RESULT = "struct<check_id variant, path variant, start variant, end variant, extra variant>"
POSITION = "struct<line variant, col variant>"
EXTRA = "struct<message variant, severity variant, lines variant, dataflow_trace variant, metadata variant>"
METADATA = "struct<cwe variant, owasp variant, confidence variant>"
TRACE = "struct<taint_source variant, taint_sink variant, intermediate_vars variant>"


def parse_results(results: DataFrame) -> DataFrame:
    """Map raw results to the finding columns; ``reject_reason`` is set where a result is malformed."""
    r = F.col("result")
    parts = results.withColumn("r", V.members_of(r, RESULT))
    parts = parts.withColumns({n: V.members_of(F.col(f"r.{n}"), POSITION) for n in ("start", "end")} | {"x": V.members_of(F.col("r.extra"), EXTRA)})
    parts = parts.withColumns({"m": V.members_of(F.col("x.metadata"), METADATA), "t": V.members_of(F.col("x.dataflow_trace"), TRACE)})
    strings = {"rule_id": "r.check_id", "raw_path": "r.path", "severity_text": "x.severity", "text": "x.message", "embedded_lines": "x.lines", "scanner_confidence": "m.confidence"}
    numbers = {"start_line": "start.line", "end_line": "end.line", "start_col": "start.col", "end_col": "end.col"}
    typed = parts.withColumns(
        {
            **{name: V.whole_number(F.col(value)) for name, value in numbers.items()},
            **{name: V.string(F.col(value)) for name, value in strings.items()},
            "traced": V.is_truthy(F.col("x.dataflow_trace")),
        }
    )

    def v(name: str) -> Column:
        return F.col(name)

    def not_object(value: str, members: str) -> Column:
        """Present, but no object."""
        return v(value).isNotNull() & v(members).isNull()

    def not_string(value: str, text: str) -> Column:
        return ~V.is_absent(v(value)) & v(text).isNull()

    severity = V.kind(v("x.severity"))
    checks: list[tuple[Column, str]] = [
        (v("r").isNull(), "result is not an object"),
        (v("rule_id").isNull(), "check_id missing or not a string"),
        (v("raw_path").isNull(), "path missing or not a string"),
        (not_object("r.extra", "x"), "extra is not an object"),
        (not_object("x.metadata", "m"), "metadata is not an object"),
        *[(v(name).isNull(), f"{name} missing or not a whole number") for name in ("start_line", "end_line")],
        *[(v(name) < 1, f"{name} below 1") for name in ("start_line", "end_line")],
        *[
            (~V.is_absent(v(numbers[name])) & v(name).isNull(), f"{name} not a whole number")
            for name in ("start_col", "end_col")
        ],
        (V.is_null(v("x.message")) | not_string("x.message", "text"), "message not a string"),
        (severity.startswith("ARRAY") | severity.startswith("OBJECT"), "severity not a string"),
        (not_string("m.confidence", "scanner_confidence"), "confidence not a string"),
        (v("traced") & v("t").isNull(), "dataflow_trace is not an object"),
    ]
    reject = F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in checks])
    return typed.withColumn("reject_reason", reject).select(
        "scan_id",
        "repo_id",
        "result_idx",
        "rule_id",
        normalize_path(v("raw_path")).alias("file_path"),
        "start_line",
        "end_line",
        "start_col",
        "end_col",
        F.coalesce("text", F.lit("")).alias("message"),
        F.when(v("severity_text").isin(SEVERITIES), v("severity_text")).otherwise(DEFAULT_SEVERITY).alias("severity"),
        F.coalesce("severity_text", F.when(~V.is_absent(v("x.severity")), F.to_json("x.severity"))).alias("severity_raw"),
        V.string_list(v("m.cwe")).alias("cwe"),
        V.string_list(v("m.owasp")).alias("owasp"),
        "embedded_lines",
        (~V.is_absent(v("x.dataflow_trace"))).alias("has_dataflow_trace"),
        F.when(v("traced"), summarize_trace(v("t"))).alias("dataflow_trace_summary"),
        "scanner_confidence",
        "reject_reason",
        F.when(v("reject_reason").isNotNull(), F.to_json(r)).alias("raw"),
    )


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def summarize_trace(trace: Column) -> Column:
    """Source, sink and number of steps of a data-flow trace, given as its ``TRACE`` members."""
    source, sink, steps = trace["taint_source"], trace["taint_sink"], trace["intermediate_vars"]
    kind = V.kind(steps)
    count = (
        F.when(kind == "STRING", F.length(F.try_variant_get(steps, "$", "string")))
        .when(kind.startswith("ARRAY"), F.size(V.items(steps)))
        .when(kind.startswith("OBJECT"), F.size(V.members(steps)))
    )
    text = F.concat_ws(
        " | ",
        F.when(V.is_truthy(source), F.concat(F.lit("Source: "), V.display(source))),
        F.when(V.is_truthy(sink), F.concat(F.lit("Sink: "), V.display(sink))),
        F.when(V.is_truthy(steps), F.concat(F.lit("Intermediate steps: "), count.cast("string"))),
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN_TRACE))


def valid_findings(parsed: DataFrame) -> DataFrame:
    key = F.concat_ws("#", "scan_id", F.col("result_idx").cast("string"))
    return parsed.filter("reject_reason IS NULL").drop("reject_reason", "raw").withColumn("finding_id", key)


def scan_rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason IS NOT NULL").select(
        "scan_id", "repo_id", "result_idx", F.col("reject_reason").alias("reason"), "raw"
    )


def resolve_matched_code(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``matched_code``: the embedded lines, or the file's lines where those are redacted.

    Findings with embedded lines stay out of the join. The others are reduced to distinct spans
    before they meet files, and only files that some span names take part, so a file with most of
    the findings is cut up once per span.
    """
    embedded = F.col("embedded_lines")
    redacted = embedded.isNull() | embedded.isin("", REDACTED)
    as_given = findings.filter(~redacted).withColumn("matched_code", embedded)
    to_read = findings.filter(redacted)

    file, span = ["repo_id", "file_path"], ["repo_id", "file_path", "start_line", "end_line"]
    spans = to_read.select(*span).distinct()
    named = files.withColumnRenamed("path", "file_path")
    texts = named.join(few(spans.select(*file)), file, "left_semi").select(
        *file, text_lines(F.col("text")).alias("_lines")
    )
    found = F.array_join(line_slice(F.col("_lines"), F.col("start_line"), F.col("end_line")), "\n")
    unread = F.concat(F.lit("<could not read file: "), F.col("file_path"), F.lit(">"))
    code = spans.join(texts, file, "left").select(*span, F.coalesce(found, unread).alias("matched_code"))
    return as_given.unionByName(to_read.join(code, span, "left")).drop("embedded_lines")


def mark_processable(findings: DataFrame) -> DataFrame:
    """Only ``.py`` findings go on to the code context and the reviewer."""
    return findings.withColumn("processable", F.col("file_path").endswith(".py"))


def limit_per_scan(findings: DataFrame, limit: int) -> DataFrame:
    """Keep the first ``limit`` processable findings of each scan and all the others.

    The rank is bounded, so Spark drops rows above it before the shuffle as well: a scan that
    holds most of the table sends at most ``limit`` rows per task to its window.
    """
    order = Window.partitionBy("scan_id").orderBy("result_idx")
    kept = (
        findings.filter("processable")
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .drop("_n")
    )
    return kept.unionByName(findings.filter("NOT processable"))
