"""Every operator as a query over the whole given tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import ordering, text
from winnow.operators import codeindex as C
from winnow.operators import exchange as X
from winnow.operators import ingest as I
from winnow.operators import large_scans as L
from winnow.operators import report as P
from winnow.operators import reuse as R
from winnow.operators import verify as V
from winnow.operators.context import CodeIndex, build_contexts, enclosing_functions
from winnow.plans import corpus as D
from winnow.plans import triage as T
from winnow.schemas import PROMPT_VERSION, REPLIES, STORED
from winnow.session import TEXTS, remove, stage, staging_folder
from winnow.sources.readers import read_replies, read_report_documents, read_scan_pieces, read_source_tree
from winnow.sources.sinks import write_report_documents, write_requests

Query = Callable[[SparkSession, str], DataFrame]

NOISY_RATE = 0.35
REPORT_TIME = "2024-01-02 03:04:05"


# -- scans -----------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as a run does: filters on what was parsed do not parse again."""
    return stage(I.parse_results(I.raw_results(I.scan_documents(D.scan_docs(spark, sf_dir)))))


def finding_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.valid_findings(_parsed(spark, sf_dir))
    return found.select(
        "scan_id",
        "result_idx",
        "rule_id",
        "file_path",
        "start_line",
        "end_line",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("start_col", "end_col")],
        "message",
        "severity",
        "severity_raw",
        F.array_join("cwe", ";").alias("cwe"),
        F.array_join("owasp", ";").alias("owasp"),
        "embedded_lines",
        "has_dataflow_trace",
        "dataflow_trace_summary",
        "scanner_confidence",
    )


def scan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of scan files that hold all documents of a source, read in chunks of 1 MB."""
    folder = _folder(spark, "scans")
    D.write_source_scans(spark, sf_dir, folder)
    pieces = read_scan_pieces(spark, folder, D.REPO)
    # The files were made for this query, and have been read.
    remove(spark, folder)
    scans = L.assemble(pieces)
    found = I.valid_findings(stage(I.parse_results(scans.results), TEXTS))
    return found.select(
        F.regexp_extract("scan_id", "source=([^/]*)", 1).alias("source"),
        "result_idx",
        "rule_id",
        "file_path",
        "start_line",
        "message",
        "severity",
        F.array_join("cwe", ";").alias("cwe"),
        "embedded_lines",
        "dataflow_trace_summary",
    )


def finding_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scan_rejects(_parsed(spark, sf_dir)).select("scan_id", "result_idx", "reason")


def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scan_errors(I.scan_documents(D.scan_docs(spark, sf_dir))).select(
        "scan_id", "error_idx", "path", "message", "summary"
    )


def scan_file_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties and plain texts are no scans; scans among them must not be rejected."""
    props = D.table(spark, sf_dir, "events").select(
        F.concat(F.lit("event"), "event_id").alias("scan_id"), F.lit("events").alias("repo_id"), F.col("props").alias("text")
    )
    texts = D.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("text"), "doc_id").alias("scan_id"), F.lit("texts").alias("repo_id"), "text"
    )
    # Each scan is made once; what becomes of it as "twice" and "junk" is put together per row.
    kinds = F.explode(F.array(*[F.lit(kind) for kind in ("", "twice", "junk")])).alias("kind")
    scans = D.scan_docs(spark, sf_dir).select("scan_id", "repo_id", "text", kinds)
    between = F.when(F.col("scan_id").rlike("[02468]$"), F.lit("\n")).otherwise(F.lit(","))
    body = (
        F.when(F.col("kind") == "twice", F.concat("text", between, "text"))
        .when(F.col("kind") == "junk", F.concat("text", F.lit(" junk }")))
        .otherwise(F.col("text"))
    )
    scans = scans.select(F.concat("kind", "scan_id").alias("scan_id"), "repo_id", body.alias("text"))
    return I.scan_file_rejects(I.scan_documents(props.unionByName(texts).unionByName(scans)))


def matched_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.valid_findings(_parsed(spark, sf_dir))
    return I.resolve_matched_code(found, D.text_files(spark, sf_dir)).select("scan_id", "result_idx", "matched_code")


def language_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.mark_processable(I.valid_findings(_parsed(spark, sf_dir)))
    fallback = X.route_fallback(
        F.when(~F.col("processable"), "unsupported_language"), F.col("file_path"), F.lit(None).cast("string")
    )
    return found.select(
        "scan_id",
        "result_idx",
        "processable",
        fallback["verdict"].alias("verdict"),
        fallback["reasoning"].alias("reasoning"),
        fallback["suggested_action"].alias("suggested_action"),
    )


def limit_per_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.mark_processable(I.valid_findings(_parsed(spark, sf_dir)))
    return I.limit_per_scan(found, 3).select("scan_id", "result_idx", "processable")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.documents(spark, sf_dir)
    shown = text.numbered(text.text_lines(F.col("text")), F.col("n_chars").cast("int"))
    return docs.select("doc_id", shown.alias("numbered"), text.strip_line_prefixes(shown).alias("stripped"))


# -- code context ----------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.file_lines(D.code_tree(spark, sf_dir))


def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.functions(C.blocks(C.logical_lines(_lines(spark, sf_dir))))
    return found.select("path", "name", "start_line", "end_line", "indent", F.size("chain").alias("depth"), "scope")


def enclosing_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = D.code_findings(spark, sf_dir)
    spans = findings.select("repo_id", F.col("file_path").alias("path"), "start_line", "end_line")
    found = enclosing_functions(spans, stage(C.functions(C.blocks(C.logical_lines(_lines(spark, sf_dir))))))
    keys = ["repo_id", "file_path", "start_line", "end_line"]
    return findings.join(found.withColumnRenamed("path", "file_path"), keys, "left").select(
        "finding_id", "function_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("function_start", "function_end")]
    )


def syntax_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter("problem IS NOT NULL").select("path", "problem")


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: the few lines that are needed are read twice, the files they come from are masked once.
    heads = stage(C.import_heads(_lines(spark, sf_dir)))
    return C.import_statements(C.logical_lines(heads), heads)


def imports_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.imports_text(_imports(spark, sf_dir)).select("path", "imports")


def imports_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.imports_map(_imports(spark, sf_dir)).select("path", "name", "module", "target")


def _index(spark: SparkSession, sf_dir: str) -> CodeIndex:
    findings = D.code_findings(spark, sf_dir)
    spans = findings.select("repo_id", F.col("file_path").alias("path"), "start_line", "end_line")
    return CodeIndex(spans, D.code_tree(spark, sf_dir))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    found = C.functions(C.blocks(C.logical_lines(lines)))
    code = F.array_join(C.source_between(F.col("masked_lines"), F.col("start_line"), F.col("end_line")), "\n")
    return found.join(lines, C.FILE).select(
        "path", "start_line", F.posexplode(C.call_names(code)).alias("call_no", "name")
    )


def import_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the calls of each function around a finding are defined."""
    found = _index(spark, sf_dir).calls.filter("def_path IS NOT NULL")
    return found.select(
        "path", "function_start", "call_no", "name", "def_path", "def_start", "def_end", "resolution_method"
    )


def unresolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _index(spark, sf_dir).calls.filter("def_path IS NULL")
    return found.select("path", "function_start", "call_no", "name")


def code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = build_contexts(D.code_findings(spark, sf_dir), D.code_tree(spark, sf_dir))
    c = F.col("context")
    return found.select(
        "finding_id",
        c["matched_code_with_lines"].alias("matched"),
        c["imports"].alias("imports"),
        c["containing_function_name"].alias("function_name"),
        c["containing_function_source"].alias("function_source"),
        F.coalesce(c["containing_function_start_line"], F.lit(0)).alias("function_start"),
        F.array_join(F.transform(c["called_functions"], lambda f: F.concat_ws("@", f["name"], f["file_path"])), ";").alias(
            "callees"
        ),
        F.array_join(F.transform(c["called_functions"], lambda f: f["source"]), "\n").alias("callee_sources"),
        F.array_join(c["extraction_notes"], ";").alias("notes"),
    )


# -- exchange --------------------------------------------------------------------------------------


def request_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.doc_findings(spark, sf_dir).select("doc_id", X.request_text().alias("request"))


def request_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are made once per fingerprint, with the instruction text of their version."""
    rows = R.add_fingerprint(D.doc_findings(spark, sf_dir))
    requests = X.build_requests(rows, X.instructions(spark, "Decide."))
    return requests.select("fingerprint", "prompt_version", "instructions", "request")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies for all documents: some valid, some malformed, late or missing."""
    rows = D.doc_findings(spark, sf_dir).join(D.table(spark, sf_dir, "labels"), "doc_id", "left")
    reply = F.struct(
        D.verdict_label().alias("verdict"),
        F.when(F.size("lines") == 1, "certain").when(F.col("n_chars") > 2000, "high").otherwise("low").alias("confidence"),
        F.element_at("lines", 1).alias("reasoning"),
        F.when(F.col("toxic") == 1, F.lit("")).alias("evidence_text"),
        F.when(F.col("toxic") == 0, F.col("lines")).alias("evidence_list"),
        F.when(F.col("source") == "src1", F.array(F.lit("nonsense"))).otherwise(F.array(F.lit("other"))).alias("fp_categories"),
        F.when(F.col("lang") != "es", F.lit("Act.")).alias("suggested_action"),
    )
    body = F.to_json(reply)
    for spelling in ("evidence_text", "evidence_list"):
        body = F.replace(body, F.lit(f'"{spelling}":'), F.lit('"evidence_quotes":'))
    return rows.select(
        F.col("finding_id").alias("fingerprint"),
        F.when(F.col("quality").isNotNull(), body).alias("reply"),
        F.when((F.col("lang") == "de") & F.col("quality").isNull(), "Timeout").alias("error"),
        (F.col("n_chars") / 100).alias("duration_seconds"),
        F.col("n_chars").alias("input_tokens"),
        F.size("lines").cast("long").alias("output_tokens"),
    ).select(*REPLIES.fieldNames())


def reply_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(replies(spark, sf_dir))


def reply_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replies by way of the JSON lines that a reviewer writes."""
    folder = _folder(spark, "replies")
    replies(spark, sf_dir).write.json(folder)
    return _validated(read_replies(spark, folder))


def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests by way of the JSON lines that a reviewer reads."""
    folder = _folder(spark, "requests")
    work = R.add_fingerprint(D.doc_findings(spark, sf_dir))
    write_requests(X.build_requests(work, X.instructions(spark, "Decide.")), folder)
    return spark.read.json(folder).select("fingerprint", "prompt_version", "instructions", "request")


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as the files of a tree, a repository for each source, and read as one."""
    folder = _folder(spark, "tree")
    docs = D.table(spark, sf_dir, "documents").select(F.col("source"), F.col("lang"), F.col("text").alias("value"))
    docs.write.partitionBy("source", "lang").text(folder)
    files = read_source_tree(spark, folder, glob="part-*")
    return files.groupBy("repo_id", F.substring_index("path", "/", 1).alias("folder")).agg(
        F.sum("length").alias("bytes"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"),
    )


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/winnow-stage-{name}-{uuid.uuid4().hex}"


def _validated(given: DataFrame) -> DataFrame:
    parsed = X.parse_reply(given)
    reason = F.col("synth_reason")
    verdict = F.coalesce("verdict", X.reply_fallback(reason))
    return parsed.select(
        "fingerprint",
        verdict["verdict"].alias("verdict"),
        verdict["confidence"].alias("confidence"),
        verdict["reasoning"].alias("reasoning"),
        F.size(verdict["evidence_quotes"]).alias("n_quotes"),
        F.array_join(verdict["missing_context"], ";").alias("missing"),
        F.array_join(verdict["fp_categories"], ";").alias("categories"),
        verdict["suggested_action"].alias("suggested_action"),
        "synth_reason",
        X.reply_note(reason).alias("note"),
        "input_tokens",
    )


# -- verification ----------------------------------------------------------------------------------


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.labelled(spark, sf_dir).withColumn("synth_reason", F.when(~F.col("has_label"), F.lit("no_tool_use")))
    return V.verify_replies(rows)


def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.labelled(spark, sf_dir)
    finding = {name: F.col(name) for name in ("matched_code", "message", "rule_id", "file_path")}
    quotes = F.col("verdict.evidence_quotes")
    status = V.quote_statuses(quotes, V.haystack(finding, F.col("context")))
    issues = V.quote_issues(F.col("verdict.verdict"), quotes, F.col("status"))
    return rows.withColumn("status", status).select(
        "doc_id", F.array_join("status", ";").alias("statuses"), F.array_join(issues, "\n").alias("issues")
    )


def quote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.quote_checks(D.labelled(spark, sf_dir))


def quote_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a quote from the document of the same number; others quote themselves."""
    turns = D.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "text").agg(F.count("*").alias("copies"))
    docs = D.documents(spark, sf_dir).select("doc_id", F.col("text").alias("hay"))
    found = docs.join(turns, F.col("conv_id") == F.col("doc_id"), "left")
    found = found.withColumn("quote", F.coalesce("text", F.substring_index("hay", ".", 1)))
    found = found.withColumn("normalized", text.normalize_texts(F.col("hay")))
    return found.select(
        "doc_id",
        F.coalesce("turn", F.lit(-1)).alias("turn"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        V.quote_statuses(F.array("quote", F.substring_index("hay", ".", 2)), F.col("hay"), F.col("normalized"))[0].alias("turn_status"),
        V.quote_statuses(F.array("normalized"), F.col("hay"), F.col("normalized"))[0].alias("own_status"),
        F.length(text.normalize_ws(F.col("quote"))).alias("normalized_length"),
    )


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup of the page of the same number and names in backticks as reasoning about every document.

    Spanish documents get none. Letters outside ASCII are folded to ``e``, so that every engine sees the same word borders.
    """
    pages = D.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("html", r"[^\x00-\x7f]", "e").alias("reasoning")
    )
    docs = D.documents(spark, sf_dir).select("doc_id", "lang", F.col("text").alias("hay"))
    names = F.concat(F.lit(" `made_up_"), F.length("hay").cast("string"), F.lit("` and `ref_x` and `the` "))
    said = F.when(F.col("lang") == "es", "").otherwise(F.concat(F.coalesce("reasoning", F.lit("")), names))
    found = docs.join(pages, F.col("page_id") == F.col("doc_id"), "left").withColumn("reasoning", said)
    suspects = V.suspect_tokens(F.col("reasoning"), F.col("hay"), ["div", "class_name", "page_id", "example", "this", "ref_x"])
    return found.select(
        "doc_id",
        F.size(V.cited_tokens(F.col("reasoning"))).alias("n_tokens"),
        F.array_join(F.sort_array(suspects), " ").alias("suspects"),
    )


def downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select(
        "doc_id",
        F.col("verdict.verdict").alias("verdict"),
        F.col("verdict.confidence").alias("confidence"),
        F.array_join("verdict.fp_categories", ";").alias("categories"),
        "verification_passed",
        "original_verdict",
        F.size("verification_notes").alias("n_notes"),
        F.array_join("advisory_warnings", ";").alias("advisory"),
    )


# -- reuse -----------------------------------------------------------------------------------------


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document findings after an edit of their whitespace."""
    rows = D.doc_findings(spark, sf_dir).withColumns(
        {
            "matched_code": F.replace("matched_code", F.lit(" "), F.lit("\t  ")),
            "function_text": F.concat(F.lit("\n"), "function_text", F.lit("  ")),
        }
    )
    return R.add_fingerprint(rows)


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = R.add_fingerprint(D.doc_findings(spark, sf_dir)).select("doc_id", "fingerprint")
    after = _current(spark, sf_dir).select("doc_id", F.col("fingerprint").alias("edited"))
    return before.join(after, "doc_id")


def reuse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = R.usable_entries(D.stored_docs(spark, sf_dir))
    found = R.reuse_verdicts(_current(spark, sf_dir), store)
    return found.select(
        "doc_id",
        "fingerprint",
        "from_cache",
        F.col("stored.verdict.verdict").alias("verdict"),
        F.col("stored.verdict.reasoning").alias("reasoning"),
        F.coalesce("stored.input_tokens", F.lit(0)).alias("input_tokens"),
    )


def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = R.work_list(_current(spark, sf_dir), D.stored_docs(spark, sf_dir))
    return misses.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("findings"))


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.upsert(D.stored_docs(spark, sf_dir), _fresh(spark, sf_dir)))


def store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of a store that two runs have written to and that was compacted then."""
    folder = _folder(spark, "store")
    R.write_store(spark, f"{folder}/runs", D.stored_docs(spark, sf_dir))
    R.write_store(spark, f"{folder}/runs", _fresh(spark, sf_dir))
    R.compact_store(spark, f"{folder}/runs", f"{folder}/compact")
    return _shown(R.read_store(spark, f"{folder}/compact"))


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over the French documents finds in a compacted store that another run has appended to."""
    folder = _folder(spark, "store")
    R.write_store(spark, f"{folder}/runs", D.stored_docs(spark, sf_dir))
    R.compact_store(spark, f"{folder}/runs", f"{folder}/compact", folder_entries=1000)
    R.write_store(spark, f"{folder}/compact", _fresh(spark, sf_dir))
    return _shown(R.lookup_store(spark, f"{folder}/compact", _current(spark, sf_dir).where("lang = 'fr'")))


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as fresh verdicts on the documents of the same number, the last one wins."""
    turns = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("said"))
    rows = R.add_fingerprint(D.labelled(spark, sf_dir)).join(turns, "doc_id")
    return rows.select(
        "fingerprint",
        F.col("verdict").withField("reasoning", F.col("said")).alias("verdict"),
        F.lit(False).alias("verification_passed"),
        F.col("verdict.missing_context").alias("verification_notes"),
        F.col("verdict.fp_categories").alias("advisory_warnings"),
        F.lit(None).cast("string").alias("original_verdict"),
        F.lit(2.5).alias("duration_seconds"),
        F.length("said").cast("long").alias("input_tokens"),
        F.lit(1).cast("long").alias("output_tokens"),
        F.timestamp_seconds(F.lit(1_800_000_000) + F.col("doc_id") * 100 + F.col("turn")).alias("stored_at"),
    ).select(*STORED.fieldNames())


def _shown(store: DataFrame) -> DataFrame:
    return store.select(
        "fingerprint",
        F.col("verdict.verdict").alias("verdict"),
        F.col("verdict.reasoning").alias("reasoning"),
        "verification_passed",
        "input_tokens",
        F.unix_timestamp("stored_at").alias("stored_at"),
    )


# -- report ----------------------------------------------------------------------------------------


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what the counts need: the text columns of the documents are never read."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = D.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("lang").alias("run_id"),
        F.concat(F.lit("rule."), "source").alias("rule_id"),
        D.verdict_label().alias("verdict"),
        D.severity_of(F.col("n_chars")).alias("severity"),
        D.extension(F.col("lang")).endswith(".py").alias("processable"),
        F.col("doc_id").alias("input_idx"),
    )


def rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.order_rules(P.rule_stats(_verdicts(spark, sf_dir)))
    return stats.withColumn("fp_percent", P.fp_percent(F.col("fp_rate")))


def noisy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.noisy_rules(P.rule_stats(_verdicts(spark, sf_dir)), min_fp_rate=NOISY_RATE)
    return stats.select("run_id", "rule_id", "false_positive", "total", P.fp_percent(F.col("fp_rate")).alias("fp_percent"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.verdict_counts(_verdicts(spark, sf_dir))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: values are seconds and tokens, the JSON property output tokens."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = D.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        F.floor(F.col("value")).cast("long").alias("input_tokens"),
        k.alias("output_tokens"),
        (F.col("value") >= 20).alias("from_cache"),
        F.col("value").alias("duration_seconds"),
    )
    totals = P.usage_totals(rows)
    return totals.select(
        *[c for c in totals.columns if c != "review_seconds"],
        F.round("review_seconds", 2).alias("review_seconds"),
    )


def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = usage(spark, sf_dir)
    return totals.select(
        "run_id",
        F.round(P.estimate_cost(F.col("total_input_tokens"), F.col("total_output_tokens")), 6).alias("cost"),
        F.coalesce(P.hit_rate(F.col("cache_hits"), F.col("cache_misses")), F.lit(-1)).alias("hit_rate"),
    )


def actionable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.number_findings(_verdicts(spark, sf_dir)).select("run_id", "doc_id", "finding_no")


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbering with small chunks, so that every group spans many of them."""
    lines = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber"
    )
    index = (F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("long")
    rows = lines.withColumn("idx", index)
    return ordering.number_rows(rows, ["flag"], ["day"], "idx", "row_no", chunk_rows=1000).select(
        "flag", "l_orderkey", "l_linenumber", "row_no"
    )


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished run, written as one is: several report parts read it."""
    usable = F.col("synth_reason").isNull()
    rows = _checked(spark, sf_dir).withColumns(
        {
            "from_cache": (F.col("lang") == "fr") & usable,
            "input_tokens": F.when(usable, F.col("n_chars")),
            "output_tokens": F.when(usable, F.size("lines").cast("long")),
            "duration_seconds": F.lit(0.5),
        }
    )
    return stage(rows.drop("text", "lines", "matched_code", "function_text", "context"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = D.table(spark, sf_dir, "documents").select(F.col("source").alias("run_id")).distinct()
    return sources.select(
        "run_id",
        F.lit(REPORT_TIME).cast("timestamp").alias("generated_at"),
        F.lit("0.1.0").alias("tool_version"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        F.lit("reviewer-1").alias("model"),
        F.concat(F.lit("/repos/"), "run_id").alias("repo_path"),
        F.concat(F.lit("/scans/"), "run_id", F.lit(".json")).alias("findings_path"),
        F.length("run_id").cast("double").alias("total_duration_seconds"),
    )


def _run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan error per Spanish text."""
    return D.table(spark, sf_dir, "documents").filter("lang = 'es'").select(F.col("source").alias("run_id"))


def _report_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    triaged = _triaged(spark, sf_dir)
    summary = P.run_summary(triaged, _run_errors(spark, sf_dir), _runs(spark, sf_dir))
    stats = P.rule_stats(triaged.withColumn("verdict", F.col("verdict.verdict")))
    return triaged, summary, stats


REPORT_RENDERED = ("generated_at", "hit_rate_percent", "estimated_cost")


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each run beside each of its rules."""
    _, summary, stats = _report_parts(spark, sf_dir)
    rules = P.run_rules(stats, min_fp_rate=NOISY_RATE)
    report = summary.join(rules.select("run_id", "rule_no", "rule_id", "total", "false_positive", "noisy"), "run_id", "left")
    return report.select(
        *[c for c in report.columns if c not in REPORT_RENDERED],
        F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
        F.coalesce("hit_rate_percent", F.lit(-1)).alias("hit_rate_percent"),
        F.round("estimated_cost", 6).alias("estimated_cost"),
    )


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report of each run, written as files and parsed back piece by piece: a row per finding."""
    triaged, summary, stats = _report_parts(spark, sf_dir)
    rules = stage(P.run_rules(stats, min_fp_rate=NOISY_RATE))
    errors = D.table(spark, sf_dir, "documents").filter("lang = 'es'")
    errors = errors.select(F.col("source").alias("run_id"), F.col("doc_id").alias("error_idx"), F.col("text").alias("summary"))
    kept = triaged.select("run_id", "finding_id", "input_idx", "rule_id", "message", "verdict", "verification_notes")
    folder = _folder(spark, "report")
    write_report_documents(P.report_fragments(summary, rules, errors, kept), folder, files=7)
    report = read_report_documents(spark, folder)
    heads = report.head.select("run_id", _parsed_as(F.concat(F.col("json"), F.lit("]}")), "total_findings long")["total_findings"].alias("total_findings"))
    rule = _parsed_as(F.col("json"), "rule_id string, total long")
    # a run's rules are as many as its scanner has
    listed = report.elements.filter("key = 'rule_stats'").select("run_id", "order", F.concat_ws(":", rule["rule_id"], rule["total"]).alias("said"))
    tuning = report.elements.filter("key = 'rules_to_consider_tuning'").select("run_id", "order", _text_of("json").alias("said"))
    errors = report.elements.filter("key = 'scan_errors'").select("run_id", "order", _text_of("json").alias("said"))
    runs = (
        heads.join(_joined(listed, "rules"), "run_id", "left")
        .join(_joined(tuning, "tuning"), "run_id", "left")
        .join(P.hash_in_order(errors, "errors"), "run_id", "left")
        .select("run_id", "total_findings", *[F.coalesce(c, F.lit("")).alias(c) for c in ("rules", "tuning")], F.coalesce("errors", F.sha2(F.lit(""), 256)).alias("errors"))
    )
    shape = (
        "finding_id string, message string, "
        "verdict struct<verdict string, evidence_quotes array<string>>, verification_notes array<string>"
    )
    found = report.elements.filter("key = 'triaged_findings'").select("run_id", "place", _parsed_as(F.col("json"), shape).alias("f"))
    return found.join(runs, "run_id").select(
        "run_id", "total_findings", "rules", "tuning", "errors", "place",
        "f.finding_id",
        "f.message",
        F.col("f.verdict.verdict"),
        F.array_join("f.verdict.evidence_quotes", "\n").alias("quotes"),
        F.array_join("f.verification_notes", "\n").alias("notes"),
    )


def _parsed_as(body, shape: str):
    return F.from_json(body, shape, {"mode": "FAILFAST"})


def _text_of(name: str):
    return F.get(_parsed_as(F.concat(F.lit('{"v":['), name, F.lit("]}")), "v array<string>")["v"], F.lit(0))


def _joined(said: DataFrame, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("order", "said")))
    return said.filter("said IS NOT NULL").groupBy("run_id").agg(F.array_join(F.transform(ordered, lambda s: s["said"]), ";").alias(name))


def finding_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.finding_markdown(_triaged(spark, sf_dir))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    triaged, summary, stats = _report_parts(spark, sf_dir)
    return P.report_blocks(summary, P.finding_markdown(triaged), stats, min_fp_rate=NOISY_RATE)


# -- whole runs ------------------------------------------------------------------------------------


def _code_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan per document with the findings of the generated module and one on a page beside it."""
    rows = D.documents(spark, sf_dir)
    inner = D.first_function_line() + 2

    def result(line, i):
        start = inner + i * 6
        return F.struct(
            F.concat(F.lit("rule."), "lang").alias("check_id"),
            D.code_path().alias("path"),
            F.struct(start.alias("line")).alias("start"),
            F.struct(F.when(line.endswith("."), start).otherwise(start + 3).alias("line")).alias("end"),
            F.struct(line.alias("message"), F.lit("ERROR").alias("severity")).alias("extra"),
        )

    page = F.struct(
        F.lit("rule.page").alias("check_id"),
        F.concat("source", F.lit("/page.html")).alias("path"),
        F.struct(F.lit(1).alias("line")).alias("start"),
        F.struct(F.lit(1).alias("line")).alias("end"),
        F.struct(F.lit("page").alias("message"), F.lit("INFO").alias("severity")).alias("extra"),
    )
    body = F.to_json(F.struct(F.concat(F.transform("lines", result), F.array(page)).alias("results")))
    return rows.select(F.concat(F.lit("scan"), "doc_id").alias("scan_id"), F.lit(D.REPO).alias("repo_id"), body.alias("text"))


def triage_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans to triaged findings: the first function of a text is quoted right, others are made up."""
    prepared = T.prepare(_code_scans(spark, sf_dir), D.code_tree(spark, sf_dir))
    sent = prepared.findings.filter("route = 'review'")
    first = F.col("result_idx") == 0
    body = F.to_json(
        F.struct(
            F.lit("false_positive").alias("verdict"),
            F.lit("high").alias("confidence"),
            F.concat(F.lit("It calls `strip_"), F.col("result_idx").cast("string"), F.lit("` and `made_up_name`.")).alias("reasoning"),
            F.array(F.when(first, F.lit("return  strip_0(t)")).otherwise(F.lit("return made_up(t)"))).alias("evidence_quotes"),
            F.array(F.lit("other")).alias("fp_categories"),
            F.lit("Close it.").alias("suggested_action"),
        )
    )
    answers = sent.groupBy("fingerprint").agg(F.min_by(body, "finding_id").alias("reply")).select(
        "fingerprint",
        "reply",
        F.lit(None).cast("string").alias("error"),
        F.lit(1.0).alias("duration_seconds"),
        F.lit(100).cast("long").alias("input_tokens"),
        F.lit(10).cast("long").alias("output_tokens"),
    )
    # Writers that retry leave replies twice, and failures beside them.
    failed = answers.withColumns({"reply": F.lit(None).cast("string"), "error": F.lit("Timeout: retry: later")})
    done = T.conclude(prepared.findings, answers.unionByName(failed).unionByName(answers))
    return done.select(
        "scan_id",
        "result_idx",
        "route",
        F.col("verdict.verdict").alias("verdict"),
        "original_verdict",
        "verification_passed",
        F.array_join("advisory_warnings", ";").alias("advisory"),
        F.col("context.containing_function_name").alias("function_name"),
    )


def triage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without a store over files that give little or no context; nobody replies."""
    prepared = T.prepare(D.faulty_scans(spark, sf_dir), D.faulty_tree(spark, sf_dir), reuse=False, max_file_bytes=D.FAULTY_BYTES)
    done = T.conclude(prepared.findings, spark.createDataFrame([], REPLIES))
    return done.select(
        "scan_id",
        "result_idx",
        "route",
        "from_cache",
        F.col("verdict.verdict").alias("verdict"),
        F.col("verdict.reasoning").alias("reasoning"),
        F.array_join("verdict.missing_context", ";").alias("missing"),
        F.array_join("context.extraction_notes", ";").alias("notes"),
        F.col("context.containing_function_name").alias("function_name"),
        "message",
    )


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        rule_stats,
        noisy_rules,
        verdict_counts,
        finding_parse,
        scan_chunks,
        finding_rejects,
        scan_errors,
        scan_file_rejects,
        matched_code,
        language_route,
        limit_per_scan,
        numbered_lines,
        block_index,
        enclosing_block,
        syntax_problems,
        imports_text,
        imports_map,
        call_sites,
        import_hop,
        unresolved_calls,
        code_context,
        request_text,
        request_export,
        reply_validate,
        reply_files,
        request_files,
        source_tree,
        evidence_quotes,
        quote_checks,
        quote_search,
        grounding,
        downgrade,
        fingerprint,
        reuse_hits,
        work_list,
        store_upsert,
        store_runs,
        store_lookup,
        usage,
        cost,
        actionable_order,
        row_numbers,
        run_report,
        json_report,
        finding_markdown,
        report_markdown,
        triage_run,
        triage_faults,
    )
}
