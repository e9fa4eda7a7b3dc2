"""Triage inputs derived from general tables (documents, labels, pages, ...).

The tables hold no scans and no source code, so each document stands for a scan and a source file:
its lines become results, functions and quotes by plain row-wise expressions over the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.text import numbered, text_lines
from winnow.schemas import CALLED_FUNCTION, CONTEXT, NEEDS_HUMAN_REVIEW, STORED, STRINGS, VERDICT
from winnow.session import TEXTS, freed_shuffles, stage

REPO = "notes"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines."""
    return table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))


def extension(lang: Column) -> Column:
    return F.when(lang.isin("en", "de"), ".py").otherwise(".html")


# -- scans -----------------------------------------------------------------------------------------


def scan_result(line: Column, i: Column) -> Column:
    dotted, comma = line.endswith("."), line.contains(",")
    metadata = F.struct(
        F.when(comma, F.lit("CWE-20")).alias("cwe_text"),
        F.when(~comma & dotted, F.array(F.lit("CWE-79"), F.lit("CWE-89"))).alias("cwe_list"),
        F.when(dotted, F.array(F.lit("A03:2021"))).alias("owasp"),
        F.when(F.length(line) > 200, F.lit("HIGH")).when(F.length(line) < 50, F.lit("LOW")).alias("confidence"),
    )
    trace = F.struct(
        F.substring_index(line, " ", 1).alias("taint_source"),
        F.array(F.lit("sink"), F.lit("x")).alias("taint_sink"),
        F.split(line, ",").alias("intermediate_vars"),
    )
    return F.struct(
        F.when(line.contains(" "), F.concat(F.lit("rule."), F.col("lang"))).alias("check_id"),
        F.concat_ws("\\", "lang", "source", F.concat(F.lit("d"), "doc_id", extension(F.col("lang")))).alias("path"),
        F.struct(i.alias("line"), F.length(line).alias("col")).alias("start"),
        F.struct((i + 1).alias("line")).alias("end"),
        F.struct(
            line.alias("message"),
            F.when(F.length(line) < 40, "INFO")
            .when(F.length(line) < 120, "WARNING")
            .when(F.length(line) < 240, "ERROR")
            .when(F.length(line) < 400, "CRITICAL")
            .otherwise("EXPERIMENT")
            .alias("severity"),
            F.when(dotted, line).otherwise("requires login").alias("lines"),
            metadata.alias("metadata"),
            F.when(comma, trace).alias("dataflow_trace"),
        ).alias("extra"),
    )


def scan_error() -> Column:
    return F.struct(
        F.when(F.col("lang") != "fr", F.col("source")).alias("path"),
        F.when(F.col("lang") != "de", F.col("text")).alias("message"),
    )


def one_key(body: Column) -> Column:
    """One key, two types: both spellings become the same key of the JSON text."""
    return F.replace(F.replace(body, F.lit('"cwe_text":'), F.lit('"cwe":')), F.lit('"cwe_list":'), F.lit('"cwe":'))


def scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan document per text: a result per line, with the quirks real scans have.

    Positions count from 0, so the first line's result is invalid; a line without a blank has no
    rule; severities, weakness lists, traces and embedded code vary with the line.
    """
    parts = F.struct(F.transform("lines", scan_result).alias("results"), F.array(scan_error()).alias("errors"))
    return documents(spark, sf_dir).select(
        F.concat(F.lit("scan"), "doc_id").alias("scan_id"), F.lit(REPO).alias("repo_id"), one_key(F.to_json(parts)).alias("text")
    )


def write_source_scans(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """One scan file per source, with the results of all its documents one after the other.

    Files are written line by line: what opens the document, the entries, what closes it.
    """
    docs = documents(spark, sf_dir)
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first_id"))
    comma = F.when(F.col("doc_id") == F.col("first_id"), "").otherwise(",")

    def entries(values: Column, place: int) -> DataFrame:
        listed = one_key(F.to_json(values))
        inner = F.substring(listed, F.lit(2), F.length(listed) - 2)
        return docs.join(F.broadcast(first), "source").select("source", F.lit(place).alias("place"), "doc_id", F.concat(comma, inner).alias("value"))

    frame = {0: '{"version": "1, [{", "paths": {"scanned": ["a", "b,]"], "results": [1, 2]}, "results": [', 2: '], "errors": [', 4: "]}"}
    parts = entries(F.transform("lines", scan_result), 1).unionByName(entries(F.array(scan_error()), 3))
    for place, text in frame.items():
        parts = parts.unionByName(first.select("source", F.lit(place).alias("place"), "first_id", F.lit(text).alias("value")).toDF("source", "place", "doc_id", "value"))
    ordered = parts.repartition("source").sortWithinPartitions("source", "place", "doc_id")
    with freed_shuffles(spark):
        ordered.select("source", "value").write.partitionBy("source").text(folder)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned files: every text, the Spanish ones at paths that no scan names."""
    folder = F.when(F.col("lang") == "es", "moved").otherwise(F.col("lang"))
    path = F.concat_ws("/", folder, "source", F.concat(F.lit("d"), "doc_id", extension(F.col("lang"))))
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.lit(REPO).alias("repo_id"),
            path.alias("path"),
            F.octet_length("text").cast("long").alias("length"),
            "text",
        )
    )


# -- source tree -----------------------------------------------------------------------------------


# How modules end, by document number: most with something that no parser takes.
FAULTS = {
    "none": "",
    "colon": "if seen\n    stop()",
    "string": "label = 'never closed",
    "dedent": "if seen:\n        one = 1\n    two = 2",
    "bracket": "rows = [(1, 2}",
    "block": "class Empty:\nlast = 1",
    "indent": "one = 1\n    two = 2",
}


def code_path() -> Column:
    return F.concat_ws("/", "source", F.concat(F.lit("d"), "doc_id", F.lit(".py")))


def line_lengths() -> Column:
    return F.array_sort(F.array_distinct(F.transform("lines", lambda line: F.length(line))))


def first_function_line() -> Column:
    return F.size(line_lengths()) + 11


def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per document and one per benchmark item.

    A document's module has a function per line with a nested one inside; it calls the function
    before it in a chain of calls, names nobody defines, and a check that another module holds if an item
    with that number exists. English modules put the functions into a class. Six of seven end in a fault.
    """
    docstring = F.concat(
        F.lit('"""Notes on '), "lang", F.lit(" "), "source", F.lit('.\ndef not_code(x):\n    call_nothing(x)\n"""')
    )
    fixed_imports = "import os, json as js\nfrom bench.common import (\n    first_check,\n    other as second,\n)"
    imports = F.transform(
        line_lengths(),
        lambda k: F.concat(F.lit("from bench.b"), k.cast("string"), F.lit(" import check_"), k.cast("string")),
    )
    pad = F.when(F.col("lang") == "en", F.lit("    ")).otherwise("")

    def function(line: Column, i: Column) -> Column:
        no = i.cast("string")
        before = F.when(i > 0, F.concat(F.lit("line_"), (i - 1).cast("string"))).otherwise(
            F.concat(F.lit("missing_"), F.size("lines").cast("string"))
        )
        rows = [
            F.concat(F.lit("def line_"), no, F.lit("(self, text):")),
            F.concat(F.lit("    def inner_"), no, F.lit("(t):")),
            F.concat(F.lit("        return strip_"), no, F.lit("(t)")),
            F.concat(F.lit("    # "), line),
            F.concat(
                F.lit("    seen = self."), before, F.lit("(inner_"), no, F.lit("(text)).keep_"), no,
                F.lit("(fold_"), no, F.lit("(text)).done_"), no, F.lit("()"),
            ),
            F.concat(
                F.lit("    return check_"), F.length(line).cast("string"), F.lit('(seen, "track(%s)" % len(text))')
            ),
        ]
        return F.concat_ws("\n", *[F.concat(pad, row) for row in rows])

    module = F.concat_ws(
        "\n",
        docstring,
        F.lit(fixed_imports),
        F.array_join(imports, "\n"),
        F.when(F.col("lang") == "en", "class Notes:").otherwise("# Notes"),
        F.array_join(F.transform("lines", function), "\n"),
        F.element_at(F.array(*[F.lit(fault) for fault in FAULTS.values()]), (F.col("doc_id") % len(FAULTS)).cast("int") + 1),
    )
    modules = documents(spark, sf_dir).select(code_path().alias("path"), module.alias("text"))
    item = F.col("item_id").cast("string")
    checks = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("bench/b"), item, F.lit(".py")).alias("path"),
        F.concat(
            F.lit("def check_"), item, F.lit("(text, *rest):\n    # "),
            F.replace(F.col("text"), F.lit("\n"), F.lit("\n    # ")), F.lit("\n    return text"),
        ).alias("text"),
    )
    tree = modules.unionByName(checks).select(
        F.lit(REPO).alias("repo_id"), "path", F.octet_length("text").cast("long").alias("length"), "text"
    )
    # Written once, as a source tree is, so that readers of paths or lengths do not build texts.
    return stage(tree, TEXTS)


FAULTY_BYTES = 2000


def faulty_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document a file without code, one that imports from another repository, and one that may be too large."""
    docs = documents(spark, sf_dir)
    said = F.array_join(F.transform("lines", lambda line: F.concat(F.lit("# "), line)), "\n")
    name = F.concat(F.lit("d"), "doc_id", F.lit(".py"))
    kinds = {
        "plain": said,
        "leave": F.concat(F.lit("from ...shared.tools import go\n\ndef f(x):\n    return go(x)\n"), said),
        "large": F.concat(F.lit("def f(x):\n    return go(x)\n"), said),
    }
    rows = docs.select(F.explode(F.array(*[F.struct(F.concat(F.lit(k + "/"), name).alias("path"), t.alias("text")) for k, t in kinds.items()])).alias("f"))
    tree = rows.select(F.lit(REPO).alias("repo_id"), "f.path", "f.text")
    item = table(spark, sf_dir, "benchmark").agg(F.min("item_id").cast("string").alias("id"))
    shared = item.select(F.lit("shared").alias("repo_id"), F.lit("tools.py").alias("path"), F.concat(F.lit("def go(x):\n    return "), "id").alias("text"))
    both = tree.unionByName(shared)
    return stage(both.select("repo_id", "path", F.octet_length("text").cast("long").alias("length"), "text"))


def faulty_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan per document with a finding in each of these files, in one that is not there and on a page."""

    def found(path: Column, line: int) -> Column:
        return F.struct(
            F.lit("rule.fault").alias("check_id"),
            path.alias("path"),
            F.struct(F.lit(line).alias("line")).alias("start"),
            F.struct(F.lit(line).alias("line")).alias("end"),
            F.struct(F.element_at("lines", 1).alias("message"), F.lit("ERROR").alias("severity"), F.lit("x = 1").alias("lines"), F.struct(F.lit("LOW").alias("confidence")).alias("metadata")).alias("extra"),
        )

    name = F.concat(F.lit("d"), "doc_id", F.lit(".py"))
    places = {"plain/": 1, "leave/": 4, "large/": 2, "gone/": 1}
    results = [found(F.concat(F.lit(k), name), line) for k, line in places.items()] + [found(F.concat(F.lit("page"), "doc_id", F.lit(".html")), 1)]
    body = F.to_json(F.struct(F.array(*results).alias("results")))
    return documents(spark, sf_dir).select(F.concat(F.lit("scan"), "doc_id").alias("scan_id"), F.lit(REPO).alias("repo_id"), body.alias("text"))


def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document a finding on its imports and one per line.

    A line with a final dot is matched inside its nested function, others from there to the end of
    the outer one.
    """
    first = first_function_line()
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", F.posexplode(F.concat(F.array(F.lit("")), "lines")).alias("line_no", "line"), first.alias("first")
    )
    inner = F.col("first") + (F.col("line_no") - 1) * 6 + 2
    start = F.when(F.col("line_no") == 0, 5).otherwise(inner)
    end = F.when((F.col("line_no") == 0) | F.col("line").endswith("."), start).otherwise(inner + 3)
    return rows.select(
        F.concat_ws("#", "doc_id", "line_no").alias("finding_id"),
        F.lit(REPO).alias("repo_id"),
        code_path().alias("file_path"),
        start.alias("start_line"),
        end.alias("end_line"),
        F.concat(F.lit("    "), "line").alias("matched_code"),
    )


# -- findings with verdicts ------------------------------------------------------------------------


def severity_of(n_chars: Column) -> Column:
    return (
        F.when(n_chars < 300, "INFO").when(n_chars < 1200, "WARNING").when(n_chars < 4000, "ERROR").otherwise("CRITICAL")
    )


def verdict_label() -> Column:
    return (
        F.when(F.col("toxic") == 1, "likely_true_positive")
        .when(F.col("quality") == 1, "false_positive")
        .otherwise(NEEDS_HUMAN_REVIEW)
    )


def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding per document with a context that shows the text as the enclosing function."""
    callee = F.struct(
        F.concat(F.lit("helper_"), "source").alias("name"),
        numbered(F.array(F.concat(F.lit("def helper_"), "source", F.lit("():")), F.lit("    pass")), F.lit(9)).alias("source"),
        F.concat("lang", F.lit("/helpers.py")).alias("file_path"),
        F.lit(9).alias("start_line"),
        F.lit("same_module_import").alias("resolution_method"),
    )
    no_calls = F.array().cast(f"array<{CALLED_FUNCTION.simpleString()}>")
    english = F.col("lang") == "en"
    context = F.struct(
        F.lit("python"),
        numbered(text_lines(F.col("text")), F.lit(1)),
        F.when(english, F.concat(F.lit("import "), "source")),
        F.when(english, F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))),
        F.when(english, numbered(text_lines(F.col("text")), F.col("n_chars").cast("int"))),
        F.when(english, F.col("n_chars").cast("int")),
        F.when(english & (F.col("n_chars") > 1000), F.array(callee)).otherwise(no_calls),
        F.when(english, F.array().cast(STRINGS)).otherwise(F.array(F.lit("File contains no function."))),
    ).cast(CONTEXT)
    first_line = F.element_at("lines", 1)
    return documents(spark, sf_dir).select(
        "doc_id",
        "lang",
        "source",
        "text",
        "n_chars",
        "lines",
        F.col("doc_id").cast("string").alias("finding_id"),
        F.col("source").alias("run_id"),
        F.col("doc_id").alias("input_idx"),
        F.concat(F.lit("rule."), "lang").alias("rule_id"),
        F.concat_ws("/", "lang", F.concat("source", extension(F.col("lang")))).alias("file_path"),
        F.lit(1).alias("start_line"),
        F.size("lines").alias("end_line"),
        first_line.alias("message"),
        severity_of(F.col("n_chars")).alias("severity"),
        F.when(F.col("n_chars") > 2000, F.array(F.lit("CWE-79"), F.lit("CWE-89"))).otherwise(F.array().cast(STRINGS)).alias("cwe"),
        F.when(english, F.array(F.lit("A03:2021"))).otherwise(F.array().cast(STRINGS)).alias("owasp"),
        F.when(F.col("n_chars") > 500, "HIGH").alias("scanner_confidence"),
        F.col("text").alias("matched_code"),
        (F.size("lines") > 4).alias("has_dataflow_trace"),
        F.when(F.size("lines") > 4, F.concat(F.lit("Source: "), first_line)).alias("dataflow_trace_summary"),
        extension(F.col("lang")).endswith(".py").alias("processable"),
        context.alias("context"),
        F.when(english, F.col("text")).alias("function_text"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document findings with a verdict from the labels; unlabelled ones ask for review.

    A labelled document of several lines quotes all of them, the second one with other whitespace, and
    every turn of the conversation of the same number.
    """
    said = (
        table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id").alias("doc_id"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
        .select("doc_id", F.transform("turns", lambda t: t["text"]).alias("said"))
    )
    joined = (
        doc_findings(spark, sf_dir)
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .join(said, "doc_id", "left")
    )
    has_label = F.col("quality").isNotNull()
    several = F.size("lines") > 1
    second = F.concat(F.replace(F.try_element_at("lines", F.lit(2)), F.lit(" "), F.lit(" \t ")), F.lit("\n"))
    silent = F.when(F.col("lang") == "fr", F.array(F.lit("  "))).otherwise(F.array().cast(STRINGS))
    quotes = F.filter(
        F.concat(F.array(F.element_at("lines", 1), second), F.slice("lines", 3, F.size("lines")), F.coalesce("said", silent)),
        lambda quote: quote.isNotNull(),
    )
    label = verdict_label()
    verdict = F.struct(
        label,
        F.when(F.col("n_chars") > 2000, "high").when(F.col("n_chars") > 500, "medium").otherwise("low"),
        F.concat(F.lit("Read "), F.col("n_chars").cast("string"), F.lit(" characters.")),
        F.when(has_label & several, quotes).otherwise(F.array().cast(STRINGS)),
        F.when(has_label, F.array().cast(STRINGS)).otherwise(F.array(F.lit("a label"))),
        F.when(label == "false_positive", F.array(F.lit("test_code"), F.lit("other"))).otherwise(F.array().cast(STRINGS)),
        F.concat(F.lit("Look at "), "source", F.lit(".")),
    ).cast(VERDICT)
    return joined.select(
        *[c for c in joined.columns if c not in ("said", "toxic", "quality")], has_label.alias("has_label"), verdict.alias("verdict")
    )


def stored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a written verdict store, keyed by the fingerprint of their text."""
    from winnow.operators.reuse import add_fingerprint

    rows = add_fingerprint(labelled(spark, sf_dir).filter("has_label"))
    entries = rows.select(
        "fingerprint",
        "verdict",
        F.lit(True).alias("verification_passed"),
        F.array().cast(STRINGS).alias("verification_notes"),
        F.array().cast(STRINGS).alias("advisory_warnings"),
        F.lit(None).cast("string").alias("original_verdict"),
        F.lit(1.5).alias("duration_seconds"),
        F.col("n_chars").alias("input_tokens"),
        F.size("lines").cast("long").alias("output_tokens"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("stored_at"),
    )
    return stage(entries.select(*STORED.fieldNames()))
