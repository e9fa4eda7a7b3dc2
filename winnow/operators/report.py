"""Aggregates, order and text of reports, for many runs at once."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from winnow.functions.ordering import number_rows
from winnow.functions.text import WS
from winnow.schemas import (
    FALSE_POSITIVE,
    INPUT_USD_PER_MTOK,
    LIKELY_TRUE_POSITIVE,
    NEEDS_HUMAN_REVIEW,
    NOISY_MIN_FINDINGS,
    NOISY_MIN_FP_RATE,
    OUTPUT_USD_PER_MTOK,
    SEVERITY_RANK,
    VERDICT_RANK,
)

# What a report calls the verdicts, and its explanation of advisory notes.
VERDICT_TITLES = {
    LIKELY_TRUE_POSITIVE: "\U0001f6a8 Likely true positive",
    NEEDS_HUMAN_REVIEW: "⚠️ Needs human review",
    FALSE_POSITIVE: "✅ False positive",
}
ADVISORY = (
    "_The grounding check flagged tokens in the reasoning that don't appear in the visible code. This often "
    'means the LLM is reasoning by contrast (e.g. "unlike pickle.loads which would be vulnerable") or '
    "referencing framework knowledge from training. It can also indicate fabrication. Read the reasoning "
    "carefully._"
)

# Head of the rule table and what stands above the noisy rules.
TABLE_HEAD = (
    "## Per-rule statistics\n",
    "| Rule | Total | FP | Likely TP | Review | FP rate |",
    "|---|---:|---:|---:|---:|---:|",
)
TUNING_TITLE = "\n**Rules with high false-positive rates that may be worth tuning:**\n"


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _label(label: str) -> Column:
    return F.col("verdict") == label


def rule_stats(verdicts: DataFrame) -> DataFrame:
    """Per run and rule: totals by verdict and the false-positive rate.

    ``verdicts`` holds ``run_id, rule_id, verdict`` (the label). Counts combine map-side, so a
    rule with most of the findings shuffles one row per task.
    """
    counts = verdicts.groupBy("run_id", "rule_id").agg(
        F.count("*").alias("total"),
        _count(_label(FALSE_POSITIVE)).alias("false_positive"),
        _count(_label(LIKELY_TRUE_POSITIVE)).alias("likely_true_positive"),
        _count(_label(NEEDS_HUMAN_REVIEW)).alias("needs_human_review"),
    )
    return counts.withColumn("fp_rate", F.col("false_positive") / F.col("total"))


def order_rules(stats: DataFrame) -> DataFrame:
    return stats.orderBy("run_id", F.col("fp_rate").desc(), F.col("total").desc(), "rule_id")


def noisy_rules(
    stats: DataFrame, min_findings: int = NOISY_MIN_FINDINGS, min_fp_rate: float = NOISY_MIN_FP_RATE
) -> DataFrame:
    """Rules worth tuning, with their statistics."""
    return stats.filter((F.col("total") >= min_findings) & (F.col("fp_rate") >= min_fp_rate))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("run_id").agg(
        F.count("*").alias("total_findings"),
        _count(_label(FALSE_POSITIVE)).alias("false_positive_count"),
        _count(_label(LIKELY_TRUE_POSITIVE)).alias("likely_true_positive_count"),
        _count(_label(NEEDS_HUMAN_REVIEW)).alias("needs_human_review_count"),
    )


def usage_totals(rows: DataFrame) -> DataFrame:
    """Per run: tokens, review time, reuse hits and misses.

    A miss is a finding that cost tokens; fallbacks without tokens are neither hit nor miss.
    ``total_*`` counts reused findings' recorded tokens as well, ``spent_*`` and
    ``review_seconds`` only fresh ones.
    """
    cached = F.coalesce("from_cache", F.lit(False))
    tokens_in, tokens_out = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    return rows.groupBy("run_id").agg(
        F.sum(tokens_in).alias("total_input_tokens"),
        F.sum(tokens_out).alias("total_output_tokens"),
        F.sum(F.when(~cached, tokens_in).otherwise(0)).alias("spent_input_tokens"),
        F.sum(F.when(~cached, tokens_out).otherwise(0)).alias("spent_output_tokens"),
        F.sum(F.when(~cached, F.coalesce("duration_seconds", F.lit(0.0))).otherwise(0.0)).alias("review_seconds"),
        _count(cached).alias("cache_hits"),
        _count(~cached & (tokens_in > 0)).alias("cache_misses"),
        _count(~cached & (tokens_in == 0)).alias("fallback_count"),
    )


def estimate_cost(
    input_tokens: Column,
    output_tokens: Column,
    input_price: Column | float = INPUT_USD_PER_MTOK,
    output_price: Column | float = OUTPUT_USD_PER_MTOK,
) -> Column:
    """US dollars for tokens at prices per million."""
    return input_tokens * input_price / 1_000_000 + output_tokens * output_price / 1_000_000


def hit_rate(hits: Column, misses: Column) -> Column:
    """Whole percent of hits, rounded down; NULL where nothing was looked up."""
    total = hits + misses
    return F.when(total > 0, F.floor(hits * 100 / total).cast("long"))


def fp_percent(rate: Column) -> Column:
    return (rate * 100).cast("int")


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    """Rank from a small fixed table; unknown values come last."""
    rank = F.lit(99)
    for name, position in ranks.items():
        rank = F.when(value == name, position).otherwise(rank)
    return rank


def number_findings(rows: DataFrame) -> DataFrame:
    """Report numbers 1..n per run: verdict, severity, rule, then input order.

    Findings in other languages precede the rest of their tie. ``input_idx`` is a whole number,
    unique within the run.
    """
    ranked = rows.withColumns(
        {
            "v_rank": rank_of(F.col("verdict"), VERDICT_RANK),
            "s_rank": rank_of(F.col("severity"), SEVERITY_RANK),
        }
    )
    return number_rows(ranked, ["run_id"], ["v_rank", "s_rank", "rule_id", "processable"], "input_idx", "finding_no")


def finding_markdown(triaged: DataFrame) -> DataFrame:
    """``run_id, finding_no, markdown``: the report section of each finding, made row by row.

    ``triaged`` carries the finding columns, the verdict struct as ``verdict`` and the outcome of
    the checks; numbering reads only the sort keys and is joined back by finding.
    """
    keys = triaged.select(
        "run_id", "finding_id", "input_idx", "processable", "severity", "rule_id", F.col("verdict.verdict").alias("verdict")
    )
    numbers = number_findings(keys).select("run_id", "finding_id", "finding_no")
    return triaged.join(numbers, ["run_id", "finding_id"]).select("run_id", "finding_no", _section().alias("markdown"))


def _bullets(items: Column, mark: str = "- ") -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit(mark), item)), "\n\n")


def _titled(title: str, items: Column, body: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"**{title}**\n\n"), body))


def _section() -> Column:
    v = F.col("verdict")
    title = F.lit(None).cast("string")
    for label, text in VERDICT_TITLES.items():
        title = F.when(v["verdict"] == label, text).otherwise(title)
    cwe = F.when(F.size("cwe") > 0, F.concat(F.lit(" — "), F.element_at("cwe", 1))).otherwise("")
    cached = F.when(F.col("from_cache"), F.lit(" _(from cache)_")).otherwise("")
    quotes = F.transform(
        v["evidence_quotes"],
        lambda quote: F.concat(
            F.lit("```\n"),
            F.replace(F.regexp_replace(quote, rf"^{WS}+|{WS}+\z", ""), F.lit("```"), F.lit("ʼʼʼ")),
            F.lit("\n```"),
        ),
    )
    categories = F.array_join(
        F.transform(v["fp_categories"], lambda c: F.concat(F.lit("`"), c, F.lit("`"))), ", "
    )
    return F.concat_ws(
        "\n\n",
        F.concat(
            F.lit("### "), F.col("finding_no").cast("string"), F.lit(". "), title, F.lit(" — `"), F.col("rule_id"), F.lit("`")
        ),
        F.concat(F.lit("**File:** `"), F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("`  ")),
        F.concat(F.lit("**Severity:** "), F.col("severity"), F.lit("  **Confidence:** "), v["confidence"], cwe, cached),
        F.when(
            F.col("original_verdict").isNotNull(),
            F.concat(
                F.lit("> ⚠️ LLM originally returned `"),
                F.col("original_verdict"),
                F.lit("` — downgraded due to verification failure."),
            ),
        ),
        F.concat(F.lit("**Reasoning:** "), v["reasoning"]),
        _titled("Evidence from the code:", v["evidence_quotes"], F.array_join(quotes, "\n\n")),
        _titled("Missing context:", v["missing_context"], _bullets(v["missing_context"])),
        F.when(F.size(v["fp_categories"]) > 0, F.concat(F.lit("**FP categories:** "), categories)),
        _titled("Verifier notes:", F.col("verification_notes"), _bullets(F.col("verification_notes"), "- ⚠️ ")),
        _titled(
            "Advisory note",
            F.col("advisory_warnings"),
            F.concat(F.lit(ADVISORY + "\n\n"), _bullets(F.col("advisory_warnings"), "- ℹ️ ")),
        ),
        F.concat(F.lit("**Suggested action:** "), v["suggested_action"]),
    )


def run_summary(triaged: DataFrame, scan_errors: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run of ``runs``: metadata, counts, usage, cost, hit rate, scan errors.

    ``runs`` holds ``run_id, generated_at, tool_version, prompt_version, model, repo_path,
    findings_path, total_duration_seconds`` (the run's wall time, NULL if unknown); a run without findings still gets its row. ``scan_errors`` carries ``run_id``.
    """
    labels = triaged.withColumn("verdict", F.col("verdict.verdict"))
    errors = scan_errors.groupBy("run_id").agg(F.count("*").alias("scan_error_count"))
    counts = [
        "total_findings", "false_positive_count", "likely_true_positive_count", "needs_human_review_count",
        "total_input_tokens", "total_output_tokens", "spent_input_tokens", "spent_output_tokens",
        "cache_hits", "cache_misses", "fallback_count", "scan_error_count",
    ]
    joined = (
        runs.join(verdict_counts(labels), "run_id", "left")
        .join(usage_totals(labels), "run_id", "left")
        .join(errors, "run_id", "left")
        .fillna(0, subset=[*counts, "review_seconds"])
    )
    return joined.withColumns(
        {
            "estimated_cost": estimate_cost(F.col("total_input_tokens"), F.col("total_output_tokens")),
            "hit_rate_percent": hit_rate(F.col("cache_hits"), F.col("cache_misses")),
        }
    )


def run_rules(
    stats: DataFrame, min_findings: int = NOISY_MIN_FINDINGS, min_fp_rate: float = NOISY_MIN_FP_RATE
) -> DataFrame:
    """A row per run and rule: its number in the report's order, its statistics, and whether to consider tuning it.

    Rules of a run are numbered in chunks of equal false-positive counts, so a run with very many
    rules is not one window.
    """
    noisy = (F.col("total") >= min_findings) & (F.col("fp_rate") >= min_fp_rate)
    ranked = stats.withColumns(
        {
            "noisy": noisy,
            "_rate": F.round(-F.col("fp_rate") * 1000).cast("int"),
            "_order": F.struct((-F.col("fp_rate")).alias("a"), (-F.col("total")).alias("b"), F.col("rule_id").alias("c")),
        }
    )
    before = Window.partitionBy("run_id").orderBy("_rate").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("run_id", "_rate").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("run_id", "_rate").orderBy("_order")
    return (
        ranked.withColumn("_in", F.row_number().over(within))
        .join(sizes, ["run_id", "_rate"])
        .withColumn("rule_no", F.col("_before") + F.col("_in"))
        .drop("_rate", "_order", "_before", "_in")
    )


def report_fragments(summary: DataFrame, rules: DataFrame, scan_errors: DataFrame, triaged: DataFrame) -> DataFrame:
    """A run's whole report as the pieces of one JSON document: ``run_id, part, place, json``.

    Read in the order of ``part`` and ``place`` they make an object: the run's summary, its ``rule_stats``, the
    ``rules_to_consider_tuning``, its ``scan_errors`` as texts, and its ``triaged_findings`` in the order of the scan.
    So a report of any number of findings is one document, and none of it is ever one value.
    """
    head = F.to_json(F.struct(*[c for c in summary.columns if c != "run_id"]), {"ignoreNullFields": "false"})
    lists = {
        "rule_stats": rules.select("run_id", _place("rule_no", "rule_id"), _element(rules, "run_id", "rule_no", "noisy")),
        "rules_to_consider_tuning": rules.filter("noisy").select("run_id", _place("rule_no", "rule_id"), _text("rule_id")),
        "scan_errors": scan_errors.select("run_id", _place("error_idx", "summary"), _text("summary")),
        "triaged_findings": triaged.select("run_id", _place("input_idx", "finding_id"), _element(triaged, "run_id")),
    }
    runs = summary.select("run_id", F.struct(F.lit(0).cast("long").alias("no"), F.lit("").alias("id")).alias("place"), F.left(head, F.length(head) - 1).alias("head"))
    pieces, elements = [], []
    for i, (name, rows) in enumerate(lists.items()):
        opening = F.lit(f',"{name}":[' if i == 0 else f'],"{name}":[')
        pieces.append(runs.select("run_id", F.lit(2 * i).alias("part"), "place", (F.concat("head", opening) if i == 0 else opening).alias("json")))
        elements.append(rows.select("run_id", F.lit(2 * i + 1).alias("part"), "place", "json"))
    pieces.append(runs.select("run_id", F.lit(2 * len(lists)).alias("part"), "place", F.lit("]}").alias("json")))
    every = elements[0]
    for rows in elements[1:]:
        every = every.unionByName(rows)
    first = every.groupBy("run_id", "part").agg(F.min("place").alias("first"))
    comma = F.when(F.col("place") == F.col("first"), "").otherwise(",")
    out = every.join(first, ["run_id", "part"]).select("run_id", "part", "place", F.concat(comma, "json").alias("json"))
    for rows in pieces:
        out = out.unionByName(rows)
    return out


def hash_in_order(rows: DataFrame, name: str) -> DataFrame:
    """Per run the SHA-256 of the texts ``said`` by ``order``, one to a line; nulls are left out.

    A run's texts are read one after the other, so they are never one value.
    """
    ordered = rows.filter("said IS NOT NULL").repartition("run_id").sortWithinPartitions("run_id", "order").select("run_id", "said")

    def hashed(batches):
        known, digest, out = None, None, []
        for batch in batches:
            for run, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or run != known:
                    out += [] if digest is None else [(known, digest.hexdigest())]
                    known, digest = run, hashlib.sha256(said.encode())
                else:
                    digest.update(b"\n" + said.encode())
        out += [] if digest is None else [(known, digest.hexdigest())]
        yield pa.RecordBatch.from_pydict({"run_id": pa.array([r for r, _ in out], runs), name: pa.array([h for _, h in out], pa.string())})

    schema = T.StructType([rows.schema["run_id"], T.StructField(name, T.StringType())])
    runs = to_arrow_type(schema["run_id"].dataType)
    return ordered.mapInArrow(hashed, schema)


def _place(no: str, key: str) -> Column:
    return F.struct(F.col(no).cast("long").alias("no"), F.col(key).cast("string").alias("id")).alias("place")


def _text(name: str) -> Column:
    listed = F.to_json(F.array(name))
    return F.substring(listed, F.lit(2), F.length(listed) - 2).alias("json")


def _element(rows: DataFrame, *without: str) -> Column:
    return F.to_json(F.struct(*[c for c in rows.columns if c not in without]), {"ignoreNullFields": "false"}).alias("json")


def report_blocks(
    summary: DataFrame,
    findings: DataFrame,
    stats: DataFrame,
    min_findings: int = NOISY_MIN_FINDINGS,
    min_fp_rate: float = NOISY_MIN_FP_RATE,
) -> DataFrame:
    """The Markdown report as ordered blocks ``run_id, block_no, part, rule_no, markdown``.

    Rows of one block (a rule table) follow each other by ``part`` and ``rule_no``; between blocks
    stands a blank line. Findings and rules are one row each and are never gathered.
    """

    def block(number: Column, markdown: Column) -> Column:
        return F.struct(number.cast("long").alias("block_no"), markdown.alias("markdown"))

    after = F.col("total_findings")
    fixed = summary.select(
        "run_id",
        F.inline(
            F.array(
                block(F.lit(0), header_text()),
                block(F.lit(1), summary_text()),
                block(F.lit(2), F.when(after > 0, F.lit("## Findings"))),
                block(after + 4, footer_text()),
            )
        ),
    )
    sections = findings.select("run_id", (F.col("finding_no") + 2).alias("block_no"), "markdown")
    texts = fixed.filter("markdown IS NOT NULL").unionByName(sections)
    whole = texts.select("run_id", "block_no", F.lit(0).alias("part"), F.lit(0).cast("long").alias("rule_no"), "markdown")
    tables = (
        rule_table(run_rules(stats, min_findings, min_fp_rate))
        .join(summary.select("run_id", "total_findings"), "run_id")
        .select("run_id", (F.col("total_findings") + 3).alias("block_no"), "part", "rule_no", "markdown")
    )
    return whole.unionByName(tables)


def header_text() -> Column:
    stamp = F.date_format("generated_at", "yyyy-MM-dd HH:mm")
    return F.concat(F.lit("# Triage report\n\n_Generated "), stamp, F.lit(" UTC_"))


def summary_text() -> Column:
    def row(name: str, *value: Column | str) -> Column:
        parts = [F.lit(v) if isinstance(v, str) else v.cast("string") for v in value]
        return F.concat(F.lit(f"| {name} | "), *parts, F.lit(" |"))

    rate = F.when(
        F.col("hit_rate_percent").isNotNull(),
        F.concat(F.lit(" ("), F.col("hit_rate_percent").cast("string"), F.lit("% hit rate)")),
    ).otherwise("")
    return F.concat_ws(
        "\n",
        F.lit("## Summary\n"),
        F.lit("| Metric | Value |"),
        F.lit("|---|---|"),
        row("Total findings", F.col("total_findings")),
        row("Likely true positive", F.col("likely_true_positive_count")),
        row("Needs human review", F.col("needs_human_review_count")),
        row("False positive", F.col("false_positive_count")),
        row("Estimated cost", F.format_string("~$%.3f", F.col("estimated_cost"))),
        row("Tokens (in / out)", F.col("total_input_tokens"), " / ", F.col("total_output_tokens")),
        row("Duration", F.coalesce(F.format_string("%.1fs", F.col("total_duration_seconds")), F.lit("unknown"))),
        row("Review time of new findings", F.format_string("%.1fs", F.col("review_seconds"))),
        row("Cache", F.col("cache_hits"), " hits, ", F.col("cache_misses"), " misses", rate),
        row("Model", "`", F.col("model"), "`"),
        row("Prompt version", "`", F.col("prompt_version"), "`"),
    )


def footer_text() -> Column:
    errors = F.col("scan_error_count")
    return F.concat_ws(
        "\n\n",
        F.lit("---"),
        F.concat(
            F.lit("_Triaged with winnow v"), F.col("tool_version"), F.lit(", prompt v"), F.col("prompt_version"), F.lit("._")
        ),
        F.when(
            errors > 0,
            F.concat(
                F.lit("_The scanner had "),
                errors.cast("string"),
                F.lit(" parse errors during the scan (not counted as findings)._"),
            ),
        ),
    )


def rule_table(rules: DataFrame) -> DataFrame:
    """The rule statistics of :func:`run_rules` as Markdown: ``run_id, part, rule_no, markdown``.

    Part 0 is the table's head, part 1 a line per rule, part 2 the title of the noisy rules, part 3 a
    line for each of those.
    """
    line = F.concat(
        F.lit("| `"), F.col("rule_id"), F.lit("` | "),
        F.concat_ws(" | ", "total", "false_positive", "likely_true_positive", "needs_human_review"),
        F.lit(" | "), fp_percent(F.col("fp_rate")).cast("string"), F.lit("% |"),
    )

    def part(rows: DataFrame, number: int, markdown: Column) -> DataFrame:
        return rows.select("run_id", F.lit(number).alias("part"), "rule_no", markdown.alias("markdown"))

    def title(rows: DataFrame, number: int, text: str) -> DataFrame:
        return part(rows.select("run_id").distinct().withColumn("rule_no", F.lit(0).cast("long")), number, F.lit(text))

    noisy = rules.where("noisy")
    return (
        title(rules, 0, "\n".join(TABLE_HEAD))
        .unionByName(part(rules, 1, line))
        .unionByName(title(noisy, 2, TUNING_TITLE))
        .unionByName(part(noisy, 3, F.concat(F.lit("- `"), F.col("rule_id"), F.lit("`"))))
    )
