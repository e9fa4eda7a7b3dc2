import json
import re

import pytest
from pyspark.sql import functions as F

from winnow.functions.vocabulary import REVIEW_VOCABULARY
from winnow.operators import exchange as X
from winnow.functions.text import normalize_texts
from winnow.operators import verify as V
from winnow.schemas import CONTEXT, VERDICT

ROW = f"""matched_code string, message string, rule_id string, file_path string,
    context {CONTEXT.simpleString()}, verdict {VERDICT.simpleString()}, synth_reason string"""

CODE = "    Path(folder, name).unlink()"

CONTEXT_ROW = (
    "python",
    "41 |     Path(folder, name).unlink()",
    "from pathlib import Path\nimport shelf",
    "drop_album",
    "39 | def drop_album(folder, name):\n40 |     name = shelf.tidy(name)\n41 |     Path(folder, name).unlink()",
    39,
    [("tidy", " 7 | def tidy(text):\n 8 |     return text.strip('/')", "lib/shelf.py", 7, "same_module_import")],
    [],
)


def check(spark, label="likely_true_positive", reasoning="A file goes.", quotes=(), categories=(), reason=None, **options):
    verdict = (label, "medium", reasoning, list(quotes), [], list(categories), "Look at it.")
    row = (CODE, "A path from outside is removed", "files.unlink-outside", "lib/albums.py", CONTEXT_ROW, verdict, reason)
    return V.verify_replies(spark.createDataFrame([row], ROW), **options).first()


QUOTES = {
    "the matched line": (["Path(folder, name).unlink()"], []),
    "spaced otherwise": (["Path(folder,\tname).unlink()".replace("\t", " \n ")], []),
    "two lines of the function": (["name = shelf.tidy(name)\n    Path(folder, name).unlink()"], []),
    "with a line number, which is not code": (["40 |     name = shelf.tidy(name)"], ["#1 does not appear verbatim"]),
    "a called function": (["return text.strip('/')"], []),
    "an import": (["import shelf"], []),
    "the message": (["A path from outside is removed"], []),
    "made up": (["os.remove(name)"], ["#1 does not appear verbatim"]),
    "one of three made up": (["import shelf", "shelf.clean(name)", "def tidy(text):"], ["#2 does not appear verbatim"]),
    "blank": (["  \n"], ["#1 is empty"]),
    "blank and made up": (["", "import os"], ["#1 is empty", "#2 does not appear"]),
    "none": ([], ["no evidence_quotes"]),
}


@pytest.mark.parametrize("case", QUOTES)
def test_quotes_of_a_false_positive(spark, case):
    quotes, issues = QUOTES[case]
    row = check(spark, "false_positive", quotes=quotes)
    assert len(row.verification_notes) == len(issues)
    assert all(part in note for part, note in zip(issues, row.verification_notes, strict=True))
    assert row.verification_passed == (not issues)


@pytest.mark.parametrize("label", ["needs_human_review", "likely_true_positive"])
def test_other_verdicts_need_no_quote(spark, label):
    assert check(spark, label).verification_passed


REASONING = {
    "names of the code": ("`drop_album` hands `name` to unlink() after tidy(name).", []),
    "words of the trade": ("The `input` reaches a `path` and there is no `validation`, so any `file` can go.", []),
    "a helper that is not there": ("It is checked by `check_folder` and again in resolve_safe(name).", ["check_folder", "resolve_safe"]),
    "each name once": ("`is_inside` first, is_inside(folder) again.", ["is_inside"]),
    "dotted": ("It calls shelf.tidy and Path.unlink, not os.truncate there.", ["os.truncate"]),
    "mixed case": ("AlbumStore wraps it.", ["AlbumStore"]),
    "snake case": ("That keeps safe_root in place.", ["safe_root"]),
    "plain words": ("Nothing stops a caller who sends two dots.", []),
}


@pytest.mark.parametrize("case", REASONING)
def test_grounding(spark, case):
    reasoning, tokens = REASONING[case]
    row = check(spark, reasoning=reasoning)
    assert [re.search("`(.*?)`", w).group(1) for w in row.advisory_warnings] == tokens
    # Advisory only: nothing is downgraded.
    assert row.verification_passed and row.verdict.verdict == "likely_true_positive"


def test_no_reasoning(spark):
    assert check(spark, reasoning="\t \n").advisory_warnings == ["Reasoning field is empty."]


def test_own_vocabulary_and_code_only(spark):
    assert check(spark, reasoning="`walrus`", vocabulary=["walrus"]).advisory_warnings == []
    assert len(check(spark, reasoning="`input`", vocabulary=["walrus"]).advisory_warnings) == 1
    quote = ["A path from outside is removed"]
    assert check(spark, "false_positive", quotes=quote).verification_passed
    assert not check(spark, "false_positive", quotes=quote, code_only=True).verification_passed


def test_downgrade(spark):
    row = check(spark, "false_positive", quotes=["rm -r"], categories=["other"])
    assert (row.verdict.verdict, row.verdict.confidence, row.verdict.fp_categories) == ("needs_human_review", "low", [])
    assert (row.original_verdict, row.verdict.evidence_quotes) == ("false_positive", ["rm -r"])
    flagged = check(spark, "needs_human_review", quotes=["rm -r"])
    assert (flagged.verification_passed, flagged.original_verdict, flagged.verdict.confidence) == (False, None, "medium")


def test_unusable_reply_is_not_verified(spark):
    row = check(spark, "false_positive", reason="api_error: Timeout")
    assert row.verdict.verdict == "needs_human_review" and row.verification_passed
    assert row.verification_notes == ["LLM call did not produce a usable verdict: api_error: Timeout"]
    assert row.advisory_warnings == []


PYTHON_PATTERNS = [
    r"`([A-Za-z_][A-Za-z0-9_]*)`",
    r"\b([a-z_][a-zA-Z0-9_]*)\s*\(",
    r"\b([a-z_][a-zA-Z0-9_]*\.[a-z_][a-zA-Z0-9_]+)",
    r"\b([A-Z][a-zA-Z0-9]*[a-z][A-Z][A-Za-z0-9]*|[a-z]+_[a-z_0-9]+)\b",
]


def test_tokens_match_the_runtime(spark):
    texts = [
        "a.b.c(d) `x` e_f g (h) éa_b a_bé camelCase CamelCase AbC x1.y2 `no-tick`",
        "naïve_name(été) _p(q) http://a.example.com/b_c?x=y_z über.alles a__b A1bC ªx_y x_y² ٣a_b",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.out for r in df.select("i", V.cited_tokens(F.col("t")).alias("out")).orderBy("i").collect()]
    want = [list(dict.fromkeys(m for p in PYTHON_PATTERNS for m in re.findall(p, t))) for t in texts]
    assert got == want


def test_vocabulary_is_plain():
    assert len(set(REVIEW_VOCABULARY)) == len(REVIEW_VOCABULARY) and all(w.islower() for w in REVIEW_VOCABULARY)


# -- replies ---------------------------------------------------------------------------------------

GOOD = '{"verdict":"false_positive","confidence":"high","reasoning":"r","evidence_quotes":["q"],"missing_context":[],"fp_categories":["other"],"suggested_action":"a"}'


@pytest.mark.parametrize(
    "reply,error,reason",
    [
        (GOOD, None, None),
        (GOOD.replace('["q"]', '""'), None, None),
        (GOOD.replace('["other"]', "null"), None, None),
        ('{"verdict":"needs_human_review","confidence":"low","reasoning":"","suggested_action":""}', None, None),
        (GOOD.replace("high", "certain"), None, "schema_validation_failed"),
        (GOOD.replace("false_positive", "fine"), None, "schema_validation_failed"),
        (GOOD.replace('["other"]', '["else"]'), None, "schema_validation_failed"),
        (GOOD.replace('["q"]', "[1]"), None, "schema_validation_failed"),
        (GOOD.replace('["q"]', '"text"'), None, "schema_validation_failed"),
        (GOOD.replace('"reasoning":"r",', ""), None, "schema_validation_failed"),
        ("{broken", None, "schema_validation_failed"),
        ("[]", None, "schema_validation_failed"),
        (None, None, "no_tool_use"),
        (None, "RateLimit", "api_error: RateLimit"),
    ],
)
def test_reply_validation(spark, reply, error, reason):
    schema = "fingerprint string, reply string, error string, duration_seconds double, input_tokens long, output_tokens long"
    row = X.parse_reply(spark.createDataFrame([("k", reply, error, 1.0, 5, None)], schema)).first()
    assert row.synth_reason == reason
    assert (row.verdict is None) == (reason is not None)
    assert (row.input_tokens, row.output_tokens) == (5, 0)
    if reason is None:
        assert all(isinstance(row.verdict[name], list) for name in ("evidence_quotes", "missing_context", "fp_categories"))


def test_route_fallbacks(spark):
    routes = ["unsupported_language", "context_failure", "pipeline_failure", "degraded_context", "review"]
    df = spark.createDataFrame([(r,) for r in routes], "route string")
    verdict = X.route_fallback(F.col("route"), F.lit("a.js"), F.lit("ValueError"))
    got = {r.route: r.v for r in df.select("route", verdict.alias("v")).collect()}
    assert got.pop("review") is None
    assert all((v.verdict, v.confidence) == ("needs_human_review", "low") for v in got.values())
    assert [v.reasoning.split(":")[0].split(";")[0] for v in got.values()][:3] == [
        "Only Python files are reviewed",
        "No context could be built",
        "Pipeline error",
    ]


def test_error_text_is_kept_whole(spark):
    df = spark.createDataFrame([("api_error: HTTP 429: rate limit: retry later",)], "reason string")
    reasoning = df.select(X.reply_fallback(F.col("reason"))["reasoning"]).first()[0]
    assert reasoning == "LLM call failed after retries: HTTP 429: rate limit: retry later"


def test_one_reply_per_fingerprint(spark):
    schema = "fingerprint string, reply string, error string, duration_seconds double, input_tokens long, output_tokens long"
    rows = [("k", None, "Late", 9.0, 900, 90), ("k", GOOD, None, 1.0, 5, 1), ("k", GOOD, None, 2.0, 7, 2), ("k", GOOD, None, 2.0, 7, 2), ("m", None, None, 1.0, 1, 1)]
    found = {r.fingerprint: r for r in X.single_replies(X.parse_reply(spark.createDataFrame(rows, schema))).collect()}
    assert found["k"].verdict.verdict == "false_positive" and found["k"].output_tokens == 2
    assert found["m"].synth_reason == "no_tool_use" and len(found) == 2


def test_reply_schema_accepts_what_the_parser_does():
    schema = json.loads(X.REPLY_SCHEMA)
    good = json.loads(GOOD)
    assert set(good) == set(schema["properties"]) and set(schema["required"]) <= set(good)
    assert good["verdict"] in schema["properties"]["verdict"]["enum"]


def test_quotes_in_a_text_that_is_normalized_already(spark):
    quotes = ["a b", " a\t b", "b c", "b\n c", " c ", "d", "", " \n", None, "x"]
    df = spark.createDataFrame([("a b\n c", quotes), ("", quotes), ("a b\n c", [])], "hay string, quotes array<string>")
    plain = V.quote_statuses(F.col("quotes"), F.col("hay"))
    given = V.quote_statuses(F.col("quotes"), F.col("hay"), normalize_texts(F.col("hay")))
    rows = df.select(plain.alias("plain"), given.alias("given")).collect()
    assert [r.plain for r in rows] == [r.given for r in rows]
    want = ["exact", "normalized", "normalized", "exact", "normalized", "fabricated", "empty", "empty", "fabricated", "fabricated"]
    assert rows[0].given == want
    other = df.select(V.quote_statuses(F.array(F.lit("x")), F.col("hay"), F.lit("x")).alias("s")).first()
    assert other.s == ["normalized"]
