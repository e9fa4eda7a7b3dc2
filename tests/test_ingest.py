import json

import pytest
from fixtures import STATIONS, result, scan_docs, source_files
from pyspark.sql import functions as F

from winnow.operators import ingest as I
from winnow.sources.readers import read_scans, read_source_tree


def parse(spark, *results, **top):
    docs = scan_docs(spark, {"results": list(results), **top})
    return I.parse_results(I.raw_results(I.scan_documents(docs)))


def one(spark, item):
    return I.valid_findings(parse(spark, item)).first()


def test_maps_a_result(spark):
    r = one(spark, result("src\\app\\a.py", 3, 4, metadata={"cwe": "CWE-1", "owasp": ["A1", "A2"], "confidence": "LOW"}))
    assert r.finding_id == "scan0#0"
    assert (r.rule_id, r.file_path, r.start_line, r.end_line, r.start_col, r.end_col) == ("rule.a", "src/app/a.py", 3, 4, 1, 9)
    assert (r.cwe, r.owasp, r.scanner_confidence, r.severity) == (["CWE-1"], ["A1", "A2"], "LOW", "WARNING")
    assert not r.has_dataflow_trace and r.dataflow_trace_summary is None


def test_defaults(spark):
    r = one(spark, {"check_id": "r", "path": "p", "start": {"line": 1}, "end": {"line": 2}})
    assert (r.message, r.severity, r.severity_raw, r.cwe, r.owasp) == ("", "WARNING", None, [], [])
    assert r.start_col is None and r.scanner_confidence is None and r.embedded_lines is None


@pytest.mark.parametrize(
    "given,expected,raw",
    [("ERROR", "ERROR", "ERROR"), ("CRITICAL", "CRITICAL", "CRITICAL"), ("EXPERIMENT", "WARNING", "EXPERIMENT"), ("error", "WARNING", "error"), (3, "WARNING", "3"), (None, "WARNING", None)],
)
def test_severity(spark, given, expected, raw):
    r = one(spark, result("a.py", 1, severity=given))
    assert (r.severity, r.severity_raw) == (expected, raw)


@pytest.mark.parametrize("cwe,expected", [("x", ["x"]), (["x", "y"], ["x", "y"]), (None, []), (5, []), ({"a": 1}, []), (["x", 5], ["x", "5"])])
def test_string_or_list(spark, cwe, expected):
    assert one(spark, result("a.py", 1, metadata={"cwe": cwe})).cwe == expected


@pytest.mark.parametrize(
    "trace,present,summary",
    [
        (None, False, None),
        ({}, True, None),
        ({"taint_source": "req", "taint_sink": "exec", "intermediate_vars": ["a", "b"]}, True, "Source: req | Sink: exec | Intermediate steps: 2"),
        ({"taint_source": ["CliLoc", [1]], "intermediate_vars": []}, True, 'Source: ["CliLoc",[1]]'),
        ({"other": 1}, True, "Dataflow trace present (structure unrecognized)"),
    ],
)
def test_dataflow_trace(spark, trace, present, summary):
    r = one(spark, result("a.py", 1, dataflow_trace=trace))
    assert (r.has_dataflow_trace, r.dataflow_trace_summary) == (present, summary)


def test_malformed_results_are_set_aside(spark):
    def without(key):
        item = result("a.py", 1)
        del item[key]
        return item

    cases = [
        ("text", "result is not an object"),
        (without("check_id"), "check_id missing or not a string"),
        (without("path"), "path missing or not a string"),
        ({**result("a.py", 1), "extra": None}, "extra is not an object"),
        (result("a.py", 1, metadata=None), "metadata is not an object"),
        (without("start"), "start_line missing or not a whole number"),
        ({**result("a.py", 1), "end": {"line": 12.5}}, "end_line missing or not a whole number"),
        (result("a.py", 0), "start_line below 1"),
        ({**result("a.py", 1), "start": {"line": 1, "col": "x"}}, "start_col not a whole number"),
        (result("a.py", 1, message=5), "message not a string"),
        (result("a.py", 1, severity=["x"]), "severity not a string"),
        (result("a.py", 1, metadata={"confidence": 5}), "confidence not a string"),
        (result("a.py", 1, dataflow_trace=[1]), "dataflow_trace is not an object"),
    ]
    parsed = parse(spark, result("ok.py", 1), *[item for item, _ in cases])
    rejects = {r.result_idx: r.reason for r in I.scan_rejects(parsed).collect()}
    assert rejects == {i: reason for i, (_, reason) in enumerate(cases, 1)}
    assert [r.file_path for r in I.valid_findings(parsed).collect()] == ["ok.py"]


def test_scan_errors(spark):
    errors = [{"path": "a.html", "message": "Syntax error\nat line 3"}, {}, "noise", {"path": "b", "message": None}]
    docs = scan_docs(spark, {"results": [], "errors": errors}, {"results": []})
    found = I.scan_errors(I.scan_documents(docs)).orderBy("error_idx").collect()
    assert [(r.error_idx, r.summary) for r in found] == [
        (0, "a.html: Syntax error"),
        (1, "<unknown>: Unknown error"),
        (3, "b: Unknown error"),
    ]


def test_unusable_documents(spark):
    good = {"paths": {}, "results": [result("a.py", 1)], "errors": 7}
    docs = scan_docs(spark, "{broken", "[1]", "{}", {"results": 5}, good, '{"results": [] } x', '{"results": [1,]}')
    parsed = I.scan_documents(docs)
    assert {r.scan_id: r.reason for r in I.scan_file_rejects(parsed).collect()} == {
        "scan0": "not valid JSON",
        "scan1": "not a JSON object",
        "scan2": "no top-level results",
        "scan3": "results is not a list",
        "scan5": "not valid JSON",
        "scan6": "not valid JSON",
    }
    assert I.scan_errors(parsed).count() == 0
    assert I.raw_results(parsed).count() == 1
    with pytest.raises(Exception, match="scan scan[0-3]: not"):
        I.raw_results(I.scan_documents(docs.filter("scan_id < 'scan2'"), on_error="raise")).collect()
    with pytest.raises(ValueError):
        I.scan_documents(docs, on_error="ignore")


def test_matched_code(spark):
    n = len(STATIONS.splitlines())
    found = I.valid_findings(
        parse(
            spark,
            result("stations.py", 1, lines="given code"),
            result("stations.py", 7, 8),
            result("stations.py", 8, 7, lines=""),
            result("stations.py", n, n + 5, lines=["no", "text"]),
            result("gone.py", 1),
        )
    )
    rows = {r.result_idx: r.matched_code for r in I.resolve_matched_code(found, source_files(spark)).collect()}
    lines = STATIONS.splitlines()
    assert rows == {
        0: "given code",
        1: "\n".join(lines[6:8]),
        2: "",
        3: lines[-1],
        4: "<could not read file: gone.py>",
    }


def test_limit_keeps_other_languages(spark):
    rows = [result(f"f{i}.{'py' if i % 3 else 'html'}", 1) for i in range(9)]
    found = I.mark_processable(I.valid_findings(parse(spark, *rows)))
    kept = I.limit_per_scan(found, 2)
    assert sorted(r.result_idx for r in kept.collect()) == [0, 1, 2, 3, 6]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_readers(spark, tmp_path):
    (tmp_path / "scans" / "met").mkdir(parents=True)
    (tmp_path / "scans" / "met" / "one.json").write_text(json.dumps({"results": [result("a.py", 1)]}, indent=1))
    docs = read_scans(spark, str(tmp_path / "scans" / "*" / "*.json"))
    row = docs.first()
    assert row.repo_id == "met" and row.scan_id.endswith("/one.json")
    assert I.raw_results(I.scan_documents(docs)).count() == 1

    tree = tmp_path / "tree"
    (tree / "pkg").mkdir(parents=True)
    (tree / "a.py").write_bytes(b"x = 1\n")
    (tree / "pkg" / "b.py").write_bytes(b"caf\xe9 \xff\xfe ok")
    (tree / "pkg" / "c.txt").write_text("no")
    files = read_source_tree(spark, str(tree), "met", glob="*.py")
    got = {r.path: (r.repo_id, r.length, r.text) for r in files.collect()}
    assert got == {
        "a.py": ("met", 6, "x = 1\n"),
        "pkg/b.py": ("met", 10, b"caf\xe9 \xff\xfe ok".decode("utf-8", errors="replace")),
    }
    plan = files.filter(F.col("length") <= 8)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,8)" in plan


def test_repeated_keys(spark):
    docs = scan_docs(spark, '{"results": [{"check_id": "a", "check_id": "b", "path": "p", "start": {"line": 1}, "end": {"line": 1}}]}')
    assert I.parse_results(I.raw_results(I.scan_documents(docs))).first().rule_id == "b"


ONE = '{"results": [], "errors": []}'
TAILS = {
    "nothing": ("", None),
    "white space": (" \n", None),
    "another document": ("\n" + ONE, "not valid JSON"),
    "a comma and another document": ("," + ONE, "more than one JSON document"),
    "junk": (" junk", "not valid JSON"),
    "junk that ends like a document": (" junk }", "not valid JSON"),
    "a bracket": ("]", "not valid JSON"),
    "brackets": ("]}", "not valid JSON"),
}


@pytest.mark.parametrize("tail", TAILS)
def test_text_after_the_document(spark, tail):
    text, reason = TAILS[tail]
    df = spark.createDataFrame([("s", "r", ONE + text)], "scan_id string, repo_id string, text string")
    assert [r.reason for r in I.scan_file_rejects(I.scan_documents(df)).collect()] == ([reason] if reason else [])


def test_trees_of_many_repositories(spark, tmp_path):
    for name in ("one/a.py", "one/sub/b.py", "two/a.py", "beside.py"):
        path = tmp_path / "trees" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    found = {(r.repo_id, r.path): r.text for r in read_source_tree(spark, str(tmp_path / "trees")).collect()}
    assert found == {("one", "a.py"): "one/a.py", ("one", "sub/b.py"): "one/sub/b.py", ("two", "a.py"): "two/a.py"}


def test_size_guard_reaches_the_files(spark, tmp_path):
    from winnow.operators import codeindex as C

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "small.py").write_text("x = 1\n")
    (tmp_path / "r" / "large.py").write_text("y = 2\n" * 1000)
    files = read_source_tree(spark, str(tmp_path))
    lines = C.file_lines(files, max_file_bytes=100)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan
    assert [r.path for r in lines.select("path").collect()] == ["small.py"]
    paths = files.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in paths


def test_rejects_parse_each_text_once(spark):
    texts = [("a", '{"results": []}'), ("b", "junk"), ("c", '{"results": []},{"results": []}'), ("d", "[1]"), ("e", "{}"), ("f", '{"results": 1}')]
    df = spark.createDataFrame([(i, "r", t) for i, t in texts], "scan_id string, repo_id string, text string")
    found = I.scan_file_rejects(I.scan_documents(df))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("parseJson") == 1
    assert {r.scan_id: r.reason for r in found.collect()} == {
        "b": "not valid JSON",
        "c": "more than one JSON document",
        "d": "not a JSON object",
        "e": "no top-level results",
        "f": "results is not a list",
    }
