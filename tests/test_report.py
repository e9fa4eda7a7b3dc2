import datetime as dt
import glob
import hashlib
import json
import random

import pytest

from pyspark.sql import functions as F

from winnow.functions.ordering import number_rows
from winnow.operators import report as P
from winnow.operators import reuse as R
from winnow.schemas import STORED
from winnow.sources import sinks
from winnow.sources.readers import read_report_documents


def verdicts(spark, rows):
    return spark.createDataFrame(rows, "run_id string, rule_id string, verdict string")


def test_rule_stats_and_noisy_rules(spark):
    rows = [("a", "noisy", "false_positive")] * 4 + [("a", "noisy", "likely_true_positive")]
    rows += [("a", "few", "false_positive")] * 4 + [("a", "calm", "needs_human_review")] * 9 + [("b", "noisy", "needs_human_review")]
    stats = P.rule_stats(verdicts(spark, rows))
    got = [tuple(r) for r in P.order_rules(stats).filter("run_id = 'a'").collect()]
    assert got == [("a", "few", 4, 4, 0, 0, 1.0), ("a", "noisy", 5, 4, 1, 0, 0.8), ("a", "calm", 9, 0, 0, 9, 0.0)]
    assert [(r.run_id, r.rule_id) for r in P.noisy_rules(stats).collect()] == [("a", "noisy")]
    totals = {r.run_id: r.total_findings for r in P.verdict_counts(verdicts(spark, rows)).collect()}
    assert totals == {"a": 18, "b": 1}


def test_usage_cost_and_rates(spark):
    schema = "run_id string, input_tokens long, output_tokens long, from_cache boolean, duration_seconds double"
    rows = [("a", 100, 10, False, 1.0), ("a", 200, 20, True, 2.0), ("a", None, None, False, None), ("a", 0, 0, False, 0.5)]
    r = P.usage_totals(spark.createDataFrame(rows, schema)).first()
    assert (r.total_input_tokens, r.spent_input_tokens, r.total_output_tokens, r.spent_output_tokens) == (300, 100, 30, 10)
    assert (r.cache_hits, r.cache_misses, r.fallback_count, r.review_seconds) == (1, 1, 2, 1.5)
    values = spark.range(1).select(
        P.estimate_cost(F.lit(194356), F.lit(22053)).alias("cost"),
        P.hit_rate(F.lit(2), F.lit(1)).alias("rate"),
        P.hit_rate(F.lit(0), F.lit(0)).alias("none"),
        P.fp_percent(F.lit(0.29)).alias("percent"),
    ).first()
    assert round(values.cost, 3) == 0.914
    assert (values.rate, values.none, values.percent) == (66, None, 28)


def test_numbering_matches_a_plain_sort(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else "cold", rng.choice("xyz"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, k string, i long")
    got = {(r.run, r.i): r.no for r in number_rows(df, ["run"], ["k"], "i", "no", chunk_rows=50).collect()}
    want = {}
    for run in ("hot", "cold"):
        for n, (_, k, i) in enumerate(sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])), 1):
            want[(run, i)] = n
    assert got == want


def test_order_of_findings(spark):
    schema = "run_id string, rule_id string, verdict string, severity string, processable boolean, input_idx long"
    rows = [
        ("a", "r1", "false_positive", "CRITICAL", True, 0),
        ("a", "r1", "needs_human_review", "INFO", True, 1),
        ("a", "r2", "needs_human_review", "ERROR", True, 2),
        ("a", "r1", "needs_human_review", "ERROR", True, 3),
        ("a", "r1", "needs_human_review", "ERROR", False, 4),
        ("a", "r9", "likely_true_positive", "INFO", True, 5),
    ]
    got = P.number_findings(spark.createDataFrame(rows, schema)).orderBy("finding_no").collect()
    assert [r.input_idx for r in got] == [5, 4, 3, 2, 1, 0]
    assert [r.finding_no for r in got] == [1, 2, 3, 4, 5, 6]


def test_rules_are_numbered_rows(spark):
    rows = [("a", f"r{i:02}", "false_positive" if i < 5 else "needs_human_review") for i in range(9) for _ in range(5 + i % 2)]
    rows += [("a", "mixed", v) for v in ("false_positive", "needs_human_review")] + [("b", "r00", "false_positive")]
    rules = P.run_rules(P.rule_stats(verdicts(spark, rows))).orderBy("run_id", "rule_no").collect()
    want = ["r01", "r03", "r00", "r02", "r04", "mixed", "r05", "r07", "r06", "r08"]
    assert [(r.run_id, r.rule_no, r.rule_id) for r in rules] == [("a", i + 1, n) for i, n in enumerate(want)] + [("b", 1, "r00")]
    assert [r.rule_id for r in rules if r.noisy] == want[:5]
    lines = P.rule_table(P.run_rules(P.rule_stats(verdicts(spark, rows)))).where("run_id = 'a'").orderBy("part", "rule_no").collect()
    assert [r.part for r in lines] == [0] + [1] * 10 + [2] + [3] * 5
    assert lines[1].markdown == "| `r01` | 6 | 6 | 0 | 0 | 100% |" and lines[-1].markdown == "- `r04`"


def test_sinks(spark, tmp_path):
    blocks = [(run, i, f"block {i}\nof {run}") for run in "ab" for i in range(50)]
    random.Random(1).shuffle(blocks)
    rows = [(run, i, 0, 0, text) for run, i, text in blocks] + [("a", 30, 1, n, f"line {n}") for n in (2, 1)]
    df = spark.createDataFrame(rows, "run_id string, block_no long, part int, rule_no long, markdown string")
    sinks.write_markdown_report(df, str(tmp_path / "md"), files=3)
    for run in "ab":
        text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "md" / f"run_id={run}" / "part-*"))))
        lines = {("a", 30): "line 1\nline 2\n"}
        assert text == "\n".join(f"block {i}\nof {run}\n" + lines.get((run, i), "") for i in range(50))
    rows = spark.createDataFrame([("a", 1, ["x"])], "run_id string, n int, tags array<string>")
    sinks.write_json_report(rows, rows, rows, str(tmp_path / "json"))
    (part,) = glob.glob(str(tmp_path / "json" / "findings" / "run_id=a" / "*.json"))
    assert json.loads(open(part).read()) == {"n": 1, "tags": ["x"]}


def test_nested_report_of_many_files(spark, tmp_path):
    runs = spark.createDataFrame([("a", 3, None), ("b", 0, 0.5), ("c", 1, 0.5)], "run_id string, total long, rate double")
    rules = spark.createDataFrame([("a", "r,1", 1, 2, True), ("a", 'r"2', 2, 1, False), ("c", "x", 1, 1, False)], "run_id string, rule_id string, rule_no long, total long, noisy boolean")
    errors = spark.createDataFrame([("a", i, f"line\n{i}, [") for i in (2, 1)], "run_id string, error_idx int, summary string")
    rows = [("a", f"f{i}", i, ["q]", None] if i % 2 else [], None) for i in range(40)] + [("c", "only", 7, [], "é")]
    found = spark.createDataFrame(rows, "run_id string, finding_id string, input_idx long, quotes array<string>, note string")
    sinks.write_report_documents(P.report_fragments(runs, rules, errors, found), str(tmp_path / "doc"), files=5)
    got = {}
    for run in "abc":
        parts = sorted(glob.glob(str(tmp_path / "doc" / f"run_id={run}" / "part-*")))
        got[run] = json.loads("".join(open(f, encoding="utf-8").read() for f in parts))
    assert len(glob.glob(str(tmp_path / "doc" / "run_id=a" / "part-*"))) > 1
    empty = {"rule_stats": [], "rules_to_consider_tuning": [], "scan_errors": [], "triaged_findings": []}
    assert got["b"] == {"total": 0, "rate": 0.5, **empty}
    assert got["a"] == {
        "total": 3,
        "rate": None,
        "rule_stats": [{"rule_id": "r,1", "total": 2}, {"rule_id": 'r"2', "total": 1}],
        "rules_to_consider_tuning": ["r,1"],
        "scan_errors": ["line\n1, [", "line\n2, ["],
        "triaged_findings": [{"finding_id": f"f{i}", "input_idx": i, "quotes": ["q]", None] if i % 2 else [], "note": None} for i in range(40)],
    }
    assert got["c"]["triaged_findings"] == [{"finding_id": "only", "input_idx": 7, "quotes": [], "note": "é"}]


# -- verdict store ---------------------------------------------------------------------------------


def entry(key, label="likely_true_positive", day=1, reasoning="why", action="do"):
    verdict = (label, "medium", reasoning, [], [], [], action)
    return (key, verdict, True, [], [], None, 1.0, 10, 1, dt.datetime(2024, 1, day))


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), STORED)


def test_latest_entry_wins(spark):
    rows = [entry("k1", "false_positive", day=2), entry("k1", day=3), entry("k1", day=1), entry("k2")]
    got = {r.fingerprint: (r.verdict.verdict, r.stored_at.day) for r in R.latest_entries(entries(spark, *rows)).collect()}
    assert got == {"k1": ("likely_true_positive", 3), "k2": ("likely_true_positive", 1)}


def test_equal_times_are_settled_the_same_way(spark):
    rows = [entry("k1", "false_positive"), entry("k1")]
    first = R.latest_entries(entries(spark, *rows)).first().verdict.verdict
    assert R.latest_entries(entries(spark, *rows[::-1])).first().verdict.verdict == first


def test_reuse_and_work_list(spark):
    findings = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k2")], "finding_id string, fingerprint string")
    store = entries(spark, entry("k2"))
    found = {r.finding_id: (r.from_cache, r.stored is not None) for r in R.reuse_verdicts(findings, store).collect()}
    assert found == {"a": (False, False), "b": (True, True), "c": (True, True)}
    assert [r.finding_id for r in R.work_list(findings, store).collect()] == ["a"]


def test_incomplete_entries_are_misses(spark):
    rows = [entry("ok"), entry("label", label="old_format"), entry("no", reasoning=None), (None, *entry("x")[1:])]
    assert [r.fingerprint for r in R.usable_entries(entries(spark, *rows)).collect()] == ["ok"]


def test_store_on_disk(spark, tmp_path):
    path = str(tmp_path / "not" / "yet" / "there")
    assert R.read_store(spark, path).count() == 0
    R.write_store(spark, path, entries(spark, entry("00aa"), entry("00bb"), entry("ffcc")))
    R.write_store(spark, path, entries(spark, entry("00aa", "false_positive", day=5), entry("12dd")))
    R.write_store(spark, path, entries(spark, entry("00bb", "false_positive", day=1, reasoning="older"), entry("ffcc", day=9)))
    got = {r.fingerprint: (r.verdict.verdict, r.stored_at.day) for r in R.read_store(spark, path).collect()}
    assert got.keys() == {"00aa", "00bb", "ffcc", "12dd"}
    assert got["00aa"] == ("false_positive", 5) and got["ffcc"][1] == 9
    # An outdated entry written by something else is skipped.
    entries(spark, entry("00ee", label="unknown")).write.mode("append").parquet(path)
    assert R.read_store(spark, path).count() == 4
    target = str(tmp_path / "compact")
    R.compact_store(spark, path, target)
    assert spark.read.parquet(target).count() == 4
    assert sorted(map(str, R.read_store(spark, target).collect())) == sorted(map(str, R.read_store(spark, path).collect()))
    with pytest.raises(ValueError, match="into itself"):
        R.compact_store(spark, path, path + "/")


def test_many_entries_of_one_key_are_one_hit(spark):
    findings = spark.createDataFrame([("a", "k1")], "finding_id string, fingerprint string")
    (row,) = R.reuse_verdicts(findings, entries(spark, entry("k1", day=2), entry("k1", "false_positive", day=4), entry("k2"))).collect()
    assert row.stored.verdict.verdict == "false_positive"


def test_report_documents_read_by_piece(spark, tmp_path):
    """Lists over several files and blocks of them; no document is ever one value."""
    said = ['a "quoted": [', "]", None, "{", ",", "é\r\n日本", "[" * 300]
    rows = [(run, kind, i, said[i % 7]) for run in ("a", "b") for kind, n in ((1, 3), (3, 0 if run == "b" else 50), (5, 40)) for i in range(n)]
    elements = [(r, k, i, ("," if i else "") + json.dumps(x if k == 3 else {"n": i, "x": x})) for r, k, i, x in rows]
    for r in ("a", "b"):
        elements += [(r, 0, 0, '{"total": 7,"rules":['), (r, 2, 0, '],"errors":['), (r, 4, 0, '],"found":['), (r, 6, 0, "]}")]
    folder = str(tmp_path / "doc")
    sinks.write_report_documents(spark.createDataFrame(elements, "run_id string, part int, place int, json string"), folder, files=5)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        pieces = read_report_documents(spark, folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    got = {(r.run_id, r.key, r.place): json.loads(r.json) for r in pieces.elements.collect()}
    keys = {1: "rules", 3: "errors", 5: "found"}
    assert got == {(r, keys[k], i): x if k == 3 else {"n": i, "x": x} for r, k, i, x in rows}
    assert sorted(r.json for r in pieces.head.collect()) == ['{"total": 7,"rules":['] * 2
    texts = pieces.elements.filter("key = 'errors'").select("run_id", "order", F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v").alias("said"))
    want = hashlib.sha256("\n".join(x for r, k, _, x in rows if r == "a" and k == 3 and x is not None).encode()).hexdigest()
    assert [tuple(r) for r in P.hash_in_order(texts, "hash").collect()] == [("a", want)]
