import datetime
import glob
import json

import pytest
from fixtures import STATIONS, line_of, result, scan_docs, source_files
from pyspark.sql import functions as F

from winnow.operators import report as P
from winnow.operators import reuse as R
from winnow.plans import triage as T
from winnow.plans.publish import publish
from winnow.schemas import STORED
from winnow.sources.readers import read_replies
from winnow.sources.sinks import write_requests

REPLIES = "fingerprint string, reply string, error string, duration_seconds double, input_tokens long, output_tokens long"


def reply(quote, label="false_positive"):
    return json.dumps(
        {
            "verdict": label,
            "confidence": "high",
            "reasoning": "The `ghost_name` helper.",
            "evidence_quotes": [quote],
            "missing_context": [],
            "fp_categories": ["other"],
            "suggested_action": "Close.",
        }
    )


def docs(spark):
    shell = line_of(STATIONS, "subprocess.run")
    bounds = line_of(STATIONS, "in_range(value)")
    level = line_of(STATIONS, "return celsius(station.level)")
    return scan_docs(
        spark,
        {
            "results": [
                result("chart.html", 1, rule="rule.html"),
                result("stations.py", shell),
                result("stations.py", bounds, rule="rule.net"),
                result("gone.py", 1),
                result("stations.py", level, rule="rule.wrap"),
                result("stations.py", shell),
                {"check_id": "x"},
            ],
            "errors": [{"path": "t.html", "message": "bad"}],
        },
    )


@pytest.fixture(scope="module")
def first_run(spark):
    prepared = T.prepare(docs(spark), source_files(spark))
    found = {r.result_idx: r for r in prepared.findings.collect()}
    answers = [
        (found[1].fingerprint, reply("subprocess.run(command, shell=True)"), None, 2.0, 100, 10),
        (found[2].fingerprint, reply("invented()", "likely_true_positive"), None, 3.0, 200, 20),
        (found[4].fingerprint, None, "Timeout", 4.0, 0, 0),
    ]
    # Retries leave failures and copies beside a usable reply.
    retried = [(found[1].fingerprint, None, "Timeout", 9.0, 0, 0), answers[0], answers[2]]
    done = T.conclude(prepared.findings, spark.createDataFrame(answers + retried, REPLIES))
    return prepared, found, done


def test_routes_and_requests(first_run):
    prepared, found, _ = first_run
    assert {i: r.route for i, r in found.items()} == {
        0: "unsupported_language",
        1: "review",
        2: "review",
        3: "degraded_context",
        4: "review",
        5: "review",
    }
    # The same match twice is asked once.
    assert found[1].fingerprint == found[5].fingerprint
    requests = {r.fingerprint: r for r in prepared.requests.collect()}
    assert requests.keys() == {found[i].fingerprint for i in (1, 2, 4)}
    text = requests[found[2].fingerprint].request
    assert "## Called functions (2 resolved)" in text and "### `in_range` (from limits.py, same_module_import)" in text
    assert "- Definition of `poll()` not resolved." in text
    assert requests[found[2].fingerprint].instructions
    assert [r.summary for r in prepared.scan_errors.collect()] == ["t.html: bad"]
    assert [r.reason for r in prepared.scan_rejects.collect()] == ["path missing or not a string"]
    assert prepared.file_rejects.count() == 0


def test_one_row_per_finding(first_run):
    _, _, done = first_run
    rows = {r.result_idx: r for r in done.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5]
    assert {i: r.verdict.verdict for i, r in rows.items()} == {
        0: "needs_human_review",
        1: "false_positive",
        2: "needs_human_review",
        3: "needs_human_review",
        4: "needs_human_review",
        5: "false_positive",
    }
    assert rows[2].original_verdict == "likely_true_positive" and not rows[2].verification_passed
    assert rows[4].verification_notes == ["LLM call did not produce a usable verdict: api_error: Timeout"]
    assert rows[3].verdict.missing_context == ["Verdict synthesized; LLM was not called."]
    assert rows[0].context.language == "unsupported"
    assert "ghost_name" in rows[1].advisory_warnings[0]
    # Tokens of a shared reply count once.
    assert [rows[i].input_tokens for i in (1, 5)] == [100, None]


def test_conservation(first_run):
    _, _, done = first_run
    usage = P.usage_totals(done).first()
    assert usage.cache_hits + usage.cache_misses + usage.fallback_count == 6
    stats = P.rule_stats(done.withColumn("verdict", F.col("verdict.verdict")))
    assert stats.agg(F.sum("total")).first()[0] == 6


def test_second_run_reuses_verdicts(spark, first_run, tmp_path):
    _, found, done = first_run
    path = str(tmp_path / "store")
    R.write_store(spark, path, R.store_rows(done, F.current_timestamp()))
    store = R.read_store(spark, path)
    # Fallbacks are not stored, downgraded replies are.
    assert {r.fingerprint for r in store.collect()} == {found[1].fingerprint, found[2].fingerprint}

    # Lines above the function move it, but its content keeps the key.
    moved = {"stations.py": STATIONS.replace("import subprocess\n", "import subprocess\nimport sys\n\n\n")}
    shift = scan_docs(
        spark,
        {
            "results": [
                result("stations.py", line_of(moved["stations.py"], "subprocess.run")),
                result("stations.py", line_of(moved["stations.py"], "return celsius(station.level)"), rule="rule.wrap"),
            ]
        },
    )
    files = source_files(spark, {**moved, "limits.py": "", "units.py": ""})
    again = T.prepare(shift, files, store)
    assert {r.result_idx: r.from_cache for r in again.findings.collect()} == {0: True, 1: False}
    assert again.requests.count() == 1
    rows = {r.result_idx: r for r in T.conclude(again.findings, spark.createDataFrame([], REPLIES)).collect()}
    assert rows[0].from_cache and rows[0].verdict.verdict == "false_positive" and rows[0].input_tokens == 100
    assert rows[0].start_line == line_of(moved["stations.py"], "subprocess.run")
    assert rows[1].verification_notes == ["LLM call did not produce a usable verdict: api_error: no reply"]
    assert T.prepare(shift, files, store, reuse=False).requests.count() == 2


def test_limit(spark):
    prepared = T.prepare(docs(spark), source_files(spark), limit=1)
    assert sorted(r.result_idx for r in prepared.findings.collect()) == [0, 1]


def test_publish(spark, first_run, tmp_path):
    prepared, _, done = first_run
    runs = spark.createDataFrame(
        [(run, "0.1.0", "0.1.0", "reviewer-1", "/repos/met", "/scans/one.json", 12.5) for run in ("scan0", "empty")],
        "run_id string, tool_version string, prompt_version string, model string, repo_path string, findings_path string, "
        "total_duration_seconds double",
    ).withColumn("generated_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    path = str(tmp_path / "report")
    publish(done, prepared.scan_errors, runs, path)

    (part,) = glob.glob(path + "/markdown/run_id=scan0/part-*")
    text = open(part, encoding="utf-8").read()
    assert text.startswith("# Triage report\n\n_Generated 2024-01-02 03:04 UTC_\n\n## Summary\n\n| Metric | Value |\n")
    assert "| Total findings | 6 |" in text and "| Cache | 0 hits, 2 misses (0% hit rate) |" in text
    order = [line for line in text.splitlines() if line.startswith("### ")]
    assert [line.split(" ", 2)[1] for line in order] == ["1.", "2.", "3.", "4.", "5.", "6."]
    assert [line.rsplit("`", 2)[1] for line in order] == ["rule.a", "rule.html", "rule.net", "rule.wrap", "rule.a", "rule.a"]
    assert "> ⚠️ LLM originally returned `likely_true_positive` — downgraded" in text
    assert text.rstrip().endswith("_The scanner had 1 parse errors during the scan (not counted as findings)._")
    assert text.index("## Findings") < text.index("### 1.") < text.index("## Per-rule statistics") < text.index("\n---\n")

    (empty,) = glob.glob(path + "/markdown/run_id=empty/part-*")
    assert "## Findings" not in open(empty, encoding="utf-8").read()
    summary = {r.run_id: r for r in spark.read.json(path + "/json/summary").collect()}
    assert summary["scan0"].total_findings == 6 and summary["empty"].total_findings == 0
    rules = spark.read.json(path + "/json/rules").orderBy("rule_no").collect()
    assert [r.rule_no for r in rules] == [1, 2, 3, 4]
    assert {r.rule_id: r.total for r in rules} == {"rule.a": 3, "rule.html": 1, "rule.net": 1, "rule.wrap": 1}
    assert "| Duration | 12.5s |" in text and "| Review time of new findings | 9.0s |" in text
    assert spark.read.json(path + "/json/findings").count() == 6


def test_exchange_files(spark, first_run, tmp_path):
    prepared, found, _ = first_run
    write_requests(prepared.requests, str(tmp_path / "requests"))
    sent = spark.read.json(str(tmp_path / "requests"))
    assert sent.count() == 3 and set(sent.columns) == {"fingerprint", "prompt_version", "instructions", "request", "reply_schema"}
    (tmp_path / "replies.json").write_text(
        json.dumps({"fingerprint": found[1].fingerprint, "reply": reply("subprocess.run(command, shell=True)"), "input_tokens": 7})
    )
    done = T.conclude(prepared.findings, read_replies(spark, str(tmp_path / "replies.json")))
    rows = {r.result_idx: r for r in done.collect()}
    assert rows[1].verdict.verdict == "false_positive" and rows[1].input_tokens == 7
    assert rows[2].synth_reason == "api_error: no reply"


def test_fingerprint_options(spark, first_run):
    prepared, found, _ = first_run
    plain = {r.result_idx: r.fingerprint for r in R.add_fingerprint(prepared.findings).collect()}
    numbered = {r.result_idx: r.fingerprint for r in R.add_fingerprint(prepared.findings, compat_line_prefix=True).collect()}
    callees = {r.result_idx: r.fingerprint for r in R.add_fingerprint(prepared.findings, include_callees=True).collect()}
    assert plain == {i: r.fingerprint for i, r in found.items()}
    # Without an enclosing function nothing is numbered; without resolved calls nothing is added.
    assert {i for i in plain if plain[i] != numbered[i]} == {1, 2, 4, 5}
    assert {i for i in plain if plain[i] != callees[i]} == {2, 4}


def test_many_entries_of_a_fingerprint_give_one_row(spark, first_run):
    prepared, found, done = first_run
    rows = R.store_rows(done, F.lit("2024-01-02").cast("timestamp"))
    later = R.store_rows(done, F.lit("2024-02-02").cast("timestamp")).withColumn("input_tokens", F.lit(77).cast("long"))
    again = T.prepare(docs(spark), source_files(spark), rows.unionByName(rows).unionByName(later))
    out = {r.result_idx: r for r in T.conclude(again.findings, spark.createDataFrame([], REPLIES)).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4, 5] and out[1].from_cache and out[1].input_tokens == 77


def store_entry(number, at="2024-01-02", tokens=1):
    return {
        "fingerprint": f"{number:02x}" + "0" * 14,
        "verdict": {"verdict": "false_positive", "confidence": "high", "reasoning": "r", "suggested_action": "a"},
        "input_tokens": tokens,
        "stored_at": datetime.datetime.fromisoformat(at),
    }


def store_table(spark, *entries):
    return spark.createDataFrame([{**dict.fromkeys(STORED.fieldNames()), **e} for e in entries], STORED)


def findings_of(spark, *numbers):
    return spark.createDataFrame([(None if n is None else f"{n:02x}" + "0" * 14,) for n in numbers], "fingerprint string")


def compacted(spark, tmp_path):
    runs, target = str(tmp_path / "runs"), tmp_path / "compact"
    R.write_store(spark, runs, store_table(spark, *[store_entry(n) for n in range(256)]))
    R.compact_store(spark, runs, str(target), folder_entries=16)
    return target


def test_lookup_reads_only_the_folders_of_its_fingerprints(spark, tmp_path):
    store = compacted(spark, tmp_path)
    assert sorted(p.name for p in store.glob("part=*")) == [f"part={d}" for d in "0123456789abcdef"]
    R.write_store(spark, str(store), store_table(spark, store_entry(0x21, "2024-03-01", 9), store_entry(0x22, "2023-01-01", 9)))
    # Files that are no Parquet fail whoever reads them.
    for folder in store.glob("part=?"):
        if folder.name not in ("part=2", "part=e"):
            for file in folder.iterdir():
                file.write_bytes(b"no Parquet")
    asked = findings_of(spark, 0x21, 0x21, 0x22, 0xE0, None)
    found = {r.fingerprint[:2]: r.input_tokens for r in R.lookup_store(spark, str(store), asked).collect()}
    assert found == {"21": 9, "22": 1, "e0": 1}
    with pytest.raises(Exception, match="part="):
        R.read_store(spark, str(store)).collect()


def test_lookup_agrees_with_a_read_of_the_whole_store(spark, tmp_path):
    store = str(compacted(spark, tmp_path))
    asked = findings_of(spark, *range(0, 256, 3), 999)
    found = {r.fingerprint for r in R.lookup_store(spark, store, asked).collect()}
    assert found == {f"{n:02x}" + "0" * 14 for n in range(0, 256, 3)}
    assert R.read_store(spark, store).count() == 256
    assert R.lookup_store(spark, store, findings_of(spark)).count() == 0
    # A store that was never compacted, one of loose files, and none at all.
    appended, loose, none = (str(tmp_path / name) for name in ("appended", "loose", "none"))
    R.write_store(spark, appended, store_table(spark, store_entry(1), store_entry(2)))
    store_table(spark, store_entry(1), store_entry(3)).write.parquet(loose)
    R.write_store(spark, loose, store_table(spark, store_entry(1, "2024-05-05", 5)))
    for path, want in ((appended, {1: 1, 2: 1}), (loose, {1: 5, 3: 1}), (none, {})):
        found = R.lookup_store(spark, path, findings_of(spark, 1, 2, 3)).collect()
        assert {int(r.fingerprint[:2], 16): r.input_tokens for r in found} == want
        assert R.read_store(spark, path).count() == len(want)
    with pytest.raises(ValueError, match="into itself"):
        R.compact_store(spark, loose, loose + "/")


def test_a_run_takes_the_path_of_a_store(spark, first_run, tmp_path):
    _, found, done = first_run
    R.write_store(spark, str(tmp_path / "runs"), R.store_rows(done, F.current_timestamp()))
    R.compact_store(spark, str(tmp_path / "runs"), str(tmp_path / "store"))
    by_path = T.prepare(docs(spark), source_files(spark), str(tmp_path / "store"))
    by_table = T.prepare(docs(spark), source_files(spark), R.read_store(spark, str(tmp_path / "store")))
    seen = [{r.result_idx: r.stored for r in p.findings.collect()} for p in (by_path, by_table)]
    assert seen[0] == seen[1] and any(seen[0].values())
