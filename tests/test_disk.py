"""What queries leave on disk while they run."""

import glob
import json
import re
import time

from fixtures import result
from pyspark.sql import functions as F

from winnow.operators import codeindex as C
from winnow.operators import context as X
from winnow.operators import large_scans as L
from winnow.plans import triage as T
from winnow.session import stage, staging_folder, unstage
from winnow.sources.readers import read_scan_pieces

FILES = "repo_id string, path string, length long, text string"
FINDINGS = "finding_id string, repo_id string, file_path string, start_line int, end_line int, matched_code string"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def staged(spark):
    """The folders of staged tables."""
    folder = staging_folder(spark).removeprefix("file:").replace("///", "/")
    return {f for f in glob.glob(f"{folder}/winnow-stage-*") if glob.glob(f"{f}/*.parquet")}


def columns_of(spark, folders):
    return [set(spark.read.parquet(f).columns) for f in folders]


def nodes_of(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes_of(plan.children().apply(i))


def names_of(plan):
    return {plan.output().apply(i).name() for i in range(plan.output().size())}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    dealt = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 10).alias("k")).count()
    out = stage(dealt)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    # the same table can be made again
    assert sorted(out.collect()) == sorted(dealt.collect()) == sorted(stage(dealt).collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    folders = staged(spark)
    unstage(out)
    assert len(staged(spark)) == len(folders) - 1


def test_calls_are_looked_for_in_a_function_without_the_lines_of_its_file(spark):
    """Rows that wait for Python are kept on disk; a file's lines beside each of its functions grow with the square of them."""
    text = "def f(x):\n    return g(x) + h(x)\ndef g(x):\n    return k(x)\n"
    lines = stage(C.file_lines(spark.createDataFrame([("r", "a.py", len(text), text)], FILES)))
    spans = [("r", "a.py", 1, 2), ("r", "a.py", 3, 4)]
    found = X.call_sites(spark.createDataFrame(spans, "repo_id string, path string, function_start int, function_end int"), lines)
    assert sorted((r.function_start, r.call_no, r.name) for r in found.collect()) == [(1, 0, "g"), (1, 1, "h"), (3, 0, "k")]
    waiting = [n.children().apply(0) for n in nodes_of(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "ArrowEvalPython"]
    assert waiting and not any("masked_lines" in names_of(n) for n in waiting)


def test_findings_meet_no_lines(spark):
    """What findings are joined with was written before, and the lines of files are gone by then."""
    text = "import os\n\ndef f(x):\n    return g(x) + len(x)\n\ndef g(x):\n    return os.k(x)\n"
    files = spark.createDataFrame([("r", "a.py", len(text), text)], FILES)
    rows = [("1", "r", "a.py", 4, 4, "x"), ("2", "r", "a.py", 4, 4, "x"), ("3", "r", "a.py", 1, 1, "x"), ("4", "r", "b.py", 1, 1, "x")]
    before = staged(spark)
    out = X.build_contexts(spark.createDataFrame(rows, FINDINGS), files)
    assert not re.search("raw_lines|masked_lines", out._jdf.queryExecution().toString())
    assert not any("raw_lines" in columns for columns in columns_of(spark, staged(spark) - before))
    got = {r.finding_id: r for r in out.collect()}
    assert got["1"].context.containing_function_source == got["2"].context.containing_function_source == "3 | def f(x):\n4 |     return g(x) + len(x)"
    assert got["1"].function_text == "def f(x):\n    return g(x) + len(x)"
    assert [c.source for c in got["1"].context.called_functions] == ["6 | def g(x):\n7 |     return os.k(x)"]
    assert got["3"].context.containing_function_source is None and got["3"].context.imports == "import os"
    assert got["4"].context.extraction_notes == ["Source file not found: b.py"]


def test_pieces_of_scans_are_written_once(spark, tmp_path):
    """No other table has a row per piece when the elements stand, and texts within a chunk are not joined by piece."""
    rows = [result("a.py", i + 1, message=f"m{i}, [" * 20) for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps({"results": rows, "engine": [[[[1, 2, 3]]]], "errors": []}))
    pieces = read_scan_pieces(spark, str(tmp_path), "r", chunk_bytes=3000)
    before = staged(spark)
    found = L.assemble(pieces)
    new = staged(spark) - before
    assert new and all(spark.read.parquet(folder).count() < pieces.count() / 5 for folder in new) and pieces.count() > 1000
    assert found.results.count() == 50 and found.documents.first().doc_error is None


def test_a_run_keeps_no_parsed_scans(spark):
    text = "def f(x):\n    return g(x)\n"
    files = spark.createDataFrame([("r", "a.py", len(text), text)], FILES)
    good = {"results": [result("a.py", 2, rule="r"), {"check_id": 5}], "errors": [{"path": "x.py", "message": "no"}]}
    scans = spark.createDataFrame([("s1", "r", json.dumps(good)), ("s2", "r", "{")], "scan_id string, repo_id string, text string")
    before = staged(spark)
    prepared = T.prepare(scans, files)
    new = columns_of(spark, staged(spark) - before)
    assert new and not any({"doc", "raw"} & columns and {"doc_error", "reject_reason"} & columns for columns in new)
    assert [r.summary for r in prepared.scan_errors.collect()] == ["x.py: no"]
    assert [r.reason for r in prepared.scan_rejects.collect()] == ["check_id missing or not a string"]
    assert [(r.scan_id, r.reason) for r in prepared.file_rejects.collect()] == [("s2", "not valid JSON")]
    assert prepared.findings.count() == 1
