"""Scans read in chunks against the same scans read whole."""

import json
import random

import pytest
from fixtures import result
from pyspark.sql import functions as F

from winnow.operators import ingest as I
from winnow.operators import large_scans as L
from winnow.sources.readers import read_scan_pieces, read_scans


def written(folder, docs):
    for name, text in docs.items():
        (folder / f"{name}.json").write_text(text, encoding="utf-8")
    return str(folder)


def both(spark, folder, chunk_bytes):
    """Findings, rejects, errors and unusable files, read whole and read in chunks."""
    whole = I.scan_documents(read_scans(spark, folder))
    parts = L.assemble(read_scan_pieces(spark, folder, chunk_bytes=chunk_bytes))

    def told(results, errors, documents):
        parsed = I.parse_results(results)
        frames = [I.valid_findings(parsed), I.scan_rejects(parsed), errors, documents.filter("doc_error IS NOT NULL").select("scan_id", "repo_id", "doc_error")]
        return [sorted(map(repr, f.collect())) for f in frames]

    return told(I.raw_results(whole), I.scan_errors(whole), whole), told(parts.results, L.scan_errors(parts), parts.documents)


def trouble(draw):
    """A text with all that could be taken for structure."""
    return "".join(draw.choices(['"', "\\", ",", "[", "]", "{", "}", ":", "é", "\n", " ", "a", '"results":[', "日本"], k=draw.randint(0, 12)))


def scan(draw, results):
    rows = [result(f"a/{trouble(draw)}.py", draw.randint(0, 9), rule=trouble(draw), lines=trouble(draw), note=[trouble(draw), {"x": [1, [2, {}]]}]) for _ in range(results)]
    rows = [draw.choice([r, r, r, r, None, 5, "s,]", [], [[1], {}], {}]) for r in rows]
    doc = {
        "version": trouble(draw),
        "paths": {"scanned": [trouble(draw), "b"], "results": [1, 2]},
        "results": rows,
        "time": [[[], [{}]], {"errors": [{"message": "inner"}]}],
        "errors": [{"path": trouble(draw), "message": trouble(draw)}, 7, {}],
        "engine": 1.5,
    }
    keys = list(doc)
    draw.shuffle(keys)
    return {k: doc[k] for k in keys}


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_like_whole_documents(spark, tmp_path, chunk_bytes):
    draw = random.Random(chunk_bytes)
    docs = {}
    for i in range(8):
        doc = scan(draw, draw.choice([0, 1, 2, 12]))
        docs[f"s{i}"] = json.dumps(doc, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5, separators=draw.choice([None, (",", ":"), (" , ", " : ")]))
    whole, parts = both(spark, written(tmp_path, docs), chunk_bytes)
    assert whole == parts and len(whole[0]) > 5 and whole[3] == []


BROKEN = {
    "empty_list": '{"results":[]}',
    "empty_errors": '{"errors":[],"results":[ ]}',
    "object": "{}",
    "no_results": '{"a":[1,2],"b":{"results":[1]}}',
    "not_a_list": '{"results":{"a":1},"errors":[]}',
    "list": "[1,2]",
    "number": "17",
    "open_list": '{"results":[{"a":1},{"b":2}',
    "open_string": '{"results":[{"a":"1},{"b":2}]}',
    "too_many_closed": '{"results":[1]]}',
    "two_documents": '{"results":[1]}\n{"results":[2]}',
    "two_with_comma": '{"results":[1]},{"results":[2]}',
    "junk_behind": '{"results":[1],"errors":[]} junk }',
    "comma_behind": '{"results":[1],"errors":[]},',
    "bad_entry": '{"results":[{"a":1},{"a":}],"errors":[]}',
    "comma_in_list": '{"results":[1,],"errors":[]}',
    "two_commas": '{"results":[1,,2],"errors":[]}',
    "key_twice": '{"results":[1],"errors":[],"results":[{"check_id":"b"},3]}',
    "spaces": ' \n{ "results" : [ \n 1 , {"check_id":"x"} \n ] \n, "errors" : [ ] } \n',
}


@pytest.mark.parametrize("chunk_bytes", [8, 1 << 20])
def test_unusable_documents(spark, tmp_path, chunk_bytes):
    whole, parts = both(spark, written(tmp_path, BROKEN), chunk_bytes)
    assert whole[:3] == parts[:3]
    name = lambda rows: {r.split("/")[-1].split(".json")[0] for r in rows}
    assert name(whole[3]) == name(parts[3])
    reason = {r.split("/")[-1].split(".json")[0]: r.split("doc_error=")[1] for r in parts[3]}
    assert reason["no_results"] == "'no top-level results')" and reason["not_a_list"] == "'results is not a list')"
    assert reason["list"] == "'not a JSON object')" and reason["open_string"] == "'not valid JSON')"


def test_one_document_over_many_tasks(spark, tmp_path):
    rows = [result("a.py", i + 1, message=f"m{i}, [" * 20) for i in range(3000)]
    path = written(tmp_path, {"big": json.dumps({"results": rows, "errors": []})})
    pieces = read_scan_pieces(spark, path, chunk_bytes=50_000)
    assert pieces.select("chunk").distinct().count() > 20
    found = I.valid_findings(I.parse_results(L.assemble(pieces).results))
    assert found.agg(F.count("*"), F.sum("start_line"), F.max("result_idx")).first()[:] == (3000, 3000 * 3001 // 2, 2999)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "50000"


def test_texts_stay_out_of_the_sums(spark, tmp_path):
    """What is staged and sorted on the way to the entries holds no piece of a text."""
    folder = written(tmp_path, {"a": json.dumps({"results": [result("a.py", 1, rule="r")], "errors": []})})
    measured = L._measured(read_scan_pieces(spark, folder, "r"))
    assert not {"piece", "file_size"} & {*measured.columns, *L._placed(measured).columns}
