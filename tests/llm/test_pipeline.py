"""The corpus pipeline and every numbered query on the smallest tables."""

import os

import pytest

import corpus_pipeline as P
from winnow.llm import simhash, toxicity
from winnow.llm.queries import QUERIES, STATEMENTS

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_names():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14)) and set(STATEMENTS) <= set(QUERIES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "mixing"]


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, function in P.STAGES:
        out = P.stage(function(spark, docs, SF_DIR))
        after = out.count()
        if name == "mixing":
            assert out.columns == [*columns, "n_tokens", "weight", "epoch", "position"] and after
        else:
            assert out.schema.names == columns
            assert (after == before) if name == "substring_dedup" else (0.5 * before < after < before)
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs, before = out, after
    assert P.run(spark, SF_DIR).count() == before


@pytest.mark.parametrize("labels", [[], [(i, 1, 1) for i in range(20)], [(99, 1, 1), (98, 1, 0)]])
def test_labels_that_teach_nothing_reject_nothing(spark, docs_of, tmp_path, labels):
    docs = docs_of([(i, f"text {i} of its own, with words {i * 7} {i * 11}") for i in range(20)] + [(20, None), (None, "")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = spark.createDataFrame([(1, "an item that no document holds at all")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = P.toxicity_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    found = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()
    assert len(found) == 22 and all(r.predicted == int(r.score >= 0.5) for r in found)
    assert P.run(spark, str(tmp_path)).count() > 0


def test_near_duplicates_send_no_keys_to_every_task(spark, docs_of, monkeypatch):
    seen, whole = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: seen.append(links) or whole(links))
    docs = docs_of([(i, f"text {i // 2} of its own, with words {i // 2 * 7} {i // 2 * 11}") for i in range(20)])
    assert P.near_duplicate_stage(spark, docs, "").count() == 10
    seen[0].collect()
    assert "Broadcast" not in seen[0]._jdf.queryExecution().toString()


@needs_tables
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STATEMENTS])
def test_queries_beyond_sql_run_on_whole_tables(spark, name):
    rows = QUERIES[name](spark, SF_DIR)
    source, key = {"op10": ("pages", "page_id"), "op12": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    if name.startswith(("op9", "op13")):
        assert rows.count() > 0
    else:
        assert rows.count() == spark.read.parquet(f"{SF_DIR}/{source}.parquet").select(key).distinct().count()
