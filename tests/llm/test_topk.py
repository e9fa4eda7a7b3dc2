"""Exact top-k search against all inner products."""

import math
import random

from pyspark.sql import functions as F

from winnow.llm import topk


def brute(rows, wanted, k):
    vectors = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in vectors:
        if wanted(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, k=10):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query boolean, w string")
    return sorted(map(tuple, topk.search(table, F.col("vec_id") % 5 == 0, k).collect()))


def test_like_all_products(spark, monkeypatch):
    draw = random.Random(5)
    grid = [-0.5, -0.25, 0.0, 0.25, 0.5]  # floats that halve exactly, with many ties
    rows = [(i, [draw.choice(grid) for _ in range(draw.choice([6, 6, 3, 0]))]) for i in range(90)]
    rows += [(200, [0.1] * 6), (200, [0.1] * 6), (200, [0.3] * 6), (205, None), (None, [1.0]), (7, [math.nan, 1.0]), (10, [math.inf])]
    rows += [(11, [None, 1.0])]
    full = [(i, v, 0, False, "x") for i, v in rows]
    import numpy as np

    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(exact, lambda i: i % 5 == 0, 4)
    assert search(spark, full, 4) == want
    for name, size in (("ROW_BLOCK", 17), ("QUERY_BLOCK", 4), ("_SCORES", 40)):
        monkeypatch.setattr(topk, name, size)
    assert search(spark, full, 4) == want


def test_repeated_rows_like_the_sql(spark, tmp_path):
    import duckdb

    from winnow.llm.queries import STATEMENTS, op5_exact_topk

    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0]), (100, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op5_exact_topk(spark, str(tmp_path)).collect())
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(sql.execute(STATEMENTS["op5_exact_topk"]).fetchall()) and len(got) == 3 * 4 + 6


def test_few_rows_and_none(spark):
    assert search(spark, [(0, [1.0], 0, True, ""), (1, [2.0], 0, True, "")]) == [(0, 1, 1, 2 * 1024 * 1024)]
    assert search(spark, [(0, [1.0], 0, True, "")]) == []
    assert search(spark, []) == []
