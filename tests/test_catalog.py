"""Every query against its SQL counterpart on the smallest tables."""

import glob
import math
import numbers
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_module  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normalized(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, numbers.Number) and not isinstance(value, bool):
        return round(float(value), 9)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], *[[normalized(r[i]) for i in order] for r in rows]), key=repr)


@pytest.mark.parametrize("name", list(entry_module.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    found = entry_module.queries()[name](spark, SF_DIR)
    cursor = sql.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(found.columns, found.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
