import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (id, text) pairs, with extra columns whose names clash with results."""

    def build(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in rows]
        if not extra:
            return spark.createDataFrame(full, schema)
        clash = ", score double, n_words long, bucket int, chunk long, part string, tokens long, component_id long, fp long, row string"
        return spark.createDataFrame([(*r, 0.5, 1, 2, 3, "x", 4, 5, 6, "r") for r in full], schema + clash)

    return build

