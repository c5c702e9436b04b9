"""Small helpers for the operators' tests: rows in, rows out."""

import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with the table's columns."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    return make
