"""Every registered query against its DuckDB oracle on the sf0.001 tables,
plus the rows-only queries for a non-empty stable schema."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import _rows
from periodix.sources.tables import TABLES
from tests.conftest import SF_SMALL

# the training-data queries have tests of their own in tests/llm
QUERIES = {name: run for name, run in E.queries().items() if name in E.REGISTRY}
SQL = {name: sql for name, sql in E.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0
    assert df.schema == QUERIES[name](spark, SF_SMALL).schema


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 7
    assert {r["year"] for r in rows} == set(range(1995, 2002))
