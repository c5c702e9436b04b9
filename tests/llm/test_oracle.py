"""The training-data queries that SQL can express against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import _rows
from periodix.llm.catalog import QUERIES, SQL
from periodix.sources.tables import TABLES
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    assert _rows(E.queries()[name](spark, SF_SMALL).toPandas()) == _rows(con.execute(SQL[name]).df())


def test_registered():
    assert set(QUERIES) <= set(E.queries()) and "pipeline" in E.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
