"""Panel invariants on the driver tables."""

import pytest
from pyspark.sql import functions as F

from periodix.operators import aggregates as agg
from periodix.operators import rankings
from periodix.plans import catalog as C
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def marked(spark):
    return C.marked(spark, SF_CHECK).cache()


def test_fixture_figures(marked):
    r = agg.yearly_market(marked).filter("year = 2001").first()
    assert r["mfo_count"] == 100
    assert round(r["total_assets"], 2) == 386706828.00
    assert round(r["total_portfolio"], 2) == 367491097.24
    assert round(r["total_npl"], 2) == 50681612.18
    assert round(r["avg_npl_pct"], 6) == 14.831986


def test_old_layout_constant(marked):
    old = marked.filter(F.col("format") == "old")
    assert old.count() > 0
    bad = old.filter((F.abs(F.col("npl_pct") - 6.4) > 1e-9) | (F.abs(F.col("over30_pct") - 8.0) > 1e-9))
    assert bad.count() == 0


def test_leaders_share_bound(marked):
    last = marked.filter("is_leader").groupBy("quarter").agg(F.max("cumulative_share").alias("s"))
    assert last.filter(F.col("s") > 0.8).count() == 0
    top = marked.groupBy("quarter").agg(F.max("cumulative_share").alias("s"))
    assert top.filter(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_ranks_are_one_to_n(marked):
    t = rankings.top_n(marked, n=10)
    per = t.groupBy("year").agg(F.collect_list("rank").alias("r")).collect()
    assert all(sorted(x["r"]) == list(range(1, 11)) for x in per)


def test_segments_sum_to_market(marked):
    m = {r["year"]: r for r in agg.yearly_market(marked).collect()}
    s = agg.yearly_segments(marked).groupBy("year").agg(F.sum("total_assets").alias("a")).collect()
    for r in s:
        assert abs(r["a"] - m[r["year"]]["total_assets"]) < 1e-3


def test_shuffled_input_is_deterministic(spark, marked):
    base = marked.drop("cumulative_share", "is_leader")
    from periodix.operators.leaders import mark_leaders

    a = {(r["mfo_name"], r["quarter"]): r["cumulative_share"] for r in marked.collect()}
    b = {(r["mfo_name"], r["quarter"]): r["cumulative_share"]
         for r in mark_leaders(base.repartition(7, F.rand(3))).collect()}
    assert a == b
