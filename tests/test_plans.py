"""Physical-plan checks: pruning, pushdown, no Python row UDFs, no
Cartesian products, group-limited top-k."""

import pytest

import __spark_entry__ as E
from periodix.plans import catalog as C
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(C.REGISTRY))
def test_no_row_udfs_or_cartesian(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_lineitem_scan_is_pruned(spark):
    plan = _plan(C.REGISTRY["yearly_market"].run(spark, SF_SMALL))
    scan = [ln for ln in plan.splitlines() if "lineitem" in ln][0]
    for unused in ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_comment"):
        assert unused not in scan


@pytest.mark.parametrize("name", ["structured_query", "top_chart_frame", "top_table"])
def test_year_filter_reaches_the_scan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        plan = _plan(C.REGISTRY[name].run(spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = [x for x in plan.splitlines() if "lineitem" in x][0]
    assert "GreaterThanOrEqual(l_shipdate,2000-01-01" in scan and "LessThan(l_shipdate,2001-01-01" in scan


def test_top_n_uses_group_limit(spark):
    df = C.REGISTRY["top_n"].run(spark, SF_SMALL)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["years", "kpis", "yearly_market", "npl_drivers", "latest_period"])
def test_queries_without_the_flag_skip_the_leader_scan(spark, name):
    plan = _plan(C.REGISTRY[name].run(spark, SF_SMALL))
    assert "cumulative_share" not in plan and "InPandas" not in plan


def test_leader_scan_is_split_and_in_the_jvm(spark):
    plan = _plan(C.REGISTRY["leaders"].run(spark, SF_SMALL))
    assert "_slice" in plan and "InPandas" not in plan


def test_broadcast_only_from_measured_sizes(spark):
    """No broadcast from planning-time estimates; AQE broadcasts the small
    side of the supplier join once its shuffle has run and been measured."""
    df = C.REGISTRY["yearly_market"].run(spark, SF_SMALL)
    assert "BroadcastExchange" not in _plan(df)
    df.collect()
    final = _plan(df)
    assert "isFinalPlan=true" in final
    assert "BroadcastHashJoin" in final
