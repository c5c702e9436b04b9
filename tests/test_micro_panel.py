"""Hand-computed micro panel: metrics, leaders, aggregates, rankings, changes."""

import pytest
from pyspark.sql import functions as F

from periodix.operators import aggregates as agg
from periodix.operators import changes, leaders, metrics, rankings

ROWS = [
    ("A", "2023-01-01", 2023, 50.0, 40.0, 1.0, 1.0, 2.0),
    ("B", "2023-01-01", 2023, 30.0, 20.0, 1.0, None, 1.0),
    ("C", "2023-01-01", 2023, 20.0, 10.0, 0.0, 0.0, 0.0),
    ("A", "2023-04-01", 2023, 90.0, 80.0, 2.0, 2.0, 8.0),
    ("B", "2023-04-01", 2023, 10.0, 0.0, 0.0, 0.0, 0.0),
    ("A", "2024-01-01", 2024, 40.0, 50.0, 0.0, 0.0, None),
    ("B", "2024-01-01", 2024, 40.0, 20.0, 0.0, 0.0, 2.0),
    ("C", "2024-01-01", 2024, 20.0, 30.0, 0.0, 0.0, 6.0),
]
SCHEMA = ("mfo_name STRING, quarter STRING, year INT, assets DOUBLE, portfolio_gross DOUBLE, "
          "del_31_60 DOUBLE, del_61_90 DOUBLE, del_90_plus DOUBLE")


@pytest.fixture(scope="module")
def panel(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns(
        {"format": F.lit("new"), "file": F.lit("f.xlsx"), "no": F.lit("1")}
    )
    return leaders.mark_leaders(metrics.enrich_metrics(df))


def _by_key(df, *cols):
    return {(r["mfo_name"], r["quarter"]): tuple(r[c] for c in cols) for r in df.collect()}


def approx(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_row_metrics_and_leaders(panel):
    got = _by_key(panel, "over30", "over30_pct", "npl_pct", "cumulative_share", "is_leader")
    want = {
        ("A", "2023-01-01"): (4, 10, 5, 0.5, True),
        ("B", "2023-01-01"): (None, None, 5, 0.8, True),
        ("C", "2023-01-01"): (0, 0, 0, 1.0, False),
        ("A", "2023-04-01"): (12, 15, 10, 0.9, False),
        ("B", "2023-04-01"): (0, None, None, 1.0, False),
        ("A", "2024-01-01"): (None, None, None, 0.4, True),
        ("B", "2024-01-01"): (2, 10, 10, 0.8, True),
        ("C", "2024-01-01"): (6, 20, 20, 1.0, False),
    }
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert all(approx(a, b) for a, b in zip(g[:4], w[:4])), (k, g, w)
        assert g[4] == w[4], (k, g, w)


def test_zero_guard_variant(spark):
    df = spark.createDataFrame([("B", 0.0, 0.0, 0.0, 0.0)],
                               "mfo_name STRING, portfolio_gross DOUBLE, del_31_60 DOUBLE, "
                               "del_61_90 DOUBLE, del_90_plus DOUBLE")
    r = metrics.enrich_metrics(df, on_zero="zero").first()
    assert r["npl_pct"] == 0.0 and r["over30_pct"] == 0.0
    r = metrics.enrich_metrics(df).first()
    assert r["npl_pct"] is None


def test_yearly_market(panel):
    rows = {r["year"]: r for r in agg.yearly_market(panel).collect()}
    assert rows[2023]["mfo_count"] == 3 and rows[2024]["mfo_count"] == 3
    assert approx(rows[2023]["total_assets"], 200) and approx(rows[2023]["total_portfolio"], 150)
    assert approx(rows[2023]["total_npl"], 11) and approx(rows[2023]["avg_npl_pct"], 1100 / 150)
    assert approx(rows[2024]["total_assets"], 100) and approx(rows[2024]["total_npl"], 8)
    assert approx(rows[2024]["avg_npl_pct"], 16.0)


def test_segments(panel):
    rows = {(r["year"], r["segment"]): r for r in agg.yearly_segments(panel).collect()}
    lead23, non23 = rows[(2023, "leaders")], rows[(2023, "non_leaders")]
    assert lead23["mfo_count"] == 2 and approx(lead23["total_assets"], 80)
    assert approx(lead23["total_portfolio"], 60) and approx(lead23["avg_npl_pct"], 5.0)
    assert non23["mfo_count"] == 3 and approx(non23["total_assets"], 120)
    assert approx(non23["avg_npl_pct"], 800 / 90)
    assert approx(rows[(2024, "leaders")]["avg_npl_pct"], 10.0)
    assert approx(rows[(2024, "non_leaders")]["avg_npl_pct"], 20.0)
    # segment filters give the same rows
    only = {r["year"]: r for r in agg.yearly_segment(panel, True).collect()}
    assert approx(only[2023]["avg_npl_pct"], 5.0)
    # grouping-sets variant agrees with both
    gs = {(r["year"], r["segment"]): r for r in agg.market_and_segments(panel).collect()}
    assert approx(gs[(2024, "market")]["avg_npl_pct"], 16.0)
    assert approx(gs[(2023, "non_leaders")]["total_assets"], 120)


def test_segment_pivot(panel):
    rows = {r["year"]: r for r in agg.segment_pivot(panel).collect()}
    assert approx(rows[2023]["npl_gap"], 5.0 - 800 / 90)
    assert rows[2024]["leaders_mfo_count"] == 2


def test_quarterly_and_changes(panel):
    q = {r["quarter"]: r for r in changes.npl_changes_market(panel).collect()}
    assert approx(q["2023-01-01"]["avg_npl_pct"], 300 / 70)
    assert approx(q["2023-04-01"]["avg_npl_pct"], 10.0)
    assert approx(q["2024-01-01"]["avg_npl_pct"], 16.0)
    assert q["2023-01-01"]["qoq_change"] is None
    assert approx(q["2023-04-01"]["qoq_change"], 10.0 - 300 / 70)
    assert approx(q["2024-01-01"]["qoq_change"], 6.0)  # spans three quarters
    assert approx(q["2024-01-01"]["yoy_change"], 16.0 - 300 / 70)
    assert q["2023-04-01"]["yoy_change"] is None


def test_entity_changes_and_deteriorating(panel):
    e = _by_key(changes.npl_changes_entity(panel), "qoq_change", "yoy_change")
    assert approx(e[("A", "2023-04-01")][0], 5.0)
    assert approx(e[("B", "2024-01-01")][1], 5.0)
    det = {(r["mfo_name"], r["quarter"]) for r in changes.deteriorating(panel).collect()}
    # B 2024-01 follows a quarter with no NPL ratio, so it has no QoQ change
    assert det == {("A", "2023-04-01"), ("C", "2024-01-01")}


def test_top_n(panel):
    rows = sorted((r["year"], r["rank"], r["mfo_name"], r["quarter"])
                  for r in rankings.top_n(panel, n=2).collect())
    assert rows == [(2023, 1, "A", "2023-04-01"), (2023, 2, "B", "2023-04-01"),
                    (2024, 1, "A", "2024-01-01"), (2024, 2, "B", "2024-01-01")]


def test_latest_year_simple_mean(panel):
    r = agg.latest_year_kpis(panel).first()
    assert r["year"] == 2024 and approx(r["mean_npl_pct"], 15.0)


def test_kpis(panel):
    r = agg.kpis(panel).first()
    assert (r["n_records"], r["n_mfos"], r["min_year"], r["max_year"]) == (8, 3, 2023, 2024)


def test_changes_with_repeated_filings_have_one_result(spark):
    rows = [("A", "2023-01-01", 2023, 4.0, "f1", "1"), ("A", "2023-01-01", 2023, 12.0, "f2", "1"),
            ("A", "2024-01-01", 2024, 8.0, "f1", "1")]
    schema = "mfo_name STRING, quarter STRING, year INT, npl_pct DOUBLE, file STRING, no STRING"
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = changes.npl_changes_entity(spark.createDataFrame(order, schema)).collect()
        assert sorted((r["npl_pct"], r["qoq_change"], r["yoy_change"]) for r in got if r["qoq_change"] is not None) == [
            (8.0, -4.0, 4.0), (12.0, 8.0, None)]


def test_top_table(panel):
    got = [tuple(r) for r in rankings.top_table(panel, 2023, n=2).collect()]
    assert [(r[0], r[1], r[2]) for r in got] == [(1, "A", 90.0), (2, "B", 10.0)]
