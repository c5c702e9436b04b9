"""Period-over-period NPL changes.

QoQ uses ``lag`` (the previous *reported* quarter, so a gap makes one step
span several quarters); YoY takes the value of the date exactly twelve
months earlier (a RANGE frame on a month index) -- never ``lag(4)``, which
would be wrong across gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodix.operators.aggregates import quarterly_market


def _with_changes(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """One window pass: ``lag`` for QoQ, and for YoY the value exactly twelve
    months earlier via a RANGE frame on a month index (empty frame -> NULL),
    which equals an equi self-join on the date a year before -- without a
    second scan or a join."""
    qdate = F.to_date("quarter")
    month = F.year(qdate) * 12 + F.month(qdate)
    base = df.withColumn("_m", month)
    # repeated filings of one quarter: in order of file and number, and the
    # first of them stands for the quarter a year later
    ties = [c for c in ("file", "no") if c in df.columns]
    keyed = Window.partitionBy(*keys) if keys else Window.partitionBy()
    w = keyed.orderBy("_m", *ties)
    year_ago = keyed.orderBy("_m").rangeBetween(-12, -12)
    then = F.min_by(value, F.struct(*ties)) if ties else F.first(value)
    out = base.withColumns({
        "prev_quarter": F.lag("quarter").over(w),
        "_prev": F.lag(value).over(w),
        "_year_ago": then.over(year_ago),
    })
    return out.withColumns({
        "qoq_change": F.col(value) - F.col("_prev"),
        "yoy_change": F.col(value) - F.col("_year_ago"),
        "qoq_rel": F.try_divide(F.col(value) - F.col("_prev"), F.col("_prev")),
    }).drop("_m", "_prev", "_year_ago", *ties)


def npl_changes_market(df: DataFrame) -> DataFrame:
    """W4, market level: weighted NPL % per quarter with QoQ / YoY changes in
    percentage points.  The quarterly table has one row per reporting date,
    so the un-partitioned ``lag`` window runs over a calendar-bounded input.
    """
    q = quarterly_market(df).select("quarter", "year", "avg_npl_pct")
    return _with_changes(q, "avg_npl_pct", [])


def npl_changes_entity(df: DataFrame, entity: str = "mfo_name") -> DataFrame:
    """W4, entity level: each firm's NPL % against its own previous quarter
    and the same quarter a year before (partitioned by entity, so work
    spreads over all firms)."""
    ties = [c for c in ("file", "no") if c in df.columns]
    base = df.select(entity, "quarter", "year", "npl_pct", *ties)
    return _with_changes(base, "npl_pct", [entity])


def deteriorating(df: DataFrame, entity: str = "mfo_name", min_change: float = 0.0) -> DataFrame:
    """Entity quarters whose NPL % rose by more than ``min_change`` pp."""
    return npl_changes_entity(df, entity).filter(F.col("qoq_change") > F.lit(min_change))
