"""Market aggregates over the enriched, leader-marked filings panel.

Every aggregate is a plain ``groupBy().agg()`` (partial + final hash
aggregate, map-side combine) over a handful of period keys -- a hot period
is collapsed on the map side before the shuffle.  Group scalars that go back
to rows (year's latest quarter, latest year) are computed as tiny aggregates
and joined back on an equi key; AQE turns those joins into broadcasts from
the measured size, so no full-partition window is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodix.functions.columns import BILLION, to_number, weighted_mean

SEGMENT_LABELS = {True: "leaders", False: "non_leaders"}


def _sum0(c: str) -> Column:
    # pandas sums an all-missing group to 0.0, Spark to NULL.
    return F.coalesce(F.sum(c), F.lit(0.0))


def _market_aggs(with_npl: bool, entity: str = "mfo_name") -> list[Column]:
    aggs = [
        F.countDistinct(entity).alias("mfo_count"),
        _sum0("assets").alias("total_assets"),
        _sum0("portfolio_gross").alias("total_portfolio"),
    ]
    if with_npl:
        aggs.append(_sum0("npl").alias("total_npl"))
    aggs.append(weighted_mean("npl_pct", "portfolio_gross").alias("avg_npl_pct"))
    return aggs


def segment_label(flag: Column) -> Column:
    """Literal segment label from the leader flag."""
    return F.when(flag, SEGMENT_LABELS[True]).otherwise(SEGMENT_LABELS[False])


def yearly_market(df: DataFrame, period: str = "year") -> DataFrame:
    """A1 (+A3, A4): firms, totals and portfolio-weighted NPL per year.

    Sums run over every quarter of the year (stock values counted once per
    quarter), as the reference does.
    """
    return df.groupBy(period).agg(*_market_aggs(True))


def quarterly_market(df: DataFrame) -> DataFrame:
    """A10: the same figures per reporting quarter (true stocks)."""
    return df.groupBy("quarter", "year").agg(*_market_aggs(True))


def yearly_segment(df: DataFrame, is_leader: bool) -> DataFrame:
    """A2 for one segment (P16 filter + P22 label); no ``total_npl``."""
    return (
        df.filter(F.col("is_leader") == F.lit(is_leader))
        .groupBy("year")
        .agg(*_market_aggs(False))
        .select("year", F.lit(SEGMENT_LABELS[is_leader]).alias("segment"), "mfo_count",
                "total_assets", "total_portfolio", "avg_npl_pct")
    )


def yearly_segments(df: DataFrame, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """A2 for both segments in one aggregation (keys + leader flag)."""
    return (
        df.groupBy(*keys, "is_leader")
        .agg(*_market_aggs(False))
        .select(*keys, segment_label(F.col("is_leader")).alias("segment"), "mfo_count",
                "total_assets", "total_portfolio", "avg_npl_pct")
    )


def quarterly_segments(df: DataFrame) -> DataFrame:
    """A10 by segment ("average NPL across market leaders in a quarter")."""
    return yearly_segments(df, keys=("quarter", "year"))


def market_and_segments(df: DataFrame) -> DataFrame:
    """A1 + A2 in a single scan: GROUPING SETS ((year), (year, is_leader)).

    ``segment`` is ``'market'`` on the market rows.
    """
    grouped = df.groupingSets([["year"], ["year", "is_leader"]], "year", "is_leader")
    out = grouped.agg(*_market_aggs(True), F.grouping("is_leader").alias("_g"))
    seg = F.when(F.col("_g") == 1, F.lit("market")).otherwise(segment_label(F.col("is_leader")))
    return out.select("year", seg.alias("segment"), "mfo_count", "total_assets",
                      "total_portfolio", "total_npl", "avg_npl_pct")


def segment_pivot(df: DataFrame) -> DataFrame:
    """Leaders vs non-leaders side by side per year, plus the NPL gap.

    Equivalent to a full outer join of the two segment tables on year: the
    yearly segments (two rows a year) turned sideways; a side with no rows in
    a year is NULL.
    """
    out = []
    for name in SEGMENT_LABELS.values():
        pick = lambda c: F.max(F.when(F.col("segment") == name, F.col(c)))  # noqa: B023, E731
        out += [pick("mfo_count").alias(f"{name}_mfo_count"), pick("total_assets").alias(f"{name}_assets"),
                pick("total_portfolio").alias(f"{name}_portfolio"), pick("avg_npl_pct").alias(f"{name}_npl_pct")]
    return yearly_segments(df).groupBy("year").agg(*out).withColumn(
        "npl_gap", F.col("leaders_npl_pct") - F.col("non_leaders_npl_pct")
    )


def weighted_avg_npl(df: DataFrame, keys: tuple[str, ...] = ("year", "format")) -> DataFrame:
    """A3 on its own, by any keys (default: year and layout, so imputed
    old-layout years are never silently mixed with measured ones)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("npl_pct").alias("n_weighted"),
        weighted_mean("npl_pct", "portfolio_gross").alias("avg_npl_pct"),
    )


def profitability(df: DataFrame, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """Portfolio-weighted profitability = sum(profit)/sum(gross)*100,
    over rows where both are present (``profit`` is raw text, coerced P10)."""
    p = to_number(F.col("profit"))
    both = p.isNotNull() & F.col("portfolio_gross").isNotNull()
    return df.groupBy(*keys).agg(
        F.count_if(both).alias("n_rows"),
        F.sum(F.when(both, p)).alias("total_profit"),
        (F.try_divide(F.sum(F.when(both, p)), F.sum(F.when(both, F.col("portfolio_gross"))))
         * 100).alias("profit_pct"),
    )


def latest_period(df: DataFrame, group: str = "year", period: str = "quarter") -> DataFrame:
    """P17 (+A5): rows whose period is the latest of their group.

    The per-group max is a tiny aggregate joined back as a semi join (no
    window over a whole year in one task).
    """
    latest = df.groupBy(group).agg(F.max(period).alias(period))
    return df.join(latest, [group, period], "left_semi")


def kpis(df: DataFrame, entity: str = "mfo_name") -> DataFrame:
    """One-row dataset summary."""
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct(entity).alias("n_mfos"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    )


def latest_year(df: DataFrame) -> DataFrame:
    """Rows of the latest year (one-row max joined back on year)."""
    return df.join(df.agg(F.max("year").alias("year")), "year", "left_semi")


def latest_year_kpis(df: DataFrame, unit: float = BILLION) -> DataFrame:
    """A8 (+P19, P21): latest year's *unweighted* mean NPL % and total assets
    in ``unit``s (deliberately not A3's weighted mean).

    Aggregated per year first (one pass, one row per year), then the latest
    year's row is picked from that calendar-bounded table.
    """
    per_year = df.groupBy("year").agg(
        F.avg("npl_pct").alias("mean_npl_pct"),
        (F.sum("assets") / F.lit(unit)).alias("total_assets_bn"),
    )
    return per_year.orderBy(F.desc("year")).limit(1)


def years(df: DataFrame) -> DataFrame:
    """The distinct years, sorted (slider domain); max is ``kpis().max_year``."""
    return df.select("year").distinct().orderBy("year")


def npl_drivers(df: DataFrame, n: int = 10, entity: str = "mfo_name") -> DataFrame:
    """Entities with the largest share of the year's NPL amount.

    Entity sums are one aggregation; year totals a second, tiny one joined
    back on year; ``n`` per year via a group-limited row_number (a top-k
    report: the limit is the feature).
    """
    from pyspark.sql import Window

    per = df.groupBy("year", entity).agg(_sum0("npl").alias("npl"))
    totals = per.groupBy("year").agg(F.sum("npl").alias("year_npl"))
    w = Window.partitionBy("year").orderBy(F.desc("npl"), F.asc(entity))
    return (
        per.join(totals, "year")
        .withColumn("npl_share", F.try_divide(F.col("npl"), F.col("year_npl")))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
    )


def source_attribution(df: DataFrame, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """The source files behind each aggregate row, one row per file."""
    return df.groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("n_records"))


SKETCH_BITS = 12                               # 2^12 registers
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)  # three standard errors of a count


def entity_sketches(df: DataFrame, by: tuple[str, ...] = ("quarter", "year"), entity: str = "mfo_name") -> DataFrame:
    """A4, opt-in: per period a sketch of its entities, a few kilobytes each,
    to be stored once and merged into counts of any longer period."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(entity), F.lit(SKETCH_BITS)).alias("sketch"))


def sketch_counts(sketches: DataFrame, *by: str) -> DataFrame:
    """Approximate distinct counts from merged sketches, within
    ``SKETCH_ERROR`` of the exact ones in all but a few cases in a thousand."""
    merged = F.hll_sketch_estimate(F.hll_union_agg(F.col("sketch")))
    return sketches.groupBy(*by).agg(merged.alias("mfo_count"))
