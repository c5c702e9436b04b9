"""Row-level metrics: old-layout imputation, completeness, delinquency ratios.

All narrow projections -- they fuse into the scan's whole-stage-codegen span
and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodix.functions.columns import NET_TO_GROSS, RESERVE_SPLIT, guarded_pct


def impute_old_layout(df: DataFrame, net_to_gross: float = NET_TO_GROSS,
                      split: tuple[float, float, float] = RESERVE_SPLIT) -> DataFrame:
    """Old-layout rows carry only net loans; derive gross and buckets.

    ``portfolio_gross = net_loans / 0.92``, ``reserves = gross - net``,
    ``31-60 = 61-90 = 0.1 * reserves``, ``90+ = 0.8 * reserves``.  Rows of the
    new layout pass through unchanged.
    """
    old = F.col("format") == "old"
    gross = F.col("net_loans") / F.lit(net_to_gross)
    reserves = gross - F.col("net_loans")
    return df.withColumns({
        "portfolio_gross": F.when(old, gross).otherwise(F.col("portfolio_gross")),
        "del_31_60": F.when(old, reserves * split[0]).otherwise(F.col("del_31_60")),
        "del_61_90": F.when(old, reserves * split[1]).otherwise(F.col("del_61_90")),
        "del_90_plus": F.when(old, reserves * split[2]).otherwise(F.col("del_90_plus")),
    })


def complete_row() -> Column:
    """P13 predicate: name, assets and gross portfolio are all present."""
    return (
        F.col("mfo_name").isNotNull()
        & F.col("assets").isNotNull()
        & F.col("portfolio_gross").isNotNull()
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows missing name, assets or gross portfolio."""
    return df.dropna(subset=["mfo_name", "assets", "portfolio_gross"])


def enrich_metrics(df: DataFrame, on_zero: str = "null") -> DataFrame:
    """P14, P15 (P15b with ``on_zero="zero"``).

    ``over30`` = sum of the three buckets (NULL if any bucket is NULL),
    ``npl`` = the 90+ bucket, ratios in percent of gross portfolio, missing
    when the portfolio is not positive.
    """
    over30 = F.col("del_31_60") + F.col("del_61_90") + F.col("del_90_plus")
    npl = F.col("del_90_plus")
    pg = F.col("portfolio_gross")
    return df.withColumns({"over30": over30, "npl": npl}).withColumns({
        "over30_pct": guarded_pct(F.col("over30"), pg, on_zero),
        "npl_pct": guarded_pct(F.col("npl"), pg, on_zero),
    })
