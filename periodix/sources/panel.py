"""Filings panel derived from the driver's TPC-H-style tables.

The test data carries no filings, so an entity x quarter panel is derived
from ``lineitem`` joined to ``supplier``: each supplier plays a reporting
organisation, each ship quarter a reporting date, and years before 1998 play
the old (bucket-less) sheet layout.  Money is summed as exact integer cents
(the cent-rounded DECIMAL of each line), so totals are engine independent.

Plan shape (scale): lineitem is pre-aggregated on (suppkey, year, quarter)
*before* the supplier join -- the partial aggregate collapses a hot supplier
on the map side, and only one row per (supplier, quarter) is shuffled and
joined.  Grouping keys are integers; the ISO quarter label is built after
the aggregation, once per output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.functions.columns import quarter_label
from periodix.operators.normalise import FILINGS_COLUMNS
from periodix.sources.tables import read_table

# Years before this one are rendered in the old (6-column) layout.
OLD_LAYOUT_BEFORE = 1998


def cents(col: str) -> Column:
    """Exact ``CAST(col AS DECIMAL(18,2))`` as integer cents (BIGINT).

    ``round(x * 100)`` is exact unless ``x * 100`` sits next to a half-cent
    tie, where binary rounding could differ from the decimal cast; only those
    rows take the (slower) decimal path.  Summing BIGINT cents keeps the
    aggregation buffers primitive longs instead of 28-digit decimals.
    """
    x100 = F.col(col) * 100
    near_tie = F.abs(x100 - F.floor(x100) - 0.5) < 1e-6
    exact = (F.col(col).cast("decimal(18,2)") * 100).cast("long")
    return F.when(near_tie, exact).otherwise(F.rint(x100).cast("long"))


def _round_cents(num_1e4: Column) -> Column:
    """Product in 1e-4 units (BIGINT) -> cents, rounding half away from zero
    like DECIMAL ``ROUND(.., 2)``.  Quotients stay far below 2^53, so the
    double division before ``floor`` is exact enough to never cross a cent."""
    up = F.floor((F.abs(num_1e4) + 50) / 100).cast("long")
    return F.when(num_1e4 >= 0, up).otherwise(-up)


def _money(c: str) -> Column:
    """Summed cents -> DOUBLE (same value as casting the DECIMAL sum)."""
    return F.col(c) / F.lit(100.0)


def _money_text(c: str) -> Column:
    """Summed cents -> the DECIMAL(.,2) text, e.g. ``'1234.50'``."""
    return (F.col(c).cast("decimal(36,0)") * F.lit(0.01).cast("decimal(2,2)")).cast("string")


def supplier_quarter_totals(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """One row per (entity name, year, calendar quarter) with cent sums; of
    one ``year`` only, the scan reads no more (a range on the ship date)."""
    li = read_table(
        spark, sf_dir, "lineitem",
        "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    )
    if year is not None:
        kind = li.schema["l_shipdate"].dataType
        first = lambda y: F.lit(f"{y}-01-01").cast(kind)
        li = li.filter((F.col("l_shipdate") >= first(year)) & (F.col("l_shipdate") < first(year + 1)))
    day = F.to_date("l_shipdate")
    # One projection computes each line's cents once; the aggregate then sums
    # plain BIGINT columns (no repeated per-row expressions inside the sums).
    lines = li.select(
        "l_suppkey", "l_linenumber", F.year(day).alias("year"), F.quarter(day).alias("qtr"),
        cents("l_extendedprice").alias("px"), cents("l_discount").alias("_dc"), cents("l_tax").alias("_tc"),
    ).select(
        "l_suppkey", "l_linenumber", "year", "qtr", "px",
        _round_cents(F.col("px") * (F.lit(100) - F.col("_dc"))).alias("net"),
        _round_cents(F.col("px") * F.col("_dc")).alias("disc"),
        _round_cents(F.col("px") * F.col("_tc")).alias("tax"),
    )
    ln = F.col("l_linenumber")
    net = F.col("net")
    sums = {
        "px": F.col("px"), "net": net,
        "d1": F.when(ln == 5, net), "d2": F.when(ln == 6, net), "d3": F.when(ln == 7, net),
        "disc": F.col("disc"), "tax": F.col("tax"),
    }
    per_key = lines.groupBy("l_suppkey", "year", "qtr").agg(*[F.sum(v).alias(k) for k, v in sums.items()])

    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    joined = per_key.join(sup, per_key.l_suppkey == sup.s_suppkey)
    return joined.groupBy("s_name", "year", "qtr").agg(
        F.min("l_suppkey").alias("suppkey"), *[F.sum(k).alias(k) for k in sums]
    )


def _tags() -> list[Column]:
    return [
        quarter_label(F.col("year"), F.col("qtr")).alias("quarter"),
        F.col("year").cast("int").alias("year"),
        F.concat(F.lit("filings_"), F.col("year").cast("string"),
                 F.when(F.col("qtr") <= 2, "_h1").otherwise("_h2"), F.lit(".xlsx")).alias("file"),
    ]


def filing_layouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two parsed layouts as separate tables (U1 input, sheet rendering).

    new layout: no, mfo_name, assets, portfolio_gross, del_31_60, del_61_90,
                del_90_plus, liabilities, equity, profit (+ format, quarter,
                year, file)
    old layout: no, mfo_name, assets, net_loans, liabilities, equity (+ tags)
    """
    t = supplier_quarter_totals(spark, sf_dir).withColumn("equity_c", F.col("px") - F.col("disc"))
    common = [F.col("suppkey").cast("string").alias("no"), F.col("s_name").alias("mfo_name"),
              _money("px").alias("assets")]
    text = [_money_text("disc").alias("liabilities"), _money_text("equity_c").alias("equity")]
    new = t.filter(F.col("year") >= OLD_LAYOUT_BEFORE).select(
        *common, _money("net").alias("portfolio_gross"), _money("d1").alias("del_31_60"),
        _money("d2").alias("del_61_90"), _money("d3").alias("del_90_plus"), *text,
        _money_text("tax").alias("profit"), F.lit("new").alias("format"), *_tags(),
    )
    old = t.filter(F.col("year") < OLD_LAYOUT_BEFORE).select(
        *common, _money("net").alias("net_loans"), *text, F.lit("old").alias("format"), *_tags(),
    )
    return new, old


def filings_parsed(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Both layouts in one pass over lineitem (old rows not yet imputed).

    Same rows as ``union_layouts(*filing_layouts(...))``, but the layout is
    chosen per row by one projection, so lineitem is scanned once.
    """
    t = supplier_quarter_totals(spark, sf_dir, year).withColumn("equity_c", F.col("px") - F.col("disc"))
    new = F.col("year") >= OLD_LAYOUT_BEFORE
    out = t.select(
        F.col("suppkey").cast("string").alias("no"),
        F.col("s_name").alias("mfo_name"),
        _money("px").alias("assets"),
        F.when(~new, _money("net")).alias("net_loans"),
        F.when(new, _money("net")).alias("portfolio_gross"),
        F.when(new, _money("d1")).alias("del_31_60"),
        F.when(new, _money("d2")).alias("del_61_90"),
        F.when(new, _money("d3")).alias("del_90_plus"),
        _money_text("disc").alias("liabilities"),
        _money_text("equity_c").alias("equity"),
        F.when(new, _money_text("tax")).alias("profit"),
        F.when(new, F.lit("new")).otherwise(F.lit("old")).alias("format"),
        *_tags(),
    )
    return out.select(*FILINGS_COLUMNS)


def filings_panel(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """The normalised ``filings`` table: parsed, imputed, null rows dropped."""
    from periodix.operators.metrics import drop_incomplete, impute_old_layout

    return drop_incomplete(impute_old_layout(filings_parsed(spark, sf_dir, year)))
