"""Render parsed filings back into positional sheet grids (``cells`` rows).

Used to feed the ingest operators from the driver's tables: every data row
becomes one grid row (the entity number is its row position, so gaps read as
blank rows), and each sheet gets a title, header, layout and totals row from
one small per-sheet aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: sheet vocabulary of the filings ---------------------------
HEADER_NEW = ["№", "Наименование МФО", "Активы", "Ссудный портфель", "Просрочка",
              "Просрочка", "Просрочка", "Обязательства", "Капитал", "Прибыль"]
LAYOUT_NEW = [None, None, None, None, "31-60 дней", "61-90 дней", "свыше 90 дней", None, None, None]
HEADER_OLD = ["№", "Наименование МФО", "Активы", "Ссудный портфель (нетто)", "Обязательства", "Капитал"]
LAYOUT_OLD = [None, None, "тыс. тенге", None, None, None]
TITLE = "Сведения о финансовом положении МФО на "
TOTAL = "Итого"
# ----------------------------------------------------------------------------

FIRST_DATA_ROW = 3
YEAR_SHIFT = 20  # sheet names carry years 20YY; the panel's are 1995 to 2001


def _lits(values: list[str | None]) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def sheet_name(quarter: Column) -> Column:
    """``'1998-04-01'`` -> ``'01.04.2018'`` (the reporting-date sheet name,
    ``YEAR_SHIFT`` years later)."""
    year = (F.substring(quarter, 1, 4).cast("int") + F.lit(YEAR_SHIFT)).cast("string")
    return F.concat(F.lit("01."), F.substring(quarter, 6, 2), F.lit("."), year)


def render_sheets(parsed: DataFrame) -> DataFrame:
    """Parsed rows of both layouts -> ``cells(file, sheet, row_idx, cells)``.

    Data rows are a narrow projection; the four frame rows of each sheet come
    from one partial aggregation of those rows (one row per sheet) -- no task
    holds a sheet.
    """
    s = lambda c: F.col(c).cast("string")
    new = F.col("format") == "new"
    sheet = sheet_name(F.col("quarter")).alias("sheet")
    data = parsed.select(
        "file", sheet,
        (F.lit(FIRST_DATA_ROW) + F.col("no").cast("int")).alias("row_idx"),
        F.when(new, F.array(
            s("no"), s("mfo_name"), s("assets"), s("portfolio_gross"), s("del_31_60"),
            s("del_61_90"), s("del_90_plus"), s("liabilities"), s("equity"), s("profit"),
        )).otherwise(F.array(s("no"), s("mfo_name"), s("assets"), s("net_loans"), s("liabilities"),
                             s("equity"))).alias("cells"),
    )
    # Aggregated from the rendered rows (not from ``parsed``): both union
    # branches then share one subtree, so its exchanges are reused and the
    # input is computed once.
    per_sheet = data.groupBy("file", "sheet", (F.size("cells") == len(HEADER_NEW)).alias("_new")).agg(
        (F.max("row_idx") - F.lit(FIRST_DATA_ROW)).alias("_last"),
        F.sum(F.get(F.col("cells"), 2).try_cast("double")).alias("_total"),
    )
    is_new = F.col("_new")
    width = F.when(is_new, F.lit(len(HEADER_NEW))).otherwise(F.lit(len(HEADER_OLD)))
    null = F.lit(None).cast("string")
    title = F.concat(F.array(F.concat(F.lit(TITLE), F.col("sheet"))), F.array_repeat(null, width - 1))
    totals = F.concat(F.array(null, F.lit(TOTAL), F.col("_total").cast("string")),
                      F.array_repeat(null, width - 3))
    frame = per_sheet.select("file", "sheet", F.explode(F.array(
        F.struct(F.lit(0).alias("row_idx"), title.alias("cells")),
        F.struct(F.lit(1).alias("row_idx"),
                 F.when(is_new, _lits(HEADER_NEW)).otherwise(_lits(HEADER_OLD)).alias("cells")),
        F.struct(F.lit(2).alias("row_idx"),
                 F.when(is_new, _lits(LAYOUT_NEW)).otherwise(_lits(LAYOUT_OLD)).alias("cells")),
        F.struct((F.col("_last") + FIRST_DATA_ROW + 1).alias("row_idx"), totals.alias("cells")),
    )).alias("r")).select("file", "sheet", F.col("r.row_idx").cast("int").alias("row_idx"), "r.cells")
    return data.unionByName(frame)


def with_defects(cells: DataFrame) -> DataFrame:
    """The same grids with the faults of real filings, by rule: every 13th
    firm reports no number for its assets, and each January sheet comes twice
    more, once under an impossible month and once cut to five columns."""
    faulty = (F.col("row_idx") >= FIRST_DATA_ROW) & (F.get("cells", 0).try_cast("int") % 13 == 0)
    blanked = F.concat(F.slice("cells", 1, 2), F.array(F.lit("n/a")), F.slice(F.col("cells"), F.lit(4), F.size("cells")))
    cells = cells.withColumn("cells", F.when(faulty, blanked).otherwise(F.col("cells")))
    january = cells.filter(F.col("sheet").startswith("01.01."))
    month13 = january.withColumn("sheet", F.regexp_replace("sheet", r"^01\.01\.", "01.13."))
    narrow = january.withColumn("file", F.concat(F.lit("narrow_"), F.col("file"))).withColumn(
        "cells", F.slice("cells", 1, 5))
    return cells.unionByName(month13).unionByName(narrow)
