"""Sheet-grid normalisation: raw ``cells`` rows -> typed ``filings`` rows.

Input ``cells(file STRING, sheet STRING, row_idx INT, cells ARRAY<STRING>)``
is a header-less positional grid, one row per sheet row (S3).  Everything
here is DataFrame code; the only Python in ingest is the workbook decoder
in ``sources/xlsx.py``.

Plan shape: one aggregation over slim rows gives each sheet's header row,
width and layout, that small table is joined back (broadcast by AQE), and a
single projection dispatches both layouts -- ``cells`` is read twice, with no
per-sheet Python, no driver loop and no task holding a whole sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodix.functions.columns import (
    BUCKET_TERMS,
    HEADER_MARKER,
    SERIAL_PATTERN,
    quarter_from_sheet,
    to_number,
    year_of_quarter,
)

FILINGS_COLUMNS = [
    "no", "mfo_name", "assets", "net_loans", "portfolio_gross",
    "del_31_60", "del_61_90", "del_90_plus", "liabilities", "equity", "profit",
    "format", "quarter", "year", "file",
]
NEW_LAYOUT_WIDTH = 10
OLD_LAYOUT_WIDTH = 6
BLOCK_ROWS = 64  # rows of a sheet whose layout terms are noted in one long
ERROR_SCHEMA = "file STRING, sheet STRING, error STRING"


def union_layouts(*parts: DataFrame) -> DataFrame:
    """Union sheets of both layouts by name; missing columns are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c in FILINGS_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*FILINGS_COLUMNS)


def dedupe_filings(df: DataFrame, keys: tuple[str, ...] = ("mfo_name", "quarter"),
                   prefer: str = "file") -> DataFrame:
    """Opt-in: one row per (entity, period) when the same filing arrives in
    several files (the reference double-counts them).  Keeps the row from the
    greatest ``prefer`` value (e.g. the latest file name).

    A ``max_by`` aggregate: partial aggregation collapses copies on the map
    side, so a heavily duplicated key never lands whole in one task.
    """
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(F.col(prefer), *[F.col(c) for c in others if c != prefer]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def _cell(i: int) -> Column:
    return F.get(F.col("cells"), i)


def _layout_hit() -> Column:
    """Whether a layout term occurs in the first cells: plain substring tests
    on the joined cells, since every row of a grid is asked."""
    cells = F.lower(F.array_join(F.slice(F.col("cells"), 1, NEW_LAYOUT_WIDTH), "\n"))
    hit = F.lit(False)
    for term in BUCKET_TERMS:
        hit = hit | cells.contains(term)
    return F.coalesce(hit, F.lit(False))


def sheet_facts(cells: DataFrame) -> DataFrame:
    """``(file, sheet, header_row, width, has_buckets)`` of every
    sheet with a header row, in one pass over the grid.

    The layout is told by the row after the header, which is not known before
    the pass has ended: rows that have a layout term are noted as bits, one long
    for ``BLOCK_ROWS`` rows, so a block of rows combines on the map side into
    three numbers.  The block of the header then holds the bit of the next row;
    for a header at the end of its block it is the first bit of the next one.
    """
    at = F.pmod(F.col("row_idx"), F.lit(BLOCK_ROWS))
    is_header = F.coalesce(F.lower(_cell(1)).contains(HEADER_MARKER), F.lit(False))
    blocks = cells.groupBy("file", "sheet", (F.col("row_idx") - at).alias("_first")).agg(
        F.min(F.when(is_header, F.col("row_idx"))).alias("_header"),
        F.max(F.size("cells")).alias("_width"),
        F.bit_or(F.when(_layout_hit(), F.call_function("shiftleft", F.lit(1).cast("long"), at))).alias("_hits"),
    ).withColumn("_hits", F.coalesce("_hits", F.lit(0).cast("long")))
    facts = blocks.groupBy("file", "sheet").agg(
        F.min("_header").alias("header_row"),
        F.max("_width").alias("width"),
        F.min_by("_hits", "_header").alias("_hits"),
        F.collect_set(F.when(F.col("_hits").bitwiseAND(1) == 1, F.col("_first"))).alias("_starts"),
    ).filter(F.col("header_row").isNotNull())
    after = F.col("header_row") + 1
    bit = F.call_function("shiftright", F.col("_hits"), F.pmod(after, F.lit(BLOCK_ROWS))).bitwiseAND(1) == 1
    starts = F.pmod(after, F.lit(BLOCK_ROWS)) == 0
    return facts.select("file", "sheet", "header_row", "width",
                        F.when(starts, F.array_contains("_starts", after)).otherwise(bit).alias("has_buckets"))


def annotate_sheets(cells: DataFrame) -> DataFrame:
    """Attach per-sheet facts to every data-region row.

    Returns data-region rows (row_idx >= header + 2) with columns
    file, sheet, row_idx, cells, quarter, header_row, width, has_buckets,
    is_record (P6 serial test).

    The facts come from ``sheet_facts``, one slim aggregate joined back on
    (file, sheet); AQE broadcasts it once its real size is known.  ``cells`` is
    read twice, for the facts and for the rows.
    """
    dated = cells.withColumn("quarter", quarter_from_sheet(F.col("sheet"))).filter(
        F.col("quarter").isNotNull()
    )
    return (
        dated.join(sheet_facts(dated), ["file", "sheet"])
        .filter(F.col("row_idx") >= F.col("header_row") + 2)
        .withColumn("is_record", F.coalesce(_cell(0).rlike(SERIAL_PATTERN), F.lit(False)))
    )


def _project_records(rows: DataFrame, *carry: str) -> DataFrame:
    """One projection for both layouts (P9 dispatch by column)."""
    new = F.col("has_buckets")
    num = lambda i: to_number(_cell(i))
    return rows.select(
        *carry,
        _cell(0).alias("no"),
        _cell(1).alias("mfo_name"),
        num(2).alias("assets"),
        F.when(~new, num(3)).alias("net_loans"),
        F.when(new, num(3)).alias("portfolio_gross"),
        F.when(new, num(4)).alias("del_31_60"),
        F.when(new, num(5)).alias("del_61_90"),
        F.when(new, num(6)).alias("del_90_plus"),
        F.when(new, _cell(7)).otherwise(_cell(4)).alias("liabilities"),
        F.when(new, _cell(8)).otherwise(_cell(5)).alias("equity"),
        F.when(new, _cell(9)).alias("profit"),
        F.when(new, "new").otherwise("old").alias("format"),
        F.col("quarter"),
        year_of_quarter(F.col("quarter")).cast("int").alias("year"),
        F.col("file"),
    )


def _sheet_error() -> Column:
    need = F.when(F.col("has_buckets"), NEW_LAYOUT_WIDTH).otherwise(OLD_LAYOUT_WIDTH)
    return (
        F.when(F.col("width") < need,
               F.concat(F.lit("sheet narrower than layout: "), F.col("width").cast("string"),
                        F.lit(" < "), need.cast("string")))
        .when(year_of_quarter(F.col("quarter")).isNull(),
              F.concat(F.lit("invalid reporting date: "), F.col("quarter")))
    )


def normalise_sheets(cells: DataFrame, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """``cells`` -> (``filings``, ``parse_errors``).

    A sheet that is too narrow for its layout, or whose reporting date is not
    a real date, goes to ``parse_errors`` instead of aborting the load
    (``mode="failfast"`` raises instead).  Old-layout rows are imputed (P11)
    and incomplete rows dropped (P13).
    """
    from periodix.operators.metrics import drop_incomplete, impute_old_layout

    rows = annotate_sheets(cells).filter("is_record").withColumn("error", _sheet_error())
    bad = rows.filter(F.col("error").isNotNull())
    errors = bad.groupBy("file", "sheet").agg(F.first("error").alias("error"))
    if mode == "failfast":
        first = errors.select(F.concat_ws(": ", "file", "sheet", "error").alias("m")).take(1)
        if first:
            raise ValueError(first[0]["m"])
    elif mode != "quarantine":
        raise ValueError("mode must be 'quarantine' or 'failfast'")
    good = _project_records(rows.filter(F.col("error").isNull()))
    return drop_incomplete(impute_old_layout(good)), errors


def parse_quality(cells: DataFrame) -> DataFrame:
    """P25: per (file, sheet) counts of record rows seen / kept / dropped.

    ``accuracy`` = kept / seen, the figure behind a "parsing accuracy" claim.
    One aggregation over the annotated rows; nothing is collected.
    """
    from periodix.operators.metrics import complete_row, impute_old_layout

    rows = annotate_sheets(cells).filter("is_record").withColumn("error", _sheet_error())
    rec = impute_old_layout(_project_records(rows, "sheet", "error"))
    quarantined = F.col("error").isNotNull()
    kept = ~quarantined & complete_row()
    return rec.groupBy("file", "sheet").agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(kept).alias("rows_kept"),
        F.count_if(~quarantined & ~complete_row()).alias("rows_incomplete"),
        F.count_if(quarantined).alias("rows_quarantined"),
    ).withColumn("accuracy", F.round(F.col("rows_kept") / F.col("rows_seen"), 6))
