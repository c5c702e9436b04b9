"""Workbook ingest: sheet names, header/layout detection, both layouts,
quarantine of bad sheets and workbooks (FIXTURES section 1)."""

import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from periodix.functions.columns import quarter_from_sheet, to_number
from periodix.operators.normalise import normalise_sheets, parse_quality
from periodix.sources.xlsx import decode_workbook, read_filings, scan_workbooks
from tests.xlsx_util import write_xlsx

N = None
NEW_SHEET = [
    ["Сведения на 01.04.2023", N, N, N, N, N, N, N, N, N],
    ["№", "Наименование МФО", "Активы", "Портфель", "Просрочка", N, N, "Обязательства", "Капитал", "Прибыль"],
    [N, N, N, N, "31-60 дней", "61-90 дней", "свыше 90", N, N, N],
    [1, "A", 90, 80, 2, 2, 8, 20, 70, 5],
    [2, "B", 10, "x", 0, 0, 0, 1, 2, 3],
    [N, "Итого", 100, N, N, N, N, N, N, N],
]
OLD_SHEET = [
    ["Сведения", N, N, N, N, N],
    ["№", "Наименование МФО", "Активы", "Ссудный портфель", "Обязательства", "Капитал"],
    [N, N, "тыс. тенге", N, N, N],
    [1, "A", 1500, 920, 800, 700],
]


@pytest.fixture(scope="module")
def workbook_dir():
    d = tempfile.mkdtemp(prefix="periodix-xlsx-")
    write_xlsx(os.path.join(d, "new.xlsx"), {
        "Отчет 01.04.2023": NEW_SHEET,
        "Свод": NEW_SHEET,                       # no reporting date -> skipped
        "02.04.2023": NEW_SHEET,                 # day is not 01 -> skipped
        "01.13.2023": NEW_SHEET,                 # month 13 -> quarantined
        "01.07.2023": [r[:9] for r in NEW_SHEET],  # 9 columns -> quarantined
    })
    write_xlsx(os.path.join(d, "old.xlsx"), {
        "01.01.2020": OLD_SHEET,
        "01.04.2020": {0: ["x", "y"]},           # no header row -> nothing
        "01.07.2020": OLD_SHEET[:2],             # header is the last row -> nothing
        "01.10.2020": [["only"]],                # one column -> nothing
    })
    with open(os.path.join(d, "broken.xlsx"), "wb") as fh:
        fh.write(b"not a zip file")
    with open(os.path.join(d, "notes.txt"), "w") as fh:
        fh.write("ignored: not *.xlsx")
    return d


def test_quarter_from_sheet(spark):
    names = ["01.04.2023", "Отчет 101.04.2023 г", "01.4.2023", "02.04.2023", "Свод", "01.13.2023"]
    df = spark.createDataFrame([(n,) for n in names], "sheet STRING")
    got = [r[0] for r in df.select(quarter_from_sheet(F.col("sheet"))).collect()]
    assert got == ["2023-04-01", "2023-04-01", None, None, None, "2023-13-01"]


def test_to_number(spark):
    vals = [" 12 ", "1e5", "1,5", "1 234", "x", "nan", "1d", "-3.5", None]
    df = spark.createDataFrame([(v,) for v in vals], "v STRING")
    got = [r[0] for r in df.select(to_number(F.col("v"))).collect()]
    assert got == [12.0, 100000.0, None, None, None, None, None, -3.5, None]


def test_read_filings(spark, workbook_dir):
    filings, errors = read_filings(spark, workbook_dir)
    rows = {(r["file"], r["quarter"]): r for r in filings.collect()}
    assert set(rows) == {("new.xlsx", "2023-04-01"), ("old.xlsx", "2020-01-01")}
    new = rows[("new.xlsx", "2023-04-01")]
    assert (new["no"], new["mfo_name"], new["assets"], new["portfolio_gross"]) == ("1", "A", 90.0, 80.0)
    assert (new["del_31_60"], new["del_61_90"], new["del_90_plus"]) == (2.0, 2.0, 8.0)
    assert (new["liabilities"], new["equity"], new["profit"]) == ("20", "70", "5")
    assert (new["format"], new["year"]) == ("new", 2023)
    old = rows[("old.xlsx", "2020-01-01")]
    assert old["format"] == "old" and old["net_loans"] == 920.0
    assert abs(old["portfolio_gross"] - 1000.0) < 1e-9
    assert abs(old["del_90_plus"] - 64.0) < 1e-9 and abs(old["del_31_60"] - 8.0) < 1e-9
    assert (old["liabilities"], old["equity"], old["profit"]) == ("800", "700", None)
    errs = {(r["file"], r["sheet"]): r["error"] for r in errors.collect()}
    assert "unreadable workbook" in errs[("broken.xlsx", None)]
    assert "invalid reporting date" in errs[("new.xlsx", "01.13.2023")]
    assert "narrower" in errs[("new.xlsx", "01.07.2023")]
    assert len(errs) == 3


def test_old_layout_invariant(spark, workbook_dir):
    from periodix.operators.metrics import enrich_metrics

    filings, _ = read_filings(spark, workbook_dir)
    r = enrich_metrics(filings.filter("format = 'old'")).first()
    assert abs(r["npl_pct"] - 6.4) < 1e-9 and abs(r["over30_pct"] - 8.0) < 1e-9


def test_failfast(spark, workbook_dir):
    raw = scan_workbooks(spark, workbook_dir)
    cells = raw.filter("error IS NULL").drop("error")
    with pytest.raises(ValueError):
        normalise_sheets(cells, mode="failfast")


def test_parse_quality(spark, workbook_dir):
    raw = scan_workbooks(spark, workbook_dir).filter("error IS NULL").drop("error")
    q = {(r["file"], r["sheet"]): r for r in parse_quality(raw).collect()}
    new = q[("new.xlsx", "Отчет 01.04.2023")]
    assert (new["rows_seen"], new["rows_kept"], new["rows_incomplete"]) == (2, 1, 1)
    assert new["accuracy"] == 0.5
    assert q[("new.xlsx", "01.13.2023")]["rows_quarantined"] == 2


def workbook_of_nothing(d):
    write_xlsx(os.path.join(d, "none.xlsx"), {"01.01.2023": [["no header"]]})
    return d


def test_cell_types(tmp_path):
    """Error, missing-value and date cells as the pandas reader has them."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = str(tmp_path / "t.xlsx")
    write_xlsx(book, {"01.01.2023": [["x"]]})
    sheet = (f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="e"><v>#N/A</v></c>'
             '<c r="B1" t="inlineStr"><is><t>N/A</t></is></c><c r="C1" s="1"><v>43190</v></c><c r="D1" s="2"><v>43190.5</v></c>'
             '<c r="E1" t="d"><v>2018-03-31T00:00:00Z</v></c><c r="F1" s="0"><v>43190</v></c><c r="G1" t="str"><v>name</v></c></row>'
             '<row r="2"><c r="A2" t="e"><v>#REF!</v></c></row></sheetData></worksheet>')
    styles = (f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/>'
              '<numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts>'
              '<cellXfs><xf numFmtId="171"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
    parts = zipfile.ZipFile(book)
    keep = {n: parts.read(n) for n in parts.namelist() if "worksheets/" not in n}
    name = [n for n in parts.namelist() if "worksheets/" in n][0]
    with zipfile.ZipFile(book, "w") as z:
        for n, data in (keep | {name: sheet, "xl/styles.xml": styles}).items():
            z.writestr(n, data)
    with open(book, "rb") as fh:
        out = list(decode_workbook("t.xlsx", fh.read()))
    assert [list(x) for x in out[0]["cells"]] == [
        [None, None, "2018-03-31 00:00:00", "2018-03-31 12:00:00", "2018-03-31 00:00:00", "43190", "name"]]


def test_empty_directory_guard(spark):
    d = tempfile.mkdtemp(prefix="periodix-empty-")
    with pytest.raises(ValueError, match="holds no workbook"):
        read_filings(spark, d)
    assert read_filings(spark, workbook_of_nothing(d), require_rows=False)[0].count() == 0
    with pytest.raises(ValueError, match="usable filing row"):
        read_filings(spark, d)


def test_layout_row_all_null_is_old_layout(spark):
    grid = [("f", "01.01.2021", 0, ["t", "Наименование", "a", "b", "c", "d"]),
            ("f", "01.01.2021", 1, [None] * 6),
            ("f", "01.01.2021", 2, ["7", "Z", "10", "9.2", "1", "2"])]
    cells = spark.createDataFrame(grid, "file STRING, sheet STRING, row_idx INT, cells ARRAY<STRING>")
    filings, errors = normalise_sheets(cells)
    r = filings.first()
    assert r["format"] == "old" and abs(r["portfolio_gross"] - 10.0) < 1e-9
    assert errors.count() == 0


def test_sheet_facts_over_blocks(spark):
    """The row after the header tells the layout, wherever the header is."""
    from periodix.operators.normalise import BLOCK_ROWS, annotate_sheets, sheet_facts

    rows, want = [], {}
    for n, (header, hit) in enumerate([(0, 1), (BLOCK_ROWS - 1, BLOCK_ROWS), (BLOCK_ROWS, BLOCK_ROWS + 1), (BLOCK_ROWS - 2, BLOCK_ROWS - 1),
                                       (BLOCK_ROWS - 1, 0), (5, 5), (5, 7), (2 * BLOCK_ROWS - 1, 2 * BLOCK_ROWS), (3, None)]):
        sheet = f"01.04.20{n:02d}"
        for r in range(3 * BLOCK_ROWS):
            first = "31" if r == hit else str(r) if r > 200 else "7"
            rows.append(("f", sheet, r, [first, "Наименование" if r in (header, header + 40) else "x"] + ["y"] * (r % 3)))
        want[sheet] = (header, 4, hit == header + 1)
    rows += [("f", "01.05.2050", 0, ["31", "x"]), ("f", "01.06.2050", 9, ["1", "наименование организации"])]
    want["01.06.2050"] = (9, 2, False)
    cells = spark.createDataFrame(rows, "file STRING, sheet STRING, row_idx INT, cells ARRAY<STRING>").repartition(5)
    got = {r["sheet"]: (r["header_row"], r["width"], r["has_buckets"]) for r in sheet_facts(cells).collect()}
    assert got == want
    plan = annotate_sheets(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition 5") <= 2  # the grid is read twice
