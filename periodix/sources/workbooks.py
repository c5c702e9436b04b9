"""Workbooks written from the test tables, for the ingest to read back.

A test adapter, not an export: it turns rendered grids (``sources/grid.py``)
into small .xlsx files in a shared folder, with the faults a directory of
filings has.  Firms are dealt out to workbooks by number, ``FIRMS`` to a file, so
no workbook grows with the data; a task holds one sheet's XML at a time.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodix.sources.grid import HEADER_NEW, render_sheets

FIRMS = 500

# --- fixed values: names of the file format ------------------------------------
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
# --------------------------------------------------------------------------------


def split_by_firm(parsed: DataFrame, firms: int = FIRMS) -> DataFrame:
    """The file of each row, one per ``firms`` numbers: ``filings_1998_h1_0002.xlsx``."""
    part = F.lpad(F.floor(F.col("no").cast("int") / firms).cast("string"), 4, "0")
    return parsed.withColumn("file", F.concat(F.regexp_replace("file", r"\.xlsx$", "_"), part, F.lit(".xlsx")))


def _letters(k: int) -> str:
    out, k = "", k + 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(ref: str, value: str, number: bool, shared: dict[str, int], k: int) -> str:
    if number:
        try:
            return f'<c r="{ref}"><v>{float(value)!r}</v></c>'
        except ValueError:
            pass
    if k == 1:  # names repeat from sheet to sheet
        return f'<c r="{ref}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def _sheet(rows: Iterator[tuple[int, list]], shared: dict[str, int]) -> str:
    out = [f'<worksheet xmlns="{MAIN}"><sheetData>']
    for at, cells in rows:
        numbers = {0, 2, 3, 4, 5, 6} if len(cells) == len(HEADER_NEW) else {0, 2, 3}
        out.append(f'<row r="{at + 1}">' + "".join(
            _cell(f"{_letters(k)}{at + 1}", v, k in numbers, shared, k) for k, v in enumerate(cells) if v is not None) + "</row>")
    return "".join([*out, "</sheetData></worksheet>"])


def workbook(sheets: Iterator[tuple[str, Iterator[tuple[int, list]]]], torn_sheet: str | None = None) -> bytes:
    """The bytes of a workbook; the XML of ``torn_sheet`` breaks off half way."""
    data, shared, names = io.BytesIO(), {}, []
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in sheets:
            names.append(name)
            xml = _sheet(rows, shared)
            z.writestr(f"xl/worksheets/sheet{len(names)}.xml", xml[:len(xml) // 2] if name == torn_sheet else xml)
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        texts = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{TYPES}"/>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{DOCUMENT}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{texts}</sst>')
    return data.getvalue()


def _place(folder: str):
    """File system and path of a folder as Spark names it."""
    return pafs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _store(file_system, folder: str, name: str, data: bytes) -> None:
    """Readers see the whole file or none: written aside, then renamed (a
    second attempt of a task replaces the file by an equal one)."""
    aside = f"{folder}/_{uuid.uuid4().hex}"
    with file_system.open_output_stream(aside, compression=None) as out:
        out.write(data)
    file_system.move(aside, f"{folder}/{name}")


def write_workbooks(parsed: DataFrame, folder: str, firms: int = FIRMS) -> DataFrame:
    """Writes the workbooks of ``parsed`` below ``folder``; ``file, n_sheets``
    of each.  Every first-half workbook of firm group 0 also comes broken: as an office
    lock file, cut off half way, and with a second sheet whose XML breaks off."""
    cells = render_sheets(split_by_firm(parsed, firms))
    file_system, path = _place(folder)
    file_system.create_dir(path, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, top = _place(folder)
        rows = ((r.file, r.sheet, r.row_idx, r.cells) for pdf in batches for r in pdf.itertuples(index=False))
        for file, of_file in groupby(rows, key=lambda r: r[0]):
            sheets = [(name, [(r[2], list(r[3])) for r in of_sheet]) for name, of_sheet in groupby(of_file, key=lambda r: r[1])]
            whole = workbook([("Свод", [(0, ["x"])]), *sheets])
            _store(place, top, file, whole)
            if file.endswith("_h1_0000.xlsx"):
                _store(place, top, "~$" + file, b"lock")
                _store(place, top, "cut_" + file, whole[:len(whole) // 2])
                _store(place, top, "torn_" + file, workbook(sheets[:1], torn_sheet=sheets[0][0]))
            yield pd.DataFrame({"file": [file], "n_sheets": [len(sheets)]})

    n = max(2, int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (cells.repartition(n, "file").sortWithinPartitions("file", "sheet", "row_idx")
            .select("file", "sheet", "row_idx", "cells").mapInPandas(write, "file STRING, n_sheets INT"))
