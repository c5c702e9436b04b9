"""Distributed read of a directory of spreadsheet workbooks.

``binaryFile`` lists and reads the files (one row per workbook, spread over
tasks); ``mapInPandas`` decodes each workbook in the executor with the
standard library (``zipfile`` + ``xml.etree``, streaming ``iterparse``) and
emits the header-less positional grid ``cells(file, sheet, row_idx, cells)``
in bounded Arrow batches.  Sheets without a reporting date in their name are
skipped before their XML is parsed (S2).  An unreadable workbook or sheet
becomes an error row instead of failing the job (S4).  Everything after the
grid is DataFrame code (``operators/normalise.py``).
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.functions.columns import SHEET_DATE_PATTERN

RAW_SCHEMA = "file STRING, sheet STRING, row_idx INT, cells ARRAY<STRING>, error STRING"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG_REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_BATCH_ROWS = 8192
_DATED = re.compile(SHEET_DATE_PATTERN)

# --- fixed values: texts the pandas reader takes for missing values, and the
# built-in number formats that show dates ------------------------------------
NA_TEXTS = frozenset([
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
])
DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36,
                          45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58])
# -----------------------------------------------------------------------------
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|[_*].')


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if "A" <= ch <= "Z":
            n = n * 26 + (ord(ch) - 64)
        else:
            break
    return n - 1


def _row_number(ref: str) -> int:
    digits = "".join(ch for ch in ref if ch.isdigit())
    return int(digits) - 1


def _text(el) -> str:
    # Inline / shared strings: plain <t> or rich-text runs <r><t>.
    return "".join(t.text or "" for t in el.iter(f"{_NS}t"))


def _number(v: str) -> str:
    try:
        x = float(v)
    except ValueError:
        return v
    if x.is_integer() and abs(x) < 1e16:
        return str(int(x))
    return repr(x)


def _sheets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.iter(f"{_PKG_REL_NS}Relationship")}
    out = []
    for sh in wb.iter(f"{_NS}sheet"):
        t = target.get(sh.get(f"{_REL_NS}id"), "")
        path = t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t))
        out.append((sh.get("name"), path))
    return out


def _date_styles(zf: zipfile.ZipFile) -> set[str]:
    """Numbers of the cell styles that show dates."""
    try:
        root = ET.fromstring(zf.read("xl/styles.xml"))
    except KeyError:
        return set()
    custom = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt")
              if re.search("[ymdhs]", _QUOTED.sub("", f.get("formatCode") or ""), re.I)}
    formats = root.find(f"{_NS}cellXfs")
    return {str(k) for k, xf in enumerate(formats if formats is not None else [])
            if int(xf.get("numFmtId") or 0) in DATE_FORMATS | custom}


def _epoch(zf: zipfile.ZipFile) -> dt.datetime:
    pr = ET.fromstring(zf.read("xl/workbook.xml")).find(f"{_NS}workbookPr")
    return dt.datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)


def _iso(moment: dt.datetime) -> str:
    return moment.strftime("%Y-%m-%d %H:%M:%S")


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    try:
        data = zf.read("xl/sharedStrings.xml")
    except KeyError:
        return []
    return [_text(si) for si in ET.fromstring(data).iter(f"{_NS}si")]


def _sheet_rows(zf: zipfile.ZipFile, path: str, shared: list[str]) -> Iterator[tuple[int, list]]:
    """Rows of one sheet.  Error cells and missing-value texts are blank, and
    dates are ISO text, as the pandas reader has them."""
    next_row = 0
    dates, epoch = _date_styles(zf), _epoch(zf)
    with zf.open(path) as fh:
        for _, el in ET.iterparse(fh, events=("end",)):
            if el.tag != f"{_NS}row":
                continue
            r = el.get("r")
            idx = int(r) - 1 if r else next_row
            next_row = idx + 1
            values: dict[int, str] = {}
            pos = 0
            for c in el.iter(f"{_NS}c"):
                ref = c.get("r")
                col = _col_index(ref) if ref else pos
                pos = col + 1
                t = c.get("t", "n")
                if t == "inlineStr":
                    is_el = c.find(f"{_NS}is")
                    val = _text(is_el) if is_el is not None else None
                else:
                    v = c.find(f"{_NS}v")
                    raw = v.text if v is not None else None
                    if raw is None:
                        val = None
                    elif t == "s":
                        val = shared[int(raw)]
                    elif t == "b":
                        val = "True" if raw == "1" else "False"
                    elif t == "e":
                        val = None
                    elif t == "str":
                        val = raw
                    elif t == "d":
                        val = _iso(dt.datetime.fromisoformat(raw.replace("Z", "")))
                    elif c.get("s") in dates:
                        val = _iso(epoch + dt.timedelta(seconds=round(float(raw) * 86400)))
                    else:
                        val = _number(raw)
                if val is not None and val not in NA_TEXTS:
                    values[col] = val
            el.clear()
            if values:
                width = max(values) + 1
                yield idx, [values.get(i) for i in range(width)]


def _error(file: str, sheet: str | None, msg: str) -> pd.DataFrame:
    return pd.DataFrame({"file": [file], "sheet": [sheet], "row_idx": [None],
                         "cells": [None], "error": [msg]})


def decode_workbook(file: str, content: bytes, batch_rows: int = _BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """One workbook -> grid batches (and error rows); pure Python helper."""
    try:
        zf = zipfile.ZipFile(io.BytesIO(content))
        sheets = _sheets(zf)
    except Exception as e:  # noqa: BLE001 -- S4: log and skip the workbook
        yield _error(file, None, f"unreadable workbook: {type(e).__name__}: {e}")
        return
    shared: list[str] | None = None
    for name, path in sheets:
        if not _DATED.search(name or ""):
            continue  # S2: prune before decoding the sheet
        try:
            if shared is None:
                shared = _shared_strings(zf)
            buf_idx, buf_cells = [], []
            for idx, cells in _sheet_rows(zf, path, shared):
                buf_idx.append(idx)
                buf_cells.append(cells)
                if len(buf_idx) >= batch_rows:
                    yield pd.DataFrame({"file": file, "sheet": name, "row_idx": buf_idx,
                                        "cells": buf_cells, "error": None})
                    buf_idx, buf_cells = [], []
            if buf_idx:
                yield pd.DataFrame({"file": file, "sheet": name, "row_idx": buf_idx,
                                    "cells": buf_cells, "error": None})
        except Exception as e:  # noqa: BLE001 -- S4: unreadable sheet -> error row
            yield _error(file, name, f"unreadable sheet: {type(e).__name__}: {e}")


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield from decode_workbook(posixpath.basename(path), bytes(content))


def scan_workbooks(spark: SparkSession, directory: str, glob: str = "*.xlsx") -> DataFrame:
    """``RAW_SCHEMA`` rows for every workbook directly in ``directory``.

    Non-recursive, like a plain glob.  ``binaryFile`` yields one row per file,
    and ``maxPartitionBytes`` spreads files over tasks.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "false")
        .load(directory)
        .select("path", "content")
    )
    return files.mapInPandas(_decode_batches, RAW_SCHEMA)


def read_filings(spark: SparkSession, directory: str, mode: str = "quarantine",
                 require_rows: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1-S5 + normalisation: a workbook directory -> (filings, parse_errors).

    The S1/S5 guards (no workbook / nothing extracted -> ``ValueError``) are
    one cheap ``isEmpty`` job each; ``require_rows=False`` leaves them out.
    The decoded grid is persisted for the reads of the normaliser and goes
    with the session's cache (``spark.catalog.clearCache()``).
    """
    from periodix.operators.normalise import normalise_sheets

    from pyspark import StorageLevel

    # Decoding is the expensive step and the normaliser reads cells twice:
    # keep the decoded grid (lost blocks are recomputed from lineage).
    if require_rows:
        listing = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
                   .option("recursiveFileLookup", "false").load(directory).select("path"))
        if listing.isEmpty():  # S1: only the file listing, contents are not read
            raise ValueError(f"{directory} holds no workbook")
    raw = scan_workbooks(spark, directory).persist(StorageLevel.MEMORY_AND_DISK)
    cells = raw.filter(F.col("error").isNull()).drop("error")
    decode_errors = raw.filter(F.col("error").isNotNull()).select("file", "sheet", "error")
    filings, sheet_errors = normalise_sheets(cells, mode=mode)
    if require_rows and filings.isEmpty():  # S5
        raw.unpersist()
        raise ValueError("no workbook holds a usable filing row")
    return filings, decode_errors.unionByName(sheet_errors)
