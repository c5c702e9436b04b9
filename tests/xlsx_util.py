"""Write minimal .xlsx workbooks with the standard library (test fixtures)."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _col(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _sheet_xml(rows: dict[int, list], shared: dict[str, int]) -> str:
    out = [f'<worksheet xmlns="{_MAIN}"><sheetData>']
    for r in sorted(rows):
        out.append(f'<row r="{r + 1}">')
        for c, v in enumerate(rows[r]):
            if v is None:
                continue
            ref = f"{_col(c)}{r + 1}"
            if isinstance(v, bool):
                out.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                out.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            elif c % 2:  # odd columns as shared strings, even as inline strings
                idx = shared.setdefault(v, len(shared))
                out.append(f'<c r="{ref}" t="s"><v>{idx}</v></c>')
            else:
                out.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
        out.append("</row>")
    out.append("</sheetData></worksheet>")
    return "".join(out)


def write_xlsx(path: str, sheets: dict[str, dict[int, list] | list[list]]) -> None:
    """``sheets``: name -> rows (list = consecutive rows from 0, dict = sparse)."""
    shared: dict[str, int] = {}
    names = list(sheets)
    bodies = []
    for name in names:
        rows = sheets[name]
        if isinstance(rows, list):
            rows = dict(enumerate(rows))
        bodies.append(_sheet_xml(rows, shared))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/workbook.xml",
                   f'<workbook xmlns="{_MAIN}" xmlns:r="{_R}"><sheets>'
                   + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>'
                             for i, n in enumerate(names))
                   + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>'
                             for i in range(len(names)))
                   + "</Relationships>")
        for i, body in enumerate(bodies):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", body)
        sst = sorted(shared, key=shared.get)
        z.writestr("xl/sharedStrings.xml",
                   f'<sst xmlns="{_MAIN}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in sst) + "</sst>")
