"""Operator 1: layout-aware text of HTML pages.

A tree builder reads tags, supplies the implied ones (a cell implies a row, a
block ends a paragraph, an item ends the item before it) and lays every
element out when it closes, so no part of it recurses and a page of any depth
or length is handled in one pass over its bytes.

* Visibility: nothing of ``head``, ``script``, ``style``, ``template``,
  ``noscript`` and embedded media, of descriptions inside ``svg`` and ``math``
  (their other text is shown), of elements with ``hidden``, ``display:
  none`` or ``visibility: hidden`` (which a descendant may lift), of closed
  ``dialog`` or, but for its summary, ``details``.
* Blocks start on a line of their own, paragraphs and headings with a blank
  line around them; white space folds as in a browser, ``pre`` and ``br``
  keep theirs.
* Lists have markers (``-``, or numbers by ``start``, ``value``, ``reversed`` and
  ``type``) and indent what they hold, by ``INDENT`` columns at most: indents are
  counted and written once, so nesting of any depth takes linear time; tables are
  set in columns padded to the widest cell of ``ALIGN`` characters or fewer,
  spanning cells included.

Defined results: a null or empty page has an empty text; text outside any
element counts; unclosed and stray tags never fail; a quote that opens no
attribute value, or one that is never closed, is an ordinary character of its
tag, which ends at the next ``>``; repeated rows give equal
rows; an empty table gives no rows.  Extra input columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm.common import prepare, table

ALIGN = 60     # a longer cell is not padded to
INDENT = 100   # columns of indentation that are shown
SHARED = 8     # longer runs of lines are referred to, not copied, by what holds them

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript noframes iframe object canvas audio video datalist "
                   "title".split())
# of drawings and formulas: what describes or defines, and is not drawn
HIDDEN_INSIDE = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset("annotation annotation-xml".split())}
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table fieldset hr menu dir".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr td th "
                           "thead tbody tfoot caption details summary dialog figcaption legend center option optgroup "
                           "hgroup search".split())
# an opening tag ends these open elements, up to the nearest of the limits
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
        "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, {"html"})}
CLOSES_P = (SPACED | frozenset("div section article aside header footer nav main address form center details "
                               "hgroup search li dt dd".split()))
SCOPE = frozenset("table td th caption html button object template".split())  # a closing tag ends nothing outside
ROWS = frozenset("td th caption tr thead tbody tfoot".split())  # these end open cells of their table

# an attribute's name may hold quotes; a quoted run starts only directly after its '=' (possessive: nothing is tried twice)
_NAMED = r"""[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"""
_VALUE = r"""[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+))?+"""
_TAG = re.compile(rf"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\r\f/]++|{_NAMED}(?:{_VALUE.replace("([", "(?:[")})?+)*+)>)""")
_ATTRIBUTE = re.compile(rf"({_NAMED})(?:{_VALUE})?+")
_FOLD = re.compile("[ \t\n\r\f]+")
BREAK = "\0"


class Element:
    __slots__ = ("tag", "flow", "shown", "count", "rows", "spans", "pre", "step", "kind", "items")

    def __init__(self, tag, flow, shown, pre):
        self.tag, self.flow, self.shown, self.pre = tag, flow, shown, pre
        self.count = None   # next number of an ordered list, own number of an item
        self.step = 1       # -1 in a reversed list
        self.kind = "1"     # numbers, letters or roman ones
        self.items = None   # of a reversed list whose first number is its length: its items so far
        self.rows = None    # of a table: lists of (lines, columns, rows)
        self.spans = (1, 1)


ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"),
         (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))  # fixed values


def numeral(n: int, kind: str) -> str:
    """Number ``n`` as a list of that ``type`` shows it."""
    out, low = "", kind.lower()
    if low == "a" and n > 0:
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
    elif low == "i" and 0 < n < 4000:
        for value, letters in ROMAN:
            out, n = out + letters * (n // value), n % value
    else:
        return str(n)
    return out if kind == low else out.upper()


def flat(lines: list) -> list[str]:
    """Lines as text.  A line is a string or ``[mark, indent, lines]``: lines
    set in by ``indent``, the first of them after ``mark``."""
    out: list[str] = []
    stack = [(iter(lines), 0)]
    marks: list[str] = []  # that wait for the next line
    base = 0               # its indent before them
    while stack:
        rest, indent = stack[-1]
        x = next(rest, None)
        if x is None:
            stack.pop()
        elif isinstance(x, str):
            if not marks:
                base = indent
            out.append(" " * min(base, INDENT) + "".join(marks) + x if x else "")
            marks = []
        else:
            mark, more, inner = x
            if mark.strip() and not marks:
                base = indent
            if mark.strip() or marks and mark:
                marks.append(mark)
            stack.append((iter(inner), indent + more))
    return out


def lay_out(flow: list) -> list:
    """Lines of a flow: inline strings, and blocks as (lines, spaced)."""
    out: list = []
    inline: list[str] = []
    gap = False

    def put(lines: list[str], spaced: bool) -> None:
        nonlocal gap
        if lines:
            if out and (gap or spaced):
                out.append("")
            if len(lines) > SHARED:
                out.append(["", 0, lines])
            else:
                out.extend(lines)
            gap = spaced
        elif spaced:
            gap = True

    def flush() -> None:
        if inline:
            lines = [_FOLD.sub(" ", x).strip(" ") for x in "".join(inline).split(BREAK)]
            inline.clear()
            while lines and not lines[-1]:
                lines.pop()
            put(lines if any(lines) else [], False)

    for item in flow:
        if isinstance(item, str):
            inline.append(item)
        elif item[1] is None:   # preformatted text within a line
            flush()
            lines = item[0].split("\n")
            while lines and not lines[-1].strip():
                lines.pop()
            put(lines, False)
        else:
            flush()
            put(*item)
    flush()
    return out


def set_table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Aligned lines of rows of cells (lines, columns, rows spanned)."""
    placed, below = [], {}  # below: column -> rows that a cell above still covers
    widths: dict[int, int] = {}
    for row in rows:
        at, cells, held = 0, [], below
        below = {c: n - 1 for c, n in held.items() if n > 1}
        for lines, columns, deep in row:
            while held.get(at):
                at += 1
            cells.append((at, lines))
            if columns == 1:
                widths[at] = max(widths.get(at, 0), *(len(x) for x in lines if len(x) <= ALIGN), 0, 0)
            if deep > 1:
                below.update((c, deep - 1) for c in range(at, at + columns))
            at += columns
        placed.append(cells)
    columns = sorted({at for cells in placed for at, _ in cells})
    offset, left = {}, 0
    for c in columns:
        offset[c] = left
        left += widths.get(c, 0) + 2
    out = []
    for cells in placed:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for at, lines in cells:
                text = lines[k] if k < len(lines) else ""
                if text:
                    line = line.ljust(offset[at]) if len(line) <= offset[at] else line + "  "
                    line += text
            out.append(line)
    return out


class Builder:
    def __init__(self):
        root = Element("#root", [], True, False)
        self.stack = [root]
        self.opened: dict[str, int] = {}  # open elements by tag

    def attributes(self, text: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(text):
            out.setdefault(name.lower(), html.unescape(a or b or c))
        return out

    def open(self, tag: str, rest: str) -> None:
        stack = self.stack
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag in CLOSES_P:
            self.close("p")
        if tag in ("td", "th") and self.within({"tr"}, {"table"}) is None and self.within({"table"}, set()) is not None:
            self.open("tr", "")
        if tag == "br":
            self.text(BREAK if not stack[-1].pre else "\n")
            return
        if tag == "hr":
            self.flow().append(([], True))
            return
        if tag in VOID:
            return
        parent = stack[-1]
        attributes = self.attributes(rest) if rest.strip(" \t\n\r\f/") else {}
        style = re.sub(r"\s+", "", attributes.get("style", "").lower())
        shown = parent.shown
        if shown is not None:  # None: nothing below can be shown
            if "visibility:hidden" in style or "visibility:collapse" in style:
                shown = False
            elif "visibility:visible" in style:
                shown = True
            if (tag in HIDDEN or "hidden" in attributes or "display:none" in style
                    or any(tag in tags and self.opened.get(holder) for holder, tags in HIDDEN_INSIDE.items())
                    or tag == "dialog" and "open" not in attributes
                    or parent.tag == "details" and parent.count == 0 and tag != "summary"):
                shown = None
        block = tag in BLOCK or "display:block" in style
        element = Element(tag, [] if block else parent.flow, shown, parent.pre or tag in ("pre", "textarea", "xmp"))
        if tag == "details":
            element.count = 1 if "open" in attributes else 0
        elif tag == "ol":
            start = re.fullmatch(r"-?\d{1,9}", attributes.get("start", ""))
            element.count = int(start[0]) if start else 1
            if attributes.get("type", "") in ("a", "A", "i", "I"):
                element.kind = attributes["type"]
            if "reversed" in attributes:
                element.step = -1
                element.items = None if start else []
        elif tag == "li":
            own = re.fullmatch(r"-?\d{1,9}", attributes.get("value", ""))
            element.count = int(own[0]) if own else None
        elif tag == "table":
            element.rows = []
        elif tag in ("td", "th"):
            number = lambda x: max(1, min(1000, int(x))) if re.fullmatch(r"\d{1,6}", x) else 1
            element.spans = number(attributes.get("colspan", "")), number(attributes.get("rowspan", ""))
        elif tag == "tr":
            element.rows = []
        stack.append(element)
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def flow(self) -> list:
        return self.stack[-1].flow

    def within(self, tags: set[str], limits: set[str]) -> int | None:
        """Place of the nearest open element of ``tags`` above the nearest of ``limits``."""
        if not any(map(self.opened.get, tags)):
            return None
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                return k
            if tag in limits:
                return None
        return None

    def end_open(self, tags: set[str], limits: set[str]) -> None:
        while (k := self.within(tags, limits)) is not None:
            self.pop_to(k)

    def close(self, tag: str) -> None:
        limits = {"table"} if tag in ROWS else set() if tag in SCOPE else SCOPE
        if (k := self.within({tag}, limits - {tag})) is not None:
            self.pop_to(k)
        elif tag == "br":
            self.text(BREAK)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            element = self.stack.pop()
            self.opened[element.tag] -= 1
            self.finish(element)

    def finish(self, e: Element) -> None:
        parent = self.stack[-1]
        if e.flow is parent.flow:
            return
        tag = e.tag
        if tag in ("td", "th"):
            if parent.rows is not None:
                parent.rows.append((flat(lay_out(e.flow)), *e.spans))
                return
        elif tag == "tr":
            k = self.within({"table"}, set())
            loose = flat(lay_out(e.flow))
            if loose:
                e.rows.append((loose, 1, 1))
            if any(c[0] for c in e.rows):
                if k is not None:
                    self.stack[k].rows.append(e.rows)
                else:  # a row outside any table is laid out on its own
                    parent.flow.append((set_table([e.rows]), False))
            return
        elif tag == "table":
            lines = set_table(e.rows)
            around = lay_out(e.flow)  # captions and text outside cells
            parent.flow.append((around + lines, True))
            return
        lines = lay_out(e.flow)
        if tag == "li" and lines:
            k = self.within({"ul", "ol", "menu", "dir"}, set())
            node = ["- ", 2, lines]
            if k is not None and self.stack[k].count is not None:
                self.number(self.stack[k], e, node)
            lines = [node]
        elif tag in ("blockquote", "dd") and lines:
            lines = [["  ", 2, lines]]
        elif tag == "ol" and e.items:  # reversed, from the number of its items
            e.count, items, e.items = len(e.items), e.items, None
            for item, node in items:
                self.number(e, item, node)
        nested = tag in ("ul", "ol", "dl", "menu", "dir") and self.within({"li", "dd"}, {"td", "th", "table"}) is not None
        parent.flow.append((lines, tag in SPACED and not nested))

    def number(self, holder: Element, item: Element, node: list) -> None:
        if holder.items is not None:
            holder.items.append((item, node))
            return
        n = holder.count if item.count is None else item.count
        holder.count = n + holder.step
        node[0] = numeral(n, holder.kind) + ". "
        node[1] = len(node[0])

    def text(self, data: str) -> None:
        top = self.stack[-1]
        if not top.shown or top.tag == "details" and top.count == 0:
            return
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "dl") and not data.strip(" \t\n\r\f"):
            return
        if top.pre and data != BREAK:
            if top.flow and isinstance(top.flow[-1], tuple) and top.flow[-1][1] is None:
                top.flow[-1] = (top.flow[-1][0] + data, None)
            else:
                top.flow.append((data.removeprefix("\n"), None))
        else:
            top.flow.append(data)

    def finish_all(self) -> list[str]:
        self.pop_to(1)
        return flat(lay_out(self.stack[0].flow))


def extract(page: str | None) -> str:
    """The visible text of one page."""
    page = (page or "").replace("\0", "�").replace("\r\n", "\n")
    builder, at = Builder(), 0

    def text(a: int, b: int) -> None:
        if a < b:
            data = page[a:b]
            builder.text(html.unescape(data) if "&" in data else data)

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            text(at, len(page))
            break
        text(at, m.start())
        at = m.end()
        if m[1]:
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif m[2]:
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        elif m[3]:
            builder.close(m[4].lower())
        else:
            tag = m[4].lower()
            builder.open(tag, m[5])
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                stop = end.start() if end else len(page)
                data = page[at:stop]
                builder.text(html.unescape(data) if tag in ("textarea", "title") else data)
                at = stop
    return "\n".join(builder.finish_all()).replace("\xa0", " ")


def page_texts(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> ``page_id, text, n_lines``; no shuffle."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(1).to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(lines, pa.int32())],
                names=["page_id", "text", "n_lines"])

    return pages.select("page_id", F.col("html")).mapInArrow(run, "page_id LONG, text STRING, n_lines INT")


def op1_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages", "page_id", "html"))
