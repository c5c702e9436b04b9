import random
import time

import pytest

from periodix.llm.html_text import extract, page_texts

CASES = [
    ("", ""), (None, ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<div>a</div><div>b <b>c</b>\n d</div>", "a\nb c d"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>x<li>y<li>z</ol>", "9. x\n10. y\n11. z"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>10<tr><td>Fig<td>7</table>", "Name   Qty\nApple  10\nFig    7"),
    ("<table><td>a<td>b</table>", "a  b"),  # implied row
    ("<table><tr><td colspan=2>long heading<td>z<tr><td>a<td>b<td>c</table>", "long heading  z\na  b  c"),
    ("<table><tr><td rowspan=2>R<td>1<tr><td>2</table>", "R  1\n   2"),
    ("<table><tr><td>p<table><tr><td>in<td>ner</table><td>q</table>", "p        q\n\nin  ner"),
    ("<pre>\n a  b\n   c</pre>d", " a  b\n   c\n\nd"), ("x<!-- <p>no</p> -->y<!-- open", "xy"),
    ("<script>if (a < b) '</p>'</script><style>p{}</style>t", "t"), ("<title>no</title>yes", "yes"),
    ("<p hidden>no</p><p style='display: none'>no<b>no</b></p>a", "a"),
    ("<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "yes"),
    ("<details><summary>S</summary>no<p>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("&lt;p&gt; &amp; &eacute;&nbsp;x", "<p> & é x"),
    ("</p></div>stray</b> <b>open", "stray open"), ("a < b and c > d", "a < b and c > d"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"), ("<h1>H</h1>text<hr>more", "H\n\ntext\n\nmore"),
    ("<a title=\"x > y\" href='#'>l</a>", "l"), ("<select><option>a<option>b</select>", "a\nb"), ("a\0b", "a�b"),
    ("<html><head><meta charset=x><body><p>z", "z"),
    ("<p data-x=don't>It's here</p><p>next</p>", "It's here\n\nnext"),  # stray quotes
    ("<p class=\"a\"\">Hello \"you\"</p>", "Hello \"you\""), ("<b 'x>y</b>z'", "yz'"), ("<p =\"x>y\">z", "y\">z"),
    ("<p title=it's'hidden>a", "a"), ("<p title = 'a>b' hidden>no</p>c", "c"), ("<p a=\"b>c", "c"), ("<i a= >d</i>", "d"),
    ("<a href=x/y'>e</a><br a='>'/>f", "e\nf"),
    ("<tr><td>a<td>b</tr>", "a  b"), ("x</table><tr><td>text", "x\ntext"), ("<tr><td>a<td>b</tr>c", "a  b\nc"),  # rows outside a table
    ("<tbody><tr><td>a<td>b<tr>loose<td>c</tbody>d", "a  b\nc  loose\nd"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert extract(page) == want


def test_any_depth_and_length():
    assert extract("<div>" * 50_000 + "x") == "x"
    assert extract("<b>" * 50_000 + "x</i>") == "x"
    assert extract("<p>a" * 20_000).count("a") == 20_000
    assert extract("<table>" * 200 + "x").strip() == "x"
    assert len(extract("<table>" + "<tr><td>k<td>" + "v" * 500_000 + "<tr><td>k" * 2000 + "</table>")) < 600_000


def test_query_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "u", ""), (3, "u", "<p>x<p>y")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").selectExpr("*", "'t' AS text")
    got = page_texts(pages).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "a", 1), (1, "a", 1), (2, "", 0), (None, "", 0), (3, "x\n\ny", 3)], key=str)
    assert page_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("E = <math><mi>m</mi><mo>c</mo><annotation>tex</annotation></math> done", "E = mc done"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>yes</text></svg>a", "yesa"),
    ("<map><area><p>in the map</map>", "in the map"), ("<desc>shown</desc>", "shown"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"),
    ("<ol type=a start=26><li>a<li>b</ol>", "z. a\naa. b"), ("<ol type=I start=9><li>x<br>y</ol>", "IX. x\n    y"),
    ("<ol reversed><li>a<ol><li>x</ol><li>b</ol>", "2. a\n   1. x\n1. b"),
    ("<ul><li><ul><li>a<li>b</ul></ul>", "- - a\n  - b"), ("<ul><li><blockquote>a<br>b</blockquote></ul>", "-   a\n    b"),
])
def test_drawings_and_numbers(page, want):
    assert extract(page) == want


def test_deep_nesting_is_linear():
    for tag in ("<ul><li>a", "<blockquote>a", "<div>a", "<ol reversed><li>a"):
        page = tag * 50_000
        start = time.perf_counter()
        got = extract(page)
        assert time.perf_counter() - start < 20
        assert got.count("a") == 50_000 and len(got) < 120 * 2 * 50_000
    assert extract("<ul><li>" * 50_000 + "x") == "- " * 50_000 + "x"


def written(node):
    """A tree as HTML and, by plain recursion, the lines it must give."""
    tag, parts = node
    if tag == "text":
        return parts, [parts]
    shown = [written(p) for p in parts]
    html = f"<{tag}>" + "".join(h for h, _ in shown) + f"</{tag}>"
    lines = [x for _, part in shown for x in part]
    if tag == "li":
        lines = [("- " if n == 0 else "  ") + x for n, x in enumerate(lines)]
    elif tag == "dd":
        lines = ["  " + x for x in lines]
    return html, lines


def test_generated_trees_against_recursion():
    rnd = random.Random(5)

    def tree(depth):
        kind = rnd.choice(["text", "div", "ul", "dd"]) if depth else "text"
        if kind == "text":
            return "div", [("text", "w%d" % rnd.randint(0, 99))]
        if kind == "ul":  # inside an item, so that no blank lines surround it
            return "ul", [("li", [tree(depth - 1) for _ in range(rnd.randint(1, 3))]) for _ in range(rnd.randint(1, 3))]
        if kind == "dd":  # in a list of its own: one dd ends another
            return "dl", [("dd", [tree(depth - 1) for _ in range(rnd.randint(1, 12))])]
        return kind, [tree(depth - 1) for _ in range(rnd.randint(1, 12))]

    for _ in range(300):
        html, lines = written(("ul", [("li", [tree(4) for _ in range(3)])]))
        assert extract(html) == "\n".join(lines)
