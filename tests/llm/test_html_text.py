import re
import time
from html.parser import HTMLParser

import pytest

from ripplework.llm import html_text

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>q", "- x\n- y\n  - z\n\nq"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<table><tr><th>Name<th>N<tr><td>Ann<td>10<tr><td>Bartholomew<td>2</table>", "Name         N\nAnn          10\nBartholomew  2"),
    ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>c</table>", "wide  c\na  b  c"),
    ("a<br>b <b>c</b>d", "a\nb cd"),
    ("<div hidden>x</div><p style='display: none'>y</p>z<script>1<2</script>", "z"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("&lt;b&gt; &amp; &copy;", "<b> & ©"),
    ("<head><title>t</title></head><body><h1>H</h1>x", "H\n\nx"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    ("<<>a<b", "<<>a<b"),
    ("x <!-- c --> y", "x y"),
    ("<a href='>'>l</a>", "l"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_cases(source, text):
    assert html_text.page_text(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><form><td>A</td><td>B</td></form></tr></table>", "A  B"),
        ("<table><form><tr><td>A</td><td>B</td></tr>say</form><tr><td>C</td></tr></table>", "say\nA  B\nC"),
        ("<table><tbody>x<tr>y<b>z</b><td>A</td></tr></tbody></table>", "x\ny\nz\nA"),
        ("<table><tr><td>a<table><tr><form><td>b</td></form></tr></table></td></tr></table>", "a b"),
        ("<table><tr><form hidden><td>A</td></form><td>B</td></tr></table>", "B"),
        ("<table><colgroup><col><td>A</td></table>", "A"),
        ("x<math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a=2</annotation></math>y", "xa=2y"),
        ("<svg><title>t</title><defs/><g>no<text>A <tspan>b</tspan></text><circle/><text>C</text></g><defs><text>D</text></defs></svg>", "A b C"),
        ("<svg><foreignObject><p>in</p></foreignObject></svg><annotation>out</annotation>", "in\n\nout"),
    ],
)
def test_all_visible_text(source, text):
    assert html_text.page_text(source) == text


def test_deep_tables_end():
    assert html_text.page_text("<table>" + "<div>" * 50_000 + "<tr><td>x") == "x"


def test_deep_and_broken_markup_ends():
    assert html_text.page_text("<div>" * 50_000 + "x") == "x"
    assert "x" in html_text.page_text("<table><tr><td>" * 3000 + "x")
    html_text.page_text("<a " * 20_000)


def test_table(spark, sf_dir):
    rows = [(1, "<p>a", "z"), (None, None, "z"), (1, "<p>a", "z"), (2, "<p>" + "long " * 100_000, "z")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert [(r.page_id, r.text[:4]) for r in got] == [(1, "a"), (None, ""), (1, "a"), (2, "long")] and got[3].n_chars == 499_999
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert html_text.extract_text(pages).count() == pages.count()
    assert html_text.extract_text(pages.limit(0)).collect() == []


class Walk(HTMLParser):
    """All character data outside of elements that show none: a page's words, without layout."""

    def __init__(self):
        super().__init__()
        self.words, self.unseen = [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.unseen:
            self.unseen += [tag] if tag == self.unseen[0] else []
        elif tag not in html_text.VOID and (tag in html_text.UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or html_text.HIDDEN_STYLE.search(a.get("style", ""))):
            self.unseen = [tag]
        elif tag == "img":
            self.words += a.get("alt", "").split()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.unseen and tag == self.unseen[0]:
            self.unseen.pop()

    def handle_data(self, data):
        if not self.unseen:
            self.words.append(data)


def plain(text):
    """Words without the marks of lists."""
    return [w for w in text.split() if not re.fullmatch(r"-|\d+\.", w)]


def test_same_words_as_a_plain_walk(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        walk = Walk()
        walk.feed(r.html or "")
        walk.close()
        assert "".join(plain(got[r.page_id])) == "".join(plain(" ".join(walk.words))), r.page_id


def test_text_in_tables_outside_of_cells():
    assert html_text.page_text("<table><tr>lost<td>x</td><p>para</p></table>").split() == ["lost", "para", "x"]
    assert html_text.page_text("<table><tbody>txt<tr><td>x<tr><div>inner</div></table>").split() == ["txt", "inner", "x"]
    assert html_text.page_text("<table><td>deep " * 300 + "<table><td>a<td>b<tr><td>c").split() == ["deep"] * 300 + ["a", "b", "c"]


def test_wide_cells_and_spans():
    wide = "w" * 500
    assert html_text.page_text(f"<table><tr><td>a<td>b<tr><td>{wide}<td>c<tr><td>ab<td>d</table>") == f"a   b\n{wide}  c\nab  d"
    assert html_text.page_text("<table><tr><td>a<td>b<td>c<tr><td colspan=2>long text<td>d<tr><td colspan=1000>e<td>f</table>").split("\n")[:2] == ["a  b  c", "long text  d"]


def test_unfinished_markup():
    assert html_text.page_text('a <a title="x>link</a> <b title=\'y>z') == "a link z"
    assert html_text.page_text("a <b") == "a <b" and html_text.page_text("a <!-- b") == "a" and html_text.page_text("a < b <3 c </") == "a < b <3 c </"
    assert html_text.page_text("<p it's>text</p x='>'> more") == "text\nmore" or html_text.page_text("<p it's>text</p x='>'> more") == "text\n\nmore"


@pytest.mark.parametrize(
    "page",
    [lambda n: "<a " * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<div>" + "<b>" * n + "<hr>" * n, lambda n: "<b>" * n + "<li>x" * n, lambda n: "<table><td>" * n + "x", lambda n: "<i><table><td>" + "<b>" * n + "</i>" * n, lambda n: "<p>" + "word " * n, lambda n: "<" * n, lambda n: "<table>" + "<tr><td colspan=1000>x<td>y" * n],
)
def test_time_in_proportion(page):
    def seconds(n):
        began = time.process_time()
        html_text.page_text(page(n))
        return time.process_time() - began

    assert seconds(32_000) < 12 * max(seconds(8000), 0.02)
