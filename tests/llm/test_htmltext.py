import time
from html.parser import HTMLParser

import pytest

from reuselens.llm import htmltext as h


class Words(HTMLParser):
    """Words of all text that is not within a hidden element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in h.BLOCK or tag in ("br", "td", "th"):
            self.out.append(" ")
        if tag in ("head", "title", "script", "style", "noscript", "template"):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in h.BLOCK:
            self.out.append(" ")
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def words(html):
    p = Words()
    p.feed(html)
    p.close()
    return "".join(p.out).split()


def test_every_visible_word_of_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = h.extract(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        # list marks are the renderer's own
        assert [w for w in r.text.split() if w != "-"] == [w for w in words(html[r.page_id]) if w != "-"], r.page_id
        assert r.n_chars == len(r.text) and r.title


@pytest.mark.parametrize("html, text", [
    ("", ""), ("a  b\n c", "a b c"), ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div>b<div>c</div>", "a\nb\nc"),
    ("a<b>b</b>c <i> d</i>", "abc d"), ("x<br>y<br><br>z", "x\ny\n\nz"), ("a<!-- <p>b -->c", "ac"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n\n  3. x\n  4. y\n\nz"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<br>red<td>3</table>", "Name   Qty\napple  3\nred"),
    ("<table><caption>T</caption><tbody><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "T\nwide cell\na  b"),
    ("<table><tr><td>a<table><tr><td>b</table><td>c</table>", "a  c\n\nb"),
    ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"), ("&lt;p&gt; &amp; &eacute;&nbsp;", "<p> & é\xa0".rstrip()),
    ("<p hidden>no</p><div style='color:red; display : NONE'>no<b>no</b></div>yes", "yes"),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style>yes", "yes"), ("<select><option>one</select>yes", "one\nyes"),
    ("<p>a</div>b</p>", "ab"), ("<td>a<td>b", "a b"), ("a<a title='>x'>b</a>", "ab"), ("1 < 2 <3", "1 < 2 <3"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("<blockquote><p>q</p></blockquote>r", "  q\n\nr"), ("<img alt='pic'>", "pic"),
    ("<H1>T</H1>x", "T\n\nx"), ("<p", ""), ("</", "</"), ("<title>t</title>", ""),
])
def test_layout(html, text):
    assert h.render(html) == text


def test_odd_rows(spark):
    big = "<div>" * 50_000 + "deep" + "</div>" * 50_000 + "<p>w</p>" * 50_000
    rows = [(1, None), (2, ""), (3, big), (None, "<b>x"), (4, "same"), (4, "same"), (5, "<table><tr><td>" * 2000 + "x"),
            (6, "<a " + '"' * 20_001), (7, "\x00<p>퟿")]
    pages = spark.createDataFrame([(b, a, 1, "t") for a, b in rows], "html string, page_id long, n_chars int, title string")
    start = time.time()
    got = sorted(((r.page_id, r.text[:8]) for r in h.extract(pages).collect()), key=str)
    assert time.time() - start < 60
    assert got == sorted([(1, ""), (2, ""), (3, "deep\n\nw\n"), (None, "x"), (4, "same"), (4, "same"), (5, "x"), (6, ""),
                          (7, "\x00\n\n퟿")], key=str)
    assert h.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("html, want", [
    ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>x</annotation></math> b", "a x=1 2 b"),
    ("<svg><title/><defs/><desc>no</desc><path d='M0'/><text>one</text><text>two</text></svg> b", "one two b"),
    ("<p>Name <textarea>x &amp; <b>\n  y</textarea>z", "Name\nx & <b>\n  y\nz"),
    ("<select><option>one<option selected>two</select>yes", "one\ntwo\nyes"),
    ("<object data=x><p>instead</p></object>", "instead"), ("<map><area><p>places</map>", "places"),
    ("a<xmp><b> &amp;\n  c</xmp>d", "a\n\n<b> &amp;\n  c\n\nd"), ("a<plaintext><p>b</plaintext>\n  c", "a\n\n<p>b</plaintext>\n  c"),
])
def test_shown_elements(html, want):
    assert h.render(html) == want


def test_deep_lists_keep_lines_marks_and_alt_texts():
    inner = "<ol start=3><li>one<br>more<li><img alt=two></ol><pre>x\n  y</pre><table><tr><td>a<td>b<tr><td>c</table>"
    lines = [x.strip() for x in h.render("<blockquote>" * 80 + inner + "</blockquote>" * 80).split("\n")]
    assert [x for x in lines if x] == ["3. one", "more", "4. two", "x", "y", "a b", "c"]


def test_wide_tables_grow_with_their_text():
    rows = "<tr><td>a<td>b" * 1000
    html = "<table><tr><td>" + "x" * 100_000 + "<td>b" + rows + "</table>"
    text = h.render(html)
    assert len(text) < 8 * len(html) and text.split("\n")[1] == "a\tb"
    spans = "<table>" + "<tr><td colspan=1000>a<td>b" * 500 + "</table>"
    assert len(h.render(spans)) < 8 * len(spans)
    nested = "<table><tr><td>" * 50 + "x" * 2000 + "<tr><td>y<td>z</table>" * 50
    assert len(h.render(nested)) < 8 * len(nested)


@pytest.mark.parametrize("html, want", [
    ("<!-- <title>x</title> --><title>y &amp;\n z</title><title>w</title>", "y & z"), ("<svg><title>no</title></svg>", None),
    ("<script>'<title>x</title>'</script>", None), ("<title>open", "open"), ("<p>a", None), ("<title></title>", ""),
    ("<svg><title>no</title></svg><TITLE lang=en>yes</TITLE >", "yes"),
])
def test_title(html, want):
    assert h.title(h.parse(html)) == want


def test_many_open_titles():
    start = time.time()
    assert h.title(h.parse("<title>" * 20_000)).startswith("<title>")
    assert time.time() - start < 5
