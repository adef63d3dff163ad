"""The scanner: any string is read, well-formed pages as the standard library's parser reads them."""

import random
import time
from html.parser import HTMLParser

import pytest

from lyceum.operators import html as H
from lyceum.operators import markup as M
from lyceum.plans import extract
from pyspark.sql import functions as F


class Plain(HTMLParser):
    """(name, attrs, items) nested lists; strings beside each other are one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = ["", {}, [], None]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, [], self.at]
        self.at[2].append(node)
        if tag not in M.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        before = self.at
        self.handle_starttag(tag, attrs)
        self.at = before

    def handle_endtag(self, tag):
        node = self.at
        while node[3] is not None and node[0] != tag:
            node = node[3]
        if node[3] is not None:
            self.at = node[3]

    def handle_data(self, data):
        self.at[2].append(data)


def shape(items):
    """Names, attributes and strings, without parents."""
    out = []
    for x in items:
        if isinstance(x, M.Node):
            out.append((x.name, x.attrs, shape(x.items)))
        elif isinstance(x, list):
            out.append((x[0], x[1], shape(x[2])))
        elif not isinstance(x, M.Aside):
            if out and isinstance(out[-1], str):
                out[-1] += x
            else:
                out.append(str(x))
    return out


PARTS = ["<", ">", "</", "/>", "<!--", "-->", "<![", "]]>", "]>", "<!", "<?", "p", "td", "table", "script", "</script", "a", "img", " ", "=", "'", '"', "&amp", "&", "CDATA[", "foo[", "if x", "x", "²", "\n", "\x00", "title", "width=", "é", "</p>", "<p>", "<br>", "<table><tr><td>"]


def test_any_string_is_read():
    """100,000 strings of odd pieces: no exception, all fields, nothing but the text's own characters in the plain text."""
    rng = random.Random(1)
    for _ in range(100_000):
        page = "".join(rng.choices(PARTS, k=rng.randrange(1, 14)))
        root, odd = M.tree(page)
        assert odd >= 0
        if rng.random() < 0.05:
            read = H.read_page(page)
            assert read["error"] is None and set(read) == set(H.FIELDS)
            again, left = M.tree(root.items[0].html()) if root.items and isinstance(root.items[0], M.Node) else (None, 0)
            if again and "<!" not in page and "<?" not in page and "script" not in page and "\x00" not in page and "&" not in page:
                assert left == 0 and "".join(again.strings()) == "".join(root.items[0].strings())


def test_well_formed_pages_are_read_as_by_the_standard_library():
    rng = random.Random(2)

    def page(depth):
        out = []
        for _ in range(rng.randrange(4)):
            kind = rng.randrange(8)
            if kind < 3 and depth:
                name = rng.choice(["p", "div", "Table", "td", "B", "li", "h1"])
                attrs = "".join(rng.choice([" id=x", " CLASS='a b'", ' href="?q=1&amp;r=2"', " disabled", " v = '&lt;'", "\n data-x=1"]) for _ in range(rng.randrange(3)))
                out.append(f"<{name}{attrs}>{page(depth - 1)}</{name}>")
            elif kind == 3:
                out.append(rng.choice(["<br>", "<br/>", "<img src=a.png alt='x>y'>", "<hr />", "<p/>"]))
            elif kind == 4:
                out.append(rng.choice(["<!-- <p>no</p> -->", "<!DOCTYPE html>", "<?php x ?>", "<script>a<b>'</p>'</script>", "<style>p > a {}</style>", "</ul>"]))
            else:
                out.append(rng.choice(["text ", "a &amp; b", "&eacute;&#65;&#x42;", "1 < 2", "x&notit;", "\n"]))
        return "".join(out)

    for _ in range(5_000):
        text = page(4)
        plain = Plain()
        plain.feed(text)
        plain.close()
        assert shape(M.tree(text)[0].items) == shape(plain.root[2]), text


@pytest.mark.parametrize(
    "page, text, odd",
    [
        ("<p>a</p><![foo[x]]>b", "a|b", 1),
        ("<p>a<![CDATA[1 < 2]]></p>", "a|1 < 2", 0),
        ("a<![if IE]>b<![endif]>c", "a|b|c", 0),
        ("<p a='x", "<p a='x", 1),
        ("x<!-- y <b>z</b>", "x<!-- y|z", 1),
        ("<p>one<p>two", "one|two", 2),
        ("</p>a</br>b", "a|b", 1),
        ("a < b <c>d", "a < b|d", 1),
        ("<script>a", "", 1),
        ("<>x<1>", "<>x<1>", 2),
    ],
)
def test_odd_places(page, text, odd):
    root, found = M.tree(page)
    assert (root.text("|"), found) == (text, odd)


def test_reading_takes_linear_time():
    for piece in ["<a b='", "<!--", "<![foo[", "</x", "<p>x</q>", "<?", "<script>", "'\"<a ", "<a b=", "<td><td/"]:
        began = time.time()
        M.tree(piece * 40_000)
        assert time.time() - began < 3, piece


def test_table_html():
    page = "<TABLE class='a  b' id=x><tr><td title='\"q\"'>1 &lt; 2<br>&amp;<!-- c --></td><td>open<table><tr><td>in</table></table>after"
    outer, inner = H.read_page(page, ("table_html",))["table_html"]
    assert outer == (
        "<table class=\"a b\" id=\"x\"><tr><td title='\"q\"'>1 &lt; 2<br/>&amp;<!-- c --></td><td>open"
        "<table><tr><td>in</td></tr></table></td></tr></table>"
    )
    assert inner == "<table><tr><td>in</td></tr></table>"


def test_bad_pages_are_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_TEXT", 1000)
    pages = [(1, "<p>fine</p>"), (2, "<p>a</p><![foo[x]]>"), (3, "<img src=a.png width='²' alt='chart'>"), (4, "<p>deep text " * 60), (5, None), (6, "")]
    read = {p: H.read_page(h) for p, h in pages}
    assert read[4]["error"].startswith("ValueError") and read[4]["text"] == "" and read[4]["tables"] == [] and read[4]["odd"] is None
    assert read[3]["images"] == ["a.png"] and read[2]["text"] == "a" and read[2]["odd"] == 1
    df = spark.createDataFrame([(k, f"https://x.example/{k}", h) for k, h in pages], "page_id long, url string, html string")
    raw = extract.raw_pages(df, F.lit("c"), F.lit("2024-01-01").cast("timestamp"), "s")
    assert raw.count() == 6
    assert [r["page_id"] for r in H.page_errors(H.parse_pages(df, "error", "odd"), "page_id").orderBy("page_id").collect()] == [2, 4]


def test_table_documents_keep_their_html(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a<table><tr><td>b</table></td></tr></table>"), (2, "none"), (3, None)], "page_id long, html string")
    rows = H.table_documents(H.parse_pages(df, "tables", "table_html"), "page_id").orderBy("table_index").collect()
    assert [(r["page_id"], r["table_index"], r["html"]) for r in rows] == [
        (1, 0, "<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>"), (1, 1, "<table><tr><td>b</td></tr></table>"),
    ]


def test_pages_without_odd_places_are_read_by_tokens():
    """Ordinary pages are cut by one pattern, and as the scanner reads them; others are left to the scanner."""
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p > a {}</style><SCRIPT src='x'>if (a<b) '<p>'</script></head><body class='a  b'>"
        "<!-- <p>no</p> --><p>one<p>two &amp; <b>three</b></p><template><p>t</p></template><table><tr><td>1<td>2</tr></table></q><br/><p/></body></html>end"
    )
    found, odd = M._in_tokens(page)
    scanned, as_scanned = M._scanned(page)
    assert odd == as_scanned == 5
    assert all(getattr(found, c) == getattr(scanned, c) for c in M.Page.__slots__)
    for odd_one in ["<a b='x>y'>", "a < b", "<!-- x", "<script>a", "<![CDATA[x]]>", "<>", "<a b='x>", "<script>a</style>"]:
        assert M._in_tokens(odd_one) is None, odd_one
    for piece in ["<!--", "<script>", "<style ", "--><!--", "<p>x</q>", "<template><p>"]:
        began = time.time()
        M.tree(piece * 20_000)[0].text()
        assert time.time() - began < 3, piece


def test_remembered_tags_are_bounded(monkeypatch):
    monkeypatch.setattr(M, "TOKENS", 10)
    tokens = M.Tokens()
    for k in range(100):
        assert tokens[f"<a href='{k}'>"] == (M._OPEN, "a", {"href": str(k)})
    tokens["<p title='" + "x" * M.TOKEN + "'>"]
    assert len(tokens) <= 10 and max(map(len, tokens)) <= M.TOKEN


def test_narrow_rows_are_dealt_before_their_pages_are_read(spark):
    """The few MB of a file are one task; the pages made of them are not."""
    from lyceum.catalog import QUERIES

    for name in ("page_texts", "page_file_links", "page_data_images", "page_broken_markup", "page_table_html", "dates_context"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4, name
