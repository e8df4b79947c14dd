"""Markup stripping, white space, links, chunking and templates."""

import re
import time
from html.parser import HTMLParser

from conftest import one_col
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking as C


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_html_fixture_cases(spark):
    cases = [
        ("a [b] c", "a b c"),
        ("a &lt;b&gt; c", "a  c"),
        ("a<b\rc>d", "ad"),  # as decoded text: '.' crosses \r
        ("d&lt;x\ny&gt;z", "d<x\ny>z"),  # a decoded tag across a newline stays
        ("<p>x &amp;lt; y</p>", "x &lt; y"),  # &amp; decoded last
        ("<script>var a='<p>'</script><style>p{}</style><!-- c -->t", "t"),
        ("<!DOCTYPE html><b>bold</b> &copy; 1 &middot; 2", "bold © 1 · 2"),
        (None, None),
    ]
    out = _apply(spark, X.strip_html, [c[0] for c in cases])
    assert out == [c[1] for c in cases]


def test_strip_ws_unicode(spark):
    out = _apply(spark, X.strip_ws, ["\u00a0  hi \n", "\t\x1c x y\u3000", "", "   ", "\u00a0"])
    assert out == ["hi", "x y", "", "", ""]


class _Text(HTMLParser):
    """Text outside scripts and styles, references decoded by the parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = "", 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.out += data


def test_references_and_markup_equal_an_html_parser(spark):
    cases = [
        "Administraci&oacute;n &#241; &#xE1; &euro; &ntilde;&Ntilde;",
        "a &amp;lt; b &amp;amp; c &unknown; &#0; &#xD800; & &; &#; x",
        "<p title='a b'>uno</p><SCRIPT type=x>var a = '<p>';</SCRIPT >dos<style>p{}</style>",
        "<!-- <!-- a --> b <!-- c\nd -->e",
        "t&uacute; &iquest;qu&eacute;? &#8364;&#x1F600; &apos;&quot;",
    ]
    want = []
    for c in cases:
        parser = _Text()
        parser.feed(c)
        parser.close()
        want.append(parser.out)
    assert _apply(spark, X.drop_markup, cases) == want


def test_unclosed_openers_keep_their_text(spark):
    cases = ["a <!-- b", "a<script>b", "x <!-- y --> z <!-- w", "<b", "1 < 2"]
    assert _apply(spark, X.drop_markup, cases) == ["a <!-- b", "ab", "x  z <!-- w", "<b", "1 < 2"]


def test_leftover_tags_equal_the_lazy_pattern(spark):
    cases = ["a <b> c", "< b <c> d", "<<<<", "a < b\nc > d", "<>x<\r>", "x <y", "<a<b\n<c>"]
    assert [re.sub("<.*?>", "", c) for c in cases] == [
        r for r in _apply(spark, lambda c: F.regexp_replace(c, X.RE_LEFTOVER_TAG, "$1"), cases)
    ]


def test_hostile_texts_take_linear_time(spark):
    texts = ["<!--" * 50_000, "<a " * 50_000, "<script>" * 30_000, "<" * 100_000, "a" + " " * 200_000 + "b", "&" * 100_000]
    start = time.time()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    rows = df.select("i", X.strip_html("v").alias("h"), F.length(X.strip_ws("v")).alias("n")).collect()
    assert len(rows) == len(texts) and time.time() - start < 20
    assert {r["i"]: r["n"] for r in rows}[4] == 200_002
    start = time.time()
    long = spark.createDataFrame([("x" * 2_000_000,)], "t string")
    assert C.chunk_fixed(long, "t").count() == -(-2_000_000 // 512) and time.time() - start < 20


def test_enclosed_equals_the_lazy_pattern(spark):
    cases = ["<a>1</a >x<a b>2<a>3</a></a><A>4</A>", "</a><a>", "<a", "", "<a\n>x\n</a>", "<ab>no</a>", "<a>" * 40_000]
    want = [re.findall(r"(?is)<a\b[^<>]*>.*?</a\s*>", c) if len(c) < 999 else [] for c in cases]
    assert _apply(spark, lambda c: X.enclosed(c, r"<a\b[^<>]*>", r"</a\s*>", "is"), cases) == want


def test_strip_equals_python(spark):
    cases = [c + "x y" + c for c in map(chr, range(0x3001)) if c.isspace()] + ["", " ", "\u200bx", "x"]
    assert _apply(spark, X.strip_ws, cases) == [c.strip() for c in cases]


def test_format_links_wraps_a_link(spark):
    out = _apply(spark, X.format_links, ["See https://a.example/x?y=1 there."])
    assert out == [
        'See <a href="https://a.example/x?y=1" target="_blank" style="color: blue;">https://a.example/x?y=1</a> there.'
    ]


def test_format_links_stops_at_nbsp(spark):
    out = _apply(spark, X.format_links, ["http://a.es/b\u00a0c y www.x.org"])
    assert out == [
        '<a href="http://a.es/b" target="_blank" style="color: blue;">http://a.es/b</a>\u00a0c y '
        '<a href="www.x.org" target="_blank" style="color: blue;">www.x.org</a>'
    ]


def test_fill_template_single_pass(spark):
    df = spark.createDataFrame([("{input} literal", "q")], "context string, input string")
    out = df.select(X.fill_template("C={context} Q={input} {other}", {"context": "context", "input": "input"}).alias("p"))
    assert one_col(out, "p") == ["C={input} literal Q=q {other}"]


def _chunks(spark, texts, length=512):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = C.chunk_fixed(df, "t", length).orderBy("id", "chunk_no").collect()
    return [(r["id"], r["chunk_no"], r["chunk"]) for r in rows]


def test_chunk_empty_and_null_give_no_rows(spark):
    assert _chunks(spark, ["", None]) == []


def test_chunk_exact_multiple(spark):
    out = _chunks(spark, ["x" * 1024])
    assert [(c[1], len(c[2])) for c in out] == [(0, 512), (1, 512)]


def test_chunk_code_points(spark):
    text = "a" * 511 + "\U0001F600" + "b" * 10
    out = _chunks(spark, [text])
    assert out[0][2].endswith("\U0001F600") and len(out[0][2]) == 512
    assert out[1][2] == "b" * 10


def test_chunks_reassemble(spark):
    text = "".join(chr(65 + i % 26) for i in range(2000))
    out = _chunks(spark, [text], 300)
    assert "".join(c[2] for c in out) == text
    assert all(len(c[2]) == 300 for c in out[:-1])


def test_notice_rows_decorate_and_blank(spark):
    df = spark.createDataFrame([("u1", "t", "x" * 600)], "url string, titulo string, texto string")
    rows = C.notice_rows(df).orderBy("chunk_no").collect()
    assert [r["resumen"] for r in rows] == ["x" * 512 + "\nURL: u1", "x" * 88 + "\nURL: u1"]
    assert {r["texto"] for r in rows} == {""}
