"""Tokens and only strings against the standard parser; character references."""

import html
import random
import time
from html.parser import HTMLParser

import pytest

from lectern.functions import links as L
from lectern.functions import markup as H
from lectern.functions import text as X
from lectern.sources import pages as P


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        self.out.append(("start", tag, "", first))

    def handle_startendtag(self, tag, attrs):  # HTML 5 ignores the slash
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.out.append(("end", tag, "", {}))

    def handle_data(self, data):
        raw = self.out and self.out[-1][:2] in (("start", "script"), ("start", "style"))
        self.out.append(("raw", self.out[-1][1], data, {}) if raw else ("text", "", data, {}))

    def handle_comment(self, data):
        self.out.append(("comment", "", data, {}))

    def handle_decl(self, decl):
        self.out.append(("declaration", "", decl, {}))

    def handle_pi(self, data):
        self.out.append(("declaration", "", data, {}))


def _joined(found):
    """Neighbouring texts as one."""
    out = []
    for token in found:
        if token[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", "", out[-1][2] + token[2], {})
        else:
            out.append(tuple(token))
    return out


CASES = [
    "<!DOCTYPE html><p class='a b' id=x data-k=\"1>2\">uno &amp; dos</p>",
    "<SCRIPT type=x>var a = '<p>' && 1;</SCRIPT >tras<style>p > a {}</style>",
    "<!-- <b> --><br/><img src='a.png' alt=\"x's\"><input disabled>",
    "a < b and c > d &lt;e&gt; <b>f</b>",
    "<?php echo 1 ?>x<a href=/n?id=A&amp;x=1>l</a>",
    "<td a=1 a=2 B='C'>v</td></x>",
]


@pytest.mark.parametrize("case", CASES)
def test_tokens_equal_a_parser(case):
    parser = _Parser()
    parser.feed(case)
    parser.close()
    assert _joined(H.tokens(case)) == _joined(parser.out)


def test_unclosed_constructs_last_to_the_end():
    assert [t[:3] for t in H.tokens("a<!-- b")] == [("text", "", "a"), ("comment", "", " b")]
    assert [t[:3] for t in H.tokens("<script>x</b>")] == [("start", "script", ""), ("raw", "script", "x</b>")]
    assert [t[:3] for t in H.tokens("<b")] == [("start", "b", "")]


def test_tokens_of_hostile_texts_take_linear_time():
    start = time.time()
    for part in ("<!--", "<a '", "<a \"", "<script>", "<", "&", "</", "<a b=", "<li>", "<td><p>"):
        list(H.tokens(part * 40_000))
        H.only_strings(part * 2_000, "li")
    assert time.time() - start < 30


def test_only_strings():
    page = (
        "<a href=1>Otros formatos</a><a href=2><b>Otros formatos</b></a><a href=3>Otros <b>formatos</b></a>"
        "<a href=4></a><a href=5><img>Otros formatos</a><a href=6> <b>x</b></a><a href=7>uno &amp; dos</a>"
        "<a href=8><i><b>hondo</b></i></a>"
    )
    got = {a["href"]: s for s, a in H.only_strings(page, "a")}
    assert got == {
        "1": "Otros formatos", "2": "Otros formatos", "3": None, "4": None, "5": None, "6": None, "7": "uno & dos", "8": "hondo",
    }
    assert [s for s, _ in H.only_strings("<ul><li>uno<li>dos <b>x</b><li>tres</ul>", "li")] == ["uno", None, "tres"]


def test_link_text_is_the_only_string(spark):
    page = (
        "<a href=1>Otros formatos</a><a href=2><b>Otros formatos</b></a><a href=3>Otros <b>formatos</b></a>"
        "<a href=5><img>Otros formatos</a><a href=6>Otros formatos<br></a>"
    )
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    links = L.extract_links(df, "html")
    assert sorted(r["href"] for r in L.filter_link_text(links).collect()) == ["1", "2"]
    read = H.element_strings(df, "a").orderBy("element_no").collect()
    assert [r["string"] for r in read] == [r["anchor_string"] for r in links.orderBy("link_no").collect()]


def test_token_rows_of_null_and_empty_bodies(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<b>x</b>")], "id int, html string")
    got = H.html_tokens(df).orderBy("token_no").collect()
    assert [(r["id"], r["token_no"], r["kind"], r["name"], r["text"]) for r in got] == [
        (3, 0, "start", "b", ""), (3, 1, "text", "", "x"), (3, 2, "end", "b", ""),
    ]


def _decoded(spark, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    return [r["o"] for r in df.select("i", X.decode_entities("t").alias("o")).orderBy("i").collect()]


def test_every_character_reference_equals_the_library(spark):
    cases = [f"x&{name} y" for name in html.entities.html5] + [f"&{name}z" for name in html.entities.html5 if not name.endswith(";")]
    numbers = [*range(0, 0x120), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000]
    cases += [f"&#{n};" for n in numbers] + [f"&#x{n:X}" for n in numbers] + ["&#00000000000000065;", "&#99999999999999999999;", "&#x;", "&#xg;", "&#;"]
    cases += ["&notit; &notin; &copy2 &COPY; &amp;lt; &unknown; &ampx &;", "& &&amp;& &#38#38;", "&" * 50 + "lt;", "&" + "a" * 40 + ";"]
    assert _decoded(spark, cases) == [html.unescape(c) for c in cases]


def test_random_references_equal_the_library(spark):
    rng = random.Random(11)
    parts = ["&", "#", "x", "amp", "lt", ";", "not", "in", "copy", " ", "12", "e9", "\n", "<", "é", "AElig", "sup1"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    assert _decoded(spark, cases) == [html.unescape(c) for c in cases]


def test_xml_records_read_nested_elements_cdata_and_broken_bodies(spark):
    rows = [
        (1, '<d a="1"><titulo>T &amp; 1</titulo><texto><p>a</p><p><![CDATA[b < c]]></p></texto><texto><p>d</p></texto><url_pdf>/x</url_pdf></d>'),
        (2, "<d><titulo>broken"),
        (3, None),
        (4, "<d><texto></texto></d>"),
        (5, "no markup"),
        (6, "<d><titulo>   sp </titulo><other><deep>1</deep></other></d>"),
    ]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "id int, xml string, extra string")
    got = {r["id"]: r for r in P.xml_records(df).collect()}
    assert got[1]["titulo"] == "T & 1" and got[1]["url_pdf"] == ["/x"] and got[1]["corrupt"] is None
    assert [x["p"] for x in got[1]["texto"]] == [["a", "b < c"], ["d"]]
    assert got[2]["titulo"] is None and got[2]["corrupt"] == "<d><titulo>broken"
    assert got[3]["titulo"] is None and got[3]["corrupt"] is None
    assert got[4]["titulo"] is None and got[4]["corrupt"] is None
    assert got[5]["corrupt"] == "no markup"
    assert got[6]["titulo"].strip() == "sp" and got[6]["extra"] == "c"
