"""Anchors, URL rewrites and notice-field extraction."""

from pyspark.sql import functions as F

from lectern.functions import links as L
from lectern.sources import pages as P


def test_extract_and_filter_links(spark):
    html = (
        '<a href="/n1.php?id=A">Otros formatos</a>'
        '<a href="/n2" title="otros formatos">PDF</a>'
        '<A HREF="/n3">otros formatos</A>'
        "<a href='/n4'>Otros <b>formatos</b></a>"
    )
    df = spark.createDataFrame([(1, "https://h.example:8080/dias/x", html)], "page_id int, url string, html string")
    links = L.extract_links(df, "html", keep=["page_id", "url"])
    rows = links.orderBy("link_no").collect()
    assert [r["href"] for r in rows] == ["/n1.php?id=A", "/n2", "/n3", "/n4"]
    exact = [r["href"] for r in L.filter_link_text(links).collect()]
    assert exact == ["/n1.php?id=A"]  # /n4 has a child element beside its text
    regex = sorted(r["href"] for r in L.filter_link_markup(links).collect())
    assert regex == ["/n2", "/n3"]  # case-sensitive, attributes included
    host = links.select(L.url_host("url").alias("h")).first()["h"]
    assert host == "h.example:8080"


def test_replace_path_keeps_query(spark):
    df = spark.createDataFrame(
        [("https://www.gaz.example/diario/txt.php?id=X#f",), ("https://h.example",)], "u string"
    )
    out = [r["x"] for r in df.select(L.replace_path("u").alias("x")).collect()]
    assert out == [
        "https://www.gaz.example/diario_boe/xml.php?id=X#f",
        "https://h.example/diario_boe/xml.php",
    ]


def test_rewrite_segments_expected_shape(spark):
    df = spark.createDataFrame(
        [("bocyl.example", "html/2024/04/29/html/BOCYL-D-29042024-1.do"), ("h", "/a/b.do?x=1"), ("h", "")],
        "host string, href string",
    )
    out = [r["x"] for r in df.select(L.rewrite_segments("host", "href").alias("x")).collect()]
    assert out == [
        "https://bocyl.example/boletines/2024/04/29/xml/BOCYL-D-29042024-1.xml",
        "https://h/boletines/a/b.xml?x=1",
        "https://h/boletines",
    ]


def test_notice_fields_edge_rows(spark):
    rows = [
        (1, "<r><titulo>T1</titulo><texto>uno</texto><texto>dos</texto><url_pdf>/p.pdf</url_pdf></r>"),
        (2, "<r><texto>sin titulo</texto></r>"),
        (3, "<r><titulo>T3</titulo></r>"),
        (4, "<r><titulo>T4</titulo><texto><p>a</p><p>b [c]</p> &lt;b&gt;x</texto><url_pdf>q.pdf</url_pdf></r>"),
        (5, "<r><b></r>"),
    ]
    df = spark.createDataFrame(rows, "id int, xml string")
    out = {
        r["id"]: (r["titulo"], r["texto"], r["url"])
        for r in P.notice_fields(df, "xml", domain=F.lit("https://d.example/"), keep=["id"]).collect()
    }
    assert out[1] == ("T1", "uno, dos", "https://d.example//p.pdf")
    assert out[2] == (None, "sin titulo", "https://d.example/")
    assert out[3] == ("T3", "", "https://d.example/")
    assert out[4] == ("T4", "ab c x", "https://d.example/q.pdf")
    assert out[5] == (None, "", "https://d.example/")
