"""Registered queries: one Spark plan per operator, each reading the
driver tables under ``sf_dir`` in full, and the DuckDB SQL that computes
the same rows (tables are views named after the Parquet files).

Conventions shared by both sides: integer outputs are BIGINT, distances
and weights are rounded to 6 decimals, every computed column is aliased.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonfn as J
from ..functions import links as L
from ..functions import markup as H
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import backfill as B
from ..operators import chunking as C
from ..operators import embedding as E
from ..operators import knn as K
from ..operators import retrieval as R
from ..operators import sessionlog as SL
from ..operators import sessions as S
from ..operators import summary as M
from ..params import (
    BULLETIN_SEGMENT,
    CHUNK_LENGTH,
    CMD_AGENT,
    CMD_HISTORY,
    CMD_RESET,
    FEEDBACK_FLAGS,
    LSA_SMOOTH,
    NOTICE_XML_PATH,
    STOP_WORDS_ES,
    SUMMARY_SENTENCES,
)
from ..runtime import read_table, scratch_path
from ..sources import files as FS
from ..sources import landing as LD
from ..sources import pages as P
from ..sources import versions as V
from ..streaming import ingest as ST
from . import sqlbits as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# Parameters of the registered queries ------------------------------------

DAY_SOURCES = [
    ("north", "https://north.example/archive?y=$anio&m=$mes&d=$dia"),
    ("south", "https://south.example/$dia-$mes-$anio/contents"),
]
BACKFILL_BUDGET_Q = 300
LINK_TEXT_Q = "de"
LINK_PATTERN_Q = ".*the.*"
EMBED_DIM = 256
K_RAG = 4
SEED = 42
FEWSHOT_EXAMPLES = [
    "Question: Where is the notice of 2 May?\nThought: I need the notice text.\n"
    'Action: ReadNotice["https://gazette-a.example/notice-1.pdf"]',
    "Question: Summarise it.\nThought: I have the text.\n"
    'Action: Finish["A call for applications."]',
]
FEWSHOT_SUFFIX = "Question: {input}\nThought:"
TOOLS = ["ObtenerTexto", "Finish"]
FEWSHOT_HEAD = "\n\n".join(FEWSHOT_EXAMPLES) + "\n\n"


def _bigint(c):
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


# Shared derived inputs -----------------------------------------------------


def _pages(spark, d, heavy: bool = True):
    return read_table(spark, d, "pages", heavy=heavy)


def _page_text(spark, d):
    """(page_id, url, titulo, texto) from the landed pages."""
    pages = _pages(spark, d)
    return pages.select(
        "page_id",
        "url",
        P.first_element_text("html", "title").alias("titulo"),
        X.strip_html("html").alias("texto"),
    )


def _notice_rows(spark, d):
    return C.notice_rows(_page_text(spark, d), "texto", "url", keep=["page_id", "url", "titulo"])


def _links(spark, d):
    pages = _pages(spark, d).select("page_id", "url", "html")
    return L.extract_links(pages, "html", keep=["page_id", "url"])


SQL_PAGE_TEXT = f"""
SELECT page_id, url,
  CASE WHEN regexp_matches(html, {Q.lit(r'(?s)<title\b[^>]*>(.*?)</title\s*>')})
       THEN {Q.drop_markup("regexp_extract(html, " + Q.lit(r'(?s)<title\b[^>]*>(.*?)</title\s*>') + ", 1)")} END AS titulo,
  {Q.strip_html('html')} AS texto
FROM pages"""

SQL_CHUNKS = f"""
WITH t AS ({SQL_PAGE_TEXT}),
s AS (SELECT page_id, url, titulo, texto, unnest(range(0, length(texto), {CHUNK_LENGTH})) AS start FROM t)
SELECT page_id, url, titulo, CAST(start // {CHUNK_LENGTH} AS BIGINT) AS chunk_no,
       substring(texto, start + 1, {CHUNK_LENGTH}) AS chunk
FROM s"""

SQL_LINKS = f"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, {Q.lit(Q.RE_ANCHOR)}, 0) AS l FROM pages),
e AS (SELECT page_id, url, l, unnest(range(0, len(l))) AS link_no FROM a),
f AS (SELECT page_id, url, CAST(link_no AS BIGINT) AS link_no, l[link_no + 1] AS anchor FROM e)
SELECT page_id, url, link_no, anchor,
  regexp_extract(regexp_extract(anchor, {Q.lit(L.RE_ANCHOR_OPEN)}, 0), {Q.lit(L.RE_HREF)}, 1) AS href,
  {Q.drop_markup("regexp_extract(anchor, " + Q.lit(L.RE_ANCHOR_INNER) + ", 1)")} AS anchor_text
FROM f"""


# 2.1 Scans, sources, sinks -------------------------------------------------


@register("scan_pages", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars, "
          "CAST(strlen(html) AS BIGINT) AS html_bytes FROM pages")
def scan_pages(spark, d):
    pages = P.scan_pages(spark, os.path.join(d, "pages.parquet"))
    return pages.select(
        "page_id", "url", _bigint(F.length("html")).alias("html_chars"), _bigint(F.octet_length("html")).alias("html_bytes")
    )


_DAYS_SQL = """SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day
  FROM events"""
_day_url_sql = " UNION ALL ".join(
    f"SELECT {Q.lit(name)} AS source, day, day_offset, "
    f"replace(replace(replace({Q.lit(tpl)}, '$anio', CAST(year(day) AS VARCHAR)), "
    f"'$mes', lpad(CAST(month(day) AS VARCHAR), 2, '0')), '$dia', lpad(CAST(day(day) AS VARCHAR), 2, '0')) AS url FROM o"
    for name, tpl in DAY_SOURCES
)


@register(
    "day_urls",
    f"""WITH d AS ({_DAYS_SQL}), a AS (SELECT max(day) AS m FROM d),
o AS (SELECT day, CAST(date_diff('day', day, m) AS BIGINT) AS day_offset FROM d, a)
{_day_url_sql}""",
)
def day_urls(spark, d):
    span = read_table(spark, d, "events").agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    # every calendar day, those without rows included
    days = span.select("hi", F.explode(B.calendar(F.col("lo"), F.col("hi"))).alias("day"))
    days = days.select("day", _bigint(F.datediff("hi", "day")).alias("day_offset"))
    return B.day_urls(days, DAY_SOURCES).select("source", "day", "day_offset", "url")


@register(
    "xml_notice_fields",
    f"""SELECT page_id,
  CASE WHEN regexp_matches(html, {Q.lit(r'(?s)<title\b[^>]*>(.*?)</title\s*>')})
       THEN {Q.drop_markup("regexp_extract(html, " + Q.lit(r'(?s)<title\b[^>]*>(.*?)</title\s*>') + ", 1)")} END AS titulo,
  {Q.strip_html("array_to_string(regexp_extract_all(html, " + Q.lit(r'(?s)<p\b[^>]*>.*?</p\s*>') + ", 0), ', ')")} AS texto,
  'https://' || {Q.host('url')} || '/' || coalesce({Q.strip_html("array_to_string(regexp_extract_all(html, " + Q.lit(r'(?s)<h1\b[^>]*>.*?</h1\s*>') + ", 0), ', ')")}, '') AS url
FROM pages""",
)
def xml_notice_fields(spark, d):
    pages = _pages(spark, d)
    domain = F.concat(F.lit("https://"), L.url_host("url"), F.lit("/"))
    return P.notice_fields(
        pages.select("page_id", "url", "html", domain.alias("domain")),
        "html",
        domain="domain",
        title_tag="title",
        text_tag="p",
        pdf_tag="h1",
        keep=["page_id"],
    )


@register(
    "csv_roundtrip",
    "SELECT doc_id, text, lang, source, n_chars FROM documents",
)
def csv_roundtrip(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_path(spark, "csv_roundtrip")
    FS.write_pipe_csv(docs, path, mode="errorifexists")
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )
    return FS.read_pipe_csv(spark, path, schema)


@register(
    "daily_csv",
    f"""WITH c AS ({SQL_CHUNKS}),
r AS (SELECT page_id % 2 AS source, url, nullif(titulo, '') AS titulo, {Q.decorate('chunk', 'url')} AS resumen FROM c)
SELECT url, titulo, CAST(NULL AS VARCHAR) AS texto, resumen FROM r
UNION ALL SELECT url, titulo, NULL, resumen FROM r WHERE source = 0""",
)
def daily_csv(spark, d):
    """Files of two sources over several days, written once and read in one
    go; a folder named twice counts twice, one that is missing not at all."""
    rows = _notice_rows(spark, d)
    source = F.when(F.pmod("page_id", F.lit(2)) == 0, F.lit("north")).otherwise(F.lit("south"))
    day = F.date_add(F.lit("2024-02-27").cast("date"), F.pmod("page_id", F.lit(5)).cast("int"))
    path = scratch_path(spark, "daily_csv")
    rows = rows.select("url", "titulo", "texto", "resumen", source.alias("source"), day.alias("day"))
    FS.write_pipe_csv(rows, path, partition_by=["source", "day"], mode="errorifexists")
    folders = [f"{path}/source={name}" for name in ("north", "south", "east", "north")]
    return FS.read_pipe_csv(spark, folders).select("url", "titulo", "texto", "resumen")


@register(
    "json_encode",
    """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' AS json
FROM documents WHERE lang IS NOT NULL""",
)
def json_encode(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "n_chars").where(F.col("lang").isNotNull())
    return FS.to_json_text(docs, ["doc_id", "lang", "n_chars"]).select("doc_id", "json")


@register(
    "json_nested",
    """WITH e AS (SELECT event_id, value, unnest([0, 1, 2, 3]) AS k, ts FROM events),
f AS (SELECT event_id, k, value + k AS temp, ts + to_hours(CAST(k * 3 AS INTEGER)) AS moment FROM e)
SELECT o.event_id, CASE WHEN n.moment IS NOT NULL THEN strftime(n.moment, '%Y-%m-%d %H:%M') END AS moment, n.temp,
  'sky ' || n.k AS sky
FROM events o LEFT JOIN (SELECT event_id, min({'moment': moment, 'temp': temp, 'k': k}) AS n FROM f WHERE hour(moment) BETWEEN 12 AND 14
  GROUP BY event_id) USING (event_id)""",
)
def json_nested(spark, d):
    """Nested arrays in a JSON body: the first entry at noon of a forecast of
    four entries, three hours apart."""
    ev = read_table(spark, d, "events").select("event_id", "ts", "value")

    def entry(k):
        at = F.date_format(F.col("ts") + F.expr(f"INTERVAL {3 * k} HOUR"), "yyyy-MM-dd HH:mm")
        sky = F.array(F.struct(F.lit(f"sky {k}").alias("description")))
        return F.struct(at.alias("at"), F.struct((F.col("value") + k).alias("temp")).alias("main"), sky.alias("weather"))

    body = F.to_json(F.struct(F.array(*[entry(k) for k in range(4)]).alias("list")))
    schema = "list array<struct<at string, main struct<temp double>, weather array<struct<description string>>>>"
    parsed = ev.select("event_id", J.parse(body, schema).alias("body"))
    noon = J.first_where("body.list", lambda x: F.substring(x["at"], 12, 2).isin("12", "13", "14"))
    found = parsed.select("event_id", noon.alias("n"))
    return found.select("event_id", F.col("n.at").alias("moment"), "n.main.temp", F.try_element_at("n.weather", F.lit(1))["description"].alias("sky"))


@register(
    "metadata_json",
    f"""WITH t AS ({SQL_PAGE_TEXT})
SELECT page_id, url, titulo AS title, texto AS text_resume FROM t""",
)
def metadata_json(spark, d):
    recs = _page_text(spark, d).select(
        "page_id", "url", F.col("titulo").alias("title"), F.col("texto").alias("text_resume")
    )
    path = scratch_path(spark, "metadata_json")
    FS.write_json_records(recs, path, mode="errorifexists")
    schema = T.StructType([T.StructField("page_id", T.LongType())] + FS.METADATA_SCHEMA.fields)
    return FS.read_json_records(spark, path, schema)


@register(
    "vector_roundtrip",
    """SELECT vec_id, label::BIGINT AS label, CAST(len(embedding) AS BIGINT) AS dim,
  round(list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, b: a + b), 6) AS v_sum,
  round(embedding[1]::DOUBLE, 6) AS v_first
FROM embeddings""",
)
def vector_roundtrip(spark, d):
    emb = read_table(spark, d, "embeddings")
    root = scratch_path(spark, "vectors")
    path = FS.save_vectors(emb, root, "1")
    back = FS.load_vectors(spark, path)
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    return back.select(
        "vec_id",
        _bigint("label").alias("label"),
        _bigint(F.size("embedding")).alias("dim"),
        F.round(F.aggregate(as_double, F.lit(0.0), lambda a, x: a + x), 6).alias("v_sum"),
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("v_first"),
    )


@register(
    "to_documents",
    f"""WITH c AS ({SQL_CHUNKS})
SELECT page_id, chunk_no, {Q.decorate('chunk', 'url')} AS page_content, url AS meta_url, CAST(1 AS BIGINT) AS n_meta FROM c""",
)
def to_documents(spark, d):
    rows = _notice_rows(spark, d)
    docs = FS.to_documents(rows, "resumen", ["url"], keep=["page_id", _bigint("chunk_no").alias("chunk_no")])
    return docs.select(
        "page_id", "chunk_no", "page_content", F.col("metadata")["url"].alias("meta_url"),
        _bigint(F.size("metadata")).alias("n_meta"),
    )


@register(
    "page_concat",
    """SELECT conv_id AS doc_id, count(*)::BIGINT AS n_pages,
  string_agg(CASE WHEN role <> 'system' THEN coalesce(text, '') || chr(10) END, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
)
def page_concat(spark, d):
    conv = read_table(spark, d, "conversations")
    paged = conv.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page_no"),
        F.when(F.col("role") == "system", F.lit(404)).otherwise(F.lit(200)).alias("status"),
        "text",
    )
    out = R.concat_pages(paged, bucket_width=4)
    return out.select("doc_id", _bigint("n_pages").alias("n_pages"), "text")


@register(
    "json_extract",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_extract(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "props")
    parsed = F.from_json("props", "k BIGINT")
    return ev.select("event_id", parsed["k"].alias("k"))


@register(
    "json_array",
    f"""WITH t AS ({SQL_PAGE_TEXT})
SELECT page_id, url, titulo AS title, texto AS text_resume FROM t""",
)
def json_array(spark, d):
    """Metadata written as files of one JSON array each, and read back."""
    recs = _page_text(spark, d).select(
        "page_id", "url", F.col("titulo").alias("title"), F.col("texto").alias("text_resume")
    )
    path = scratch_path(spark, "json_array")
    FS.write_json_array(recs, path, "page_id")
    schema = T.StructType([T.StructField("page_id", T.LongType())] + FS.METADATA_SCHEMA.fields)
    return FS.read_json_records(spark, path, schema, array_file=True)


@register(
    "html_tokens",
    f"""WITH r AS (SELECT page_id, {Q.markup_tokens('html')} AS l FROM pages),
e AS (SELECT page_id, l, unnest(range(0, len(l))) AS i FROM r),
t AS (SELECT page_id, CAST(i AS BIGINT) AS token_no, l[i + 1] AS t, starts_with(l[i + 1], chr(1)) AS raw,
  lower(regexp_extract(CASE WHEN starts_with(l[i + 1], chr(1)) THEN l[i] ELSE l[i + 1] END, '^</?([A-Za-z][^ />]*)', 1)) AS name FROM e)
SELECT page_id, token_no, name, CASE WHEN starts_with(t, '<!--') THEN 'comment' WHEN t[1:2] IN ('<!', '<?') THEN 'declaration'
  WHEN raw THEN 'raw' WHEN starts_with(t, '</') AND name <> '' THEN 'end' WHEN name <> '' THEN 'start' ELSE 'text' END AS kind,
  CASE WHEN starts_with(t, '<!--') THEN t[5:-4] WHEN t[1:2] IN ('<!', '<?') THEN t[3:-2] WHEN raw THEN t[2:]
    WHEN name <> '' THEN '' ELSE {Q.decode_entities('t')} END AS text
FROM t""",
)
def html_tokens(spark, d):
    """The pages as token rows."""
    return H.html_tokens(_pages(spark, d).select("page_id", "html")).select("page_id", "token_no", "kind", "name", "text")


@register(
    "element_strings",
    f"""WITH l AS ({SQL_LINKS})
SELECT page_id, link_no AS element_no, CASE WHEN {Q.one_string("regexp_extract(anchor, " + Q.lit(L.RE_ANCHOR_INNER) + ", 1)")}
  THEN nullif(anchor_text, '') END AS string FROM l""",
)
def element_strings(spark, d):
    """The only string of every anchor, read from the tokens."""
    pages = _pages(spark, d).select("page_id", "html")
    return H.element_strings(pages, "a").select("page_id", "element_no", "string")


def _xml(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@register(
    "xml_records",
    f"""WITH t AS ({SQL_PAGE_TEXT})
SELECT page_id, CASE WHEN page_id % 7 <> 3 THEN titulo END AS titulo,
  CASE WHEN page_id % 7 <> 3 THEN substring(texto, 1, 40) || '|' || substring(texto, 41, 40) || '|' || url END AS paragraphs,
  CASE WHEN page_id % 7 <> 3 THEN '/pdf/' || page_id END AS url_pdf, page_id % 7 = 3 AS corrupt FROM t""",
)
def xml_records(spark, d):
    """Notice bodies with nested paragraphs and CDATA, some broken off."""
    t = _page_text(spark, d)
    paragraph = lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))
    body = F.concat(
        F.lit('<notice lang="es"><titulo>'), _xml(F.col("titulo")), F.lit("</titulo><!-- c --><texto>"),
        paragraph(_xml(F.substring("texto", 1, 40))),
        paragraph(F.concat(F.lit("<![CDATA["), F.replace(F.substring("texto", 41, 40), F.lit("]]>"), F.lit("")), F.lit("]]>"))),
        F.lit("</texto><texto>"), paragraph(_xml(F.col("url"))), F.lit("</texto><url_pdf>/pdf/"), F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 7 == 3, F.lit("</pdf>")).otherwise(F.lit("</url_pdf></notice>")),
    )
    rows = P.xml_records(t.select("page_id", body.alias("xml")))
    paragraphs = F.flatten(F.transform("texto", lambda x: x["p"]))
    return rows.select(
        "page_id", "titulo", F.array_join(paragraphs, "|").alias("paragraphs"), F.element_at("url_pdf", 1).alias("url_pdf"),
        F.col("corrupt").isNotNull().alias("corrupt"),
    )


@register("landing_files", "SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM pages")
def landing_files(spark, d):
    """Pages landed as JSON lines and read through the data source: in one
    batch by byte ranges, and as a stream that is stopped and goes on after
    more files have landed."""
    pages = read_table(spark, d, "pages").select("page_id", "url", "html")
    folder, sink, ckpt = (scratch_path(spark, n) for n in ("landing", "landing_stream", "landing_ckpt"))
    LD.register(spark)
    for rest in (0, 1):  # the stream ends, more lands, and it starts anew
        pages.where(F.col("page_id") % 2 == rest).write.mode("append").json(folder)
        stream = spark.readStream.format("landing").option("path", folder).option("rangeBytes", 1 << 20).load()
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
        query.trigger(availableNow=True).start().awaitTermination()
    batch = spark.read.format("landing").option("path", folder).option("rangeBytes", 1 << 20).load()
    return batch.unionByName(spark.read.parquet(sink))


@register(
    "vector_versions",
    """SELECT 1::BIGINT AS version, vec_id, label::BIGINT AS label FROM embeddings WHERE vec_id % 2 = 0
UNION ALL SELECT 2, vec_id, label + 1 FROM embeddings""",
)
def vector_versions(spark, d):
    """Two published versions and a third that was never finished: readers
    find the second, and still the first by its number."""
    emb = read_table(spark, d, "embeddings").select("vec_id", "embedding", _bigint("label").alias("label"))
    root = scratch_path(spark, "versions")
    first = V.save(emb.where(F.col("vec_id") % 2 == 0), root)
    V.save(emb.withColumn("label", F.col("label") + 1), root, expected=first)
    emb.limit(1).write.parquet(V.new_data_path(root))  # no manifest follows
    newest = V.load(spark, root).select(F.lit(V.current(spark, root)).cast("bigint").alias("version"), "vec_id", "label")
    old = V.load(spark, root, first).select(F.lit(first).cast("bigint").alias("version"), "vec_id", "label")
    return old.unionByName(newest)


@register(
    "bucketed_session",
    "SELECT conv_id AS session_id, turn AS seq, text AS prompt FROM conversations WHERE conv_id = 3",
)
def bucketed_session(spark, d):
    """One session read from its bucket of a log written by two appends and
    a compaction between them."""
    conv = read_table(spark, d, "conversations")
    rows = conv.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("prompt"))
    root = scratch_path(spark, "bucketed_log")
    SL.append(rows.where("seq < 2"), root)
    SL.append(rows.where("seq BETWEEN 2 AND 3"), root)
    SL.compact(spark, root)
    SL.append(rows.where("seq > 3"), root)
    return SL.one_session(spark, root, 3)


@register(
    "stream_index",
    f"""WITH c AS (SELECT DISTINCT {Q.decorate('chunk', 'url')} AS page_content FROM ({SQL_CHUNKS})),
t AS (SELECT page_content, unnest(list_distinct(list_transform({Q.tokens('page_content')}, lambda x: {Q.bucket('x', EMBED_DIM)}))) AS b FROM c)
SELECT sha256(page_content) AS digest, page_content, count(*)::BIGINT AS buckets FROM t GROUP BY page_content""",
)
def stream_index(spark, d):
    """The index of pages that land twice, the second half of them again on
    a second day, equals that of their distinct chunks."""
    pages = _pages(spark, d, heavy=False).select("page_id", "url", "html")
    landing = scratch_path(spark, "index_landing")
    pages.where(F.col("page_id") % 4 < 3).coalesce(1).write.mode("append").parquet(landing)
    pages.where(F.col("page_id") % 4 > 1).coalesce(1).write.mode("append").parquet(landing)
    index, ckpt = scratch_path(spark, "stream_index"), scratch_path(spark, "stream_index_ckpt")
    ST.stream_index(spark, landing, pages.schema, index, ckpt, _embed, max_files=1)
    out = spark.read.parquet(f"{index}/batch_id=*")
    return out.select("digest", "page_content", _bigint(F.size(F.filter("embedding", lambda x: x != 0))).alias("buckets"))


# 2.2 Projections, filters, predicates ------------------------------------


@register(
    "strip_html",
    f"SELECT page_id, {Q.strip_html('html')} AS text FROM pages",
)
def strip_html(spark, d):
    return _pages(spark, d).select("page_id", X.strip_html("html").alias("text"))


@register(
    "link_filter_exact",
    f"""WITH l AS ({SQL_LINKS})
SELECT page_id, link_no, href, 'https://' || {Q.host('url')} || href AS abs_url,
  {Q.replace_path("'https://' || " + Q.host('url') + " || href", NOTICE_XML_PATH)} AS xml_url
FROM l WHERE anchor_text = {Q.lit(LINK_TEXT_Q)} AND {Q.one_string("regexp_extract(anchor, " + Q.lit(L.RE_ANCHOR_INNER) + ", 1)")}""",
)
def link_filter_exact(spark, d):
    links = L.filter_link_text(_links(spark, d), LINK_TEXT_Q)
    abs_url = L.absolute_url(L.url_host("url"), F.col("href"))
    return links.select(
        "page_id", _bigint("link_no").alias("link_no"), "href", abs_url.alias("abs_url"),
        L.replace_path(abs_url).alias("xml_url"),
    )


@register(
    "link_filter_regex",
    f"""WITH l AS ({SQL_LINKS})
SELECT page_id, link_no, anchor, {Q.rewrite_segments(Q.host('url'), 'href', BULLETIN_SEGMENT)} AS bulletin_url
FROM l WHERE regexp_matches(anchor, {Q.lit(LINK_PATTERN_Q)})""",
)
def link_filter_regex(spark, d):
    links = L.filter_link_markup(_links(spark, d), LINK_PATTERN_Q)
    return links.select(
        "page_id", _bigint("link_no").alias("link_no"), "anchor",
        L.rewrite_segments(L.url_host("url"), F.col("href")).alias("bulletin_url"),
    )


@register(
    "route_messages",
    None,  # filled below (shares the message derivation)
)
def route_messages(spark, d):
    msgs = _messages(spark, d)
    routed = S.route_messages(msgs, "text")
    return routed.select("conv_id", "turn", "route", "clean_text")


def _messages(spark, d):
    """Chat messages derived from the conversations: commands are added to
    some turns so that every route occurs, and the text is padded with
    white space the trimming must remove."""
    conv = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    return _derive_messages(conv)


SQL_MESSAGES = f"""SELECT conv_id, turn, chr(160) || ' ' || (CASE turn % 4
    WHEN 1 THEN {Q.lit(CMD_RESET.upper() + ' ')} || text
    WHEN 2 THEN text || {Q.lit(' ' + CMD_HISTORY.upper())}
    WHEN 3 THEN {Q.lit(CMD_AGENT.capitalize() + ' ')} || text
    ELSE text END) || chr(10) || chr(9) AS text FROM conversations"""

SQL_ROUTED = f"""WITH m AS ({SQL_MESSAGES}), c AS (SELECT conv_id, turn, {Q.strip_ws('text')} AS clean_text FROM m)
SELECT conv_id, turn, CASE
  WHEN contains(lower(clean_text), {Q.lit(CMD_RESET)}) THEN 'reset'
  WHEN contains(lower(clean_text), {Q.lit(CMD_HISTORY)}) THEN 'history'
  WHEN contains(lower(clean_text), {Q.lit(CMD_AGENT)}) THEN 'agent'
  ELSE 'retrieve' END AS route, clean_text FROM c"""
ORACLES["route_messages"] = SQL_ROUTED


@register(
    "strip_text",
    f"SELECT conv_id, turn, {Q.strip_ws('text')} AS clean_text FROM ({SQL_MESSAGES})",
)
def strip_text(spark, d):
    return _messages(spark, d).select("conv_id", "turn", X.strip_ws("text").alias("clean_text"))


@register(
    "array_filter_first",
    """SELECT day, f.ts AS ts, f.event_id AS event_id, f.value AS value FROM (SELECT CAST(ts AS DATE) AS day,
  min(CASE WHEN hour(ts) = 12 THEN {'ts': ts, 'event_id': event_id, 'value': value} END) AS f
FROM events GROUP BY 1)""",
)
def array_filter_first(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "ts", "value")
    noon = F.when(F.hour("ts") == 12, F.struct("ts", "event_id", "value"))
    first = ev.groupBy(F.to_date("ts").alias("day")).agg(F.min(noon).alias("f"))
    return first.select("day", F.col("f.ts").alias("ts"), F.col("f.event_id").alias("event_id"), F.col("f.value").alias("value"))


# 2.3 Joins / 2.6 top-k -------------------------------------------------------


SQL_LABEL_MEANS = """m AS (SELECT label, i, round(avg(v), 6) AS v FROM (
    SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL),
q AS (SELECT label AS qid, list(v ORDER BY i) AS qvec FROM m GROUP BY label)"""


def _significant(x: str) -> str:
    """``x`` to nine significant digits."""
    return f"CASE WHEN {x} > 0 THEN round({x}, CAST(8 - floor(log10({x})) AS INTEGER)) ELSE 0 END"


def _knn_sql(k: int, with_label: bool = False) -> str:
    label = ", c.label::BIGINT AS label" if with_label else ""
    label_out = ", label" if with_label else ""
    return f"""WITH {SQL_LABEL_MEANS}, p AS (
  SELECT q.qid::BIGINT AS qid, c.vec_id{label},
    list_sum(list_transform(range(len(q.qvec)), lambda i:
      (q.qvec[i + 1] - c.embedding[i + 1]::DOUBLE) * (q.qvec[i + 1] - c.embedding[i + 1]::DOUBLE))) AS d
  FROM q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_significant('d')}, vec_id) AS rank FROM p)
SELECT qid, CAST(rank AS BIGINT) AS rank, vec_id, round(d, 6) AS dist{label_out} FROM r WHERE rank <= {k}"""


def _label_means(emb):
    """The mean vector of each label, from every row: a handful of questions."""
    parts = emb.select(_bigint("label").alias("qid"), F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("qid", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    vectors = means.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("parts"))
    return vectors.select("qid", F.transform("parts", lambda x: x["v"]).alias("qvec"))


def _knn_out(hits):
    return hits.select("qid", _bigint("rank").alias("rank"), "vec_id", F.round("dist", 6).alias("dist"))


_KNN_COLUMNS = {"id_col": "vec_id", "vec_col": "embedding", "q_id": "qid", "q_vec": "qvec"}


@register("knn_l2", _knn_sql(4))
def knn_l2(spark, d):
    emb = read_table(spark, d, "embeddings", heavy=True)
    return _knn_out(K.knn(emb, _label_means(emb), k=4, **_KNN_COLUMNS))


@register("knn_top1", _knn_sql(1))
def knn_top1(spark, d):
    emb = read_table(spark, d, "embeddings", heavy=True)
    return _knn_out(K.nearest(emb, _label_means(emb), **_KNN_COLUMNS))


@register("knn_with_metadata", _knn_sql(4, with_label=True))
def knn_with_metadata(spark, d):
    emb = read_table(spark, d, "embeddings", heavy=True)
    hits = _knn_out(K.knn(emb, _label_means(emb), k=4, **_KNN_COLUMNS))
    joined = K.attach_metadata(hits, read_table(spark, d, "embeddings"), "vec_id", ["label"])
    return joined.select("qid", "rank", "vec_id", "dist", _bigint("label").alias("label"))


#: Vectors of one block of questions of ``knn_rows``.
KNN_BLOCK_BYTES = 4 << 20


@register(
    "knn_rows",
    f"""WITH p AS (SELECT q.vec_id AS qid, c.vec_id,
    list_sum(list_transform(range(len(q.embedding)), lambda i:
      (q.embedding[i + 1]::DOUBLE - c.embedding[i + 1]::DOUBLE) * (q.embedding[i + 1]::DOUBLE - c.embedding[i + 1]::DOUBLE))) AS d
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_significant('d')}, vec_id) AS rank FROM p)
SELECT qid, CAST(rank AS BIGINT) AS rank, vec_id, round(d, 6) AS dist FROM r WHERE rank <= 4""",
)
def knn_rows(spark, d):
    """Every fiftieth row against all rows, questions in blocks."""
    emb = read_table(spark, d, "embeddings", heavy=True)
    asked = emb.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return _knn_out(K.knn(emb, asked, k=4, max_bytes=KNN_BLOCK_BYTES, **_KNN_COLUMNS))


@register(
    "vector_dims",
    "SELECT count(*)::BIGINT AS n_vectors, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim FROM embeddings",
)
def vector_dims(spark, d):
    out = K.vector_dims(read_table(spark, d, "embeddings"), "embedding")
    return out.select(*[_bigint(c).alias(c) for c in out.columns])


@register(
    "vector_head",
    "SELECT vec_id, " + ", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS e{i}" for i in range(1, 6)) + " FROM embeddings",
)
def vector_head(spark, d):
    emb = read_table(spark, d, "embeddings")
    head = F.slice("embedding", 1, 5)
    return emb.select("vec_id", *[F.round(F.element_at(head, i).cast("double"), 6).alias(f"e{i}") for i in range(1, 6)])


# Retrieval over page chunks ------------------------------------------------


def _embed(df, text_col, out_col):
    """The index's embedding, as a caller would supply one."""
    return E.embed_with(df, text_col, lambda texts: E.embed_texts(texts, EMBED_DIM), out_col, T.DoubleType())


def _index(spark, d):
    """Notices -> chunks -> splits -> vectors, saved and loaded again."""
    rows = _notice_rows(spark, d)
    splits = C.recursive_split(rows, "resumen", keep=["page_id", "chunk_no"], out_col="page_content")
    chunk_id = F.concat_ws(":", *[F.col(c).cast("string") for c in ("page_id", "chunk_no", "split_no")])
    vectors = _embed(splits.select(chunk_id.alias("chunk_id"), "page_content"), "page_content", "embedding")
    return FS.load_vectors(spark, FS.save_vectors(vectors, scratch_path(spark, "index"), "1"))


def _retrieved(spark, d):
    return R.retrieve(_index(spark, d), _questions(spark, d), lambda q: _embed(q, "question", "qvec"), k=K_RAG)


def _questions(spark, d):
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _rag_context(spark, d):
    return R.stuff_context(_retrieved(spark, d))


def _sparse_sql(src: str, id_expr: str, text_expr: str, name: str) -> str:
    return f"""{name}_t AS (SELECT {id_expr} AS id, unnest({Q.tokens(text_expr)}) AS tok FROM {src}),
{name}_c AS (SELECT id, {Q.bucket('tok', EMBED_DIM)} AS bucket, count(*) AS cnt FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(cnt * cnt)::DOUBLE) AS norm FROM {name}_c GROUP BY id),
{name}_w AS (SELECT c.id, c.bucket, c.cnt / n.norm AS w FROM {name}_c c JOIN {name}_n n USING (id)),
{name}_q AS (SELECT id, sum(w * w) AS ss FROM {name}_w GROUP BY id)"""


SQL_RAG_HITS = f"""WITH ch AS (SELECT page_id || ':' || chunk_no || ':0' AS chunk_id, {Q.strip_ws(Q.decorate('chunk', 'url'))} AS page_content
  FROM ({SQL_CHUNKS})),
qs AS (SELECT item_id AS qid, text AS question FROM benchmark),
{_sparse_sql('ch', 'chunk_id', 'page_content', 'cv')},
{_sparse_sql('qs', 'qid', 'question', 'qv')},
dots AS (SELECT q.id AS qid, c.id AS chunk_id, sum(q.w * c.w) AS dot FROM qv_w q JOIN cv_w c USING (bucket) GROUP BY ALL),
pairs AS (
  SELECT qs.qid, ch.chunk_id, ch.page_content,
    greatest(coalesce(qq.ss, 0) + coalesce(cc.ss, 0) - 2 * coalesce(dots.dot, 0), 0.0) AS d
  FROM qs CROSS JOIN ch
  LEFT JOIN qv_q qq ON qq.id = qs.qid
  LEFT JOIN cv_q cc ON cc.id = ch.chunk_id
  LEFT JOIN dots ON dots.qid = qs.qid AND dots.chunk_id = ch.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_significant('d')}, chunk_id) AS rank FROM pairs)
SELECT qid, CAST(rank AS BIGINT) AS rank, chunk_id, round(d, 6) AS dist, page_content FROM r WHERE rank <= {K_RAG}"""

SQL_RAG_CONTEXT = f"""WITH hits AS ({SQL_RAG_HITS})
SELECT qid, count(*)::BIGINT AS n_hits, string_agg(page_content, chr(10) || chr(10) ORDER BY rank) AS context
FROM hits GROUP BY qid"""


@register("index_search", SQL_RAG_HITS)
def index_search(spark, d):
    hits = _retrieved(spark, d)
    return hits.select("qid", _bigint("rank").alias("rank"), "chunk_id", F.round("dist", 6).alias("dist"), "page_content")


@register("rag_context", SQL_RAG_CONTEXT)
def rag_context(spark, d):
    ctx = _rag_context(spark, d)
    return ctx.select("qid", _bigint("n_hits").alias("n_hits"), "context")


def _template_sql(template: str, slots: dict) -> str:
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(" + "|".join(slots) + r")\}", template):
        if m.start() > pos:
            parts.append(Q.lit(template[pos : m.start()]))
        parts.append(f"coalesce(CAST({slots[m.group(1)]} AS VARCHAR), '')")
        pos = m.end()
    if pos < len(template):
        parts.append(Q.lit(template[pos:]))
    return " || ".join(parts)


@register(
    "rag_prompt",
    f"""WITH ctx AS ({SQL_RAG_CONTEXT})
SELECT b.item_id AS qid, {_template_sql(R.DEFAULT_TEMPLATE, {'context': 'ctx.context', 'input': 'b.text'})} AS prompt
FROM benchmark b LEFT JOIN ctx ON ctx.qid = b.item_id""",
)
def rag_prompt(spark, d):
    prompts = R.build_prompts(_questions(spark, d), _rag_context(spark, d))
    return prompts.select("qid", "prompt")


SQL_HISTORY = """SELECT conv_id, count(*)::BIGINT AS n_prompts, string_agg(text, chr(10) ORDER BY turn) AS history
FROM conversations GROUP BY conv_id"""


@register(
    "rag_prompt_history",
    f"""WITH ctx AS ({SQL_RAG_CONTEXT}), h AS ({SQL_HISTORY})
SELECT b.item_id AS qid, {_template_sql(R.HISTORY_TEMPLATE, {'history': 'h.history', 'context': 'ctx.context', 'input': 'b.text'})} AS prompt
FROM benchmark b LEFT JOIN ctx ON ctx.qid = b.item_id LEFT JOIN h ON h.conv_id = b.item_id // 2""",
)
def rag_prompt_history(spark, d):
    """Prompts that carry the memory of the session the question is asked in
    (two questions a session)."""
    questions = _questions(spark, d).withColumn("conv_id", F.floor(F.col("qid") / 2))
    log = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    history = S.session_history(log, "conv_id", "turn", "text", bucket_width=4)
    prompts = R.build_prompts(
        questions, _rag_context(spark, d), template=R.HISTORY_TEMPLATE, history=history, session_col="conv_id"
    )
    return prompts.select("qid", "prompt")


def _answer(prompts):
    """A stand-in for the caller's model that uses the whole prompt."""
    return [f"{len(p)} characters: {p}" for p in prompts]


@register(
    "chat_log",
    """WITH q AS (SELECT item_id // 2 AS session_id, item_id * 2 AS seq, text AS prompt FROM benchmark)
SELECT session_id, seq, prompt, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn_no FROM (
  SELECT * FROM q UNION ALL SELECT session_id, seq + 1, length(prompt) || ' characters: ' || prompt FROM q)""",
)
def chat_log(spark, d):
    """Questions and their answers appended to the session log, read back
    with their turn numbers."""
    asked = _questions(spark, d).select(
        F.floor(F.col("qid") / 2).alias("session_id"), (F.col("qid") * 2).alias("seq"), F.col("question").alias("prompt")
    )
    answered = R.generate(asked, "prompt", _answer, "answer")
    path = scratch_path(spark, "chat_log")
    S.append_log(asked, path)
    S.append_log(answered.select("session_id", (F.col("seq") + 1).alias("seq"), F.col("answer").alias("prompt")), path)
    numbered = S.number_turns(S.read_log(spark, path), "session_id", "seq", "seq")
    return numbered.select("session_id", "seq", "prompt", _bigint("turn_no").alias("turn_no"))


@register("one_session", "SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3")
def one_session(spark, d):
    """One session's messages; the predicate reaches the scan."""
    log = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    return S.session_messages(log, 3, "conv_id")


@register(
    "fewshot_prompt",
    f"""SELECT item_id, {Q.lit(FEWSHOT_HEAD)} || {_template_sql(FEWSHOT_SUFFIX, {'input': 'text'})} AS prompt FROM benchmark""",
)
def fewshot_prompt(spark, d):
    qs = read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return R.fewshot_prompt(qs, FEWSHOT_EXAMPLES, FEWSHOT_SUFFIX).select("item_id", "prompt")


# 2.4 Aggregations / 2.5 windows --------------------------------------------


@register(
    "chunk_counts",
    f"""WITH c AS ({SQL_CHUNKS})
SELECT {Q.host('url')} AS host, count(*)::BIGINT AS n_chunks, count(DISTINCT page_id)::BIGINT AS n_pages FROM c GROUP BY 1""",
)
def chunk_counts(spark, d):
    rows = _notice_rows(spark, d)
    return rows.groupBy(L.url_host("url").alias("host")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("page_id").alias("n_pages")
    )


@register(
    "backfill_days",
    f"""WITH c AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n_rows FROM events GROUP BY 1, 2),
a AS (SELECT max(CAST(ts AS DATE)) AS m FROM events),
o AS (SELECT source, day, CAST(date_diff('day', day, m) AS BIGINT) AS day_offset, n_rows::BIGINT AS n_rows FROM c, a),
w AS (SELECT *, CAST(coalesce(sum(n_rows) OVER (PARTITION BY source ORDER BY day_offset
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rows_before FROM o)
SELECT source, day, day_offset, n_rows, rows_before FROM w WHERE rows_before <= {BACKFILL_BUDGET_Q}""",
)
def backfill_days(spark, d):
    ev = read_table(spark, d, "events").select(F.col("event_type").alias("source"), "ts")
    with_off = B.day_offsets(ev, "ts")
    counts = with_off.groupBy("source", "day", "day_offset").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = B.backfill_days(counts, budget=BACKFILL_BUDGET_Q)
    return kept.select("source", "day", _bigint("day_offset").alias("day_offset"), "n_rows", "rows_before")


@register(
    "backfill_rows",
    f"""WITH c AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n_rows FROM events GROUP BY 1, 2),
a AS (SELECT max(CAST(ts AS DATE)) AS m FROM events),
o AS (SELECT source, day, date_diff('day', day, m) AS day_offset, n_rows FROM c, a),
w AS (SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY source ORDER BY day_offset
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before FROM o),
k AS (SELECT source, day FROM w WHERE rows_before <= {BACKFILL_BUDGET_Q})
SELECT e.event_id, e.event_type AS source, CAST(e.ts AS DATE) AS day, e.value FROM events e
WHERE EXISTS (SELECT 1 FROM k WHERE k.source = e.event_type AND k.day = CAST(e.ts AS DATE))""",
)
def backfill_rows(spark, d):
    ev = read_table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), "ts", "value")
    with_off = B.day_offsets(ev, "ts")
    counts = with_off.groupBy("source", "day", "day_offset").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = B.backfill_days(counts, budget=BACKFILL_BUDGET_Q)
    rows = B.rows_of_kept_days(with_off, kept, ["source", "day"])
    return rows.select("event_id", "source", "day", "value")


@register(
    "session_history",
    SQL_HISTORY,
)
def session_history(spark, d):
    log = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    hist = S.session_history(log, "conv_id", "turn", "text", bucket_width=4)
    return hist.select("conv_id", _bigint("n_prompts").alias("n_prompts"), "history")


@register(
    "seeded_pick",
    f"SELECT lang, arg_min(doc_id, md5(doc_id::VARCHAR || ':{SEED}')) AS doc_id, min(md5(doc_id::VARCHAR || ':{SEED}')) AS pick_key "
    "FROM documents GROUP BY lang",
)
def seeded_pick(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{SEED}")))
    return docs.groupBy("lang").agg(F.min_by("doc_id", key).alias("doc_id"), F.min(key).alias("pick_key"))


@register(
    "union_sources",
    """SELECT doc_id, lang, source, n_chars FROM documents WHERE coalesce(lang IN ('en', 'fr'), false)
UNION ALL BY NAME
SELECT doc_id, lang, n_chars FROM documents WHERE NOT coalesce(lang IN ('en', 'fr'), false)""",
)
def union_sources(spark, d):
    docs = read_table(spark, d, "documents")
    in_set = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))
    a = docs.filter(in_set).select("doc_id", "lang", "source", "n_chars")
    b = docs.filter(~in_set).select("doc_id", "lang", "n_chars")
    return FS.union_all([a, b]).select("doc_id", "lang", "source", "n_chars")


# 2.8 Text, date, URL, vector functions ---------------------------------------


@register(
    "chunk_text",
    f"SELECT page_id, chunk_no, chunk, CAST(length(chunk) AS BIGINT) AS chunk_chars FROM ({SQL_CHUNKS})",
)
def chunk_text(spark, d):
    t = _page_text(spark, d)
    ch = C.chunk_fixed(t, "texto", keep=["page_id"])
    return ch.select("page_id", _bigint("chunk_no").alias("chunk_no"), "chunk", _bigint(F.length("chunk")).alias("chunk_chars"))


@register(
    "resumen_rows",
    f"SELECT page_id, chunk_no, url, titulo, '' AS texto, {Q.decorate('chunk', 'url')} AS resumen FROM ({SQL_CHUNKS})",
)
def resumen_rows(spark, d):
    rows = _notice_rows(spark, d)
    return rows.select("page_id", _bigint("chunk_no").alias("chunk_no"), "url", "titulo", "texto", "resumen")


@register(
    "format_links",
    f"SELECT page_id, chunk_no, {Q.format_links(Q.decorate('chunk', 'url'))} AS html FROM ({SQL_CHUNKS})",
)
def format_links(spark, d):
    rows = _notice_rows(spark, d)
    return rows.select("page_id", _bigint("chunk_no").alias("chunk_no"), X.format_links("resumen").alias("html"))


@register(
    "url_host",
    f"SELECT page_id, url, {Q.host('url')} AS host FROM pages",
)
def url_host(spark, d):
    return _pages(spark, d, heavy=False).select("page_id", "url", L.url_host("url").alias("host"))


@register(
    "extract_links",
    f"SELECT page_id, link_no, href, anchor_text FROM ({SQL_LINKS})",
)
def extract_links(spark, d):
    return _links(spark, d).select("page_id", _bigint("link_no").alias("link_no"), "href", "anchor_text")


@register(
    "rewrite_path",
    f"SELECT page_id, link_no, {Q.replace_path(chr(39) + 'https://' + chr(39) + ' || ' + Q.host('url') + ' || href', NOTICE_XML_PATH)} AS xml_url FROM ({SQL_LINKS})",
)
def rewrite_path(spark, d):
    links = _links(spark, d)
    abs_url = L.absolute_url(L.url_host("url"), F.col("href"))
    return links.select("page_id", _bigint("link_no").alias("link_no"), L.replace_path(abs_url).alias("xml_url"))


@register(
    "rewrite_segments",
    f"SELECT page_id, link_no, {Q.rewrite_segments(Q.host('url'), 'href', BULLETIN_SEGMENT)} AS bulletin_url FROM ({SQL_LINKS})",
)
def rewrite_segments(spark, d):
    links = _links(spark, d)
    return links.select(
        "page_id", _bigint("link_no").alias("link_no"), L.rewrite_segments(L.url_host("url"), F.col("href")).alias("bulletin_url")
    )


@register(
    "date_shift_format",
    """SELECT event_id, CAST(CAST(ts AS DATE) + INTERVAL 7 DAY AS DATE) AS day_plus_7,
  CAST(CAST(ts AS DATE) - INTERVAL 30 DAY AS DATE) AS day_minus_30,
  strftime(ts, '%Y%m%d') AS ymd, strftime(ts, '%Y_%m_%d') AS y_m_d, strftime(ts, '%Y-%m-%d') AS iso,
  strftime(ts, '%H:%M:%S') AS hms, CAST(year(ts) AS VARCHAR) AS anio,
  lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS mes, lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS dia
FROM events""",
)
def date_shift_format(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "ts")
    day = F.to_date("ts")
    parts = B.day_parts(day)
    return ev.select(
        "event_id",
        F.date_add(day, 7).alias("day_plus_7"),
        F.date_sub(day, 30).alias("day_minus_30"),
        F.date_format("ts", "yyyyMMdd").alias("ymd"),
        F.date_format("ts", "yyyy_MM_dd").alias("y_m_d"),
        F.date_format("ts", "yyyy-MM-dd").alias("iso"),
        F.date_format("ts", "HH:mm:ss").alias("hms"),
        parts["anio"].alias("anio"),
        parts["mes"].alias("mes"),
        parts["dia"].alias("dia"),
    )


@register(
    "hash_embed",
    f"""WITH {_sparse_sql('documents', 'doc_id', 'text', 'dv')}
SELECT c.id AS doc_id, c.bucket, c.cnt::BIGINT AS cnt, round(c.cnt / n.norm, 6) AS weight
FROM dv_c c JOIN dv_n n USING (id)""",
)
def hash_embed(spark, d):
    docs = read_table(spark, d, "documents", heavy=True).select("doc_id", "text")
    sp = E.sparse_weights(docs, ["doc_id"], "text", EMBED_DIM)
    return sp.select("doc_id", "bucket", "cnt", F.round("weight", 6).alias("weight"))


@register(
    "split_short",
    f"""WITH c AS ({SQL_CHUNKS}), s AS (SELECT page_id, chunk_no, {Q.strip_ws(Q.decorate('chunk', 'url'))} AS split FROM c)
SELECT page_id, chunk_no, CAST(0 AS BIGINT) AS split_no, split FROM s WHERE split <> ''""",
)
def split_short(spark, d):
    rows = _notice_rows(spark, d).select("page_id", "chunk_no", "resumen")
    sp = C.recursive_split(rows, "resumen", keep=["page_id", "chunk_no"])
    return sp.select("page_id", _bigint("chunk_no").alias("chunk_no"), _bigint("split_no").alias("split_no"), "split")


@register("recursive_split")
def recursive_split(spark, d):
    docs = read_table(spark, d, "documents", heavy=True).select("doc_id", "text")
    sp = C.recursive_split(docs, "text", keep=["doc_id"])
    return sp.select("doc_id", _bigint("split_no").alias("split_no"), "split")


# Sessions, tools, feedback -----------------------------------------------------


def _transcripts(spark, d):
    conv = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    tool = (
        F.when(F.pmod("conv_id", F.lit(3)) == 0, F.lit("ObtenerTexto"))
        .when(F.pmod("conv_id", F.lit(3)) == 1, F.lit("Buscar"))
        .otherwise(F.lit("Finish"))
    )
    close = F.when(F.pmod("turn", F.lit(5)) == 4, F.lit(")")).otherwise(F.lit("]"))
    text = F.concat(
        F.lit("Thought: "), "text", F.lit("\nAction: "), tool, F.lit('["'),
        F.translate("text", "\n", " "), F.lit('"\r'), close,
    )
    return conv.select("conv_id", "turn", text.alias("text"))


SQL_TRANSCRIPTS = """SELECT conv_id, turn, 'Thought: ' || text || chr(10) || 'Action: ' ||
  (CASE conv_id % 3 WHEN 0 THEN 'ObtenerTexto' WHEN 1 THEN 'Buscar' ELSE 'Finish' END) || '["' ||
  translate(text, chr(10), ' ') || '"' || chr(13) || (CASE WHEN turn % 5 = 4 THEN ')' ELSE ']' END) AS text FROM conversations"""

SQL_TOOL_CALLS = f"""WITH t AS ({SQL_TRANSCRIPTS}),
l AS (SELECT conv_id, turn, regexp_extract({Q.strip_ws('text')}, '([^\\n]*)$', 1) AS last_line FROM t),
a AS (SELECT conv_id, turn, starts_with(last_line, 'Action: ') AS is_action, substring(last_line, 9) AS action FROM l),
p AS (SELECT conv_id, turn, is_action AND regexp_matches(action, '^(.*?)\\[(.*?)\\]') AS ok, action FROM a)
SELECT conv_id, turn,
  CASE WHEN ok THEN regexp_extract(action, '^(.*?)\\[(.*?)\\]', 1) END AS tool,
  CASE WHEN ok THEN regexp_extract(action, '^(.*?)\\[(.*?)\\]', 2) END AS tool_input,
  coalesce(ok AND regexp_extract(action, '^(.*?)\\[(.*?)\\]', 1) = 'Finish', false) AS finished
FROM p"""


@register("tool_calls", SQL_TOOL_CALLS)
def tool_calls(spark, d):
    calls = S.tool_calls(_transcripts(spark, d))
    return calls.select("conv_id", "turn", "tool", "tool_input", "finished")


@register(
    "unknown_tools",
    f"SELECT conv_id, turn, tool FROM ({SQL_TOOL_CALLS}) WHERE tool IS NOT NULL AND tool <> 'Finish' "
    f"AND tool NOT IN ({', '.join(Q.lit(t) for t in TOOLS)})",
)
def unknown_tools(spark, d):
    calls = S.tool_calls(_transcripts(spark, d))
    registry = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in TOOLS])).alias("name"))
    return S.unknown_tools(calls, registry).select("conv_id", "turn", "tool")


_flag_list = ", ".join(Q.lit(f) for f in FEEDBACK_FLAGS)
SQL_FLAGGED = f"""SELECT conv_id AS session_id, turn AS idx, text, ([{_flag_list}, 'Otro'])[turn % 4 + 1] AS flag FROM conversations"""


def _flagged(spark, d):
    conv = read_table(spark, d, "conversations")
    flags = F.array(*[F.lit(f) for f in (*FEEDBACK_FLAGS, "Otro")])
    flag = flags[F.pmod("turn", F.lit(4)).cast("int")]
    return conv.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "text", flag.alias("flag"))


@register("feedback_rows", f"SELECT * FROM ({SQL_FLAGGED}) WHERE flag IN ({_flag_list})")
def feedback_rows(spark, d):
    """Feedback stored with its text; unknown flags are refused."""
    path = scratch_path(spark, "feedback")
    S.store_feedback(_flagged(spark, d), path)
    return spark.read.parquet(path)


@register(
    "feedback_counts",
    f"SELECT flag, flag IN ({_flag_list}) AS valid, count(*)::BIGINT AS n FROM ({SQL_FLAGGED}) GROUP BY ALL",
)
def feedback_counts(spark, d):
    return S.feedback_counts(_flagged(spark, d))


@register(
    "session_tokens",
    f"""SELECT conv_id, array_to_string(list_transform(range(32), lambda i: substr({Q.lit(S.TOKEN_ALPHABET)},
  ('0x' || substr(h, 2 * i + 1, 2))::INTEGER % 62 + 1, 1)), '') AS token
FROM (SELECT DISTINCT conv_id, sha256(conv_id || ':{SEED}') AS h FROM conversations)""",
)
def session_tokens(spark, d):
    conv = read_table(spark, d, "conversations").select("conv_id")
    return S.session_tokens(conv, "conv_id", SEED)


@register(
    "session_append",
    "SELECT conv_id AS session_id, turn AS seq, text AS prompt FROM conversations",
)
def session_append(spark, d):
    conv = read_table(spark, d, "conversations")
    path = scratch_path(spark, "session_log")
    rows = conv.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("prompt"))
    # questions first, then answers: two appends to the same log
    S.append_log(rows.filter(F.col("seq") % 2 == 0), path)
    S.append_log(rows.filter(F.col("seq") % 2 == 1), path)
    return S.read_log(spark, path)


@register(
    "prompt_steps",
    """WITH a AS (SELECT item_id, text AS idea, 'Name a project for: ' || text AS p FROM benchmark),
b AS (SELECT item_id, idea, length(p) || ' characters: ' || p AS name FROM a),
c AS (SELECT *, 'Write a plan for ' || name AS p FROM b)
SELECT item_id, idea, name, length(p) || ' characters: ' || p AS plan FROM c""",
)
def prompt_steps(spark, d):
    qs = read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("idea"))
    steps = [
        ("Name a project for: {idea}", "idea", "name"),
        ("Write a plan for {name}", "name", "plan"),
    ]
    return R.prompt_steps(qs, steps, _answer).select("item_id", "idea", "name", "plan")


# Summary ----------------------------------------------------------------------


_stops_sql = ", ".join(Q.lit(w) for w in STOP_WORDS_ES)
SQL_SENTENCES = f"""s0 AS (SELECT doc_id, {Q.sentences('text')} AS l FROM documents),
s1 AS (SELECT doc_id, l, unnest(range(0, len(l))) AS sent_no FROM s0),
s AS (SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, l[sent_no + 1] AS sentence FROM s1),
t AS (SELECT doc_id, sent_no, unnest({Q.tokens('sentence')}) AS term FROM s),
c AS (SELECT doc_id, sent_no, term, count(*)::BIGINT AS cnt FROM t WHERE term NOT IN ({_stops_sql}) GROUP BY ALL)"""
SQL_STEMMED = SQL_SENTENCES[: SQL_SENTENCES.rindex("c AS (SELECT doc_id")] + f"""st_0 AS (SELECT DISTINCT term AS w FROM t
  WHERE term NOT IN ({_stops_sql})),
{Q.stems('st')},
c AS (SELECT doc_id, sent_no, stem AS term, count(*)::BIGINT AS cnt FROM t JOIN st ON t.term = st.w GROUP BY ALL)"""


@register(
    "lsa_term_weights",
    f"WITH {SQL_SENTENCES} SELECT doc_id, sent_no, term, cnt FROM c",
)
def lsa_term_weights(spark, d):
    docs = read_table(spark, d, "documents", heavy=True).select("doc_id", "text")
    counts = M.term_counts(M.split_sentences(docs))
    return counts.select("doc_id", _bigint("sent_no").alias("sent_no"), "term", "cnt")


@register(
    "lsa_stem_weights",
    f"WITH {SQL_STEMMED} SELECT doc_id, sent_no, term, cnt FROM c",
)
def lsa_stem_weights(spark, d):
    """Counts of stems in each sentence."""
    docs = read_table(spark, d, "documents", heavy=True).select("doc_id", "text")
    counts = M.term_counts(M.split_sentences(docs), stems=True)
    return counts.select("doc_id", _bigint("sent_no").alias("sent_no"), "term", "cnt")


_a = float(LSA_SMOOTH)


def _lsa_sql(counts: str) -> str:
    return f"""WITH {counts},
sm AS (SELECT doc_id, sent_no, max(cnt) AS m, sum(cnt) AS s1, sum(cnt * cnt) AS s2 FROM c GROUP BY ALL),
v AS (SELECT doc_id, count(DISTINCT term) AS v FROM c GROUP BY ALL),
sc AS (SELECT s.doc_id, s.sent_no, s.sentence,
  CASE WHEN sm.m > 0 THEN sqrt({Q.dbl(_a * _a)} * v.v::DOUBLE + {Q.dbl(2 * _a * (1 - _a))} * sm.s1::DOUBLE / sm.m::DOUBLE
    + {Q.dbl((1 - _a) * (1 - _a))} * sm.s2::DOUBLE / (sm.m::DOUBLE * sm.m::DOUBLE)) ELSE 0.0 END AS score
  FROM s JOIN v USING (doc_id) LEFT JOIN sm USING (doc_id, sent_no)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_no) AS rn FROM sc)
SELECT doc_id, count(*)::BIGINT AS n_sentences, string_agg(sentence, chr(10) ORDER BY sent_no) AS summary
FROM r WHERE rn <= {SUMMARY_SENTENCES} GROUP BY doc_id"""


@register("lsa_summary", _lsa_sql(SQL_SENTENCES))
def lsa_summary(spark, d):
    docs = read_table(spark, d, "documents", heavy=True).select("doc_id", "text")
    out = M.lsa_summary(docs)
    return out.select("doc_id", _bigint("n_sentences").alias("n_sentences"), "summary")


@register("lsa_stem_summary", _lsa_sql(SQL_STEMMED))
def lsa_stem_summary(spark, d):
    """The summary over stems."""
    docs = read_table(spark, d, "documents", heavy=True).select("doc_id", "text")
    return M.lsa_summary(docs, stems=True).select("doc_id", "n_sentences", "summary")


# Streaming ----------------------------------------------------------------------


@register(
    "stream_chunks",
    f"SELECT page_id, chunk_no, url, titulo, '' AS texto, {Q.decorate('chunk', 'url')} AS resumen FROM ({SQL_CHUNKS})",
)
def stream_chunks(spark, d):
    schema = spark.read.parquet(os.path.join(d, "pages.parquet")).select("page_id", "url", "html").schema
    sink = scratch_path(spark, "stream_chunks")
    ckpt = scratch_path(spark, "stream_chunks_ckpt")
    ST.stream_notice_chunks(spark, _landing(d, "pages"), schema, sink, ckpt)
    out = spark.read.parquet(sink)
    return out.select("page_id", _bigint("chunk_no").alias("chunk_no"), "url", "titulo", "texto", "resumen")


def _landing(d: str, table: str) -> str:
    return os.path.join(d, f"{table}.parquet")


@register(
    "stream_session_log",
    f"SELECT conv_id AS session_id, turn AS seq, clean_text AS prompt, route FROM ({SQL_ROUTED}) "
    "WHERE route NOT IN ('reset', 'history')",
)
def stream_session_log(spark, d):
    schema = T.StructType(
        [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("text", T.StringType())]
    )
    log = scratch_path(spark, "stream_session_log")
    ckpt = scratch_path(spark, "stream_session_log_ckpt")
    ST.stream_session_log(spark, _landing(d, "conversations"), schema, log, ckpt, derive=_derive_messages)
    return spark.read.parquet(log).select("session_id", "seq", "prompt", "route")


SQL_EPOCHS = f"""WITH r AS ({SQL_ROUTED}),
e AS (SELECT conv_id, turn, route, route NOT IN ('reset', 'history') AS stored, CAST(count(*) FILTER (route = 'reset')
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS epoch FROM r)
SELECT conv_id, turn, route, epoch, CASE WHEN stored THEN row_number() OVER (PARTITION BY conv_id, epoch, stored ORDER BY turn) END AS turn_no
FROM e"""


@register("session_epochs", SQL_EPOCHS)
def session_epochs(spark, d):
    """Sessions that begin anew at a reset."""
    return S.session_epochs(_messages(spark, d))


@register("stream_session_epochs", SQL_EPOCHS)
def stream_session_epochs(spark, d):
    """The same from a stream: turns land in three files, one a micro-batch,
    and every conversation's epoch and turn number are state."""
    conv = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    landing = scratch_path(spark, "stream_epochs_landing")
    for part in (F.col("turn") < 2, F.col("turn").between(2, 4), F.col("turn") > 4):
        conv.where(part).coalesce(1).write.mode("append").parquet(landing)
    sink, ckpt = scratch_path(spark, "stream_epochs"), scratch_path(spark, "stream_epochs_ckpt")
    ST.stream_session_epochs(spark, landing, conv.schema, sink, ckpt, max_files=1, derive=_derive_messages)
    return spark.read.parquet(f"{sink}/batch_id=*").select("conv_id", "turn", "route", "epoch", "turn_no")


def _derive_messages(df: DataFrame) -> DataFrame:
    t = F.col("text")
    m = F.pmod(F.col("turn"), F.lit(4))
    text = (
        F.when(m == 1, F.concat(F.lit(CMD_RESET.upper() + " "), t))
        .when(m == 2, F.concat(t, F.lit(" " + CMD_HISTORY.upper())))
        .when(m == 3, F.concat(F.lit(CMD_AGENT.capitalize() + " "), t))
        .otherwise(t)
    )
    return df.select("conv_id", "turn", F.concat(F.lit("  "), text, F.lit("\n\t")).alias("text"))
