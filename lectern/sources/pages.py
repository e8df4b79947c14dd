"""Landing tables of fetched bodies and the fields read from them.

Live HTTP fetching is not part of the engine: fetched bodies land in a
table ``(source, day, url, html)`` (or any table with a body column) and
every step after that is a Spark plan, so ingestion is repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import notice_pdf_url
from ..functions.text import drop_markup, enclosed, strip_html


def scan_pages(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet landing table; only the requested columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Raw files as ``(url, html)``, one row per file, plus any partition
    columns of the directory layout (``key=value`` folders).

    ``wholetext`` keeps each file in one row; files are split across tasks
    by the file listing, so many small files read in parallel.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # the keyword, not .option(): text() would reset the option to False
    df = reader.text(path, wholetext=True)
    return df.select(
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
        *[c for c in df.columns if c != "value"],
    )


def land_files(df: DataFrame, path: str, key: str, body: str) -> None:
    """Write each body as its own text file under ``path/key=<value>/``
    (the landing layout :func:`scan_files` reads).  The text writer ends
    every record with a newline."""
    df.select(key, body).repartition(F.col(key)).write.mode("errorifexists").partitionBy(key).text(path)


def elements(body, tag: str) -> Column:
    """Every ``<tag ...>...</tag>`` element (markup included), in order."""
    return enclosed(body, rf"<{tag}\b[^<>]*>", rf"</{tag}\s*>")


def first_element_text(body, tag: str) -> Column:
    """Visible text of the first ``tag`` element; NULL when there is none.
    Its own tags are markup like any other."""
    return drop_markup(F.try_element_at(elements(body, tag), F.lit(1)))


def notice_fields(
    df: DataFrame,
    body_col: str = "html",
    domain: Column | str | None = None,
    title_tag: str = "titulo",
    text_tag: str = "texto",
    pdf_tag: str = "url_pdf",
    keep: list[str] | None = None,
) -> DataFrame:
    """Fields of a notice document, parsed once per row.

    * ``titulo``: text of the first title element (NULL when missing);
    * ``texto``: all text elements, joined by ", " and stripped of markup
      and brackets;
    * ``url``: domain + stripped text of the PDF-link elements.

    Regex extraction never fails the job on malformed markup.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != body_col]
    dom = F.lit("") if domain is None else (F.col(domain) if isinstance(domain, str) else domain)
    return df.select(
        *keep,
        first_element_text(body_col, title_tag).alias("titulo"),
        strip_html(F.array_join(elements(body_col, text_tag), ", ")).alias("texto"),
        notice_pdf_url(dom, elements(body_col, pdf_tag)).alias("url"),
    )


#: Fields of a notice body: nested paragraphs, several texts and PDF links.
NOTICE_XML_SCHEMA = "titulo string, texto array<struct<p array<string>>>, url_pdf array<string>"


def xml_records(df: DataFrame, body_col: str = "xml", schema: str = NOTICE_XML_SCHEMA, keep: list[str] | None = None) -> DataFrame:
    """Notice bodies read as XML: nested elements, CDATA sections and
    references as the format has them.  ``schema`` names the children of the
    root element.  A body that is not well-formed does not fail the job: its
    fields are NULL and ``corrupt`` holds it; a NULL body gives NULL fields."""
    keep = keep if keep is not None else [c for c in df.columns if c != body_col]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreSurroundingSpaces": "false"}
    parsed = df.select(*keep, F.from_xml(F.col(body_col), f"{schema}, _corrupt string", options).alias("_record"))
    names = [f.name for f in parsed.schema["_record"].dataType.fields if f.name != "_corrupt"]
    bad = F.col("_record._corrupt")
    fields = [F.when(bad.isNull(), F.col(f"_record.{n}")).alias(n) for n in names]
    return parsed.select(*keep, *fields, bad.alias("corrupt"))
