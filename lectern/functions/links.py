"""Links in index pages and the URL rewrites that turn them into notice
addresses.  Regex-only (no HTML parser), evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import BULLETIN_SEGMENT, LINK_PATTERN, LINK_TEXT, NOTICE_XML_PATH
from .arrays import posexplode_rows
from .text import decode_entities, drop_markup, enclosed

RE_ANCHOR_OPEN = r"(?is)^<a\b[^>]*>"
RE_ANCHOR_INNER = r"(?is)^<a\b[^>]*>(.*)</a\s*>$"
RE_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]*)"""
RE_NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
RE_URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def anchors(html) -> Column:
    """Array of whole ``<a ...>...</a>`` elements, in page order."""
    return enclosed(html, r"<a\b[^<>]*>", r"</a\s*>", "is")


_TAG = r"<(?!(?:area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)\b)[A-Za-z][^<>]*>"
#: An element's content that is one string, alone or inside elements that
#: hold nothing else.
RE_ONLY_STRING = rf"(?is)^(?:{_TAG})*([^<]+)(?:</[A-Za-z][^<>]*>)*$"


def only_string(inner) -> Column:
    """The only string of an element, from its content; NULL where it has
    child elements beside text, several children, or none."""
    found = F.regexp_extract(_col(inner), RE_ONLY_STRING, 1)
    return F.when(found != "", decode_entities(found))


def extract_links(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per anchor: ``link_no`` (0-based), ``anchor`` (markup),
    ``href``, ``anchor_text`` (visible text, entities decoded) and
    ``anchor_string`` (its only string, NULL where it has none)."""
    keep = keep if keep is not None else [c for c in df.columns if c != html_col]
    exploded = posexplode_rows(df, keep, anchors(html_col), "link_no", "anchor")
    open_tag = F.regexp_extract("anchor", RE_ANCHOR_OPEN, 0)
    inner = F.regexp_extract("anchor", RE_ANCHOR_INNER, 1)
    return exploded.select(
        *keep,
        "link_no",
        "anchor",
        F.regexp_extract(open_tag, RE_HREF, 1).alias("href"),
        drop_markup(inner).alias("anchor_text"),
        only_string(inner).alias("anchor_string"),
    )


def filter_link_text(links: DataFrame, text: str = LINK_TEXT) -> DataFrame:
    """Anchors whose only string equals ``text`` exactly (case-sensitive):
    one with child elements beside its text has none and is refused."""
    return links.filter(F.col("anchor_string") == F.lit(text))


def filter_link_markup(links: DataFrame, pattern: str = LINK_PATTERN) -> DataFrame:
    """Anchors whose whole markup (attributes included) matches ``pattern``
    anywhere, case-sensitive."""
    return links.filter(F.col("anchor").rlike(pattern))


def url_host(url) -> Column:
    """Network location (host, with port and user info when present)."""
    return F.regexp_extract(_col(url), RE_NETLOC, 1)


def absolute_url(host, href) -> Column:
    """``https://{host}{href}`` with no slash inserted."""
    return F.concat(F.lit("https://"), _col(host), _col(href))


def replace_path(url, new_path: str = NOTICE_XML_PATH) -> Column:
    """Replace the path of an absolute URL, keeping query and fragment.
    A path without a leading slash gets one."""
    path = new_path if new_path.startswith("/") else "/" + new_path
    return F.regexp_replace(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)[^?#]*", "$1" + path.replace("$", r"\$"))


def rewrite_segments(host, href, segment: str = BULLETIN_SEGMENT) -> Column:
    """Second-gazette rewrite: in the href every ``html`` then every ``do``
    becomes ``xml``; the URL is ``https://{host}/{href}`` and its first path
    segment is replaced by ``segment``.  NULL when the URL has no path (the
    original raised there)."""
    href_x = F.replace(F.replace(_col(href), F.lit("html"), F.lit("xml")), F.lit("do"), F.lit("xml"))
    url = F.concat(F.lit("https://"), _col(host), F.lit("/"), href_x)
    head = F.regexp_extract(url, RE_URL_PARTS, 1)
    path = F.regexp_extract(url, RE_URL_PARTS, 2)
    tail = F.regexp_extract(url, RE_URL_PARTS, 3)
    new_path = F.regexp_replace(path, r"^/[^/]*", "/" + segment)
    return F.when(path != "", F.concat(head, new_path, tail))


def notice_pdf_url(domain, elements) -> Column:
    """Domain followed by the stripped text of the ``url_pdf`` elements;
    no element gives the domain alone."""
    from .text import strip_html

    return F.concat(_col(domain), F.coalesce(strip_html(F.array_join(_col(elements), ", ")), F.lit("")))
