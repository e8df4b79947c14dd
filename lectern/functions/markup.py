"""HTML as a sequence of tokens, read in one pass.

A small state machine walks the markup once: every step finds the end of the
token that begins where it stands, so time is linear in the text.  Quoted
attribute values may hold angle brackets; scripts and styles are raw text up
to their own end tag; what an opener leaves unclosed lasts to the end of the
text, as in HTML 5.  Text, and each element's only string, are read from the
tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = ("script", "style")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element whose end a following start tag implies, and those tags.
IMPLIED = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")

Token = tuple[str, str, str, dict[str, str]]


def _tag(html: str, at: int) -> tuple[str, dict[str, str], int]:
    """Name, attributes and end of the tag whose name begins at ``at``."""
    name = _NAME.match(html, at)
    attributes: dict[str, str] = {}
    at = name.end()
    while (found := _ATTRIBUTE.match(html, at)) and found.end() > at:
        value = next((g for g in found.groups()[1:] if g is not None), "")
        attributes.setdefault(found[1].lower(), unescape(value))
        at = found.end()
    end = html.find(">", at)
    return name[0].lower(), attributes, len(html) if end < 0 else end + 1


def _until(html: str, mark: str, at: int) -> tuple[int, int]:
    """Where what ends at ``mark`` ends, and where the text goes on."""
    end = html.find(mark, at)
    return (len(html), len(html)) if end < 0 else (end, end + len(mark))


def tokens(html: str) -> Iterator[Token]:
    """``(kind, name, text, attributes)`` of every token in order.  Kinds:
    ``text`` (references decoded), ``start``, ``end``, ``raw`` (content of a
    script or style), ``comment``, ``declaration``."""
    at = 0
    while at < len(html):
        if html[at] != "<":
            end = html.find("<", at)
            end = len(html) if end < 0 else end
            yield "text", "", unescape(html[at:end]), {}
            at = end
        elif html.startswith("<!--", at):
            end, after = _until(html, "-->", at + 4)
            yield "comment", "", html[at + 4 : end], {}
            at = after
        elif html[at + 1 : at + 2] in ("!", "?"):
            end, after = _until(html, ">", at + 2)
            yield "declaration", "", html[at + 2 : end], {}
            at = after
        elif _NAME.match(html, at + 1):
            name, attributes, at = _tag(html, at + 1)
            yield "start", name, "", attributes
            if name in RAW:
                closer = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(html, at)
                end = closer.start() if closer else len(html)
                if end > at:
                    yield "raw", name, html[at:end], {}
                at = end
        elif _NAME.match(html, at + 2) and html[at + 1] == "/":
            name, _, at = _tag(html, at + 2)
            yield "end", name, "", {}
        else:  # a bracket that opens nothing is text
            end = html.find("<", at + 1)
            end = len(html) if end < 0 else end
            yield "text", "", unescape(html[at:end]), {}
            at = end


def only_strings(html: str, tag: str) -> list[tuple[str | None, dict[str, str]]]:
    """Of every ``tag`` element in order of its start: its only string, and
    its attributes.  An element whose only child is a text (or a comment) has
    that string; one whose only child is an element has that one's; any other
    has none.  Start tags imply the ends of elements before them."""
    # open elements: (name, number of children, the string of the last child, place in out)
    stack: list[list] = []
    out: list[list] = []

    def child(text: str | None) -> None:
        if stack:
            stack[-1][1] += 1
            stack[-1][2] = text

    def close() -> None:
        _, children, text, place = stack.pop()
        own = text if children == 1 else None
        if place is not None:
            out[place][0] = own
        child(own)

    last = None
    for kind, name, text, attributes in tokens(html):
        if kind in ("text", "raw") and last in ("text", "raw") and stack:
            stack[-1][2] = None if stack[-1][2] is None else stack[-1][2] + text
        elif kind in ("text", "raw", "comment"):
            child(text)
        elif kind == "start":
            while stack and name in IMPLIED.get(stack[-1][0], ()):
                close()
            place = None
            if name == tag:
                place = len(out)
                out.append([None, attributes])
            if name in VOID:
                child(None)
            else:
                stack.append([name, 0, None, place])
        elif kind == "end" and any(entry[0] == name for entry in stack):
            while stack[-1][0] != name:
                close()
            close()
        last = kind
    while stack:
        close()
    return [(text, attributes) for text, attributes in out]


_ATTRIBUTES = T.MapType(T.StringType(), T.StringType())


def html_tokens(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per token: ``token_no`` (from 0), ``kind, name, text,
    attributes``.  A NULL or empty body has none."""
    keep = keep if keep is not None else [c for c in df.columns if c != html_col]
    schema = df.select(*keep).schema.add("token_no", "long").add("kind", "string").add("name", "string").add("text", "string")
    schema = schema.add("attributes", _ATTRIBUTES)
    names = df.select(*keep).columns

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for *row, body in pdf.itertuples(index=False, name=None):
                for i, token in enumerate(tokens(body or "")):
                    rows.append((*row, i, *token))
                    if len(rows) >= 4096:  # a long body is not held as rows
                        yield pd.DataFrame(rows, columns=schema.names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    return df.select(*names, F.col(html_col).alias("_body")).mapInPandas(cut, schema)


def element_strings(df: DataFrame, tag: str, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per ``tag`` element: ``element_no`` (from 0), ``string`` (its
    only string, NULL where it has none) and ``attributes``."""
    keep = keep if keep is not None else [c for c in df.columns if c != html_col]
    schema = df.select(*keep).schema.add("element_no", "long").add("string", "string").add("attributes", _ATTRIBUTES)

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = [
                (*row, i, text, attributes)
                for *row, body in pdf.itertuples(index=False, name=None)
                for i, (text, attributes) in enumerate(only_strings(body or "", tag))
            ]
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    return df.select(*keep, F.col(html_col).alias("_body")).mapInPandas(read, schema)
