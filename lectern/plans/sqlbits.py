"""DuckDB SQL fragments of the oracles.  Markup, references and white space
have forms of their own; links, tokens and sentences share their patterns."""

from __future__ import annotations

from ..functions import links as L
from ..functions import text as X
from ..operators.embedding import TOKEN_RE
from ..operators.summary import SENTENCE_RE
from ..params import (
    LINK_TEMPLATE,
    STEM_GERUNDS,
    STEM_PRONOUNS,
    STEM_RESIDUAL,
    STEM_STANDARD,
    STEM_VERB_OTHER,
    STEM_VERB_Y,
    URL_SEPARATOR,
)


def lit(s: str) -> str:
    """SQL string literal (newlines and other characters kept verbatim)."""
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    """Double literal that parses back to exactly ``x``."""
    return format(float(x), ".17e")


def rx(pattern: str) -> str:
    """A Java pattern for RE2: ``(?d)`` is Java-only and is RE2's default."""
    return lit(pattern.replace("(?d)", ""))


def regexp_replace_all(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {rx(pattern)}, {lit(repl)}, 'g')"


RE_ANCHOR = r"(?is)<a\b[^<>]*>.*?</a\s*>"

# The oracle's own forms: RE2 runs in linear time, so lazy patterns do.
_MARKUP = (
    r"(?is)<script\b[^<>]*>.*?</script\s*>",
    r"(?is)<style\b[^<>]*>.*?</style\s*>",
    r"(?s)<!--.*?-->",
    r"(?s)<![^<>]*>",
    r"(?s)<\?[^<>]*>",
    r"(?s)</?[A-Za-z][^<>]*>",
)
# References met in the test pages; the ampersand last, as one pass gives it.
_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": "\u00a0", "copy": "©", "middot": "·"}
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def decode_entities(x: str) -> str:
    for name, ch in [*_REFERENCES.items(), ("amp", "&")]:
        x = f"replace({x}, {lit('&' + name + ';')}, {lit(ch)})"
    return x


def drop_markup(x: str) -> str:
    for p in _MARKUP:
        x = regexp_replace_all(x, p)
    return decode_entities(x)


def strip_html(x: str) -> str:
    return regexp_replace_all(f"translate({drop_markup(x)}, '[]', '')", "<[^>\n]*>")


def one_string(inner: str) -> str:
    """An element's content is one string, maybe inside elements that hold nothing else."""
    void = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"
    return (
        f"(regexp_matches({inner}, {lit(r'(?is)^(?:<[A-Za-z][^<>]*>)*[^<]+(?:</[A-Za-z][^<>]*>)*$')}) "
        f"AND NOT regexp_matches({inner}, {lit(rf'(?i)<(?:{void})[ />]')}))"
    )


def markup_tokens(html: str) -> str:
    """List of comments, declarations, tags and texts; raw text behind a mark."""
    whole = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<[!?][^>]*>|</?[a-z][^>]*>|[^<]+"
    raw = r"(?is)^<(?:script|style)\b[^>]*>(.*)</(?:script|style)\s*>$"
    parts = (
        f"list_filter([regexp_extract(t, '^<[^>]*>'), nullif(chr(1) || regexp_extract(t, {lit(raw)}, 1), chr(1)), "
        "regexp_extract(t, '</[^<>]*>$')], lambda x: x IS NOT NULL)"
    )
    return (
        f"flatten(list_transform(regexp_extract_all({html}, {lit(whole)}), "
        f"lambda t: CASE WHEN regexp_matches(t, {lit(raw)}) THEN {parts} ELSE [t] END))"
    )


def strip_ws(x: str) -> str:
    return f"trim({x}, {lit(_BLANKS)})"


def decorate(chunk: str, url: str) -> str:
    return f"({chunk} || {lit(URL_SEPARATOR)} || {url})"


def format_links(x: str) -> str:
    return regexp_replace_all(x, X.RE_LINK, LINK_TEMPLATE.format(r"\0"))


def host(url: str) -> str:
    return f"regexp_extract({url}, {rx(L.RE_NETLOC)}, 1)"


def replace_path(url: str, new_path: str) -> str:
    path = new_path if new_path.startswith("/") else "/" + new_path
    return f"regexp_replace({url}, {rx(r'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)[^?#]*')}, {lit(chr(92) + '1' + path)})"


def rewrite_segments(h: str, href: str, segment: str) -> str:
    url = f"('https://' || {h} || '/' || replace(replace({href}, 'html', 'xml'), 'do', 'xml'))"
    parts = rx(L.RE_URL_PARTS)
    head = f"regexp_extract({url}, {parts}, 1)"
    path = f"regexp_extract({url}, {parts}, 2)"
    tail = f"regexp_extract({url}, {parts}, 3)"
    new_path = f"regexp_replace({path}, '^/[^/]*', {lit('/' + segment)})"
    return f"CASE WHEN {path} <> '' THEN {head} || {new_path} || {tail} END"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(TOKEN_RE)}, 0)"


def bucket(tok: str, dim: int) -> str:
    return f"CAST((('0x' || substr(md5({tok}), 1, 8))::BIGINT % {dim}) AS INTEGER)"


def sentences(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, {lit(SENTENCE_RE)}, 0), "
        f"lambda s: {strip_ws('s')}), lambda s: s <> '')"
    )


# Spanish stems, step by step over a table ``name_0`` of words ``w``; regions
# are cut by patterns, suffixes by the longest alternative at the end.
_V = "aeiouáéíóúü"
_NEXT_REGION = f"^[^{_V}]*[{_V}]+[^{_V}](.*)$"


def _ending(x: str, start: str, suffixes) -> str:
    """The longest suffix that ends ``x`` from its character ``start`` on."""
    return f"regexp_extract(substr({x}, {start} + 1), {lit('(' + '|'.join(suffixes) + ')$')}, 1)"


def _less(x: str, suffix: str) -> str:
    return f"left({x}, length({x}) - length({suffix}))"


def stems(name: str) -> str:
    """CTEs from ``name_0(w)`` to ``name(w, stem)``."""
    rules = list(STEM_STANDARD.items())
    region = " ".join(f"WHEN {lit(x)} THEN {'r1' if r == 'R1' else 'r2'}" for x, (r, _, _) in rules)
    put = " ".join(f"WHEN {lit(x)} THEN {lit(new)}" for x, (_, new, _) in rules if new)
    more = " ".join(f"WHEN {lit(x)} THEN {_ending('b', 'r2', more)}" for x, (_, _, more) in rules if more)
    return f"""{name}_1 AS (SELECT w, length(w) - length(regexp_extract(w, '{_NEXT_REGION}', 1)) AS r1,
  regexp_extract(regexp_extract(w, '{_NEXT_REGION}', 1), '{_NEXT_REGION}', 1) AS s2,
  CASE WHEN length(w) < 3 THEN '' WHEN regexp_matches(w, '^.[^{_V}]') THEN regexp_extract(w, '^.[^{_V}]+[{_V}](.*)$', 1)
    WHEN regexp_matches(w, '^[{_V}]') THEN regexp_extract(w, '^[{_V}]+[^{_V}](.*)$', 1) ELSE substr(w, 4) END AS sv FROM {name}_0),
{name}_2 AS (SELECT w, r1, length(w) - length(s2) AS r2, length(w) - length(sv) AS rv, {_ending('w', '(length(w) - length(sv))', sorted(STEM_PRONOUNS))} AS p FROM {name}_1),
{name}_3 AS (SELECT *, {_less('w', 'p')} AS h, {_ending(_less('w', 'p'), 'rv', sorted(STEM_GERUNDS))} AS g FROM {name}_2),
{name}_4 AS (SELECT w, r1, r2, rv, CASE WHEN p = '' OR g = '' OR (g = 'yendo' AND NOT ends_with(h, 'uyendo')) THEN w
  ELSE {_less('h', 'g')} || translate(g, 'áéíóú', 'aeiou') END AS a FROM {name}_3),
{name}_5 AS (SELECT *, {_ending('a', '0', sorted(STEM_STANDARD))} AS s FROM {name}_4),
{name}_6 AS (SELECT *, s <> '' AND length(a) - length(s) >= CASE s {region} END AS std FROM {name}_5),
{name}_7 AS (SELECT *, CASE WHEN std THEN {_less('a', 's')} || CASE s {put} ELSE '' END ELSE a END AS b FROM {name}_6),
{name}_8 AS (SELECT *, CASE WHEN std THEN CASE s {more} ELSE '' END ELSE '' END AS e FROM {name}_7),
{name}_9 AS (SELECT *, {_less('b', 'e')} AS c, s = 'amente' AND e = 'iv' AS iv FROM {name}_8),
{name}_10 AS (SELECT w, rv, a, std, CASE WHEN iv THEN {_less('c', _ending('c', 'r2', ['at']))} ELSE c END AS c,
  {_ending('a', 'rv', sorted(STEM_VERB_Y))} AS y, {_ending('a', 'rv', sorted(STEM_VERB_OTHER))} AS v FROM {name}_9),
{name}_11 AS (SELECT w, rv, CASE WHEN std THEN c WHEN y <> '' AND ends_with({_less('a', 'y')}, 'u') THEN {_less('a', 'y')}
  WHEN v IN ('en', 'es', 'éis', 'emos') AND ends_with({_less('a', 'v')}, 'gu') THEN left({_less('a', 'v')}, length(a) - length(v) - 1)
  ELSE {_less('a', 'v')} END AS d FROM {name}_10),
{name}_12 AS (SELECT w, rv, d, {_ending('d', 'rv', sorted(STEM_RESIDUAL))} AS o FROM {name}_11),
{name} AS (SELECT w, translate(CASE WHEN o IN ('e', 'é') AND ends_with({_less('d', 'o')}, 'gu') AND length(d) - 2 >= rv
  THEN left(d, length(d) - 2) ELSE {_less('d', 'o')} END, 'áéíóú', 'aeiou') AS stem FROM {name}_12)"""
