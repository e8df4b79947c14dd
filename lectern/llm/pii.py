"""Personal data: fixed patterns, and information-theoretic sanitisation of
the terms that give them away.  DataFrame functions only.

Patterns find emails, addresses, card and phone numbers; their values are the
protected entities.  Every word of a document that holds an entity *e* is a
suspect.  Over the whole corpus, with document counts,

    IC(e)     = -log2 df(e)/N                     information in the entity
    PMI(e, t) = log2 N * df(e, t) / (df(e) * df(t))
    share     = PMI / IC                          1: the term gives e away

where df(e, t) counts documents that have both.  A term whose share reaches
``generalise`` is replaced by its kind, one that reaches ``remove`` by a blank
mark, wherever it stands in a document that holds the entity.

Copies of one text are one document, and documents in which an entity stands
in the same surroundings (``AROUND`` characters on either side: copies with a
changed end) are one observation of it.  At least ``contexts`` observations
must show a pair: a word met once beside an entity says nothing.

share >= g needs df(t) <= df(e) * (N / df(e)) ** (1 - g), since df(e, t) is at
most df(e): frequent words leave before any pair is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

# Fixed patterns.  They match what the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
# match, in linear time and constant stack: repetitions are possessive, and a
# run is tried from its start (or from the end of the last match) only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
#: Quick tests that a text may hold a kind.
MAY = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
}
TERM = r"\p{L}[\p{L}\p{N}'’-]{2,}+"
AROUND = 120
CONTEXTS = 3
GENERALISE, REMOVE = 0.8, 0.95
#: Array steps are taken in groups of this size, so that long arrays cost
#: far less than the square of their length.
GROUP = 128


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(x: Column, zero: int, step) -> Column:
    """For each element, ``step`` folded over the elements before it."""

    def scan(part, start):
        first = F.struct(F.array().cast("array<bigint>").alias("out"), start.alias("at"))
        return F.aggregate(
            part,
            first,
            lambda acc, v: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), step(acc["at"], v).alias("at")),
            lambda acc: acc["out"],
        )

    def over(a):
        last = ((F.size(a) - 1) / GROUP).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * GROUP + 1, GROUP))

        def joined(p):
            totals = F.transform(p, lambda q: F.aggregate(q, F.lit(zero).cast("bigint"), step))
            return F.flatten(F.zip_with(p, scan(totals, F.lit(zero).cast("bigint")), scan))

        return F.when(F.size(a) > 0, let(parts, joined)).otherwise(F.array().cast("array<bigint>"))

    return let(x, over)


def matches(text: Column, regex: str, make) -> Column:
    """``make(start, value, gap before, gap after)`` for every match of a
    pattern: extracting gives the values, splitting the gaps between them."""
    pattern = F.lit(regex)

    def placed(m, g):
        lengths = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda a, b: (F.length(a) + F.length(b)).cast("bigint"))
        index = F.sequence(F.lit(0), F.size(m) - 1)
        return let(
            running(lengths, 0, lambda a, v: a + v),
            lambda at: F.transform(
                index,
                lambda i: let(
                    at[i] + F.length(g[i]), lambda start: make(start, m[i], g[i], g[i + 1])
                ),
            ),
        )

    def found(m):
        return F.when(F.size(m) > 0, let(F.split(text, regex, -1), lambda g: placed(m, g)))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), found)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """The checksum of a digit string holds."""

    def add(acc, i):
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return value.rlike(f"^{part}\\.{part}\\.{part}\\.{part}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


SPAN = "struct<start:bigint,kind:int,end:bigint,entity:string,context:bigint>"


def _spans(text: Column, kind: str) -> Column:
    regex = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]

    def make(start, value, before, after):
        # for values that are no personal data nothing more is computed
        return F.when(
            _sound(kind, value),
            F.struct(
                start.cast("bigint").alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (start + F.length(value)).cast("bigint").alias("end"),
                _entity(kind, value).alias("entity"),
                F.xxhash64(F.right(before, F.lit(AROUND)), F.left(after, F.lit(AROUND))).alias("context"),
            ).cast(SPAN),
        )

    may = text.contains(MAY[kind]) if kind == "email" else text.rlike(MAY[kind])
    found = F.when(may, F.filter(matches(text, regex, make), lambda s: s.isNotNull()))
    return F.coalesce(found, F.array().cast(f"array<{SPAN}>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, ``spans`` sorted by start, then
    kind, and the text as ``body`` where there are any."""
    spans = F.concat(*[_spans(F.col("body"), k) for k in KINDS[:4]])
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("body"))
    found = rows.select("doc_id", F.xxhash64("body").alias("text_hash"), F.array_sort(spans).alias("spans"), "body")
    return found.withColumn("body", F.when(F.size("spans") > 0, F.col("body")))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """``text_hash, body`` once a text: copies are one document."""
    return texts.select("text_hash", "body").dropDuplicates(["text_hash"])


def words_of(texts: DataFrame) -> DataFrame:
    """``text_hash, term``: the distinct words of each text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(TERM), F.lit(0)))
    return texts.select("text_hash", F.explode(words).alias("term"))


def observations(base: DataFrame) -> DataFrame:
    """``text_hash, entity, context``: each entity of each distinct text, with
    its first surroundings there."""
    spans = base.select("text_hash", F.explode("spans").alias("s"))
    return spans.groupBy("text_hash", "s.entity").agg(F.min_by("s.context", "s.start").alias("context"))


def disclosing_terms(
    docs: DataFrame, held: DataFrame, seen: DataFrame, total: int, contexts: int, generalise: float
) -> tuple[DataFrame, DataFrame]:
    """``entity, term, share`` of the words that give an entity away, and the
    suspects ``text_hash, term``.  ``held`` are the distinct texts that hold
    entities, ``seen`` the entities observed in them, ``total`` the number of
    all distinct texts of ``docs``."""
    per_entity = seen.groupBy("entity").agg(F.count_distinct("context").alias("df_entity"), F.count("*").alias("texts"))
    per_entity = per_entity.where(F.col("df_entity") >= contexts)
    bound = F.col("df_entity") * F.pow(F.lit(float(max(total, 1))) / F.col("df_entity"), F.lit(1 - generalise))
    # a hair above, for the rounding of the power
    per_entity = written(per_entity.withColumn("df_most", F.floor(bound * (1 + 1e-9))), "pii-entities")
    most, n_seen = per_entity.agg(F.max("df_most"), F.sum("texts")).first()
    observed = join_hot(seen, per_entity, ["entity"], "texts", n_seen or 0)

    text = F.coalesce("text", F.lit(""))
    every = words_of(distinct_texts(docs.select(F.xxhash64(text).alias("text_hash"), text.alias("body"))))
    rare = every.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(contexts, F.lit(most or 0)))
    suspects = words_of(held.join(observed.select("text_hash").distinct(), "text_hash", "left_semi"))
    suspects = written(suspects.join(rare, "term"), "pii-suspects")
    pairs = suspects.join(observed, "text_hash").where(F.col("df") <= F.col("df_most"))
    counted = pairs.groupBy("entity", "term", "df_entity", "df").agg(F.count_distinct("context").alias("df_pair"))
    n = F.lit(float(max(total, 1)))
    information = F.log2(n / F.col("df_entity"))
    pmi = F.log2(n * F.col("df_pair") / (F.col("df_entity") * F.col("df")))
    scored = counted.where(F.col("df_pair") >= contexts).withColumn("share", F.when(information > 0, pmi / information))
    return scored.select("entity", "term", "share").where(F.col("share") >= generalise), suspects.select("text_hash", "term")


TERMS = "array<struct<start:bigint,kind:int,end:bigint,mark:string>>"


def _term_spans(body: Column, shares: Column, remove: float) -> Column:
    """Where the words of a map (term -> share) stand in a text."""
    mark = lambda term, share: F.when(share >= remove, "[REDACTED]").otherwise(
        F.when(term.rlike("[0-9]"), "[CODE]").otherwise("[TERM]")
    )

    def make(start, value, _before, _after):
        def marked(share):
            return F.struct(
                start.cast("bigint").alias("start"), F.lit(KINDS.index("term")).alias("kind"),
                (start + F.length(value)).cast("bigint").alias("end"), mark(F.lower(value), share).alias("mark"),
            )

        return let(F.try_element_at(shares, F.lower(value)), lambda share: F.when(share.isNotNull(), marked(share)))

    found = F.filter(matches(body, TERM, make), lambda x: x.isNotNull())
    return F.coalesce(found, F.array()).cast(TERMS)


def find(
    docs: DataFrame, contexts: int = CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, text_hash, base, terms``.

    ``base`` holds the pattern spans (start, kind, end), ``terms`` the spans
    of disclosing terms (start, kind, end, mark), both sorted, in code
    points, ends exclusive; terms that touch a base span are left out.  Null
    text is empty; null and repeated ids are rows like others; other columns
    are not read."""
    base = written(base_spans(docs), "pii-spans")
    with_any = base.where(F.size("spans") > 0)
    seen = written(observations(with_any), "pii-seen")
    copies = base.groupBy("text_hash").agg(F.count("*").alias("copies"))
    counts = copies.agg(F.count("*").alias("texts"), F.sum("copies").alias("rows")).first()
    texts = distinct_texts(with_any)
    flagged, suspects = disclosing_terms(docs, texts, seen, counts["texts"], contexts, generalise)

    # the words that give away an entity of the same text; the strictest share counts
    held = suspects.join(written(flagged, "pii-terms"), "term").join(seen.select("text_hash", "entity"), ["text_hash", "entity"])
    held = held.groupBy("text_hash", "term").agg(F.max("share").alias("share"))
    held = held.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    placed = texts.join(held, "text_hash").select("text_hash", _term_spans(F.col("body"), F.col("shares"), remove).alias("terms"))
    placed = written(placed.join(copies, "text_hash"), "pii-places")

    base, total = base.drop("body"), counts["rows"] or 0
    with_terms = join_hot(base, placed, ["text_hash"], "copies", total)
    clear = F.filter(
        "terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))
    )
    slim = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    plain = base.join(placed.select("text_hash"), "text_hash", "left_anti").withColumn("terms", F.array().cast(TERMS))
    every = with_terms.withColumn("terms", clear).unionByName(plain)
    return every.select("doc_id", "text_hash", slim.alias("base"), "terms")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _cut(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans."""
    found = find(docs, **options)
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(4)]
    every = F.array_sort(F.concat("base", F.transform("terms", _cut)))
    return found.select(
        "doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, mark; sorted by start) replaced
    by its mark; of overlapping spans the first gives the mark."""

    def build(all_, reach):
        last = ((F.size(all_) - 1) / GROUP).cast("int")

        def group(g):
            lo = g * GROUP
            begin = reach[lo]
            part = let(
                F.slice(all_, lo + 1, GROUP),
                lambda some: let(
                    F.substring(text, begin + 1, F.array_max(F.transform(some, lambda s: s["end"])) - begin),
                    lambda sub: F.array_join(
                        F.zip_with(
                            some,
                            F.slice(reach, lo + 1, GROUP),
                            lambda s, at: F.when(
                                s["start"] >= at,
                                F.concat(F.substring(sub, at - begin + 1, s["start"] - at), s["mark"]),
                            ).otherwise(""),
                        ),
                        "",
                    ),
                ),
            )
            return part

        tail = F.array_max(F.transform(all_, lambda s: s["end"]))
        pieces = F.array_join(F.transform(F.sequence(F.lit(0), last), group), "")
        return F.concat(pieces, F.substring(text, tail + 1, F.length(text)))

    def over(all_):
        ends = F.transform(all_, lambda s: s["end"])
        return let(running(ends, 0, lambda a, v: F.greatest(a, v)), lambda reach: build(all_, reach))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, over))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the spans of ``find`` replaced in ``text`` (and
    ``n_chars``, where present, counted anew); all rows and columns stay, a
    null text stays null.  Rows are matched to their spans by doc_id and text."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])
    marked = F.transform(
        "base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tags[s["kind"]].alias("mark"))
    )
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["mark"].alias("mark")))
    found = find(docs, **options).where("size(base) > 0")
    found = found.select(
        F.col("doc_id").alias("span_doc"),
        F.col("text_hash").alias("span_hash"),
        F.array_sort(F.concat(marked, terms)).alias("pii_spans"),
    ).dropDuplicates(["span_doc", "span_hash"])
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("span_doc")) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("span_hash")
    )
    names = docs.columns
    joined = docs.join(found, on, "left")
    text = F.when(F.col("pii_spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("pii_spans")))
    out = joined.select(*[text.alias(c) if c == "text" else docs[c] for c in names])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
