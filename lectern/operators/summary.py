"""Extractive LSA summary as a Spark job.

Published method (Steinberger and Jezek, 2004, with max-tf smoothing):
term x sentence matrix ``A`` with ``A[t,s] = a + (1-a) * c(t,s) / max_t
c(t,s)`` for every term of the document's vocabulary (columns with no term
stay zero), thin SVD ``A = U S V^T``, sentence score
``sqrt(sum_i s_i^2 v_{i,s}^2)`` over all singular values, best ``n``
sentences returned in text order.

With every singular value kept, ``S V^T = U^T A`` and ``U`` has orthonormal
columns spanning the columns of ``A``, so the score of sentence ``s`` is the
Euclidean norm of column ``s`` of ``A``:

    score^2 = a^2 * V + 2a(1-a) * S1/m + (1-a)^2 * S2/m^2

with ``V`` the vocabulary size of the document and, for the sentence,
``m`` its largest term count, ``S1`` the sum and ``S2`` the sum of squares
of its term counts.  Everything lies in the document's own row: no matrix, no
SVD, no Python, no exchange.

Sentences are maximal runs without ``. ! ?`` or newline, followed by their
terminators, trimmed.  Terms are runs of letters and digits, lower-cased,
minus a stop-word list; with ``stems`` they are the stems of those words
(:mod:`.stemming`).

Time is linear in the text: a document is cut and tokenised once, and every
sentence is scored from its own terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, posexplode_rows
from ..functions.text import strip_ws
from ..params import LSA_SMOOTH, STOP_WORDS_ES, SUMMARY_SENTENCES
from .embedding import tokens
from .stemming import stem_arrays

SENTENCE_RE = r"[^.!?\n]+[.!?]*"


def sentences_of(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    raw = F.regexp_extract_all(t, F.lit(SENTENCE_RE), 0)
    return F.filter(F.transform(raw, lambda s: strip_ws(s)), lambda s: s != "")


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sent_no, sentence)``; ``sent_no`` is 0-based."""
    return posexplode_rows(docs, [id_col], sentences_of(text_col), "sent_no", "sentence")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _terms(sentence, stop_words) -> Column:
    """Non-stop-word terms of a sentence, sorted, so that equal ones meet."""
    return F.array_sort(F.filter(tokens(sentence), lambda t: ~t.isin(*stop_words)))


def _runs(terms: Column) -> Column:
    """``struct(term, cnt)`` of each distinct term of a sorted array."""

    def counted(a):
        first = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (a[i] != a[F.greatest(i - 1, F.lit(0))]))

        def ends(at):
            after = F.concat(F.slice(at, 2, 1 << 30), F.array(F.size(a)))
            return F.zip_with(at, after, lambda lo, hi: F.struct(a[lo].alias("term"), (hi - lo).cast("bigint").alias("cnt")))

        return F.when(F.size(a) > 0, _let(first, ends))

    return _let(terms, counted)


def term_counts(sentences: DataFrame, id_col: str = "doc_id", stop_words=STOP_WORDS_ES, stems: bool = False) -> DataFrame:
    """``(id, sent_no, term, cnt)`` for non-stop-word terms (or their stems),
    counted inside the sentence's own row."""
    if stems:
        words = F.filter(tokens("sentence"), lambda t: ~t.isin(*stop_words))
        sentences = sentences.select(id_col, "sent_no", stem_arrays(F.array(words))[0].alias("_terms"))
        runs = _runs(F.array_sort("_terms"))
    else:
        runs = _runs(_terms(F.col("sentence"), stop_words))
    return explode_rows(sentences, [id_col, "sent_no"], runs, "run").select(
        id_col, "sent_no", F.col("run.term").alias("term"), F.col("run.cnt").alias("cnt")
    )


def _score(vocabulary: Column, terms: Column, smooth: float) -> Column:
    """Score of a sentence from its sorted terms: one walk keeps the length
    of the current run, the longest run (m) and the sum of squares (S2)."""
    start = F.struct(F.lit("").alias("term"), *[F.lit(0).cast("bigint").alias(c) for c in ("run", "m", "s2")])

    def step(acc, t):
        run = F.when(t == acc["term"], acc["run"]).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            t.alias("term"), (run + 1).alias("run"), F.greatest(acc["m"], run + 1).alias("m"), (acc["s2"] + 2 * run + 1).alias("s2")
        )

    a = float(smooth)

    def scored(acc):
        m = acc["m"].cast("double")
        square = (
            F.lit(a * a) * vocabulary.cast("double")
            + F.lit(2 * a * (1 - a)) * F.size(terms).cast("double") / m
            + F.lit((1 - a) * (1 - a)) * acc["s2"].cast("double") / (m * m)
        )
        return F.when(acc["m"] > 0, F.sqrt(square)).otherwise(F.lit(0.0))

    return F.aggregate(terms, start, step, scored)


def _scores(sentences: Column, terms: Column, smooth: float) -> Column:
    """Score, number and text of every sentence of a document from the sorted
    terms of each; NULL without a vocabulary.  The vocabulary size is bound
    outside the sentences, so it is counted once."""

    def scored(s, t):
        def each(v):
            def one(sentence, i):
                score = _let(t[i], lambda own: _score(v, own, smooth))
                return F.struct(score.alias("score"), i.alias("sent_no"), sentence.alias("sentence"))

            return F.when(v > 0, F.transform(s, one))

        return _let(F.size(F.array_distinct(F.flatten(t))), each)

    return _let(sentences, lambda s: _let(terms, lambda t: scored(s, t)))


def _scored(docs: DataFrame, id_col: str, text_col: str, smooth: float, stop_words, stems: bool) -> tuple[DataFrame, Column]:
    """A frame and, in it, the scored sentences of each document, all in its
    own row."""
    if stems:
        cut = docs.select(id_col, sentences_of(text_col).alias("_sentences"))
        words = F.transform("_sentences", lambda s: F.filter(tokens(s), lambda t: ~t.isin(*stop_words)))
        cut = cut.select(id_col, "_sentences", stem_arrays(words).alias("_stems"))
        return cut, _scores(F.col("_sentences"), F.transform("_stems", lambda x: F.array_sort(x)), smooth)

    def both(s):
        return _scores(s, F.transform(s, lambda x: _terms(x, stop_words)), smooth)

    return docs.select(id_col, F.col(text_col).alias("_text")), _let(sentences_of("_text"), both)


def scored_sentences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    smooth: float = LSA_SMOOTH,
    stop_words=STOP_WORDS_ES,
    stems: bool = False,
) -> DataFrame:
    """``(id, sent_no, sentence, score)`` for every sentence of documents
    that have a vocabulary, without an exchange."""
    rows, scored = _scored(docs, id_col, text_col, smooth, stop_words, stems)
    return explode_rows(rows, [id_col], scored, "s").select(id_col, "s.sent_no", "s.sentence", "s.score")


def lsa_summary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = SUMMARY_SENTENCES,
    smooth: float = LSA_SMOOTH,
    stop_words=STOP_WORDS_ES,
    stems: bool = False,
) -> DataFrame:
    """``(id, n_sentences, summary)``: best ``n`` sentences by score (ties:
    earlier first), joined by newlines in text order.  Map-side throughout."""
    rows, scored = _scored(docs, id_col, text_col, smooth, stop_words, stems)

    def best(s):
        ranked = F.array_sort(
            F.transform(s, lambda x: F.struct((-x["score"]).alias("k"), x["sent_no"].alias("i"), x["sentence"].alias("t")))
        )
        return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))

    def summary(b):
        text = F.array_join(F.transform(b, lambda x: x["t"]), "\n")
        return F.when(b.isNotNull(), F.array(F.struct(F.size(b).cast("bigint").alias("n_sentences"), text.alias("summary"))))

    # exploded, not filtered: a filter would be evaluated below, once more
    found = explode_rows(rows, [id_col], _let(_let(scored, best), summary), "s")
    return found.select(id_col, "s.n_sentences", "s.summary")
