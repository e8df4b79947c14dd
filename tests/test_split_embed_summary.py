"""Recursive splitter, default embedding and the LSA summary."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lectern.operators import chunking as C
from lectern.operators import embedding as E
from lectern.operators import stemming
from lectern.operators import summary as M
from lectern.params import STOP_WORDS_ES


def test_split_worked_examples():
    text = "aaaa bbbb cccc dddd"
    assert C.split_text(text, 10, 4, (" ", "")) == ["aaaa bbbb", "cccc dddd"]
    assert C.split_text(text, 10, 5, (" ", "")) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert C.split_text("ab\n\ncd", 3, 0) == ["ab", "cd"]
    assert C.split_text("   ", 10, 2) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=60))
def test_short_text_is_one_stripped_split(text):
    # the native fast path assumes this for texts no longer than the size
    expected = [text.strip()] if text.strip() else []
    assert C.split_text(text, 60, 10) == expected


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc \n", min_size=1, max_size=300))
def test_splits_bounded_and_in_text(text):
    parts = C.split_text(text, 20, 5)
    for p in parts:
        assert len(p) <= 20
        assert p in text
    # nothing is lost: every non-space character is covered
    assert set("".join(parts)) >= set(text) - {" ", "\n"}


def test_recursive_split_fast_and_slow_paths(spark):
    long = ("word " * 2000).strip()
    df = spark.createDataFrame([(1, "  short text \n"), (2, long), (3, ""), (4, None)], "id int, t string")
    rows = C.recursive_split(df, "t", keep=["id"]).orderBy("id", "split_no").collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["id"], []).append(r["split"])
    assert by_id[1] == ["short text"]
    assert by_id[2] == C.split_text(long)
    assert all(len(s) <= 4000 for s in by_id[2]) and len(by_id[2]) == 3
    assert 3 not in by_id and 4 not in by_id


def test_bucket_known_value_and_hook_equals_the_native_form(spark):
    assert E.bucket_of("hola", 256) == 33
    df = spark.createDataFrame([("Hola, hola año_ß 12 été",), ("",), ("...",)], "t string")
    both = E.with_hashed_embedding(df, "t", "a", 64)
    both = E.embed_with(both, "t", lambda texts: E.embed_texts(texts, 64), "b", T.DoubleType())
    for r in both.collect():
        assert np.allclose(r["a"], r["b"], atol=0)


def test_embed_with_gives_every_text_its_vector(spark):
    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(50)], "id int, t string").repartition(3)
    out = E.embed_with(df, "t", lambda texts: [[len(t), 1.0] for t in texts])
    assert {r["id"]: r["embedding"] for r in out.collect()} == {i: [float(i), 1.0] for i in range(50)}


def test_embedding_normalised_and_empty(spark):
    df = spark.createDataFrame([(1, "Hola hola, mundo!"), (2, ""), (3, "...")], "id int, t string")
    rows = {r["id"]: r["e"] for r in E.with_hashed_embedding(df, "t", "e", 64).collect()}
    v = np.asarray(rows[1])
    assert math.isclose(float(v @ v), 1.0, rel_tol=1e-12)
    assert v[E.bucket_of("hola", 64)] == v.max()
    assert not np.any(rows[2]) and not np.any(rows[3])


def _svd_scores(text, smooth=0.4):
    """Sentences, and their scores by an explicit SVD of the smoothed matrix."""
    sentences = [s.strip() for s in re.findall(r"[^.!?\n]+[.!?]*", text) if s.strip()]
    words = [[w for w in re.findall(r"[^\W_]+", s.lower()) if w not in STOP_WORDS_ES] for s in sentences]
    counts = np.array([[ws.count(t) for ws in words] for t in sorted(set(sum(words, [])))], float)
    top = counts.max(0)
    a = np.where(top > 0, smooth + (1 - smooth) * counts / np.maximum(top, 1), 0)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    return sentences, np.linalg.norm(s[:, None] * vt, axis=0)


def test_lsa_score_equals_svd(spark):
    text = (
        "El tribunal convoca plazas de auxiliar. Las plazas de auxiliar se cubren por concurso! "
        "El plazo termina en mayo.\nSe publica la lista de admitidos. Nada mas. "
        "Auxiliar auxiliar auxiliar? Concurso de traslados para plazas vacantes."
    )
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    scored = M.scored_sentences(docs).orderBy("sent_no").collect()
    sentences, ranks = _svd_scores(text)
    expected_summary = [sentences[i] for i in sorted(np.argsort(-ranks, kind="stable")[:3])]
    assert np.allclose([r["score"] for r in scored], ranks, rtol=1e-9, atol=1e-12)
    got = M.lsa_summary(docs, n=3).first()["summary"].split("\n")
    assert got == expected_summary


def test_lsa_summary_invariants(spark):
    text = "Uno dos tres. Cuatro cinco! Seis siete ocho nueve. Diez."
    docs = spark.createDataFrame([(1, text), (2, "de la y."), (3, "")], "doc_id int, text string")
    out = {r["doc_id"]: r for r in M.lsa_summary(docs, n=2).collect()}
    assert set(out) == {1}  # no vocabulary, no summary
    lines = out[1]["summary"].split("\n")
    assert len(lines) == 2 and all(line in text for line in lines)
    assert text.index(lines[0]) < text.index(lines[1])


def test_long_sentence_of_equal_terms_is_fast(spark):
    docs = spark.createDataFrame([(1, "palabra otra " * 20_000)], "doc_id int, text string")
    assert M.scored_sentences(docs).count() == 1
    got = {r["term"]: r["cnt"] for r in M.term_counts(M.split_sentences(docs)).collect()}
    assert got == {"palabra": 20_000}  # "otra" is a stop word


def test_summary_tokenises_a_text_once_and_in_linear_time(spark):
    import time

    docs = spark.createDataFrame([(1, "uno dos tres. cuatro cinco.")], "doc_id int, text string")
    plan = M.lsa_summary(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(E.NON_TOKEN_RE) <= 2
    assert plan.count(M.SENTENCE_RE) == 1

    def seconds(n):
        text = " ".join(f"frase {i} sobre el tema {i % 97} de plazas." for i in range(n))
        best = []
        for _ in range(3):
            t0 = time.perf_counter()
            assert M.lsa_summary(spark.createDataFrame([(1, text)], "doc_id int, text string")).count() == 1
            best.append(time.perf_counter() - t0)
        return min(best)

    seconds(1000)
    assert seconds(40_000) < 6 * max(seconds(20_000), 0.3)  # quadratic work on 40,000 sentences takes minutes


# Pairs published with the Spanish Snowball stemmer.
STEMS = """checa chec checar chec checoslovaquia checoslovaqui chelo chel chemise chemis cheque chequ chequeo cheque
cheques chequ chesca chesc chester chest chetumaleños chetumaleñ cheyene cheyen chía chi chiapaneca chiapanec
chiapas chiap chicharrones chicharron chichen chich torá tor tórax torax torcer torc toreado tor toreándolo tor
torearlo tor toreó tore torero torer tormentas torment tornen torn torneo torne torniquete torniquet torpedearon torped
torpeza torpez torrencial torrencial torrenciales torrencial torreón torreon torrescano torrescan""".split()


@pytest.mark.parametrize("word,expected", list(zip(STEMS[::2], STEMS[1::2])))
def test_published_stems(word, expected):
    assert stemming.stem(word) == expected


@pytest.mark.parametrize(
    "word,expected",
    [
        ("efectivamente", "efect"), ("administrativamente", "administr"), ("posiblemente", "posibl"), ("biología", "biolog"),
        ("construyendo", "constru"), ("haciéndola", "hac"), ("paguen", "pag"), ("averigüe", "averigü"), ("", ""), ("a", "a"), ("yo", "yo"),
    ],
)
def test_every_step_of_the_stemmer(word, expected):
    assert stemming.stem(word) == expected


def test_stems_are_made_once_a_distinct_word(monkeypatch):
    import pandas as pd

    seen = []
    monkeypatch.setattr(stemming, "stem", lambda w: seen.append(w) or w[:3])
    monkeypatch.setattr(stemming, "_STEMS", {})
    out = stemming._stem_lists(pd.Series([[["plazas", "plazas"], None], None, [["plazas", "cargo"]]]))
    assert out.tolist() == [[["pla", "pla"], None], None, [["pla", "car"]]]
    assert sorted(seen) == ["cargo", "plazas"]


def test_summary_over_stems_equals_svd(spark):
    text = (
        "El tribunal convoca una plaza de auxiliar. Las plazas de auxiliares se cubren por concursos! "
        "El plazo termina en mayo.\nSe publican las listas de admitidos. Nada mas. "
        "Auxiliar auxiliares auxiliar? Concurso de traslados para plazas vacantes."
    )
    docs = spark.createDataFrame([(1, text), (2, None), (3, "de la y.")], "doc_id int, text string")
    sentences = [s.strip() for s in re.findall(r"[^.!?\n]+[.!?]*", text) if s.strip()]
    words = [[stemming.stem(w) for w in re.findall(r"[^\W_]+", s.lower()) if w not in STOP_WORDS_ES] for s in sentences]
    counts = np.array([[ws.count(t) for ws in words] for t in sorted(set(sum(words, [])))], float)
    top = counts.max(0)
    a = np.where(top > 0, 0.4 + 0.6 * counts / np.maximum(top, 1), 0)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    ranks = np.linalg.norm(s[:, None] * vt, axis=0)
    scored = M.scored_sentences(docs, stems=True).orderBy("sent_no").collect()
    assert np.allclose([r["score"] for r in scored], ranks, rtol=1e-9, atol=1e-12)
    got = M.lsa_summary(docs, n=3, stems=True).collect()
    assert [r["summary"].split("\n") for r in got] == [[sentences[i] for i in sorted(np.argsort(-ranks, kind="stable")[:3])]]
