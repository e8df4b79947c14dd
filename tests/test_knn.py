"""Exact k-NN against brute force, ties, small corpora, question blocks."""

import numpy as np
import pytest

from lectern.operators import knn as K


def _brute(corpus, questions, k):
    out = {}
    for qid, q in questions:
        d = [(round(float(np.sum((np.asarray(v, float) - np.asarray(q, float)) ** 2)), 9), cid) for cid, v in corpus]
        out[qid] = [cid for _, cid in sorted(d)[:k]]
    return out


def _run(spark, corpus, questions, k, **kw):
    c = spark.createDataFrame(corpus, "id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(questions, "qid long, embedding array<float>")
    hits = K.knn(c, q, k=k, **kw).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["id"])
    return got, hits


@pytest.mark.parametrize("k", [1, 4])
def test_matches_brute_force(spark, k):
    rng = np.random.default_rng(7)
    corpus = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    questions = [(100 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(7)]
    got, _ = _run(spark, corpus, questions, k)
    assert got == _brute(corpus, questions, k)


def test_ties_broken_by_id_and_short_corpus(spark):
    v = [1.0, 0.0]
    corpus = [(5, v), (2, v), (9, [0.0, 1.0])]
    got, hits = _run(spark, corpus, [(1, v)], 4)
    assert got == {1: [2, 5, 9]}  # equal vectors: smaller id first; 3 < k rows
    assert sorted(round(h["dist"], 6) for h in hits) == [0.0, 0.0, 2.0]


@pytest.mark.parametrize("group_bytes", [1 << 30, 200])
def test_more_questions_than_fit_are_asked_in_blocks(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(K, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(3)
    corpus = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(80)] + [(900, corpus_tie := [0.5] * 4), (901, corpus_tie)]
    questions = [(200 + i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)] + [(300, corpus_tie)]
    got, hits = _run(spark, corpus, questions, 3, max_bytes=100)
    assert got == _brute(corpus, questions, 3)
    assert {(r["qid"], r["rank"], r["id"], r["dist"]) for r in hits} == {
        (r["qid"], r["rank"], r["id"], r["dist"]) for r in _run(spark, corpus, questions, 3)[1]
    }


def test_blocks_leave_out_missing_vectors_and_take_text_ids(spark):
    c = spark.createDataFrame([("a", [0.0]), ("b", None), ("c", [2.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([("x", [0.1]), ("y", None), ("z", [3.0])], "qid string, embedding array<float>")
    for max_bytes in (1 << 20, 8):
        got = {(r["qid"], r["rank"], r["id"]) for r in K.knn(c, q, k=2, max_bytes=max_bytes).collect()}
        assert got == {("x", 1, "a"), ("x", 2, "c"), ("z", 1, "c"), ("z", 2, "a")}


def test_no_question_of_a_blocked_join_reaches_the_driver(spark, monkeypatch):
    monkeypatch.setattr(K, "_batch", None)
    c = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "id long, embedding array<float>")
    hits = K.knn(c, c.withColumnRenamed("id", "qid"), k=1, max_bytes=16)
    assert {(r["qid"], r["id"]) for r in hits.collect()} == {(i, i) for i in range(9)}


def test_order_holds_at_small_scales(spark):
    corpus = [(i, [(10 - i) * 1e-6, 0.0]) for i in range(1, 6)]
    got, _ = _run(spark, corpus, [(1, [0.0, 0.0])], 2)
    assert got == {1: [5, 4]}


def test_order_holds_far_from_the_origin(spark):
    corpus = [(i, [1e6 + i / 8, -1e6]) for i in range(9)]
    got, _ = _run(spark, corpus, [(1, [1e6 + 0.5, -1e6])], 3)
    assert got == {1: [4, 3, 5]}


def test_a_task_yields_k_rows_a_question(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(30_000)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, embedding array<double>")
    hits = K.knn(corpus, q, k=2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan
    seen = []
    best = K._Best(np.zeros((1, 2)), 2)
    for lo in range(0, 30_000, 10_000):
        part = rows[lo : lo + 10_000]
        best.add(np.array([i for i, _ in part], object), np.array([v for _, v in part]))
        seen.append(len(best.ids[0]))
    assert seen == [2, 2, 2]
    assert [r["id"] for r in hits.orderBy("rank").collect()] == sorted(range(30_000), key=lambda i: sum(x * x for x in rows[i][1]))[:2]


def test_empty_sides(spark):
    assert _run(spark, [(1, [0.0])], [], 2)[0] == {}
    assert _run(spark, [], [(1, [0.0])], 2)[0] == {}


def test_dimension_mismatch_raises(spark):
    corpus = [(1, [1.0, 2.0]), (2, [1.0])]
    with pytest.raises(Exception):
        _run(spark, corpus, [(1, [0.0, 0.0])], 1)
