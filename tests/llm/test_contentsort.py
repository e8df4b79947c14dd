"""Exact duplicates: brute force, ties, hot groups, plan."""

import hashlib
from collections import Counter, defaultdict

import pytest
from llm_fixtures import DOCS, SF
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import contentsort, queries
from lectern.llm.common import table


def brute(rows, pick=max):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, best, len(ids), sha) for i in ids]
    return Counter(out)


def rows_of(df):
    return [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()]


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_hot_group_ties_nulls_and_long_texts(spark, keep, pick):
    long = "x" * 200_000
    rows = [(i, "copy of copies") for i in range(400)]  # cut in pieces
    rows += [(1000 + i, f"text {i % 150}") for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, None), (None, "no id"), (None, "no id"), (None, "one id"), (7000, "one id")]
    rows += [(3000, long), (3001, long + "y"), (3002, long), (3000, long), (3000, long)]
    rows += [(4000, "á"), (4001, "á"), (4002, "A"), (4003, "a"), (4004, "a ")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    got = contentsort.copies(docs.repartition(5), keep)
    assert Counter(rows_of(got)) == brute(rows, pick)
    kept = [r for r in got.collect() if r["kept"]]
    assert len(kept) == len({t or "" for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_query_on_the_small_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert Counter(rows_of(queries.QUERIES["op13_content_sort"](spark, SF))) == brute(rows)


def test_normalised_texts_and_carried_columns(spark):
    docs = spark.createDataFrame([(1, "A b", "x"), (2, "a B", "y"), (3, "c", "z")], "doc_id long, text string, kept string")
    got = contentsort.unique_documents(docs, normalise=F.lower)
    assert got.columns == ["doc_id", "text", "kept"]
    assert sorted(map(tuple, got.collect())) == [(1, "A b", "x"), (3, "c", "z")]


def test_empty_table_and_wrong_keep(spark):
    empty = spark.createDataFrame([], DOCS)
    assert contentsort.copies(empty).collect() == []
    with pytest.raises(ValueError):
        contentsort.copies(empty, "newest")


def test_texts_are_shuffled_once_and_no_python_runs(spark):
    schema = "head binary, print long, piece long, text string, doc_id long"
    dealt = spark.createDataFrame([(b"a", 1, -1, "a", 1), (b"a", 1, -1, "a", 2)], schema)
    runs = contentsort.runs(dealt, 8, F.col("doc_id").desc(), [])
    size = F.count("*").over(Window.partitionBy(*contentsort.KEY, "run"))
    plan = runs.withColumn("size", size)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
