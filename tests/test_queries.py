"""Every registered query against its DuckDB oracle (sf0.001), the
streaming queries against their batch forms, and the entry point."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables missing")

QUERIES = {k: f for k, f in entry_mod.queries().items() if not k.startswith("op") and k != "pipeline"}
ORACLES = {k: q for k, q in entry_mod.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert res["cols_match"], res
    assert res["rows_match"], res
    assert res["values_match"], res


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_stream_equals_batch(spark):
    stream = QUERIES["stream_chunks"](spark, SF)
    batch = QUERIES["resumen_rows"](spark, SF)
    assert sorted(map(tuple, stream.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"qid", "n_hits", "context"}
    assert all(r["n_hits"] == 4 for r in rows)


def test_every_key_has_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 45


def test_recursive_split_matches_brute_force(spark):
    """Rows-only query checked against the splitter applied row by row on
    the driver (small fixture), fast path included."""
    import pandas as pd

    from lectern.operators.chunking import split_text

    got = {}
    for r in QUERIES["recursive_split"](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["split_no"], r["split"]))
    docs = pd.read_parquet(os.path.join(SF, "documents.parquet"), columns=["doc_id", "text"])
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        expected = split_text(text)
        assert [s for _, s in sorted(got.get(doc_id, []))] == expected, doc_id
        assert all(len(s) <= 4000 for s in expected)


@pytest.mark.parametrize(("name", "table"), [("stream_chunks", "pages"), ("stream_session_log", "conversations")])
def test_streams_read_a_table_of_many_files(spark, tmp_path, name, table):
    """A table may be a folder of files, more of them than one micro-batch takes."""
    spark.read.parquet(f"{SF}/{table}.parquet").repartition(20).write.parquet(str(tmp_path / f"{table}.parquet"))
    one, many = QUERIES[name](spark, SF), QUERIES[name](spark, str(tmp_path))
    assert one.count() > 0
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))


@pytest.mark.parametrize(("name", "table"), [("stream_chunks", "pages"), ("stream_session_log", "conversations")])
def test_streams_of_a_table_without_rows(spark, tmp_path, name, table):
    spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
