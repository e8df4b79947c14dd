import re

import duckdb
import pytest
from llm_fixtures import DOCS, SF
from test_minmax import brute as near_brute
from test_packing import check as packed_check
from test_pii import mask, spans

import corpus_pipeline
from lectern.llm import decontaminate
from lectern.llm.common import table


@pytest.fixture(scope="module")
def stages(spark):
    """The output of every stage over all documents, each on the one before."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_are_the_five(stages):
    assert list(stages) == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_language_keeps_what_has_letters(spark, stages):
    docs, kept = rows(table(spark, SF, "documents")), rows(stages["language"])
    assert set(kept) == {d for d, r in docs.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert all(kept[d]["text"] == docs[d]["text"] and kept[d]["lang"] == docs[d]["lang"] for d in kept)


def test_one_of_each_group_stays(stages):
    before = [(d, r["text"]) for d, r in rows(stages["language"]).items()]
    assert set(rows(stages["near_duplicates"])) == {d for d, _, _, kept in near_brute(before, 5) if kept}


def test_leaks_go(stages):
    items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    plain = [p for (t,) in items if len((p := " ".join(re.findall(r"\w+", t.lower()))).split()) >= decontaminate.MIN_WORDS]

    def leaked(text):
        text = f" {' '.join(re.findall(r'\w+', text.lower()))} "
        return any(f" {p} " in text for p in plain)

    before = rows(stages["near_duplicates"])
    assert set(rows(stages["decontamination"])) == {d for d, r in before.items() if not leaked(r["text"])}


def test_personal_data_goes(stages):
    before, after = rows(stages["decontamination"]), rows(stages["personal_data"])
    assert set(before) == set(after)
    assert any(spans(r["text"]) for r in before.values())
    for d, r in after.items():
        assert r["text"] == mask(before[d]["text"], spans(before[d]["text"])) and r["n_chars"] == len(r["text"])


def test_the_rest_is_packed_whole(stages):
    assert packed_check([(d, r["text"]) for d, r in rows(stages["personal_data"]).items()], stages["packing"].collect()) < 0.02


def test_stages_keep_the_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, " 12 ", "en", "s", 4)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "ids_crc32").collect())) == sorted(
        map(tuple, stages["packing"].select("doc_id", "start", "ids_crc32").collect())
    )


def test_documents_without_any_label_stay(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(["One text", "ein Text", None, "", "12 34", "текст"])], DOCS)
    kept = rows(corpus_pipeline.language(spark, docs, SF))
    assert {d: (r["text"], r["lang"]) for d, r in kept.items()} == {0: ("One text", None), 1: ("ein Text", None), 5: ("текст", None)}
    assert corpus_pipeline.language(spark, docs, SF).columns == docs.columns


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark):
    """Ten thousand rows of 4,000 characters were one batch of 40 MB."""
    spark.conf.unset(corpus_pipeline.BATCH_SETTING)
    docs = spark.range(10_000).selectExpr("id AS doc_id", "repeat('word ', 800) AS text", "'en' AS lang", "'s' AS source", "1 AS n_chars")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    corpus_pipeline.packed(spark, docs.limit(1), SF)
    got = docs.coalesce(1).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 10_000
    assert max(r["size"] for r in got) <= corpus_pipeline.BATCH_BYTES + 8192
    spark.conf.set(corpus_pipeline.BATCH_SETTING, "1000000")
    corpus_pipeline.packed(spark, docs.limit(1), SF)
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == "1000000"
    spark.conf.unset(corpus_pipeline.BATCH_SETTING)
