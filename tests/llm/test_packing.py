import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SF
from tokenizers import Tokenizer

from lectern.llm import packing, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 63, 64, 65, 513, 700, 1023, 1024, 5000])
def test_cuts_lie_in_their_classes(n):
    got = packing.cuts(n)
    assert sum(size for size, _ in got) == n
    for size, k in got:
        assert 1024 // (k + 1) < size <= 1024 // k
        assert k >= packing.UNCUT or size == 1024 // k


@pytest.mark.parametrize("capacity", [64, 1024])
def test_the_table_of_cuts_equals_the_cuts(capacity):
    n = np.array([1, 2, 63, 64, 65, 513, 700, 1023, 1024, 1025, 5000, 2048, 7])
    doc, length, kind = packing.Cutter(capacity)(n)
    got = [list(zip(length[doc == i].tolist(), kind[doc == i].tolist())) for i in range(len(n))]
    assert got == [packing.cuts(int(k), capacity) for k in n]


def check(rows, out, capacity=1024):
    tok = Tokenizer.from_file(BYTE)
    want = defaultdict(list)
    for doc, text in rows:
        want[doc].append(np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for spans in seqs.values():
        at = 0
        for lo, n in sorted(spans):
            assert lo == at
            at += n
        assert at <= capacity
    assert set(docs) == set(want)
    for doc, pieces in docs.items():
        if len(want[doc]) == 1:
            (ids,), at = want[doc], 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
            assert at == len(ids)
        else:
            assert sum(p["length"] for p in pieces) == sum(map(len, want[doc]))
    used = sum(r["length"] for r in out)
    return 1 - used / (len(seqs) * capacity) if seqs else 0


def test_query_equals_brute_force_and_pads_little(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert check(rows, queries.op7_harmonic_packing(spark, SF).collect()) < 0.02


def test_nulls_empty_long_repeats_and_clashing_columns(spark):
    rows = [(3, None), (1, ""), (2, "long word " * 30_000), (None, "no id"), (9, "a"), (9, "a"), (9, "a"), (4, "x<|endoftext|> y")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, class int, worker string")
    check(rows, packing.pack(df, BYTE).collect())
    assert packing.pack(df.limit(0), BYTE).collect() == []


def test_many_short_documents(spark):
    rows = [(i, "word " * (i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert check(rows, packing.pack(df, BYTE).collect()) < 0.06


def test_memory_goes_back_after_every_slice_of_texts(monkeypatch):
    import pyarrow as pa

    from lectern.llm import tokenizing

    returned, slices = [], []

    class Pool:
        def release_unused(self):
            returned.append(len(slices))

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    for lo, hi in tokenizing.text_batches(pa.array(["ab", None, "", "cdef", "g", "hi"]), 4):
        slices.append((lo, hi))
    assert slices == [(0, 4), (4, 6)]
    assert returned == [1, 2]
