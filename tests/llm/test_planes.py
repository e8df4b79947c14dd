import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import planes, queries
from lectern.llm.tokenizing import Encoder, encoder

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def split(enc, texts):
    ids, n = enc.ended(texts, 7)
    parts = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
    assert all(p[-1] == 7 for p in parts)
    return [p[:-1].tolist() for p in parts]


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab é.,'\n\t ñΣ12-\x01\u2028\u0301s<|", max_size=30), max_size=8))
def test_encoder_equals_the_library(path, texts):
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert split(encoder(path), texts) == want


MARKS = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", " ", "a", "b.\nc", "\n", "word,\nNext line.\n"]


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(MARKS), max_size=6).map("".join), max_size=8))
def test_added_tokens_and_lines_equal_an_untouched_tokenizer(path, texts):
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert split(encoder(path), texts) == want


def test_a_text_that_spells_an_added_token():
    assert split(encoder(WORD), ["a <|endoftext|> b"]) == [[320, 49407, 321]]
    assert split(encoder(BYTE), ["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


def test_a_small_cache_changes_nothing(monkeypatch):
    rows = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()
    texts = [t or "" for (t,) in rows]
    enc = Encoder(BYTE)
    enc.KEEP = 50
    got = [ids for lo in range(0, len(texts), 20) for ids in split(enc, texts[lo : lo + 20])]
    assert got == [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("layout", ["bits", "bytes"])
@pytest.mark.parametrize("n", [0, 1, 7, 4096])
def test_planes_round_trip(layout, n):
    ids = np.random.default_rng(n).integers(0, 1 << 17, n).astype("<u4")
    assert (planes.from_planes(planes.to_planes(ids, 17, layout), n, layout) == ids).all()


@pytest.mark.parametrize("layout", ["bits", "bytes"])
def test_file_chunks_are_read_alone(tmp_path, layout):
    w = planes.PlaneWriter(16, layout, block=100)
    ids = np.arange(950, dtype="<u4") % 300
    raw = planes.MAGIC
    for lo in range(0, 950, 95):
        w.add([lo], np.array([95]), ids[lo : lo + 95])
        raw += b"".join(w.flush())
    raw += b"".join(w.flush(last=True))
    (tmp_path / "f").write_bytes(raw)
    with open(tmp_path / "f", "rb") as f:
        index = planes.read_index(f, len(raw))
        assert [n for _, n, _ in index["chunks"]] == [100] * 9 + [50]
        assert (planes.read_chunk(f, index, 4) == ids[400:500]).all()
        assert planes.read_docs(f, index)[:, 2].tolist() == [95] * 10


def brute(rows, path=WORD):
    tok = Tokenizer.from_file(path)
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = queries.op4_bit_planes(spark, SF).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_nulls_empty_long_and_clashing_columns(spark):
    rows = [(3, None), (1, ""), (2, "long word " * 60_000), (None, "no id"), (9, " "), (11, "x<|endoftext|>\n<|startoftext|> y")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part int, path string")
    got = sorted(map(tuple, planes.round_trip(df, WORD).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert planes.round_trip(df.limit(0), WORD).collect() == []


def test_repeated_rows_keep_gapless_starts(spark):
    df = spark.createDataFrame([(5, "same text")] * 40 + [(4, "other")], "doc_id long, text string")
    got = sorted(planes.round_trip(df, WORD).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [4] + [5] * 40


def test_a_piece_is_asked_for_once_a_call():
    """Repeats inside a batch are found by Arrow, and a word before a stop is
    the word that is known already."""
    enc = Encoder(BYTE)
    asked, spelt, known, one = [], [], enc._known, enc._spelt
    enc._known = lambda pieces: asked.extend(pieces) or known(pieces)
    enc._spelt = lambda word, spaced: spelt.append(word) or one(word, spaced)
    texts = ["A vilona brunt A vilona, brunt.", "vilona vilona brunt", "", " ", "x\ny vilona.\nBrunt  z", "vilona<|endoftext|> brunt"] * 50
    assert split(enc, texts) == [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert sorted(asked) == sorted(set(asked))
    assert spelt.count("vilona") == spelt.count("brunt") == 1
