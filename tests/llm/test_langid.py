import zlib

import duckdb
import numpy as np
import pytest
from llm_fixtures import SF

from lectern.llm import langid, queries


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(1)
    texts = [("aa", "tha then thing of the and "), ("bb", "der und schön nicht für ein ")]
    passages, y = [], []
    for k, (_, t) in enumerate(texts):
        for _ in range(60):
            w = t.split()
            passages.append(" ".join(rng.choice(w, 12)).encode())
            y.append(k)
    return langid.Network(["aa", "bb"], hidden=6).fit(passages, y, steps=80)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=3)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    x = rng.integers(97, 105, (7, 4)).astype(np.uint8)
    real = np.arange(7)[:, None] < np.array([7, 3, 5, 1])[None, :]
    y = np.array([0, 2, 1, 1])
    _, grad = net.step(x, real, y)
    for k, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if k[0] == "e":
                at = (int(x[rng.integers(0, 2), 0]), at[1])
            old = w[at]
            w[at] = old + 1e-2
            up = net.step(x, real, y)[0]
            w[at] = old - 1e-2
            down = net.step(x, real, y)[0]
            w[at] = old
            assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-3, (k, at)


def test_reading_in_windows_equals_the_traced_layers(small):
    x = np.random.default_rng(0).integers(32, 250, (langid.WINDOW + 2 * langid.CONTEXT, 5)).astype(np.uint8)
    ahead = small.layer(x[: langid.WINDOW + langid.CONTEXT], 0, langid.CONTEXT)
    behind = small.layer(x[langid.CONTEXT :][::-1], 1, langid.CONTEXT)[::-1]
    want = small.probabilities(np.concatenate((ahead, behind), 2)).transpose(0, 2, 1)
    assert np.abs(small.read(x) - want).max() < 1e-5


def test_every_byte_has_a_label(small):
    text = b"then thing of the and tha " * 30 + "für nicht der und schön ".encode() * 30
    labels = small.positions(text)
    assert len(labels) == len(text)
    assert (labels[:600] == 0).mean() > 0.9 and (labels[-600:] == 1).mean() > 0.9
    assert len(small.positions(b"")) == 0


def test_a_text_counts_whole_and_alone(small):
    texts = [b"the thing and then", "der für und ".encode() * 500, b"x"]
    together = small.pooled(texts)
    for t, p in zip(texts, together, strict=True):
        assert np.allclose(small.pooled([t])[0], p, atol=1e-5)
    assert np.allclose(together.sum(1), 1)


def test_edge_rows(spark, small):
    rows = [(1, None), (2, ""), (3, "12 !? \n"), (4, "the thing and then"), (4, "the thing and then"), (None, "der und für"), (5, "und " * 100_000)]
    df = spark.createDataFrame([(d, t, 0.5, "x") for d, t in rows], "doc_id long, text string, score double, lang_pred string")
    got = sorted(map(tuple, langid.predict(df, small).collect()), key=str)
    label = {r[0]: r[2] for r in got}
    assert len(got) == len(rows)
    assert [label[k] for k in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "aa", "bb", "bb"]
    assert all(0 <= r[3] <= 1 for r in got)
    assert {r[2] for r in map(tuple, langid.predict(df, None).collect())} == {"und"}
    assert langid.predict(df.limit(0), small).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.learned(df) is None
    assert {r["lang_pred"] for r in langid.identify(df).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    got = queries.op1_language(spark, sf).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.96
