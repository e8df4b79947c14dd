import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from llm_fixtures import DOCS, SF
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import decontaminate, queries

WORDS = st.lists(st.integers(0, 6), max_size=90).map(lambda x: np.array(x, np.uint32))


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    assert decontaminate.common_subsequence(a, b) == row[-1]


@pytest.fixture(scope="module")
def world():
    rng = random.Random(6)
    syllables = ["ka", "lo", "mi", "ren", "tu", "sho", "pel", "dra", "vi", "nost", "qua", "ze"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.choice((1, 2, 2, 3)))) for _ in range(2500)]
    common = vocabulary[:40]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    items = {}
    for i, n in enumerate((8, 14, 18, 25, 34, 45, 60, 90, 200)):
        w = prose(n)
        cut = max(1, len(w) - 6)
        items[i] = " ".join(w[:cut]) + ". " + " ".join(w[cut:]) + "?"
    return rng, prose, items


def test_leaks_exact_and_paraphrased(spark, world):
    rng, prose, items = world
    rows, want = [], {}
    for i in range(400):
        rows.append((i, " ".join(prose(rng.choice((5, 60, 300, 900))))))
    for i, text in items.items():
        words = text.split()
        before, after = prose(rng.randrange(0, 400)), prose(rng.randrange(0, 400))
        rows.append((1000 + i, " ".join(before + words + after)))
        rows.append((1100 + i, text.upper().replace(" ", "\n")))
        want[1000 + i] = want[1100 + i] = i
        if len(words) >= 18:  # a tenth of the words replaced, one more put in
            other = list(words)
            for at in rng.sample(range(len(words)), len(words) // 10):
                other[at] = "changed"
            other.insert(len(other) // 2, "extra")
            rows.append((1200 + i, " ".join(before + other + after)))
            want[1200 + i] = i
    rows.append((2000, " ".join(prose(60_000) + items[4].split() + prose(20_000))))
    want[2000] = 4
    rows += [(3000, None), (3001, ""), (None, items[5]), (3002, items[5]), (3002, items[5])]
    want[3002] = 5
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, words string, share double")
    bench = spark.createDataFrame([*items.items(), (90, None), (91, ""), (92, "too short"), (None, "no id here at all for this")], "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"]} == set(want.items())
    assert sum(r["doc_id"] == 3002 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], DOCS)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in rows if d is not None and d not in want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontaminate.leaks(docs, bench).collect() == []
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "doc_id long, text string")
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert [r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_sketch_spans_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(2)
    topics = rng.choice(decontaminate.FEATURES, (5, 30))
    texts = [rng.choice(topics[i % 5], 320).astype(np.uint32).tobytes() for i in range(60)]
    words = spark.createDataFrame([(bytearray(t),) for t in texts], "words binary").repartition(4)
    table = decontaminate.projection(words)
    passages = np.array([np.bincount(p, minlength=decontaminate.FEATURES) for t in texts for p in np.frombuffer(t, np.uint32).reshape(-1, 32)])
    idf = np.log((len(passages) + 1) / ((passages > 0).sum(0) + 1)) + 0.1
    a = passages * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    leading = np.linalg.svd(a, full_matrices=False)[2][:5]
    span = np.linalg.qr((table / idf[:, None]).astype(float))[0]
    assert np.linalg.norm(leading @ span, axis=1).min() > 0.999


def test_query_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    plain = {i: " ".join(re.findall(r"\w+", t.lower())) for i, t in items}
    want = set()
    for d, t in docs:
        text = f" {' '.join(re.findall(r'\w+', (t or '').lower()))} "
        want |= {(d, i) for i, p in plain.items() if len(p.split()) >= decontaminate.MIN_WORDS and f" {p} " in text}
    assert want and {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, SF).collect()} == want


def test_paraphrases_that_keep_three_fifths_are_found(spark, world):
    rng, prose, _ = world
    items, rows = [], []
    for i in range(120):
        n = (8, 10, 13, 15, 18, 20, 24, 30)[i % 8]
        w = prose(n)
        end = n - max(1, n // 5)  # the answer stays as it is
        items.append((i, " ".join(w[:end]) + ". " + " ".join(w[end:]) + "?"))
        other = list(w)
        for at in rng.sample(range(end), int(n * 0.38)):
            other[at] = f"changed{rng.randrange(10**6)}"
        rows.append((i, " ".join(prose(rng.randrange(20, 120)) + other + prose(rng.randrange(20, 120)))))
        rows.append((1000 + i, " ".join(prose(rng.randrange(20, 120)) + w + prose(rng.randrange(20, 120)))))
    rows += [(2000 + i, " ".join(prose(300))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(1000 + i, i) for i in range(120)} <= got
    assert sum((i, i) in got for i in range(120)) >= 119
    assert not [d for d, i in got if d >= 2000 and i % 8 >= 4]  # items of 18 words or more


def test_words_beyond_ascii_and_short_items(spark):
    def same(a, b):
        return (decontaminate.hashed(a) == decontaminate.hashed(b)).all()

    assert same("«¿Qué» – dijo él… “así”。", "qué dijo él así") and len(decontaminate.hashed("东京、ไทย カナ")) == 7
    items = {1: "北京是中华人民共和国的首都。", 2: "¿Dónde nació el poeta Ángel González, y cuándo?", 3: "Short exact item", 4: "ประเทศไทย", 5: "東京"}
    rows = [
        (1, "前面有一些别的文字，北京是中华人民共和国的首都，后面也有。"),
        (2, "Leí: «¿Dónde nació el poeta Ángel González — y cuándo?» … y nada más"),
        (3, "before a “short exact item” after"),
        (4, "ข้อความประเทศไทยยาว"),
        (5, "私は東京に住む"),
        (6, "short but not exact item 京東 北京"),
        (7, None),
    ]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(i, i) for i in range(1, 6)}


def _random_items(rng, n, vocabulary):
    return [(i, " ".join(f"w{min(int(rng.pareto(0.8) * 20), vocabulary)}" for _ in range(rng.integers(6, 90)))) for i in range(n)]


def test_the_rare_word_filter_loses_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    items = _random_items(rng, 60, 900)
    table = rng.standard_normal((decontaminate.FEATURES, 8)).astype(np.float32)
    df = rng.integers(1, 500, decontaminate.FEATURES + 1).astype(float)
    bench = decontaminate.Benchmark(items, table, df)
    docs = []
    for i in range(40):
        words = [f"w{min(int(rng.pareto(0.8) * 20), 900)}" for _ in range(rng.integers(1, 400))]
        for _, text in [items[k] for k in rng.integers(0, len(items), 2)]:  # a paraphrase keeps 65 or 85 % of the words in order
            keep = [w for w in text.split() if rng.random() < rng.choice([0.65, 0.85])]
            at = rng.integers(0, len(words) + 1)
            words[at:at] = keep
        docs.append(decontaminate.hashed(" ".join(words)))
    docs.append(decontaminate.hashed(" ".join(t for _, t in items) * 9))  # more than one stretch
    got = [decontaminate.matches(d, table, bench) for d in docs]
    monkeypatch.setattr(decontaminate.Benchmark, "candidates", lambda self, present: np.arange(len(self.parts)))
    assert got == [decontaminate.matches(d, table, bench) for d in docs]
    assert sum(map(len, got)) > 60


def test_what_a_task_carries_of_20000_items_is_small():
    import pickle

    rng = np.random.default_rng(9)
    items = _random_items(rng, 20_000, 300_000)
    table = rng.standard_normal((decontaminate.FEATURES, 48)).astype(np.float32)
    bench = decontaminate.Benchmark(items, table, np.ones(decontaminate.FEATURES + 1))
    # 200 MB for a million words: a fixed number of bytes a word and passage
    assert len(pickle.dumps(bench)) < 200 * sum(len(t.split()) for _, t in items)
    for i in (3, 1234, 19_999):
        words = decontaminate.hashed("x y z " * 40 + items[i][1] + " u v" * 60)
        assert i in decontaminate.matches(words, table, bench)


def test_paraphrases_equal_brute_force_subsequences():
    """Every item whose words mostly stand in order within a window is found
    (the cosine, fitted here on the items, is what decides besides)."""
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(words, rng.integers(10, 60)))) for i in range(30)]
    table = rng.standard_normal((decontaminate.FEATURES, 48)).astype(np.float32)
    bench = decontaminate.Benchmark(items, table, np.ones(decontaminate.FEATURES + 1))
    for i, text in items:
        kept = [w for w in text.split() if rng.random() < 0.93]
        doc = [*rng.choice(words, 150), *kept, *rng.choice(words, 150)]
        found = decontaminate.matches(decontaminate.hashed(" ".join(doc)), table, bench)
        want = {}
        for k, other in items:
            part = decontaminate.hashed(other)
            share = decontaminate.common_subsequence(part, decontaminate.hashed(" ".join(doc))) / len(part)
            if share >= decontaminate.LCS_ALONE:
                want[k] = share
        assert set(want) == {k for k, (share, _, _) in found.items() if share >= decontaminate.LCS_ALONE}
        assert i in found


def test_a_large_benchmark_is_searched_in_blocks(spark, monkeypatch):
    docs = queries.table(spark, SF, "documents").limit(60)
    bench = queries.table(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_WORDS", 100)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole


def test_words_of_latin_texts_are_those_of_any_text():
    texts = ["Él año_2 naïve—ßtraße ×÷ µm ²x ªb «ça» İstanbul ÿÀ", "plain ASCII, a_b 12", "ñ", "", "ž Łódź š", "x­é y ö"]
    for text in [*texts, " ".join(texts)]:
        words = [w.encode() for w in decontaminate._WORD.findall(text.lower())]
        assert decontaminate.hashed(text).tolist() == list(map(xxhash.xxh32_intdigest, words))


def test_screening_many_documents_loses_no_leak(monkeypatch):
    """Documents that cannot hold a leak leave before they are looked through
    one by one; the others give what every passage compared would give."""
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(names, n)) + ". " + " ".join(rng.choice(names, 2))) for i, n in enumerate([6, 9, 20, 40, 70, 150] * 3)]
    docs = [np.empty(0, np.uint32)]
    for i in range(60):
        words = list(rng.choice(names, int(rng.integers(1, 500))))
        if i % 3 == 0:
            kept = [w for w in items[i % len(items)][1].split() if rng.random() < 0.85]
            words[5:5] = kept
        docs.append(decontaminate.hashed(" ".join(words)))
    docs.append(decontaminate.hashed("quite other words " * 200))
    docs.append(decontaminate.hashed("quite other words " * 12_000 + items[4][1]))  # more than one stretch
    df = np.ones(decontaminate.FEATURES + 1)
    table = rng.standard_normal((decontaminate.FEATURES, 16)).astype(np.float32)
    bench = decontaminate.Benchmark(items, table, df)
    screens = decontaminate.screened(docs, bench)
    every = np.arange(len(bench.parts))
    want = [decontaminate.matches(w, table, bench, (bench.places(w), every)) for w in docs]
    assert [decontaminate.matches(w, table, bench, s) for w, s in zip(docs, screens)] == want
    assert sum(map(bool, want)) >= 15 and 4 in want[-1]
    assert not len(screens[0][1]) and not len(screens[-2][1])
    assert decontaminate.screened([], bench) == []
    monkeypatch.setattr(decontaminate, "FIELDS", 1)
    assert decontaminate.Benchmark(items, table, df).group == 1
