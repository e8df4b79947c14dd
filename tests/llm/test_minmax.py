import random
import re
from collections import defaultdict

import duckdb
import numpy as np
from llm_fixtures import DOCS, SF

from lectern.llm import minmax, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, width):
    out = []
    for d, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        out.append((d, s))
    return out


def brute(rows, width):
    """Components by comparing all pairs (that share a shingle)."""
    sets = sets_of(rows, width)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    seen = set()
    for i, (_, a) in enumerate(sets):
        near = {j for x in a for j in where[x] if j > i}
        for j in near - seen:
            b = sets[j][1]
            if 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(s), low[find(i)], d == low[find(i)]) for i, (d, s) in enumerate(sets))


def run(spark, rows, width=2):
    df = spark.createDataFrame([(d, t, "x", 7, 1) for d, t in rows], "doc_id long, text string, bands string, a long, key int")
    out = minmax.near_duplicates(df, width).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted(map(tuple, out.collect()))


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_chains_groups_and_borders(spark):
    rng = random.Random(4)
    rows = []
    base = words(rng, 120)
    for i in range(60):  # a chain: each text differs a little from the one before
        base = list(base)
        base[rng.randrange(120)] = f"x{i}"
        rows.append((1000 - i, " ".join(base)))
    for g in range(12):  # pairs just about the border
        a = words(rng, 100)
        for cut in (8, 9, 10, 11, 12, 13):
            rows.append((2000 + 10 * g + cut, " ".join(a[:-cut] + [f"y{g}{cut}{k}" for k in range(cut)])))
    rows += [(5000 + i, "Same Text  here and\tthere now") for i in range(300)]
    rows += [(5500, "same text here AND there now"), (5501, "same text here and there nöw"), (5502, "SAME TEXT HERE AND THERE NOW Ö")]
    rows += [(6000 + i, t) for i, t in enumerate(["", None, " \n", "one", "ONE", "one two", "One two", "É é", "é É"])]
    rows += [(7000, " ".join(words(rng, 40_000)))]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 2)


def test_large_group_of_near_copies_meets_one_leader(spark):
    rng = random.Random(5)
    base = words(rng, 200)
    rows = []
    for i in range(1500):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert {r[2] for r in run(spark, rows)} == {0}


def test_empty_null_ids_and_repeats(spark):
    assert run(spark, []) == []
    out = minmax.near_duplicates(
        spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e")], "doc_id long, text string"), 2
    ).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, True)] * 2 + [(3, 3, True)] * 2


def test_keep_one_of_each(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(4, text, "en", None, 1), (2, text, "en", None, 1), (2, text, "en", None, 1), (9, text + " more", "en", "s", 2), (5, "other", None, None, 3), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    out = minmax.keep_one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 5, 6]


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(map(tuple, queries.op8_minmax(spark, SF).collect())) == brute(rows, 2)


def test_min_max_bands_meet_as_promised():
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a = np.concatenate((both, rng.integers(0, 1 << 63, 10, dtype=np.uint64)))
        b = np.concatenate((both, rng.integers(0, 1 << 63, 10, dtype=np.uint64)))
        met += (minmax.bands_of(a) == minmax.bands_of(b)).sum()
    assert abs(met / 200 / minmax.BANDS - 0.8**4) < 0.04


def test_sketches_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(1)
    for n in (4, 50, 3000):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a = np.concatenate((both, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)))
        b = np.concatenate((both, rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)))
        bits = (minmax.sketch_of(a) ^ minmax.sketch_of(b)).view(np.uint64)
        assert sum(int(x).bit_count() for x in bits) <= n // 4 + n // 3


def test_many_outliers_of_one_group_are_settled(spark):
    rng = random.Random(9)
    base = words(rng, 90)
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.choice((1, 2, 4, 6, 8, 12, 20))):
            w[rng.randrange(90)] = f"q{rng.randrange(10**7)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows, 2)
