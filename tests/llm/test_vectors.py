import duckdb
import numpy as np
from llm_fixtures import SF

from lectern.llm import queries, vectors


def brute(rows, cosine=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {i: 0 for i, _ in rows}
    comp = {i: i for i, _ in rows}
    ids = [i for i, _ in ok]
    for dim in {len(v) for _, v in ok}:
        mine = [(i, v) for i, v in ok if len(v) == dim]
        x = np.array([v / np.abs(v).max() for _, v in mine])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        for k, (i, _) in enumerate(mine):
            link[i] = int(near[k].sum())
        todo = True
        while todo:
            todo = False
            for k, (i, _) in enumerate(mine):
                for j in np.flatnonzero(near[k]):
                    low = min(comp[i], comp[mine[j][0]])
                    if comp[i] != low or comp[mine[j][0]] != low:
                        comp[i] = comp[mine[j][0]] = low
                        todo = True
    assert len(ids) == len(set(ids))
    return sorted(((i, link[i], comp[i], i == comp[i] or i is None) for i, _ in rows), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, links string")
    return sorted(map(tuple, vectors.near_duplicates(df, **options).collect()), key=str)


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_groups_chains_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f32(rng.standard_normal(16))) for i in range(300)]
    for g in range(8):
        c = rng.standard_normal(16)
        rows += [(1000 + 100 * g + k, f32(c + 0.15 * rng.standard_normal(16))) for k in range(3 + 9 * g)]
    rows += [(5000 + k, f32([np.cos(k / 4), np.sin(k / 4), 0, 0])) for k in range(12)]  # a chain, 4 dimensions
    rows += [(6000, None), (6001, []), (6002, [0.0] * 16), (6003, [float("nan")] * 16), (6004, [float("inf")] + [1.0] * 15)]
    rows += [(6005, [None] + [1.0] * 15), (6006, [1e-30] * 16), (6007, [2e30] * 16)]
    rows += [(7000 + k, [1.0, 2.0] * 8) for k in range(400)]  # equal vectors
    order = rng.permutation(len(rows))
    assert run(spark, [rows[i] for i in order], window=32) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0])]) == [(1, 0, 1, True), (None, 0, None, True)]


def test_a_group_larger_than_window_and_block_is_counted_whole(spark):
    rng = np.random.default_rng(4)
    c = rng.standard_normal(32)
    rows = [(k, f32(c + 0.05 * rng.standard_normal(32))) for k in range(1300)]
    assert {r[1:3] for r in run(spark, rows, window=64)} == {(1299, 0)}


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    assert sorted(map(tuple, queries.op6_embedding_neighbours(spark, SF).collect()), key=str) == brute(rows)


def test_links_do_not_depend_on_the_number_of_partitions(spark):
    rng = np.random.default_rng(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (20, 100, 500):
            rows = []
            for i in range(n // 2):  # separate pairs of cosine 0.92
                a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
                rows += [(2 * i, f32(a)), (2 * i + 1, f32(0.92 * a + np.sqrt(1 - 0.92**2) * b))]
            spark.conf.set("spark.sql.shuffle.partitions", "200")
            assert run(spark, rows) == brute(rows), n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def cone(rng, n, dim, cosine, pairs):
    """``n`` vectors whose cosines lie about ``cosine``, and pairs of 0.91."""
    axis = np.zeros(dim)
    axis[0] = 1.0
    side = rng.standard_normal((n, dim))
    side[:, 0] = 0
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    for k in range(pairs):
        a, b = side[2 * k], rng.standard_normal(dim)
        b[0] = 0
        b -= (b @ a) * a
        near = (0.91 - cosine) / (1 - cosine)
        side[2 * k + 1] = near * a + np.sqrt(1 - near * near) * b / np.linalg.norm(b)
    return np.sqrt(cosine) * axis + np.sqrt(1 - cosine) * side


def test_no_link_is_lost_in_a_cone(spark):
    rng = np.random.default_rng(12)
    x = cone(rng, 4000, 64, 0.75, 300)
    rows = [(int(i), f32(x[i])) for i in rng.permutation(len(x))]
    got = run(spark, rows, window=64)
    assert got == brute(rows)
    assert sum(link > 0 for _, link, _, _ in got) >= 600


def test_passes_grow_with_the_cone():
    assert vectors.passes_for(51_282, 0.9) == vectors.passes_for(51_282, 0.9, mean=0.0)
    assert vectors.passes_for(51_282, 0.9) < vectors.passes_for(51_282, 0.9, mean=0.5) < vectors.passes_for(51_282, 0.9, mean=0.8)
    assert vectors.passes_for(100, 0.9, mean=0.95) == 1
