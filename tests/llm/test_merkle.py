"""Merkle manifest: brute force, witnesses, many blocks and sources, tampering."""

import hashlib
import zlib

import pytest
from llm_fixtures import DOCS, SF

from lectern.llm import merkle, queries
from lectern.llm.common import table


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def level_up(nodes):
    return [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]


def climb(nodes):
    """All levels from the bottom to the one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(level_up(out[-1]))
    return out


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = climb([leaf_of(r) for r in sources[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node, proof = leaf_of((*r[:4], text)), ""
            for levels, at in ((trees[s], i), (top, place)):
                for nodes in levels[:-1]:
                    lo = at - at % 16
                    run = nodes[lo : lo + 16]
                    proof += "".join(x for j, x in enumerate(run) if j != at % 16)
                    node = h(*run[: at % 16], node, *run[at % 16 + 1 :])
                    at //= 16
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 512, 4096, 4113])
def test_one_source_of_any_size(spark, n):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert rows_of(merkle.manifest(docs, merkle.every_fifth())) == brute([(d, s, la, k, t) for d, t, la, s, k in rows])


def test_sources_nulls_repeats_ties_and_long_texts(spark):
    rows = [(i, f"T {i}", None, f"source {i % 40}", i) for i in range(200)]
    rows += [(i, "AÁa", "x", None, None) for i in range(30)]
    rows += [(5, "Same Row", "en", "dup", 8)] * 20 + [(5, "Other Row", "en", "dup", 8), (None, None, None, "dup", None), (None, "", "", "dup", -3)]
    rows += [(900, "Z" * 300_000, "en", "", 1), (901, "zz", "en", "ÿ", 1), (902, "zz", "en", "\U0001f600", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert rows_of(merkle.manifest(docs, merkle.every_fifth())) == brute([(d, s, la, k, t) for d, t, la, s, k in rows])


def test_query_on_the_small_tables(spark):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert rows_of(queries.QUERIES["op11_merkle_manifest"](spark, SF)) == brute(rows)


def test_untampered_rows_verify_and_columns_may_clash(spark):
    docs = spark.createDataFrame([(i, "A", "en", "s", 1, "x", "y") for i in range(40)], DOCS + ", root string, tree string")
    assert all(r["verified"] for r in merkle.manifest(docs).collect())


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_witness_of_an_open_block_equals_its_closed_one():
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    tree = merkle.Append()
    for node in nodes:
        tree.add(node)
    root = tree.close(only=True)
    for i, node in enumerate(nodes):
        found = merkle.witness(tree.levels(), i)
        assert merkle.folded(node, found) == root
        assert merkle.unpacked(merkle.packed(found)) == found
