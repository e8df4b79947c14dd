"""Prefix trie: brute force over nodes as tuples of turns."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest
from llm_fixtures import SF
from pyspark.sql import functions as F

from lectern.llm import queries, trie
from lectern.llm.common import join_hot, numbered, table
from lectern.runtime import scratch_path

CONV = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            value = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), value, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])
        out[c] = base[:h] + v[h:]
    return out


def brute(rows):
    convs = rebuild(rows)
    members, ended = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ended[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        own = (len(who) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    out = []
    for node, who in members.items():
        parent = min(members[node[:-1]]) if node else None
        names = ",".join(map(str, sorted(ended[node])))
        digest = hashlib.sha256(names.encode()).hexdigest()
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_random_conversations(spark):
    rng = random.Random(7)
    rows = []
    for c in range(0, 700, 2):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello", "a longer turn", "", "é 😀"])))
    got = trie.rebuilt_trie(spark.createDataFrame(rows, CONV).repartition(5))
    assert rows_of(got) == brute(rows)


def test_hot_copies_long_conversations_nulls_ties_and_negative_ids(spark):
    rows = [(1000 + c, t, "user", f"same {t}") for c in range(300) for t in range(7)]  # equal but for what they borrow
    rows += [(5000, t, "user", f"turn {t}") for t in range(600)]
    rows += [(5001, t, "user", f"turn {t}") for t in range(30)] + [(5001, 99, "user", "other end")]
    rows += [(-7, 0, "user", "a"), (-7, 1, None, None), (-7, 1, "", ""), (-7, None, "user", "first"), (-300, 2, "x", "y" * 100_000)]
    rows += [(None, 0, "user", "no conversation"), (7700, None, None, None), (7701, 3, "user", "b"), (7701, 3, "user", "b"), (7701, 3, "user", "a")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], CONV + ", depth int, key string").repartition(4)
    assert rows_of(trie.rebuilt_trie(docs)) == brute(rows)


def test_one_conversation_and_turnless_ones(spark):
    # 100 borrows from itself; ids whose only turn is replaced by nothing end at the root
    rows = [(c, 0, "user", "only") for c in (101, 102, 103, 104, 105, 106)]
    for some in (rows, rows[:1], [(100, t, "u", "x") for t in range(4)]):
        assert rows_of(trie.rebuilt_trie(spark.createDataFrame(some, CONV))) == brute(some)
    turnless = [c for c, turns in rebuild(rows).items() if not turns]
    assert turnless


def test_query_on_the_small_tables(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, SF, "conversations").collect()]
    assert rows_of(queries.QUERIES["op12_truncation_trie"](spark, SF)) == brute(rows)


def test_empty_table(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], CONV)).collect() == []


def test_rounds_follow_the_shared_depth_not_the_length(spark, monkeypatch):
    made = {}

    def path(session, name):
        made[name] = scratch_path(session, name)
        return made[name]

    monkeypatch.setattr(trie, "scratch_path", path)
    rows = [(c * 100, t, "user", f"{c} {t}") for c in range(3) for t in range(2000)]
    nodes = trie.rebuilt_trie(spark.createDataFrame(rows, CONV))
    assert nodes.count() == 6001
    assert nodes.agg(F.max("depth")).first()[0] == 2000
    assert [f for f in os.listdir(made["trie-nodes"]) if f.startswith("depth=")] == ["depth=0"]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_numbering_spreads_one_group(spark, n):
    df = spark.range(n).select(F.lit(1).alias("g"), (F.lit(n) - F.col("id")).alias("o"), F.lit(2).cast("long").alias("x"))
    got = numbered(df, ["g"], ["o"], "at", {"sum": "x"}).orderBy("o").collect()
    assert [(r["at"], int(r["sum"])) for r in got] == [(i, 2 * (i + 1)) for i in range(n)]


def test_hot_keys_join_like_any_other(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 30)], "k int, v int")
    small = spark.createDataFrame([(k, f"name {k}", 50 if k == 1 else 1) for k in range(1, 20)], "k int, name string, n int")
    got = join_hot(rows, small, ["k"], "n", 78)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(small.drop("n"), "k").collect()))
