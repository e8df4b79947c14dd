"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns.  Conversations are taken from
the deepest place where two different ones still agree upwards: at each depth
those that end there (or whose own, unshared rest begins below) join the nodes
that survive from the depth below, equal sequences are grouped, the group is
one node, and with its last turn stripped it goes on to the next depth.
Members, children, leaves and saved tokens are added up in the same grouping
that finds the node.

What makes this a handful of small shuffles:

* A sequence is named by a sum of digests of (depth, turn), 120 bits, so its
  truncation is the sum less one digest and no text moves.  Running sums come
  from range partitions, so a conversation of any length is spread.
* Equal conversations are one sequence from the start, and turns below the
  last one shared with another sequence form a path of their own: they are
  nodes already and are written down without peeling.  The number of rounds is
  the depth down to which different conversations agree.
* Groups are pre-aggregated; joins of popular prefixes broadcast a bounded
  number of rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch_path
from .common import arrow_schema, join_hot, numbered, running, shuffle_parts, written

ROOT_KEY = "0:0"
NOTHING = hashlib.sha256(b"").hexdigest()
#: Members listed per string before the strings of a node are digested in order.
ID_RANGE = 1 << 16
#: A rebuilt conversation borrows fewer than BORROW turns from that of its hundred.
BORROW, EVERY = 6, 100


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, value, chars``: the turns of each conversation numbered
    from 0 by turn (null first, equal ones by digest), each as the digest of
    its role and text; null roles and texts are empty.  Rows without a
    conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    value = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", value.alias("value"), F.length(text).cast("long").alias("chars")
    )
    return written(numbered(rows, ["conv_id"], ["turn", "value"], "at"), "trie-turns")


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation borrows: unsigned CRC-32 of its decimal id, modulo BORROW."""
    return F.crc32(conv_id.cast("string").cast("binary")) % BORROW


def rebuilt(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, part, at, value, chars``: the first turns of the first
    conversation of a conversation's hundred, then its own behind as many."""
    whole = F.col("conv_id") - F.col("conv_id") % EVERY
    heads = turns.where((whole == F.col("conv_id")) & (F.col("at") < BORROW - 1)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("at", "value", "chars"))).alias("head"))  # fewer than BORROW
    lent = convs.select("conv_id", whole.alias("base")).join(heads, "base")
    lent = lent.select("conv_id", F.explode(F.slice("head", F.lit(1), borrowed(F.col("conv_id")).cast("int"))).alias("t"))
    lent = lent.select("conv_id", F.lit(0).alias("part"), "t.at", "t.value", "t.chars")
    own = turns.where(F.col("at") >= borrowed(F.col("conv_id")))
    return lent.unionByName(own.select("conv_id", F.lit(1).alias("part"), "at", "value", "chars"))


def prefixes(turns: DataFrame, order: list[str]) -> DataFrame:
    """``conv_id, depth, key, parent, chars, upto``: every conversation's
    first ``depth`` turns by name, the name one turn less, and the code points
    of its last turn and of all."""
    parted = turns.repartitionByRange(shuffle_parts(turns.sparkSession), "conv_id", *order)
    parted = written(parted.withColumn("_part", F.spark_partition_id()), "trie-parts")
    deep = running(parted, ["conv_id"], order, "nth", {}).withColumn("depth", F.col("nth") + 1).drop("nth")
    mark = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("value")), 256)
    terms = [F.conv(F.substring("mark", at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]  # 60 bits each
    deep = written(deep.withColumn("mark", mark).select("_part", "conv_id", "depth", "chars", terms[0].alias("a"), terms[1].alias("b")), "trie-terms")
    summed = running(deep, ["conv_id"], ["depth"], "nth", {"sa": "a", "sb": "b", "upto": "chars"})

    def name(a, b):
        return F.concat_ws(":", a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string"))

    sa, sb = F.col("sa"), F.col("sb")
    return summed.select(
        "conv_id", "depth", name(sa, sb).alias("key"), name(sa - F.col("a"), sb - F.col("b")).alias("parent"), "chars", "upto"
    )


def ends(last: DataFrame) -> DataFrame:
    """``length, key, ends``: the digest of the ascending decimal ids,
    comma-joined, of the conversations that are equal.  Ids come joined by
    ranges; a task streams the ranges of a sequence, as a digest must."""
    block = F.floor(F.col("conv_id") / F.lit(ID_RANGE))
    some = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = last.groupBy("length", "key", block.alias("block")).agg(some.alias("ids"))  # at most ID_RANGE distinct ids
    dealt = parts.repartition(shuffle_parts(last.sparkSession), "length", "key").sortWithinPartitions("length", "key", "block")
    schema_ddl = "length long, key string, ends string"

    def digests(batches):
        import pyarrow as pa

        schema, key, state, out = arrow_schema(schema_ddl), None, None, []
        for batch in batches:
            for length, name, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (length, name) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (length, name), hashlib.sha256()
                state.update(ids.encode())
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"length": key[0], "key": key[1], "ends": state.hexdigest()}], schema=schema)

    return dealt.select("length", "key", "ids").mapInArrow(digests, schema_ddl)


NODE = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
OUT_SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def trie(convs: DataFrame, turns: DataFrame, order: list[str]) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``convs`` lists the ids, ``turns`` (``conv_id, value, chars`` and the
    ``order`` columns) their turns; a conversation without turns ends at the
    root.  No conversations give no nodes.
    """
    spark = convs.sparkSession
    rows = written(prefixes(turns, order), "trie-prefixes")
    total = rows.count()
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "key", "upto")).alias("last"))
    last = convs.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.depth", F.lit(0)).cast("long").alias("length"),
        F.coalesce("last.key", F.lit(ROOT_KEY)).alias("key"), F.coalesce("last.upto", F.lit(0)).cast("long").alias("all"),
    )
    last = written(last, "trie-last")
    sequences = last.groupBy("length", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.max("all").alias("all"))
    sequences = written(sequences.join(ends(last), ["length", "key"]).withColumnRenamed("key", "end_key"), "trie-sequences")

    # the deepest turn each sequence shares with a different one
    own = join_hot(rows, sequences.select("conv_id", "length"), ["conv_id"], "length", total)
    own = written(own, "trie-own")
    shared = own.groupBy("depth", "key").agg(F.count("*").alias("n")).where("n > 1")
    deepest = join_hot(own.select("conv_id", "depth", "key"), shared, ["depth", "key"], "n", total)
    deepest = deepest.groupBy("conv_id").agg(F.max("depth").alias("top"))
    sequences = written(sequences.join(deepest, "conv_id", "left").withColumn("top", F.coalesce("top", F.lit(0).cast("long"))), "trie-tops")
    rounds = sequences.agg(F.max("top")).first()[0]
    if rounds is None:
        return spark.createDataFrame([], OUT_SCHEMA)
    facts = sequences.withColumn("weight", F.col("length"))
    own = written(join_hot(own, facts, ["conv_id"], "weight", total), "trie-shared")

    # turns below it: nodes of one sequence, in place
    saved = (F.col("copies") - 1) * (F.col("all") - F.col("upto") + F.col("chars"))
    tails = own.where("depth > top").select(
        "conv_id", "depth", F.col("copies").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"), "parent", "top",
    )

    # what each sequence brings to the depth where its peeling begins
    at_top = own.where("depth = top").select("conv_id", "key", "upto")
    more = F.col("length") > F.col("top")
    feed = sequences.join(at_top, "conv_id", "left").select(
        "top", F.coalesce("key", F.lit(ROOT_KEY)).alias("key"), "conv_id", F.col("copies").alias("n"),
        more.cast("long").alias("child"), more.cast("long").alias("leaves"),
        F.when(more, (F.col("copies") - 1) * (F.col("all") - F.coalesce("upto", F.lit(0)))).otherwise(F.lit(0)).cast("long").alias("saved"),
        F.when(~more, F.col("ends")).alias("ended"),
    )
    feed, inner = written(feed, "trie-feed"), scratch_path(spark, "trie-inner")
    own.where("depth <= top").select("depth", "conv_id", "parent", "chars").write.partitionBy("depth").parquet(inner)
    place = scratch_path(spark, "trie-nodes")
    survivors = None
    for depth in range(rounds, -1, -1):
        here = feed.where(F.col("top") == depth).drop("top")
        found = (here if survivors is None else here.unionByName(survivors)).groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.max("ended").alias("ended"),
        )
        if depth:
            turn = spark.read.schema("conv_id long, parent string, chars long").parquet(f"{inner}/depth={depth}")
            found = found.join(turn, "conv_id")
        else:
            found = found.withColumns({"parent": F.lit(None).cast("string"), "chars": F.lit(0).cast("long")})
        found = found.select(
            "conv_id", "key", "parent", "n_convs", "n_children",
            F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            (F.col("below") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
            F.coalesce("ended", F.lit(NOTHING)).alias("ends_sha256"),
        )
        found.write.parquet(f"{place}/depth={depth}")
        # strip the last turn: the nodes go on under their parent's name
        survivors = spark.read.schema(found.schema).parquet(f"{place}/depth={depth}").select(
            F.col("parent").alias("key"), "conv_id", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("child"),
            F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ended"),
        )
    nodes = spark.read.parquet(place).withColumn("depth", F.col("depth").cast("long"))

    # parents by name, for peeled nodes and for the first turns of unshared paths
    children = nodes.where("depth > 0").select(*NODE, "parent").unionByName(tails.where("depth = top + 1").select(*NODE, "parent"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    named = join_hot(children, above, ["depth", "parent"], "weight", total)
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    paths = tails.where("depth > top + 1").withColumn("parent_conv_id", F.col("conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", *NODE[2:]]
    return named.select(out).unionByName(root.select(out)).unionByName(paths.select(out))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations (``conv_id, turn, role, text``), each
    rebuilt with the head of its hundred.  Nulls, ties and rows without
    conv_id as in :func:`turns_in_order`; repeated rows are turns each; other
    columns are ignored."""
    turns = turns_in_order(conversations)
    convs = written(turns.select("conv_id").distinct(), "trie-convs")
    return trie(convs, rebuilt(convs, turns), ["part", "at"])
