"""Merkle manifest of a dataset, with a witness of every row.

Each row is a leaf; the leaves of a source, ascending by identifier, are the
bottom of a tree of arity ``ARITY`` (every run of consecutive nodes becomes
the hash of their digests; the last run may be shorter, even one node) up to
the source's subroot, and the subroots the bottom of a last tree up to the
root.

Witnesses grow as the tree does.  ``Append`` takes the nodes of an aligned
block one by one.  A node stays open until its run completes; then the run is
attached, once, to the open subtrees it closes, as the next part of the
witness of everything below them.  A block of ``ARITY ** LEVELS`` nodes is one
row with its runs; block roots are appended in the same way by later rounds,
distributed alike, until one node a source remains, and then the subroots,
so a witness is what its block holds followed by what the blocks above it
hold.  No task holds more than one block, whatever the size of a source, and
no text leaves the task that reads it.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, numbered, shuffle_parts, written

ARITY = 16
#: Levels of a block: a block has at most ARITY ** LEVELS nodes.
LEVELS = 2
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """H: SHA-256 of digests concatenated as lower-case hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


class Append:
    """Streaming aligned append of at most one block of nodes."""

    def __init__(self):
        self.open: list[list[bytes]] = [[] for _ in range(LEVELS + 1)]
        #: Completed runs by level: the witness parts of the subtrees below.
        self.runs: list[list[list[bytes]]] = [[] for _ in range(LEVELS)]
        self.n = 0

    def add(self, node: bytes) -> None:
        self.n += 1
        self._push(0, node)

    def _push(self, level: int, node: bytes) -> None:
        self.open[level].append(node)
        if level < LEVELS and len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.runs[level].append(run)
        self._push(level + 1, digest(*run))

    def close(self, only: bool) -> bytes:
        """Complete what is open and return the block's root.  The ``only``
        block of its tree ends where one node remains; one among others is
        raised to the full height."""
        for level in range(LEVELS):
            alone = len(self.open[level]) == 1 and not self.runs[level]
            if only and alone and not any(self.open[level + 1 :]):
                return self.open[level][0]
            if self.open[level]:
                self._complete(level)
        return self.open[LEVELS][0]

    def levels(self) -> list[bytes]:
        """The digests of each level that has runs, in order: every run once,
        shared by the witnesses of all nodes below it."""
        return [b"".join(d for run in runs for d in run) for runs in self.runs if runs]


def witness(levels: list[bytes], i: int) -> list[tuple[int, list[bytes]]]:
    """``(place, run)`` of node ``i`` of a block and of each subtree it lies in."""
    out = []
    for raw in levels:
        lo = i - i % ARITY
        run = raw[32 * lo : 32 * (lo + ARITY)]
        out.append((i % ARITY, [run[k : k + 32] for k in range(0, len(run), 32)]))
        i //= ARITY
    return out


def packed(witness: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(struct.pack("BB", at, len(run)) + b"".join(run) for at, run in witness)


def unpacked(raw: bytes) -> list[tuple[int, list[bytes]]]:
    out, lo = [], 0
    while lo < len(raw):
        at, n = raw[lo], raw[lo + 1]
        lo += 2
        out.append((at, [raw[k : k + 32] for k in range(lo, lo + 32 * n, 32)]))
        lo += 32 * n
    return out


def siblings(witness: list[tuple[int, list[bytes]]]) -> str:
    """The run's other digests, level by level, left to right, in hex."""
    return "".join(d.hex() for at, run in witness for j, d in enumerate(run) if j != at)


def folded(node: bytes, witness: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that follows from a node and its witness."""
    for at, run in witness:
        node = digest(*run[:at], node, *run[at + 1 :])
    return node


# Leaves -------------------------------------------------------------------


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row, ``text`` standing for its text; as bytes."""
    parts = [field(text if c == "text" else F.col(c)) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampering(text: Column) -> Column:
    """A text as a tamperer would leave it: A-Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``tree, doc_id, leaf, changed``: the source as a name without nulls,
    the row's leaf, and, where ``tampered`` holds, the leaf of its tampered
    text.  Computed where the rows are read."""
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf(tampering(F.col("text"))))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), changed.alias("changed"))


# Trees ----------------------------------------------------------------------

BLOCKS_SCHEMA = (
    "tree string, block long, root binary, "
    "docs array<long>, nodes array<binary>, changed array<binary>, levels array<binary>"
)


def blocks(nodes: DataFrame) -> DataFrame:
    """One row per aligned block of ``tree, at, doc_id, leaf, changed``: its
    root, its rows, and the levels their witnesses are read from."""
    spark = nodes.sparkSession
    dealt = nodes.withColumn("block", F.expr(f"at div {BLOCK}"))
    dealt = dealt.repartition(shuffle_parts(spark), "tree", "block").sortWithinPartitions("tree", "block", "at")
    dealt = dealt.select("tree", "block", "doc_id", "leaf", "changed")

    def grow(batches):
        import pyarrow as pa

        schema = arrow_schema(BLOCKS_SCHEMA)
        key, rows, tree = None, [], Append()

        def done():
            # a first block that is not full has no other beside it
            root = tree.close(only=key[1] == 0 and tree.n < BLOCK)
            docs, nodes, changed = zip(*rows, strict=True)
            columns = [[key[0]], [key[1]], [root], [docs], [nodes], [changed], [tree.levels()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for name, block, doc, node, changed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, block) != key:
                    if rows:
                        yield done()
                    key, rows, tree = (name, block), [], Append()
                rows.append((doc, node, changed))
                tree.add(node)
        if rows:
            yield done()

    return written(dealt.mapInArrow(grow, BLOCKS_SCHEMA), "merkle-blocks")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, then blocks of block roots, until every tree has
    one block: the further appends."""
    out = [blocks(nodes)]
    while True:
        many = out[-1].where("block > 0").select("tree").distinct()
        above = out[-1].select("tree", F.col("block").alias("at"), F.col("block").alias("doc_id"), F.col("root").alias("leaf"))
        above = above.join(many, "tree", "left_semi").withColumn("changed", F.lit(None).cast("binary"))
        if above.isEmpty():
            return out
        out.append(blocks(above))


def nodes_of(level: DataFrame) -> DataFrame:
    """``tree, block, at, witness`` of every node of a later round's blocks
    (``at``: which block of the round before it is)."""

    def each(batches):
        import pyarrow as pa

        schema = arrow_schema(NODES_SCHEMA)
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["docs"])
                found = [packed(witness(row["levels"], i)) for i in range(n)]
                columns = [[row["tree"]] * n, [row["block"]] * n, row["docs"], found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return level.select("tree", "block", "docs", "levels").mapInArrow(each, NODES_SCHEMA)


NODES_SCHEMA = "tree string, block long, at long, witness binary"


def upper(levels: list[DataFrame], over: DataFrame) -> DataFrame:
    """``tree, block, upper``: the witness of each block of the first round,
    extended through all later rounds and by ``over`` (``tree, upper``), the
    witness of the tree's own root."""
    found = None
    for level in reversed(levels):
        above = level.select("tree", "block")
        if found is None:
            ends = above.withColumn("upper", F.lit(b""))
        else:
            # blocks that a later round holds, and the only blocks of their trees
            ends = above.join(found, ["tree", "block"], "left").withColumn("upper", F.coalesce("upper", F.lit(b"")))
        if level is levels[0]:
            return ends.join(over.withColumnRenamed("upper", "over"), "tree").select(
                "tree", "block", F.concat("upper", "over").alias("upper")
            )
        inside = nodes_of(level).join(ends, ["tree", "block"])
        found = inside.select("tree", F.col("at").alias("block"), F.concat("witness", "upper").alias("upper"))
    return found


def roots(levels: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree: the root of its only block in its last round."""
    tops = []
    for this, after in zip(levels, [*levels[1:], None], strict=True):
        tops.append((this if after is None else this.join(after.select("tree").distinct(), "tree", "left_anti")).select("tree", "root"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionAll(t)
    return out


MANIFEST_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, source, lang, n_chars, text``):
    ``doc_id, leaf, subroot, root, proof_sha256`` of the table as it is, and
    ``folded_root``, recomputed from the witness and the leaf, the tampered
    text's leaf where ``tampered`` holds; ``verified`` compares it with root.

    Null values have a mark of their own in the leaf; a null source is a
    source, before all others; null identifiers come first; equal rows have
    equal leaves, whose order does not matter.  An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    first = leaves(docs, F.lit(False) if tampered is None else tampered)
    bottom = rounds(numbered(first, ["tree"], ["doc_id", "leaf"], "at"))
    subroots = written(roots(bottom), "merkle-subroots")
    sources = subroots.select(F.lit("").alias("all"), "tree", "root")
    sources = numbered(sources, ["all"], ["tree"], "at").select(
        F.lit("").alias("tree"), "at", F.col("at").alias("doc_id"), F.col("root").alias("leaf"),
        F.lit(None).cast("binary").alias("changed"), F.col("tree").alias("name"),
    )
    sources = written(sources, "merkle-sources")
    top = rounds(sources.drop("name"))
    root = roots(top).first()
    if root is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    root = bytes(root["root"])
    last = upper(top, spark.createDataFrame([("", b"")], "tree string, upper binary"))
    inside = nodes_of(top[0]).join(last, ["tree", "block"]).select("at", F.concat("witness", "upper").alias("upper"))
    over = sources.join(inside, "at").select(F.col("name").alias("tree"), "upper")
    above = written(upper(bottom, over), "merkle-witnesses")
    rows = bottom[0].join(above, ["tree", "block"]).join(subroots.withColumnRenamed("root", "subroot"), "tree")

    def verify(batches):
        import pyarrow as pa

        schema = arrow_schema(MANIFEST_SCHEMA)
        for batch in batches:
            for row in range(batch.num_rows):
                docs, nodes, changed, levels, upper_raw, subroot = (c[row].as_py() for c in batch.columns)
                above = unpacked(upper_raw)
                rest = siblings(above)
                proofs, ends = [], []
                for i, (node, other) in enumerate(zip(nodes, changed, strict=True)):
                    below = witness(levels, i)
                    proofs.append(hashlib.sha256((siblings(below) + rest).encode()).hexdigest())
                    ends.append(folded(node if other is None else other, below + above))
                n = len(docs)
                columns = [
                    docs, [x.hex() for x in nodes], [subroot.hex()] * n, [root.hex()] * n, proofs,
                    [x.hex() for x in ends], [x == root for x in ends],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.select("docs", "nodes", "changed", "levels", "upper", "subroot").mapInArrow(verify, MANIFEST_SCHEMA)


def every_fifth(doc_id: str = "doc_id") -> Column:
    """Where 5 divides the unsigned CRC-32 of the decimal identifier."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
