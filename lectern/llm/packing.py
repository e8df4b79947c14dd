"""Harmonic packing of documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class *k* holds the pieces
longer than capacity/(k+1) and at most capacity/k, and every bin of class *k*
takes exactly *k* pieces, so bins are filled by counting alone and any worker
fills them without knowing another's.

Documents may be cut, so padding is kept small by cutting each document to
class capacities: first whole sequences, then the largest capacity/k that
fits the rest, until the rest lies in class ``UNCUT`` or above, where a bin
loses less than one piece of at most capacity/UNCUT tokens.

Pieces are numbered per class: counts per (worker, class) give each worker
its first number, so workers fill bins independently and a class has one
bin that is not full.  The pieces of those last bins (fewer than k a class,
a number bounded by the capacity alone) share bins by first fit.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, written
from .tokenizing import encoder, text_batches

CAPACITY = 1024
#: Rests in this class or above are not cut further.
UNCUT = 16
END_ID = 0


def cuts(n: int, capacity: int = CAPACITY, uncut: int = UNCUT) -> list[tuple[int, int]]:
    """``(length, class)`` of the pieces of ``n`` tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest  # rest lies in (capacity/(k+1), capacity/k]
        if k < uncut and rest != capacity // k:
            k += 1
            rest_now = capacity // k
        else:
            rest_now = rest
        out.append((rest_now, k))
        rest -= rest_now
    return out


class Cutter:
    """The pieces of many documents at once, from a table of the cuts of
    every rest."""

    def __init__(self, capacity: int = CAPACITY):
        rests = [cuts(rest, capacity) for rest in range(capacity)]
        self.capacity = capacity
        self.count = np.array([len(r) for r in rests])
        self.first = np.cumsum(self.count) - self.count
        flat = [piece for r in rests for piece in r]
        self.length = np.array([length for length, _ in flat])
        self.kind = np.array([k for _, k in flat])

    def __call__(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, length, class)`` of the pieces of documents of ``n``
        tokens, in order."""
        whole, rest = np.divmod(n, self.capacity)
        pieces = whole + self.count[rest]
        doc = np.repeat(np.arange(len(n)), pieces)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = at >= whole[doc]
        spot = np.where(cut, self.first[rest[doc]] + at - whole[doc], 0)
        return doc, np.where(cut, self.length[spot], self.capacity), np.where(cut, self.kind[spot], 1)


PIECES_SCHEMA = (
    "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, class int, worker int, nth long"
)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Tokenised documents cut into pieces, numbered per worker and class.

    ``doc_id, text``; null text is empty, so its only token is the end id.
    Repeated rows are packed each.  Null ids stay null."""

    def cut(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        enc, worker, cutter = encoder(tokenizer), TaskContext.get().partitionId(), Cutter(capacity)
        numbers = np.zeros(capacity + 1, np.int64)
        schema = arrow_schema(PIECES_SCHEMA)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in text_batches(texts):
                tokens, n = enc.ended(texts[lo : hi].to_pylist(), end_id)
                doc, length, kind = cutter(n)
                stop = np.cumsum(length)
                raw = memoryview(tokens.view(np.uint8))
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (stop - length)).tolist(), (4 * stop).tolist(), strict=True)]
                order = np.argsort(kind, kind="stable")
                counts = np.bincount(kind, minlength=capacity + 1)
                nth = np.empty(len(kind), np.int64)
                nth[order] = np.arange(len(kind)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(numbers, counts)
                numbers += counts
                start = stop - length - (np.cumsum(n) - n)[doc]
                columns = [ids[lo:hi].take(pa.array(doc)), start, length, crcs, n[doc], kind, np.full(len(doc), worker), nth]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES_SCHEMA)


def first_fit(rest: list[tuple], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(bin, offset)`` for pieces ``(.., length)`` taken longest first."""
    used: list[int] = []
    out = []
    for *_, length in rest:
        for b, u in enumerate(used):
            if u + length <= capacity:
                break
        else:
            b = len(used)
            used.append(0)
        out.append((b, used[b]))
        used[b] += length
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  Sequence ids and offsets are gapless from 0."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = cut.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("class", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    totals = counts.groupBy("class").agg(F.sum("n").alias("n")).collect()  # at most one row per class, <= capacity
    base, at = [], 0
    for r in sorted(totals, key=lambda r: r["class"]):
        full = r["n"] // r["class"]
        base.append((r["class"], at, full * r["class"]))
        at += full
    known = spark.createDataFrame(base, "class int, base long, kept long")
    numbered = (
        cut.join(firsts, ["class", "worker"])
        .join(F.broadcast(known), "class")  # bounded: one row per class
        .withColumn("number", F.col("first") + F.col("nth"))
    )
    numbered = written(numbered.drop("first", "nth", "worker"), "numbered")
    in_bin = numbered.where("number < kept").withColumn("sequence_id", F.expr("base + number div class"))
    upto = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    # classes below UNCUT hold pieces of one length: their offsets need no other row
    same = in_bin.where(F.col("class") < UNCUT).withColumn("offset", F.expr("(number % class) * length"))
    rest = in_bin.where(F.col("class") >= UNCUT).withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0)))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # fewer than k pieces of each class k: bounded by the capacity
    left = numbered.where("number >= kept").select("class", "number", "length").collect()
    left = sorted(left, key=lambda r: (-r["length"], r["class"], r["number"]))
    found = [(r["class"], r["number"], at + b, o) for r, (b, o) in zip(left, first_fit(left, capacity), strict=True)]
    spots = spark.createDataFrame(found, "class int, number long, sequence_id long, offset long")
    last = numbered.where("number >= kept").join(F.broadcast(spots), ["class", "number"])
    cols = [F.col(c).cast("long") for c in out]
    return same.select(cols).unionAll(rest.select(cols)).unionAll(last.select(cols))
