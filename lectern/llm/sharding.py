"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a key belongs to the
first point at or after its own hash.  Loads are bounded by the row count:
every shard takes ``floor`` or ``ceil`` of rows / shards.  Keys that find
their shard full continue clockwise to the next shard with room, so the
counts differ by one at most and only overflowing keys leave their place.

All keys between two ring points (an arc) see the shards in the same
clockwise order, so placing needs only the rows per arc: a table of
``shards * vnodes`` counts, which is all the driver gets.  It settles who
keeps how many rows of which arc; the rows are numbered inside their arc by
a window (equal rows counted before, so a key that holds a third of all rows
is one row there) and look their segment up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shuffle_parts

VNODES = 128
#: Copies of one row that are expanded by one task at a time.
COPIES_AT_ONCE = 4096


def ring(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """``(position, shard)`` in ring order.  A shard's points depend on its
    own number only: one more shard leaves the others' points where they are."""
    points = []
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"shard {shard} point {v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big", signed=True), shard))
    return sorted(points)


def settle(counts: dict[int, int], points: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(arc, first rank, rank behind the last, shard, first slot)``.

    First every arc fills its own shard in ring order, then what is left over
    walks clockwise to shards with room."""
    total = sum(counts.values())
    low, extra = divmod(total, n_shards)
    home = [0] * n_shards
    for arc, n in counts.items():
        home[points[arc][1]] += n
    room = [low] * n_shards
    for shard in sorted(range(n_shards), key=lambda s: (-home[s], s))[:extra]:
        room[shard] += 1
    used = [0] * n_shards
    out, left = [], []

    def take(arc: int, lo: int, shard: int, n: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            out.append((arc, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return n

    for arc in sorted(counts):
        got = take(arc, 0, points[arc][1], counts[arc])
        if got < counts[arc]:
            left.append((arc, got))
    for arc, lo in left:
        for step in range(1, len(points) + 1):
            if lo == counts[arc]:
                break
            lo += take(arc, lo, points[(arc + step) % len(points)][1], counts[arc] - lo)
    return out


def _arc_of(points: list[tuple[int, int]]):
    bounds = [p for p, _ in points]

    @F.pandas_udf(T.IntegerType())
    def arc(pos):
        import numpy as np
        import pandas as pd

        return pd.Series((np.searchsorted(np.array(bounds, np.int64), pos.to_numpy(), "left") % len(bounds)).astype("int32"))

    return arc


def place(df: DataFrame, key: Column, carry: dict[str, Column], n_shards: int, vnodes: int = VNODES) -> DataFrame:
    """One row per row of ``df``: ``key``, the ``carry`` columns, ``shard``
    and ``slot`` (gapless from 0 in each shard).

    The hash of the key and the carried values set the place, so rows with a
    null key spread like others; rows equal in all of them are
    interchangeable.  Any column may be null.  An empty table gives no rows.
    Other columns of ``df`` are not read, whatever their names.
    """
    names = ["key", *carry]
    rows = df.select(key.alias("key"), *[c.alias(n) for n, c in carry.items()])
    pos = F.when(F.col("key").isNull(), F.xxhash64(*names)).otherwise(F.xxhash64("key"))
    points = ring(n_shards, vnodes)
    equal = rows.withColumn("pos", pos).groupBy("pos", *names).agg(F.count("*").alias("copies"))
    equal = equal.withColumn("arc", _arc_of(points)("pos"))
    counts = {r["arc"]: r["n"] for r in equal.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    spark = df.sparkSession
    segments = spark.createDataFrame(
        settle(counts, points, n_shards), "seg_arc int, lo long, hi long, shard int, first_slot long"
    )
    before = Window.partitionBy("arc").orderBy("pos", *names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = equal.withColumn("first_rank", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES_AT_ONCE}"))).alias("chunk")
    ranked = ranked.select("*", chunk).repartition(shuffle_parts(spark), "pos", "chunk")
    lo = F.col("chunk") * COPIES_AT_ONCE
    hi = F.least(lo + COPIES_AT_ONCE, F.col("copies")) - 1
    ranked = ranked.select("*", F.explode(F.sequence(lo, hi)).alias("copy")).withColumn(
        "rank", F.col("first_rank") + F.col("copy")
    )
    # at most two segments per arc and one per shard: bounded by the ring
    hit = (F.col("arc") == F.col("seg_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(segments), hit).select(
        *names, "shard", (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """Placement of documents: ``key`` (doc_id), ``size`` (UTF-8 bytes of the
    text plus 1; null text: 1), ``text_crc32``, ``shard``, ``slot``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    return place(docs, F.col("doc_id"), {"size": size, "text_crc32": crc}, n_shards, vnodes)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents as one folder of Parquet files per shard, joined to
    their placement by id, size and crc.  Rows equal in these are numbered on
    both sides, so each gets one place of its own."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("key"), size.alias("size"), crc.alias("text_crc32"))
    same = Window.partitionBy("key", "size", "text_crc32")
    rows = rows.withColumn("copy", F.row_number().over(same.orderBy(F.xxhash64("row"))))
    places = placed.select("key", "size", "text_crc32", "shard", "slot")
    places = places.withColumn("copy", F.row_number().over(same.orderBy("shard", "slot")))
    on = [rows[c].eqNullSafe(places[c]) for c in ("key", "size", "text_crc32", "copy")]
    full = rows.join(places, on).select("row.*", "shard", "slot")
    full.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
