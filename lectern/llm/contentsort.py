"""Exact duplicates by a content sort, DataFrame functions only.

Rows are range-partitioned by sampled splitters over (first bytes of the
normalised text, fingerprint of the whole text, piece) and sorted on disk by
the same key and the text itself, so equal texts lie side by side.  Each row
is compared in full with its neighbour: a run starts where the texts differ,
and the row of a run with the smallest (or largest) identifier stays.

The splitters hold ``HEAD`` bytes of a text and two numbers, never a text, so
the driver sees little however long the texts are.  Groups of copies of more
than ``max(ROWS, rows / SHARE)`` rows are dealt by identifier over as many
pieces as that takes; there are at most ``SHARE`` such groups, whose pieces
are put together by the SHA-256 of their text from a broadcast of one row
each.  Texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_parts, written

#: Bytes of a text in the splitters.
HEAD = 64
#: A group of copies with more than this share of all rows is cut in pieces ...
SHARE = 4096
#: ... unless it has no more rows than this.
ROWS = 64


def unchanged(text: Column) -> Column:
    return text


KEY = ["head", "print", "piece"]


def runs(dealt: DataFrame, parts: int, first: Column, others: list[str]) -> DataFrame:
    """Rows of ``dealt`` (``head, print, piece, text, doc_id``) sorted by
    content, numbered by run of equal neighbours; ``starts`` marks the first
    of each, in the order of ``first``.  One exchange, by range."""
    parted = dealt.repartitionByRange(parts, *KEY)
    neighbours = Window.partitionBy(*KEY).orderBy("text", first)
    before = F.lag("text").over(neighbours)
    compared = parted.withColumn("starts", before.isNull() | (before != F.col("text")))
    run = F.sum(F.col("starts").cast("long")).over(neighbours.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return compared.select(*KEY, "doc_id", "starts", run.alias("run"), F.sha2("text", 256).alias("text_sha256"), *others)


def copies(
    docs: DataFrame,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = unchanged,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Every row with its group of equal texts: ``doc_id, keep_id,
    group_size, kept, text_sha256``; with ``carry`` also ``row``, the whole
    input row.

    ``keep`` names which identifier stays, ``smallest`` or ``largest``;
    ``normalise`` is applied to the text, null texts are empty texts.  Exactly
    one row of a group is kept, also among rows repeating one identifier; a
    null identifier stays only where the group has no other.  An empty table
    gives no rows; other columns are ignored (or carried in ``row``).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: smallest or largest, not {keep}")
    spark = docs.sparkSession
    text = F.coalesce(normalise(F.col(text_col)), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *whole)
    rows = rows.withColumn("print", F.xxhash64("text"))

    counts = written(rows.groupBy("print").agg(F.count("*").alias("n")), "copies-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(ROWS, total // SHARE)
    # more than total / SHARE rows each: at most SHARE rows
    large = counts.where(F.col("n") > limit).select("print", F.expr(f"(n + {limit - 1}) div {limit}").alias("pieces"))

    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(-1))
    dealt = rows.join(F.broadcast(large), "print", "left").select(
        F.substring(F.col("text").cast("binary"), 1, HEAD).alias("head"), "print", piece.alias("piece"), "text", "doc_id", *["row"] * carry
    )
    first = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    sorted_runs = runs(dealt, shuffle_parts(spark), first, ["row"] * carry)

    in_run = Window.partitionBy(*KEY, "run")
    best = F.min if keep == "smallest" else F.max
    found = sorted_runs.select(
        "doc_id", "starts", "piece", "text_sha256", best("doc_id").over(in_run).alias("best"), F.count("*").over(in_run).alias("size"),
        *["row"] * carry,
    )
    found = written(found, "copies-runs")
    pieces = found.where("piece >= 0 AND starts").groupBy("text_sha256")
    totals = pieces.agg(best("best").alias("all_best"), F.sum("size").alias("all_size"))  # at most SHARE groups and their pieces
    joined = found.join(F.broadcast(totals), "text_sha256", "left")
    keep_id, size = F.coalesce("all_best", "best"), F.coalesce("all_size", "size")
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        (F.col("starts") & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
        *["row"] * carry,
    )


def unique_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    return copies(docs, carry=True, **options).where("kept").select("row.*")
