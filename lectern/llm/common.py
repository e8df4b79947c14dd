"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared scratch folder and read it
    back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def open_fs(uri: str):
    """``(pyarrow filesystem, path)`` of a shared folder given as URI or as
    absolute path; usable on the driver and in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write an iterable of bytes to ``uri``: first under a name of its own,
    then renamed, so that a repeated task replaces a file by its equal and no
    reader meets half a file.  Returns the size."""
    import uuid

    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(tmp) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(tmp, path)
    return size


def shuffle_parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ranged(df: DataFrame, *cols, n: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by ``cols``."""
    return df.repartitionByRange(n or shuffle_parts(df.sparkSession), *cols).sortWithinPartitions(*cols)


def arrow_schema(ddl: str):
    """The pyarrow schema of a column list ``"name type, name type"`` (usable
    in tasks, where there is no session to parse it)."""
    import pyarrow as pa

    flat = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
        "double": pa.float64(), "boolean": pa.bool_(),
    }

    def kind(t: str):
        if t.startswith("array<struct<"):
            fields = t.removeprefix("array<struct<").removesuffix(">>").split(",")
            return pa.list_(pa.struct([(n, flat[k]) for n, k in (x.split(":") for x in fields)]))
        if t.startswith("array<"):
            return pa.list_(flat[t[6:-1]])
        return flat[t]

    return pa.schema([(n, kind(t)) for n, t in (c.split(" ") for c in ddl.split(", "))])


def rows_to_arrow(rows: list[tuple], schema) -> object:
    """A pyarrow batch of row tuples."""
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def batches_of(fn: Callable, schema, size: int = 4096) -> Callable:
    """Turn a generator ``fn(rows)`` over row dicts into a ``mapInArrow``
    function that yields batches of at most ``size`` rows."""

    def run(batches):
        def rows():
            for batch in batches:
                step = max(1, min(batch.num_rows, 1024))
                for at in range(0, batch.num_rows, step):
                    yield from batch.slice(at, step).to_pylist()

        out = []
        for row in fn(rows()):
            out.append(row)
            if len(out) >= size:
                yield rows_to_arrow(out, schema)
                out = []
        if out:
            yield rows_to_arrow(out, schema)

    return run


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table ``(a, b)`` of longs.

    Alternating large-star and small-star passes (published as connected
    components in map-reduce): a node's neighbours are hung on the smallest
    id among them until every component is a star on its smallest id.  Each
    pass is two aggregations with map-side combine and one shuffle join whose
    skewed side Spark may split; each result is a written table, so no pass
    recomputes another.  Returns ``(id, component)`` for every node that has
    an edge; the driver sees two numbers a pass.
    """
    spark = edges.sparkSession
    cur = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        # large star: u -> smallest neighbour (itself included), for larger neighbours
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours and u itself hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = (
            hung.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        cur = written(small, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    stars = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("id"), "component").distinct())


def numbered(df: DataFrame, group: list[str], order: list, out: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``df`` with ``out``, their place (from 0) among the rows of
    their group in ascending order, nulls first; ``sums`` names running sums
    (row included) of columns.  Group columns hold no nulls.

    No group lies in one task: the rows are range-partitioned by group and
    order, written, numbered inside their (partition, group), and moved by
    the counts and sums of the partitions before, one small row each.
    """
    sums = sums or {}
    parted = df.repartitionByRange(shuffle_parts(df.sparkSession), *group, *order)
    parted = written(parted.withColumn("_part", F.spark_partition_id()), "numbered-parts")
    return running(parted, group, order, out, sums).drop("_part")


def running(parted: DataFrame, group: list[str], order: list, out: str, sums: dict[str, str]) -> DataFrame:
    """The numbering of :func:`numbered` for rows that carry the range
    partition ``_part`` they came from."""
    here = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = parted.groupBy("_part", *group).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *group, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in ("n", *sums)]
    )
    local = parted.select("*", F.count("*").over(here).alias(out), *[F.sum(c).over(here).alias(n) for n, c in sums.items()])
    moved = local.join(offsets, ["_part", *group])
    kept = [c for c in parted.columns if c not in ("_part", *group)]
    return moved.select(
        "_part", *group, *kept, (F.col(out) - 1 + F.col("_n")).alias(out), *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums]
    )


#: Keys with more than this share of the rows of a join are broadcast.
HOT_SHARE = 1024


def join_hot(rows: DataFrame, small: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``small``, which has one row a key and the
    key's number of ``rows`` in ``weight`` (``total`` in all).  Keys that hold
    more than a share of the rows, at most HOT_SHARE of them, meet their row
    where they lie; only the others are shuffled."""
    often = F.col(weight) > max(1, total // HOT_SHARE)
    hot = small.where(often).drop(weight)
    there = rows.join(F.broadcast(hot), on)
    moved = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(~often).drop(weight), on)
    return there.unionByName(moved)
