"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every vector with its own random hyperplanes, orders the
vectors lexicographically by the concatenated hash bits and compares each
block with its neighbours inside a bounded window; pairs confirmed by their
exact cosine are united inside the task, so a chunk of a pass gives at most
one edge per vector.  Edges of all passes are united into components.

The order is that of the whole table: hash bits without vectors are sorted
over all partitions and numbered, and the numbers are cut into chunks of
``CHUNK`` windows, each with the first window of the next.  Vectors less than
a window apart always meet, however many partitions the session has.

Links are then counted without emitting pairs: the members of a component
are dealt in blocks of about ``BLOCK`` vectors, each pair of blocks is one
matrix product, and only counts per vector leave it.  Equal vectors are one
class with a weight throughout.

Hyperplanes cut the unit vectors less their mean (one vector a dimension,
summed over all rows): in a cone, where all vectors share a direction, planes
through the origin would hardly tell them apart.  Cosines stay those of the
vectors as they are.

With the mean's squared length ``m``, a pair of cosine ``c`` has the centred
cosine (c - m) / (1 - m), and agrees on a hyperplane with the probability that
belongs to it; unrelated pairs agree on one in two.  With ``n`` classes a pass
needs about log2(n / WINDOW) equal leading bits to bring a pair into one
window, so ``passes`` grows with the bits and with ``m``: enough for a miss
under 1e-6 for one pair on its own (a group has many pairs).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, components, rows_to_arrow, shuffle_parts, written

WINDOW = 256
BLOCK = 512
#: Windows of a chunk of the sorted order.
CHUNK = 8
BITS = 60
SEED = 987


def passes_for(n: int, cosine: float, window: int = WINDOW, mean: float = 0.0, miss: float = 1e-6) -> int:
    """Passes so that a pair of this cosine stays apart with probability at
    most ``miss``, by the bits that bring a window's worth of ``n`` together;
    ``mean`` is the squared length of the mean unit vector."""
    centred = (cosine - mean) / (1 - mean) if mean < cosine else 0.0
    same = 1 - math.acos(centred) / math.pi
    bits = max(0.0, math.log2(max(n, 1) / window) + 1)
    together = same**bits
    return 1 if together >= 1 else max(4, math.ceil(math.log(miss) / math.log1p(-together)))


SUM_SCHEMA = "dim int, n long, total binary"


def _centres(classes: DataFrame) -> dict[int, np.ndarray]:
    """The mean unit vector of each vector length, over all classes; a task
    sends one sum a length."""

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            by_dim: dict[int, list] = {}
            for v in batch.column(0).to_pylist():
                by_dim.setdefault(len(v), []).append(v)
            for dim, rows in by_dim.items():
                held = sums.setdefault(dim, [0, np.zeros(dim)])
                held[0] += len(rows)
                held[1] += _unit(rows).sum(0)
        yield rows_to_arrow([(dim, n, total.tobytes()) for dim, (n, total) in sums.items()], arrow_schema(SUM_SCHEMA))

    found: dict[int, list] = {}
    for r in classes.select("v").mapInArrow(add, SUM_SCHEMA).collect():
        held = found.setdefault(r["dim"], [0, np.zeros(r["dim"])])
        held[0] += r["n"]
        held[1] += np.frombuffer(r["total"], np.float64)
    return {dim: total / n for dim, (n, total) in found.items()}


def _planes(passno: int, dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, passno, dim)).standard_normal((dim, BITS))


def _matrix(column) -> np.ndarray:
    """The rows of a pyarrow list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def is_valid() -> F.Column:
    """True for rows that may link: an id, and a vector of finite components
    that are not all zero; else false, never null."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


PASS_SCHEMA = "pass int, dim int, bits long, key long"
EDGE_SCHEMA = "a long, b long"


def _project(passes: int, centres: dict[int, np.ndarray]):
    def run(batches):
        schema = arrow_schema(PASS_SCHEMA)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512).to_pylist()
                by_dim: dict[int, list] = {}
                for r in some:
                    by_dim.setdefault(len(r["v"]), []).append(r)
                for dim, rows in by_dim.items():
                    unit = _unit([r["v"] for r in rows]) - centres[dim]
                    for p in range(passes):
                        signs = (unit @ _planes(p, dim) > 0).astype(np.int64)
                        bits = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        out = [(p, dim, b, r["key"]) for b, r in zip(bits.tolist(), rows, strict=True)]
                        yield rows_to_arrow(out, schema)

    return run


def _ranked(ordered: DataFrame) -> DataFrame:
    """``ordered`` (sorted over its partitions, written with ``place``, the
    partition in the upper bits and the row below) with ``rank``, the row's
    number in the whole.  The driver sees a count per partition."""
    part = F.shiftright("place", 33)
    counts = sorted((r["part"], r["count"]) for r in ordered.groupBy(part.alias("part")).count().collect())
    starts, before = [], 0
    for number, count in counts:
        starts.append((number, before))
        before += count
    offsets = ordered.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)
    return ordered.join(F.broadcast(offsets), part == F.col("part")).select("pass", "dim", "key", rank.alias("rank"))


def _unite(cosine: float, window: int):
    """For each chunk (pass, dim, id, v, rank): its edges."""

    def run(table):
        import pyarrow as pa

        table = table.select(["pass", "dim", "rank", "id", "v"]).sort_by("rank").combine_chunks()
        edges = list(unite(table.to_batches()))
        return pa.Table.from_batches(edges, arrow_schema(EDGE_SCHEMA))

    def unite(batches):
        schema = arrow_schema(EDGE_SCHEMA)
        root: dict[int, int] = {}

        def find(x):
            top = x
            while root.get(top, top) != top:
                top = root[top]
            while root.get(x, x) != top:
                root[x], x = top, root[x]
            return top

        def flush():
            edges = [(x, r) for x in root if (r := find(x)) != x]
            root.clear()
            for at in range(0, len(edges), 8192):
                yield rows_to_arrow(edges[at : at + 8192], schema)

        def join(ids, unit):
            """Unite what is linked among the vectors of two neighbouring blocks."""
            linked = unit @ unit.T >= cosine
            np.fill_diagonal(linked, True)
            busy = np.flatnonzero(linked.sum(1) > 1)
            if not len(busy):
                return
            linked = linked[np.ix_(busy, busy)]
            label = np.arange(len(busy))
            while True:
                low = np.where(linked, label[None, :], len(busy)).min(1)
                if (low == label).all():
                    break
                label = low
            for x, y in zip(busy.tolist(), busy[label].tolist(), strict=True):
                a, b = find(ids[x]), find(ids[y])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    root.setdefault(min(a, b), min(a, b))

        where, ids, unit = None, [], None  # the block before
        held_ids, held, n = [], [], 0

        def close():
            nonlocal ids, unit, held_ids, held, n
            if held:
                fresh = _unit(np.concatenate(held))
                both = fresh if unit is None else np.concatenate((unit, fresh))
                join(ids + held_ids, both)
                ids, unit = held_ids, fresh
                held_ids, held, n = [], [], 0

        for batch in batches:
            passes, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((np.diff(passes) != 0) | (np.diff(dims) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True):
                if hi > lo and (passes[lo], dims[lo]) != where:
                    close()
                    yield from flush()
                    where, ids, unit = (passes[lo], dims[lo]), [], None
                while lo < hi:
                    some = batch.slice(lo, min(hi - lo, window - n))
                    held_ids += some.column(3).to_pylist()
                    held.append(_matrix(some.column(4)))
                    n += some.num_rows
                    lo += some.num_rows
                    if n == window:
                        close()
        close()
        yield from flush()

    return run


def _count(cosine: float):
    def run(key, table):
        import pyarrow as pa

        first, second = key[2].as_py(), key[3].as_py()
        own = table["own"].to_numpy()
        ids, weight = table["id"].to_numpy(), table["weight"].to_numpy()
        unit = _unit(_matrix(table["v"].combine_chunks()))
        one, two = own == first, own == second
        out = []
        if one.any() and two.any():
            linked = unit[one] @ unit[two].T >= cosine
            if first == second:
                np.fill_diagonal(linked, False)
            out.append((ids[one], linked @ weight[two]))
            if first != second:
                out.append((ids[two], linked.T @ weight[one]))
        got = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in got], names=["id", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): ``vec_id, n_links,
    component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without id, link with nothing (``n_links`` 0, their own
    component, kept).  Vectors of different lengths do not link.  Repeated
    rows are vectors of their own with equal values; different vectors with
    one smallest id count as one node.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    classes = rows.where(is_valid()).groupBy(F.col("embedding").alias("v")).agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    # a number for each class: smallest ids may meet
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    centres = _centres(classes)
    passes = passes or passes_for(n, cosine, window, max((float(c @ c) for c in centres.values()), default=0.0))
    projected = classes.select("key", "v").mapInArrow(_project(passes, centres), PASS_SCHEMA)
    ordered = projected.repartitionByRange(shuffle_parts(spark), "pass", "dim", "bits", "key")
    ordered = ordered.sortWithinPartitions("pass", "dim", "bits", "key")
    place = F.monotonically_increasing_id().alias("place")
    ranked = _ranked(written(ordered.select("pass", "dim", "key", place), "vector-order"))
    chunk = F.floor(F.col("rank") / (window * CHUNK))
    # the first window of a chunk is the last of the chunk before, too
    twice = (F.col("rank") % (window * CHUNK) < window) & (chunk > 0)
    chunks = ranked.withColumn("chunk", F.explode(F.when(twice, F.array(chunk - 1, chunk)).otherwise(F.array(chunk))))
    chunks = chunks.join(classes.select("key", "id", "v"), "key").select("chunk", "pass", "dim", "rank", "id", "v")
    edges = chunks.groupBy("chunk").applyInArrow(_unite(cosine, window), EDGE_SCHEMA).distinct()
    labels = written(components(written(edges, "vector-edges")), "labels")

    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = labels.join(sizes, "component").join(classes, "id")
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = members.select("component", F.size("v").alias("dim"), "own", "id", "weight", "v", other)
    members = members.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    counted = members.groupBy("component", "dim", "one", "two").applyInArrow(_count(cosine), "id long, links long")
    links = counted.groupBy("id").agg(F.sum("links").alias("links"))

    found = classes.join(labels, "id", "left").join(links, "id", "left")
    found = found.select(
        "v",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    linked = rows.where(is_valid()).join(found, F.col("embedding") == F.col("v")).select("vec_id", "n_links", "component_id")
    odd = rows.where(~is_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionAll(odd)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
