"""Near-duplicates by min-max hashing of word shingles.

Both the minimum and the maximum of a shingle set under each of 64
permutations are kept: 128 signature values from 64 hash evaluations per
shingle.  A band is the two values of two permutations (four values), 32
bands.  Two sets of similarity 0.8 share no band with probability
(1 - 0.8^4)^32 < 5e-8.

Candidates are confirmed on full shingle sets, without all pairs of a group:

1. Documents with equal sets are one class; its smallest id stands for it.
2. In each bucket every class is compared with the bucket's smallest one;
   confirmed links give components.
3. In a bucket whose classes still lie in several components, the classes
   outside the smallest one's component are compared with the bucket's
   classes of other components.  Pairs whose sets differ too much by their
   parity sketches never leave the join: each set's sketch holds, in
   ``SKETCH_BITS`` bits, the parity of the shingles that fall on a bit, so the
   bits in which two sketches differ are at most the shingles in which the sets
   differ (the published bitmap filter; an exact bound).  Then every pair of a
   bucket has been confirmed, refused, or lies in one component.

A comparison streams: the task holds one leader's set at a time and the
others pass by; leaders with many others are dealt to several tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, components, shuffle_parts, written

PERMUTATIONS = 64
PER_BAND = 2
BANDS = PERMUTATIONS // PER_BAND
SEED = 20240711
SKETCH_BITS = 1024
#: Others of one leader compared by one task at a time.
AT_ONCE = 1024

_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, k: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * k
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``width``-word shingles.

    A-Z are lower-cased, words are runs without ASCII white space; a text
    with fewer words is one shingle, a text without words has none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = _mix(out * _K2 + h[i : i + n] + np.uint64(i + 1), _K1)
    return np.unique(out)


def bands_of(s: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 4096):
        h = _MUL[:, None] * s[at : at + 4096][None, :] + _ADD[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(PER_BAND):
        key = _mix(key * _K2 + low[i::PER_BAND], _K1)
        key = _mix(key * _K2 + high[i::PER_BAND], _K1)
    return key.view(np.int64)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The parity of the shingles on each of ``SKETCH_BITS`` bits, as longs."""
    odd = np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SIGNATURE_SCHEMA = (
    "doc_id long, text_hash long, n_shingles long, print1 long, print2 long, bands array<long>, sketch array<long>"
)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per row: set size, a 128-bit print of the set, band keys and sketch
    (none for sets under four shingles, which reach 0.8 only by being equal)."""

    def sign(batches):
        def each(rows):
            for r in rows:
                s = shingles(r["text"], width)
                p1 = int(_mix(s, _K1).sum(dtype=np.uint64).view(np.int64))
                p2 = int(_mix(s ^ _K1, _K2).sum(dtype=np.uint64).view(np.int64))
                bands, sketch = (bands_of(s).tolist(), sketch_of(s).tolist()) if len(s) >= 4 else ([], [])
                yield r["doc_id"], r["text_hash"], len(s), p1, p2, bands, sketch

        yield from batches_of(each, arrow_schema(SIGNATURE_SCHEMA), 1024)(batches)

    return _texts(docs).mapInArrow(sign, SIGNATURE_SCHEMA)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


PAIR_SCHEMA = "a long, b long"


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity.

    ``texts`` (id, text).  Rows of one leader ``a`` are dealt in groups of
    about ``AT_ONCE``, each led by a copy of the leader's text."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("parts"))
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    leaders = leaders.join(texts, F.col("a") == F.col("id")).select(
        "a", "part", F.lit(None).cast("long").alias("b"), "text"
    )
    others = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    others = others.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text")
    dealt = leaders.unionAll(others).repartition(shuffle_parts(pairs.sparkSession), "a", "part")

    def compare(batches):
        def each(rows):
            lead, sets = None, []
            for r in rows:
                s = shingles(r["text"], width)
                if r["b"] is None:  # nulls sort first
                    sets = sets + [s] if (r["a"], r["part"]) == lead else [s]
                    lead = (r["a"], r["part"])
                elif any(_similar(x, s, percent) for x in sets):
                    yield r["a"], r["b"]

        yield from batches_of(each, arrow_schema(PAIR_SCHEMA))(batches)

    return dealt.sortWithinPartitions("a", "part", "b").mapInArrow(compare, PAIR_SCHEMA).distinct()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, text_hash, n_shingles,
    component_id, kept``.

    Links join documents whose shingle sets have 100 * intersection >=
    percent * union; ``component_id`` is the smallest doc_id reachable.
    Null or wordless texts have no shingles and link with nothing.  Rows
    without doc_id are kept with a null component.  Repeated rows fall into
    one class, each is returned; distinct texts under one doc_id that leads
    their classes count as one document.  Other columns are not read.
    """
    sig = written(signatures(docs, width), "signatures")
    print_ = ["n_shingles", "print1", "print2"]
    linkable = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # equal sets meet before the shuffle, so a set of a third of all rows is a row a task
    classes = written(
        linkable.groupBy(*print_)
        .agg(F.min_by(F.struct("doc_id", "text_hash", "bands", "sketch"), F.struct("doc_id", "text_hash")).alias("m"))
        .select(F.col("m.doc_id").alias("id"), "m.text_hash", *print_, "m.bands", "m.sketch"),
        "classes",
    )
    members = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    lead = members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    # buckets of two and more classes
    shared = written(members.join(lead, "key"), "buckets")
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")

    needed = shared.select("id").distinct()
    chosen = classes.join(needed, "id").select("id", "text_hash")
    texts = _texts(docs).alias("t").join(
        chosen.alias("c"), F.expr("t.doc_id = c.id AND t.text_hash = c.text_hash")
    )
    texts = written(texts.select("c.id", "t.text"), "candidates")

    star = written(shared.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    links = written(confirmed(star, texts, width, percent), "links")
    labels = written(components(links), "labels")

    # what is left of each bucket: classes beyond its leader's component
    named = shared.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    head = labels.select(F.col("id").alias("a"), F.col("component").alias("lead_component"))
    named = named.join(head, "a", "left").withColumn("lead_component", F.coalesce("lead_component", "a"))
    named = written(named.select("key", "a", "id", "n", "component", "lead_component"), "named")
    unsettled = named.where("component <> lead_component").select("key").distinct()
    # a leader has met all of its bucket already
    rest = named.where("id <> a").join(unsettled, "key", "left_semi")
    rest = written(rest.join(classes.select("id", "sketch"), "id"), "unsettled")
    minor = rest.where("component <> lead_component").select(
        "key",
        F.col("id").alias("m_id"),
        F.col("n").alias("m"),
        F.col("component").alias("m_component"),
        F.col("sketch").alias("m_sketch"),
    )
    differing = " + ".join(f"bit_count(sketch[{i}] ^ m_sketch[{i}])" for i in range(SKETCH_BITS // 64))
    close = F.expr(f"({100 + percent}) * ({differing}) <= ({100 - percent}) * (n + m)")
    cross = rest.join(minor, "key").where((F.col("component") != F.col("m_component")) & fits & close)
    cross = cross.select(F.least("id", "m_id").alias("a"), F.greatest("id", "m_id").alias("b")).distinct()
    cross = written(cross.join(star, ["a", "b"], "left_anti"), "pairs")
    more = written(confirmed(cross, texts, width, percent), "links")
    if not more.isEmpty():
        labels = written(components(links.unionAll(more)), "labels")

    found = classes.join(labels, "id", "left").select(*print_, F.coalesce("component", "id").alias("component_id"))
    linked = linkable.select("doc_id", "text_hash", *print_).join(found, print_)
    alone = sig.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "text_hash", *print_, F.col("doc_id").alias("component_id")
    )
    every = linked.select("doc_id", "text_hash", *print_, "component_id").unionAll(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return every.select("doc_id", "text_hash", "n_shingles", "component_id", kept.alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of every group (its smallest doc_id), all
    columns as they were.  Repeated rows of a kept document become one; rows
    without doc_id stay."""
    found = near_duplicates(docs, width, percent).where("kept AND doc_id IS NOT NULL")
    found = found.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    on = F.expr("doc_id = kept_id") & (F.xxhash64("text") == F.col("kept_hash"))
    rows = docs.where("doc_id IS NOT NULL").join(found, on)
    rows = rows.dropDuplicates(["kept_id", "kept_hash"]).select(*[docs[c] for c in docs.columns])
    return rows.unionAll(docs.where("doc_id IS NULL"))
