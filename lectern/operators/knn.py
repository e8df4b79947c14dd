"""Exact k-nearest-neighbour search (squared L2), flat-index semantics.

Plan
----
* Questions whose vectors fit ``max_bytes`` (checked before anything is
  collected) travel with the tasks: the corpus is never shuffled and only ids
  and vectors reach Python.  ``mapInPandas`` scans each partition once and
  carries the k best rows per question along.
* More questions are joined in blocks: questions are dealt over blocks of at
  most about ``max_bytes``, the corpus over groups of at most about
  ``GROUP_BYTES``, and every pair of a block and a group is one key of one
  shuffle, the block's questions sorted before the group's rows.  A task
  holds one block of questions and their k best rows, and streams the group.
  No question reaches the driver.
* Either way one matrix product per Arrow batch finds the rows that may
  belong to the k best; their distances are then taken from differences, which
  keeps the order exact at any scale.  A task yields k rows per question, and
  a ``row_number() <= k`` window over the question id merges them (Spark plans
  a partial group limit before the exchange).

Rows rank by distance; distances equal to nine significant digits (a relative
tolerance, whatever the vectors' scale) count as ties and rank by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import QUESTION_BYTES, RETRIEVER_K, SEARCH_K


def _to_matrix(series: pd.Series, dim: int) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim))
    mat = np.stack([np.asarray(v, dtype=np.float64) for v in series])
    if mat.shape[1] != dim:
        raise ValueError(f"vector of size {mat.shape[1]} where {dim} was expected")
    return mat


def vector_dims(df: DataFrame, vec_col: str) -> DataFrame:
    """min/max vector size and row count; all sizes must agree."""
    size = F.size(vec_col)
    return df.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(size).alias("min_dim"),
        F.max(size).alias("max_dim"),
    )


#: Corpus vectors met by one block of questions in one task.
GROUP_BYTES = 256 << 20


def _vector_bytes(df: DataFrame, vec_col: str) -> int:
    return 8 * (df.agg(F.sum(F.size(vec_col))).first()[0] or 0)


def _batch(questions: DataFrame, q_id: str, q_vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of questions known to be few."""
    pdf = questions.select(q_id, q_vec).toPandas()
    dim = len(pdf[q_vec].iloc[0]) if len(pdf) else 0
    return pdf[q_id].to_numpy(), _to_matrix(pdf[q_vec], dim)


DIGITS = 9


def _key(dist: np.ndarray) -> np.ndarray:
    """The distance to ``DIGITS`` significant digits."""
    scale = 10.0 ** (DIGITS - 1 - np.floor(np.log10(np.where(dist > 0, dist, 1.0))))
    return np.rint(dist * scale) / scale


class _Best:
    """The k best (distance, id) of each question so far."""

    def __init__(self, questions: np.ndarray, k: int):
        self.q, self.k = questions, k
        self.norm = np.einsum("ij,ij->i", questions, questions)
        self.dist = [np.empty(0)] * len(questions)
        self.ids = [np.empty(0, object)] * len(questions)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.einsum("ij,ij->i", x, x)
        near = self.norm[:, None] + norm[None, :] - 2.0 * (self.q @ x.T)
        # rounding of the product, generously
        slack = 1e-13 * x.shape[1] * (self.norm[:, None] + norm[None, :])
        for i in range(len(self.q)):
            upper = near[i] + slack[i]
            bound = np.partition(upper, self.k - 1)[self.k - 1] if len(upper) > self.k else np.inf
            if len(self.dist[i]) == self.k:
                bound = min(bound, self.dist[i].max())
            some = np.flatnonzero(near[i] - slack[i] <= bound * (1 + 10.0 ** (1 - DIGITS)))
            if len(some):
                gap = x[some] - self.q[i]
                dist = np.concatenate((self.dist[i], np.einsum("ij,ij->i", gap, gap)))
                both = np.concatenate((self.ids[i], ids[some]))
                key = _key(dist)
                order = sorted(range(len(dist)), key=lambda j: (key[j], both[j]))[: self.k]
                self.dist[i], self.ids[i] = dist[order], both[order]


def knn(
    corpus: DataFrame,
    questions: DataFrame,
    k: int = RETRIEVER_K,
    id_col: str = "id",
    vec_col: str = "embedding",
    q_id: str = "qid",
    q_vec: str = "embedding",
    max_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """Top-``k`` corpus rows per question by squared L2 distance.

    Returns ``(q_id, rank, id_col, dist)``; ``rank`` starts at 1.  An empty
    corpus gives no rows, one smaller than k fewer rows; questions and rows
    without a vector are left out.  More columns of the hits:
    :func:`attach_metadata`.
    """
    fields = [questions.schema[q_id], corpus.schema[id_col]]
    schema = T.StructType(
        [T.StructField(q_id, fields[0].dataType), T.StructField(id_col, fields[1].dataType), T.StructField("dist", T.DoubleType()), T.StructField("_key", T.DoubleType())]
    )
    corpus = corpus.select(id_col, vec_col).where(F.col(vec_col).isNotNull())
    questions = questions.select(q_id, q_vec).where(F.col(q_vec).isNotNull())
    asked = _vector_bytes(questions, q_vec)
    if asked <= max_bytes:
        hits = _carried(corpus, questions, k, id_col, vec_col, q_id, q_vec, schema)
    else:
        hits = _blocked(corpus, questions, k, id_col, vec_col, q_id, q_vec, schema, -(-asked // max_bytes))
    w = Window.partitionBy(q_id).orderBy(F.col("_key"), F.col(id_col))
    ranked = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(q_id, "rank", id_col, "dist")


def _found(qids, best: _Best, q_id: str, id_col: str):
    """The k best rows of every question, as frames."""
    for lo in range(0, len(qids), 1024):
        some = [i for i in range(lo, min(lo + 1024, len(qids))) if len(best.dist[i])]
        if some:
            dist = np.concatenate([best.dist[i] for i in some])
            yield pd.DataFrame(
                {
                    q_id: np.repeat(np.asarray(qids, object)[some], [len(best.dist[i]) for i in some]),
                    id_col: np.concatenate([best.ids[i] for i in some]),
                    "dist": dist,
                    "_key": _key(dist),
                }
            )


def _add(best: _Best, ids: pd.Series, vectors: pd.Series) -> None:
    step = max(1, 4_000_000 // max(1, len(best.q)))
    for lo in range(0, len(ids), step):
        x = _to_matrix(vectors.iloc[lo : lo + step], best.q.shape[1])
        best.add(ids.iloc[lo : lo + step].to_numpy().astype(object), x)


def _carried(corpus, questions, k, id_col, vec_col, q_id, q_vec, schema) -> DataFrame:
    """Hits of few questions, which travel with the tasks."""
    spark = corpus.sparkSession
    ids, matrix = _batch(questions, q_id, q_vec)
    if not len(ids):
        return spark.createDataFrame([], schema)
    batch = spark.sparkContext.broadcast((ids, matrix))  # at most max_bytes

    def top_k(batches):
        qids, qm = batch.value
        best = _Best(qm, k)
        for pdf in batches:
            _add(best, pdf[id_col], pdf[vec_col])
        yield from _found(qids, best, q_id, id_col)

    return corpus.mapInPandas(top_k, schema)


def _blocked(corpus, questions, k, id_col, vec_col, q_id, q_vec, schema, n_blocks: int) -> DataFrame:
    """Hits of any number of questions: each block of questions meets each
    group of corpus rows in one task."""
    n_groups = max(1, -(-_vector_bytes(corpus, vec_col) // GROUP_BYTES))
    double = "array<double>"
    none_id, none_row = F.lit(None).cast(schema[q_id].dataType), F.lit(None).cast(schema[id_col].dataType)
    every_group = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    asked = questions.select(
        F.pmod(F.xxhash64(q_id), F.lit(n_blocks)).cast("int").alias("_block"), every_group.alias("_group"), F.lit(0).alias("_kind"),
        F.col(q_id).alias("_q"), none_row.alias("_row"), F.col(q_vec).cast(double).alias("_vec"),
    )
    met = corpus.select(
        every_block.alias("_block"), F.pmod(F.xxhash64(id_col), F.lit(n_groups)).cast("int").alias("_group"), F.lit(1).alias("_kind"),
        none_id.alias("_q"), F.col(id_col).alias("_row"), F.col(vec_col).cast(double).alias("_vec"),
    )
    parts = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks * n_groups)
    dealt = asked.unionByName(met).repartition(parts, "_block", "_group").sortWithinPartitions("_block", "_group", "_kind")

    def top_k(batches):
        pair, qids, vectors, best = None, [], [], None
        for pdf in batches:
            starts = np.flatnonzero((pdf[["_block", "_group", "_kind"]].diff().fillna(1) != 0).any(axis=1))
            for lo, hi in zip(starts, [*starts[1:], len(pdf)], strict=True):
                some = pdf.iloc[lo:hi]
                now, kind = (some["_block"].iloc[0], some["_group"].iloc[0]), some["_kind"].iloc[0]
                if now != pair:
                    if best is not None:
                        yield from _found(qids, best, q_id, id_col)
                    pair, qids, vectors, best = now, [], [], None
                if kind == 0:
                    qids += some["_q"].tolist()
                    vectors += some["_vec"].tolist()
                elif qids:
                    if best is None:
                        best = _Best(_to_matrix(pd.Series(vectors), len(vectors[0])), k)
                        vectors = []
                    _add(best, some["_row"], some["_vec"])
        if best is not None:
            yield from _found(qids, best, q_id, id_col)

    return dealt.mapInPandas(top_k, schema)


def nearest(corpus: DataFrame, questions: DataFrame, **columns) -> DataFrame:
    """The plain search: the single nearest row."""
    return knn(corpus, questions, k=SEARCH_K, **columns)


def attach_metadata(hits: DataFrame, table: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Look up columns of the hits by id (questions x k rows against the
    table; the planner picks the join by their sizes)."""
    return table.select(id_col, *cols).join(hits, id_col)
