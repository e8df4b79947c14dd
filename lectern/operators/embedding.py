"""Text embedding.

The default embedding is deterministic and needs no model: tokens are the
maximal runs of letters and digits of the lower-cased text, each token is
hashed to a bucket (first 32 bits of its MD5, modulo ``dim``), and the
bucket counts are L2-normalised.  Tokenising and hashing run in the JVM;
only the per-row bucket histogram is computed in an Arrow-batched pandas
UDF (one ``numpy.bincount`` per batch).

Any other model is plugged in as a batch function ``list[str] ->
list[list[float]]`` through :func:`embed_with`, run by ``mapInPandas``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_RE = r"[\p{L}\p{N}]+"
NON_TOKEN_RE = r"[^\p{L}\p{N}]+"


def tokens(text) -> Column:
    """Maximal runs of letters and digits of the lower-cased text (the
    non-empty pieces between runs of other characters; splitting is about
    three times faster than extracting every match)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(t), NON_TOKEN_RE), "")


def bucket_of(token: str, dim: int) -> int:
    """Bucket of one token: first 32 bits of the MD5 of its UTF-8 bytes,
    modulo ``dim``."""
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


def _dense_counts(token_lists: pd.Series, dim: int) -> np.ndarray:
    """(rows x dim) int64 token counts of one Arrow batch; the batch's
    distinct tokens are hashed once."""
    n = len(token_lists)
    lens = np.fromiter((0 if t is None else len(t) for t in token_lists), dtype=np.int64, count=n)
    parts = [t for t in token_lists if t is not None and len(t)]
    if not parts:
        return np.zeros((n, dim), dtype=np.int64)
    flat = np.concatenate(parts)
    codes, vocab = pd.factorize(flat)
    buckets = np.fromiter((bucket_of(t, dim) for t in vocab), dtype=np.int64, count=len(vocab))[codes]
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    return np.bincount(rows * dim + buckets, minlength=n * dim).reshape(n, dim)


def _counts_udf(dim: int):
    @F.pandas_udf("counts array<int>, norm double")
    def bucket_counts(token_lists: pd.Series) -> pd.DataFrame:
        dense = _dense_counts(token_lists, dim)
        # integer sums of squares are exact; sqrt is correctly rounded
        norm = np.sqrt((dense * dense).sum(axis=1).astype(np.float64))
        return pd.DataFrame({"counts": list(dense.astype(np.int32)), "norm": norm})

    return bucket_counts


def _unit_udf(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def unit_vectors(token_lists: pd.Series) -> pd.Series:
        dense = _dense_counts(token_lists, dim).astype(np.float64)
        norm = np.sqrt((dense * dense).sum(axis=1))
        out = np.divide(dense, norm[:, None], out=np.zeros_like(dense), where=norm[:, None] > 0)
        return pd.Series(list(out))

    return unit_vectors


def hashed_counts(text, dim: int = 256) -> Column:
    """``struct<counts array<int>, norm double>``: token counts per bucket
    and their Euclidean norm.  Tokens are cut in the JVM."""
    return _counts_udf(dim)(tokens(text))


def hashed_embedding(text, dim: int = 256) -> Column:
    """Default embedding: hashed token counts scaled to unit length,
    ``array<double>``; a text without tokens gives the zero vector."""
    return _unit_udf(dim)(tokens(text))


def with_hashed_embedding(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 256) -> DataFrame:
    return df.withColumn(out_col, hashed_embedding(text_col, dim))


def sparse_weights(df: DataFrame, id_cols: list[str], text_col: str, dim: int = 256) -> DataFrame:
    """Sparse form ``(ids..., bucket, cnt, weight)`` of the default embedding,
    without any shuffle: each row's counts are exploded in place."""
    with_counts = df.select(*id_cols, hashed_counts(text_col, dim).alias("_h"))
    exploded = with_counts.select(
        *id_cols, F.col("_h.norm").alias("_norm"), F.posexplode_outer("_h.counts").alias("bucket", "cnt")
    ).filter(F.col("cnt") > 0)
    return exploded.select(
        *id_cols,
        F.col("bucket").cast("int").alias("bucket"),
        F.col("cnt").cast("bigint").alias("cnt"),
        (F.col("cnt") / F.col("_norm")).alias("weight"),
    )


def embed_texts(texts: list[str], dim: int) -> list[np.ndarray]:
    """The default embedding of a list of texts, for :func:`embed_with`."""
    cut = pd.Series([[t for t in re.split(r"[\W_]+", text.lower()) if t] for text in texts])
    dense = _dense_counts(cut, dim).astype(np.float64)
    norm = np.sqrt((dense * dense).sum(axis=1))
    return list(np.divide(dense, norm[:, None], out=np.zeros_like(dense), where=norm[:, None] > 0))


def embed_with(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list[str]], list],
    out_col: str = "embedding",
    element: T.DataType | None = None,
) -> DataFrame:
    """Run a caller-supplied batch embedding function over ``text_col``.

    ``fn`` receives the texts of one Arrow batch and must return one vector
    per text.  It runs inside the executors, batch by batch.  ``element`` is
    the type of the vector's elements (float by default).
    """
    element = element or T.FloatType()
    kind = np.float64 if isinstance(element, T.DoubleType) else np.float32
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(element))])

    def run(batches):
        for pdf in batches:
            vecs = fn(pdf[text_col].fillna("").tolist()) if len(pdf) else []
            out = pdf.copy()
            out[out_col] = [np.asarray(v, dtype=kind) for v in vecs]
            yield out

    return df.mapInPandas(run, schema)
