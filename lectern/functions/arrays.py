"""Exploding computed arrays.

An inner ``explode``/``posexplode`` lets the optimizer infer a filter
``size(array) > 0`` below the generator, which evaluates the array
expression a second time (twice the regex work, or two Python UDF calls).
The outer variants followed by a NULL filter drop the same rows with one
evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posexplode_rows(df: DataFrame, keep: list, arr: Column, pos_col: str, val_col: str) -> DataFrame:
    """One row per element (position 0-based); empty or NULL arrays give
    no row."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos_col, val_col)).filter(F.col(pos_col).isNotNull())


def explode_rows(df: DataFrame, keep: list, arr: Column, val_col: str) -> DataFrame:
    """One row per non-NULL element."""
    return df.select(*keep, F.explode_outer(arr).alias(val_col)).filter(F.col(val_col).isNotNull())
