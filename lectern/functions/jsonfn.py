"""JSON responses held in a column: parse, index into nested fields, and
take the first array element that satisfies a predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(c, schema: str) -> Column:
    """``from_json`` with an explicit DDL schema; malformed text gives NULL
    fields rather than a failed job."""
    col = F.col(c) if isinstance(c, str) else c
    return F.from_json(col, schema, {"mode": "PERMISSIVE"})


def first_where(arr, predicate) -> Column:
    """First element of ``arr`` for which ``predicate(element)`` holds; NULL
    when none does (the original raised there)."""
    col = F.col(arr) if isinstance(arr, str) else arr
    return F.try_element_at(F.filter(col, predicate), F.lit(1))
