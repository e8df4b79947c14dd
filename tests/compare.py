"""Spark result vs DuckDB oracle: row count, column names and an
order-insensitive comparison of the values."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def rows_of(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=_key)


def compare(spark_df, con, sql: str) -> dict:
    s_rows = [r.asDict(recursive=True) for r in spark_df.collect()]
    s_cols = sorted(spark_df.columns)
    res = con.execute(sql)
    d_cols_raw = [c[0] for c in res.description]
    d_rows = [dict(zip(d_cols_raw, r)) for r in res.fetchall()]
    d_cols = sorted(d_cols_raw)
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows), "spark_cols": s_cols, "oracle_cols": d_cols}
    out["cols_match"] = s_cols == d_cols
    out["rows_match"] = len(s_rows) == len(d_rows)
    if out["cols_match"]:
        a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
        out["values_match"] = a == b
        if not out["values_match"]:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            out["first_diff"] = repr(diff)[:1500]
            sa, sb = set(a), set(b)
            out["only_spark"] = repr(list(sa - sb)[:2])[:800]
            out["only_oracle"] = repr(list(sb - sa)[:2])[:800]
    else:
        out["values_match"] = False
    return out
