import hashlib
import io
import os
import zlib

import pytest
from compare import compare, duck
from llm_fixtures import SF

from lectern.llm import queries, warc

PAGES = "page_id long, url string, html string, digest string, first long"


def brute(rows):
    first = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and p is not None:
            first[raw] = min(p, first.get(raw, p))
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = first.get(raw)
        revisit = to is not None and p is not None and p != to
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)
    return sorted(map(tuple, warc.round_trip(df).collect()), key=str)


def test_edge_rows(spark):
    long = "é" * 50
    rows = [(4, "u", long), (2, "u\r\nWARC-Type: x", long), (9, None, long), (1, "u", "short"), (3, "u", "short")]
    rows += [(5, "", None), (6, "u", ""), (None, "u", long), (7, "u", "x" * 3_000_000), (8, "u", "WARC/1.1\r\n\r\n" * 9), (8, "u", "other")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_hot_group(spark):
    rows = [(i, "u", "same page " * 30) for i in range(500, 0, -1)] + [(i, "u", f"own {i} " * 30) for i in range(1000, 1500)]
    assert got(spark, rows) == brute(rows)


def archive(n=60):
    raw, starts = b"", []
    for i in range(n):
        starts.append(len(raw))
        body = os.urandom(50).hex().encode() * (i % 7) + warc.MAGIC
        pack = zlib.compressobj(0 if i % 2 else 6, zlib.DEFLATED, 31)  # level 0 stores the magic as it is
        raw += pack.compress(warc.record_bytes(i, "u", body, "d", None)) + pack.flush()
    return raw, starts


@pytest.mark.parametrize("split", [1, 37, 1000, 10**9])
def test_every_split_owns_the_records_that_start_in_it(split):
    raw, starts = archive()
    found = []
    for lo in range(0, len(raw), split):
        ids = [r["record_id"] for r in warc.records_in(io.BytesIO(raw), len(raw), lo, lo + split)]
        assert ids == [f"<urn:page:{i}>" for i, s in enumerate(starts) if lo <= s < lo + split]
        found += ids
    assert len(found) == len(starts)


def test_damage_loses_its_record_only():
    raw, starts = archive(20)
    bad = bytearray(raw)
    bad[starts[5] + 200 : starts[5] + 230] = b"\0" * 30
    ids = [r["record_id"] for r in warc.records_in(io.BytesIO(bytes(bad)), len(bad), 0, len(bad))]
    assert set(ids) >= {f"<urn:page:{i}>" for i in range(20) if i != 5}


def test_query_equals_sql(spark):
    res = compare(queries.op5_warc(spark, SF), duck(SF), queries.ORACLES["op5_warc"])
    assert res["cols_match"] and res["rows_match"] and res["values_match"], res
