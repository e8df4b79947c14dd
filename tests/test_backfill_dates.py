"""Whole-day backfill, day URLs and date formats."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import backfill as B


def test_budget_boundary(spark):
    counts = [4, 0, 6, 1, 9]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(counts)], "source string, day_offset int, n_rows long")
    kept = sorted(r["day_offset"] for r in B.backfill_days(df, budget=10).collect())
    assert kept == [0, 1, 2, 3]  # 10 is not greater than 10


def test_budget_per_source(spark):
    df = spark.createDataFrame(
        [("a", 0, 50), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1), ("b", 2, 1)], "source string, day_offset int, n_rows long"
    )
    kept = sorted((r["source"], r["day_offset"]) for r in B.backfill_days(df, budget=10).collect())
    assert kept == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]


def test_day_urls_padding(spark):
    days = spark.createDataFrame([(dt.date(2024, 4, 9),), (dt.date(987, 12, 25),)], "day date")
    out = B.day_urls(days, [("g", "https://g.example/$anio/$mes/$dia/i?d=$dia")])
    got = sorted(r["url"] for r in out.collect())
    assert got == ["https://g.example/2024/04/09/i?d=09", "https://g.example/987/12/25/i?d=25"]


def test_day_offsets_from_newest_day(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 3, 10),), (dt.datetime(2024, 1, 1, 23),), (dt.datetime(2024, 1, 3, 1),)], "ts timestamp"
    )
    got = sorted(r["day_offset"] for r in B.day_offsets(df, "ts").collect())
    assert got == [0, 0, 2]
