"""Day addresses and whole-day backfill under a row budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fill_dollar_template
from ..params import BACKFILL_BUDGET, DAY_SLOTS


def day_parts(day: Column) -> dict:
    """Year unpadded, month and day zero-padded to two digits."""
    return {
        DAY_SLOTS[0]: F.year(day).cast("string"),
        DAY_SLOTS[1]: F.lpad(F.month(day).cast("string"), 2, "0"),
        DAY_SLOTS[2]: F.lpad(F.dayofmonth(day).cast("string"), 2, "0"),
    }


def day_urls(days: DataFrame, sources: list[tuple[str, str]], day_col: str = "day") -> DataFrame:
    """One row per (source, day): the source's URL template filled with the
    day.  ``sources`` is a short list of (name, template) pairs; it is
    expanded with a generator on each day row, so no join is needed."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("source"), fill_dollar_template(tpl, day_parts(F.col(day_col))).alias("url"))
            for name, tpl in sources
        ]
    )
    return days.select("*", F.inline(entries))


def day_offsets(df: DataFrame, ts_col: str, anchor: Column | None = None) -> DataFrame:
    """Adds ``day`` and ``day_offset`` (days before the anchor day; the
    default anchor is the newest day in the data)."""
    with_day = df.withColumn("day", F.to_date(F.col(ts_col)))
    if anchor is None:
        # Uncorrelated scalar subquery: one aggregate, evaluated once.
        anchor = with_day.select(F.max("day")).scalar()
    return with_day.withColumn("day_offset", F.datediff(anchor, F.col("day")))


def backfill_days(
    day_counts: DataFrame,
    source_col: str = "source",
    offset_col: str = "day_offset",
    count_col: str = "n_rows",
    budget: int = BACKFILL_BUDGET,
) -> DataFrame:
    """Keep whole days, newest first, until the running row total has gone
    strictly over ``budget``: a day is kept when the rows of the newer days
    of its source add up to no more than the budget.  Empty days add zero.

    ``day_counts`` is one row per (source, day), so the window runs over a
    small aggregate, never over the rows themselves.
    """
    w = (
        Window.partitionBy(source_col)
        .orderBy(F.col(offset_col))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum(count_col).over(w), F.lit(0)).cast("bigint")
    return (
        day_counts.withColumn("rows_before", before)
        .filter(F.col("rows_before") <= F.lit(budget))
    )


def rows_of_kept_days(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the kept days (whole days, never cut).  ``kept`` has one row
    per kept (source, day); the planner picks the join by its size."""
    return rows.join(kept.select(*keys), keys, "left_semi")


def calendar(first: Column, last: Column) -> Column:
    """Every day from ``first`` to ``last``, newest first."""
    return F.reverse(F.sequence(first, last, F.expr("INTERVAL 1 DAY")))
