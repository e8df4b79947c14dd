"""Ordered string aggregation and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import scratch_path


def _join_sorted(pairs: Column, sep: str) -> Column:
    """``pairs`` is an array of struct(o, v); join v in o order, NULL v
    skipped."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["v"]), sep)


def ordered_concat(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    value_col: str,
    sep: str,
    out_col: str,
    bucket_width: int | None = None,
    count_col: str | None = None,
) -> DataFrame:
    """Concatenate ``value_col`` per group in ``order_col`` order.

    With ``bucket_width`` the aggregation runs in two levels: first per
    (group, order bucket), so a hot group is spread over many tasks and
    each partial string holds at most ``bucket_width`` rows; then the
    partial strings of a group are joined in bucket order.  A group whose
    values are all NULL gives NULL.
    """
    order = F.col(order_col)
    value = F.col(value_col)
    if bucket_width is None:
        agg = [
            F.collect_list(F.struct(order.alias("o"), value.alias("v"))).alias("_pairs"),
            F.count(value).alias("_n"),
        ]
        if count_col:
            agg.append(F.count(F.lit(1)).alias(count_col))
        grouped = df.groupBy(*group_cols).agg(*agg)
        return grouped.select(
            *group_cols,
            *([count_col] if count_col else []),
            F.when(F.col("_n") > 0, _join_sorted(F.col("_pairs"), sep)).alias(out_col),
        )

    bucket = F.floor(order / F.lit(bucket_width)).alias("_bucket")
    # Distribute on (group, bucket) explicitly: an input already clustered
    # by the group alone would otherwise be reused, keeping a hot group in
    # one task.  Collecting does not shrink rows, so nothing is lost by
    # shuffling before the partial aggregate.
    level1 = (
        df.select(*group_cols, bucket, order.alias("_o"), value.alias("_v"))
        .repartition(*[F.col(c) for c in group_cols], F.col("_bucket"))
        .groupBy(*group_cols, "_bucket")
        .agg(
            F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_v").alias("v"))).alias("_pairs"),
            F.count("_v").alias("_n"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .select(
            *group_cols,
            "_bucket",
            "_rows",
            F.when(F.col("_n") > 0, _join_sorted(F.col("_pairs"), sep)).alias("_part"),
        )
    )
    agg = [
        F.collect_list(F.struct(F.col("_bucket").alias("o"), F.col("_part").alias("v"))).alias("_pairs"),
        F.count("_part").alias("_n"),
    ]
    if count_col:
        agg.append(F.sum("_rows").alias(count_col))
    level2 = level1.groupBy(*group_cols).agg(*agg)
    return level2.select(
        *group_cols,
        *([count_col] if count_col else []),
        F.when(F.col("_n") > 0, _join_sorted(F.col("_pairs"), sep)).alias(out_col),
    )


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each ``name: column`` of ``sums``, the sum of the column
    (null counts as 0) over the rows of the group up to this one in ascending
    ``order``, which tells the rows of a group apart.

    No group lies in one task: the rows are range-partitioned by group and
    order and written once, summed inside each (partition, group), and moved
    by the totals of the partitions before, one small row each.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "running_sums")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parted = spark.read.parquet(path)
    here = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    value = {name: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for name, c in sums.items()}
    totals = parted.groupBy("_part", *group).agg(*[F.sum(v).alias(f"_before_{name}") for name, v in value.items()])
    offsets = totals.select("_part", *group, *[F.coalesce(F.sum(f"_before_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums])
    local = parted.select("*", *[F.sum(v).over(here).alias(name) for name, v in value.items()])
    joined = local.join(offsets, ["_part", *group])
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"_before_{name}")).cast("bigint").alias(name) for name in sums])
