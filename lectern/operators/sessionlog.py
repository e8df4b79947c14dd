"""A session log laid out by hash, so that one session is read without the rest.

Messages ``(session_id, seq, prompt)`` lie in ``bucket=<n>`` folders by the
hash of their session.  Reading a session reads its bucket's folder alone.  An
append adds one file to each bucket it touches; :func:`compact` writes every
bucket anew as one sorted file and publishes the result as the next version
(:mod:`..sources.versions`), to which later appends go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions as V

#: Buckets of a log; fixed for its life.
BUCKETS = 64


def bucket_of(session: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(session.cast("string")), F.lit(buckets)).cast("int")


def _laid_out(rows: DataFrame, buckets: int) -> DataFrame:
    placed = rows.withColumn("bucket", bucket_of(F.col("session_id"), buckets))
    return placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "session_id", "seq")


def append(rows: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Append messages; the first append makes the log."""
    spark = rows.sparkSession
    if not V.current(spark, root):
        V.save(_laid_out(rows, buckets), root, expected=0, partition_by=["bucket"])
        return
    _laid_out(rows, buckets).write.mode("append").partitionBy("bucket").parquet(V.path_of(spark, root))


def read(spark: SparkSession, root: str) -> DataFrame:
    """All messages."""
    return V.load(spark, root).drop("bucket")


def one_session(spark: SparkSession, root: str, session_id, buckets: int = BUCKETS) -> DataFrame:
    """One session's messages in order, from its bucket's folder alone."""
    session = F.lit(session_id)
    # the bucket is known before the plan is made, so its folder is the only one listed in the scan
    bucket = spark.range(1).select(bucket_of(session, buckets)).first()[0]
    log = V.load(spark, root)
    return log.where((F.col("bucket") == bucket) & (F.col("session_id") == session)).drop("bucket").orderBy("seq")


def files(spark: SparkSession, root: str) -> list[str]:
    return sorted(V.load(spark, root).inputFiles())


def compact(spark: SparkSession, root: str, buckets: int = BUCKETS) -> int:
    """Write each bucket as one file and publish that as the next version;
    raises when another version was published, or messages were appended,
    meanwhile.  Returns the version."""
    before, old = V.current(spark, root), files(spark, root)
    path = V.new_data_path(root)
    _laid_out(read(spark, root), buckets).write.partitionBy("bucket").parquet(path)
    if files(spark, root) != old:
        raise V.VersionConflict("messages were appended during the compaction")
    return V.publish(spark, root, path, expected=before)
