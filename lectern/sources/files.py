"""File sinks and scans: pipe-separated CSV, JSON records, vector tables."""

from __future__ import annotations

import os
from collections import Counter
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTICE_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("titulo", T.StringType()),
        T.StructField("texto", T.StringType()),
        T.StructField("resumen", T.StringType()),
    ]
)

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text_resume", T.StringType()),
    ]
)

_CSV_OPTIONS = {
    "sep": "|",
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "encoding": "UTF-8",
}


def write_pipe_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Pipe-separated CSV with a header; quotes doubled inside quoted fields,
    newlines kept inside fields, leading and trailing spaces kept.  An empty
    string reads back as NULL (as a pandas reader gives NaN).  Partitioning by ``source, ingest_date``
    lets later scans prune whole days."""
    writer = (
        df.write.mode(mode)
        .options(**_CSV_OPTIONS)
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def read_pipe_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType = NOTICE_SCHEMA,
    index_column: bool = False,
) -> DataFrame:
    """Every CSV under ``paths`` (a glob, a directory or a list), as one bag:
    a path given twice gives its rows twice, a path without files gives none.
    ``index_column`` accepts files whose first, unnamed column is a row
    index; it is dropped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    read_schema = schema
    if index_column:
        read_schema = T.StructType([T.StructField("_c0", T.StringType())] + schema.fields)
    # folders of several sources and days in one scan, whatever their layout
    reader = spark.read.schema(read_schema).options(**_CSV_OPTIONS, recursiveFileLookup="true")

    def exists(path: str) -> bool:
        try:
            reader.csv(path)  # lists the files, reads none
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    times = Counter(paths)
    times = {p: n for p, n in times.items() if exists(p)}
    # one scan of every path that is there, and one more for each repetition
    scans = [reader.csv([p for p, n in times.items() if n > k]) for k in range(max(times.values(), default=0))]
    df = reduce(DataFrame.unionAll, scans) if scans else spark.createDataFrame([], read_schema)
    return df.drop("_c0") if index_column else df


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, order: str, mode: str = "errorifexists") -> None:
    """Files holding one JSON array of records each, ascending by ``order``
    within and across files; each is written row by row, never held whole."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    dealt = df.select(text.alias("json"), F.col(order).alias("_order")).repartitionByRange(n, "_order").sortWithinPartitions("_order")

    def lines(batches):
        import pandas as pd

        held = None
        for pdf in batches:
            out = []
            for record in pdf["json"]:
                out.append("[" if held is None else held + ",")
                held = record
            if out:
                yield pd.DataFrame({"value": out})
        if held is not None:
            yield pd.DataFrame({"value": [held, "]"]})

    dealt.select("json").mapInPandas(lines, "value string").write.mode(mode).text(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType = METADATA_SCHEMA, array_file: bool = False) -> DataFrame:
    """JSON lines, or (``array_file``) files holding one JSON array of
    records each."""
    reader = spark.read.schema(schema)
    if array_file:
        reader = reader.option("multiLine", True)
    return reader.json(path)


def to_json_text(df: DataFrame, cols: list[str], out_col: str = "json") -> DataFrame:
    return df.withColumn(out_col, F.to_json(F.struct(*cols)))


def save_vectors(df: DataFrame, root: str, version: str) -> str:
    """Write the vector table to a new directory ``root/v=<version>``.

    Readers keep using the previous version until the new one is fully
    written, so a failed write never leaves an empty or partial table.
    """
    path = os.path.join(root, f"v={version}")
    df.write.mode("errorifexists").parquet(path)
    return path


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Read a vector table; a missing path raises."""
    return spark.read.parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def to_documents(df: DataFrame, text_col: str, metadata_cols: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``(page_content, metadata map<string,string>)`` per row."""
    metadata_cols = list(metadata_cols or [])
    if metadata_cols:
        meta = F.create_map(*[x for c in metadata_cols for x in (F.lit(c), F.col(c).cast("string"))])
    else:
        meta = F.create_map().cast("map<string,string>")
    return df.select(*(keep or []), F.col(text_col).alias("page_content"), meta.alias("metadata"))
