"""Landed JSON-lines files as a Spark data source, batch and stream.

    register(spark)
    spark.read.format("landing").option("path", folder).schema(...).load()
    spark.readStream.format("landing").option("path", folder).schema(...).load()

A file is cut into byte ranges of ``rangeBytes``; a task reads the lines that
start inside its range, so one large file is read by many tasks.  Files are
ordered by modification time and name.  A stream's offset is the last file
taken, kept in the checkpoint, so each file is read once over restarts; a
file lands under another name (or a leading dot or underscore) until it is
whole.  Folders are any that a pyarrow file system opens.
"""

from __future__ import annotations

import io
import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 32 << 20
DEFAULT_SCHEMA = "page_id bigint, url string, html string"


class ByteRange(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def landed(folder: str) -> list[tuple[int, str, int]]:
    """``(modification time, path, size)`` of the whole files, in order."""
    from pyarrow import fs

    system, path = _open(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    whole = [f for f in found if f.is_file and f.base_name[0] not in "._"]
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in whole)


def ranges(files: list[tuple[int, str, int]], folder: str, size: int) -> list[ByteRange]:
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    return [
        ByteRange(scheme + path if scheme else path, lo, min(lo + size, total))
        for _, path, total in files
        for lo in range(0, total, size)
    ]


def lines_of(part: ByteRange):
    """The lines that start inside a byte range."""
    system, path = _open(part.uri)
    with io.BufferedReader(system.open_input_file(path), 1 << 20) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # the line that began before the range
        f.seek(at)
        while at < part.end:
            line = f.readline()
            if not line:
                return
            at += len(line)
            if line.strip():
                yield line


def rows_of(part: ByteRange, schema: T.StructType):
    names = [f.name for f in schema.fields]
    for line in lines_of(part):
        record = json.loads(line)
        yield tuple(record.get(n) for n in names)


class LandingReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.folder = schema, options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self):
        return ranges(landed(self.folder), self.folder, self.size) or [ByteRange("", 0, 0)]

    def read(self, partition):
        return rows_of(partition, self.schema) if partition.uri else iter(())


class LandingStreamReader(DataSourceStreamReader):
    """Offsets: modification time and path of the last file taken."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.folder = schema, options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = landed(self.folder)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        return ranges([f for f in landed(self.folder) if lo < f[:2] <= hi], self.folder, self.size)

    def read(self, partition):
        return rows_of(partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


class LandingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return DEFAULT_SCHEMA

    def reader(self, schema: T.StructType) -> LandingReader:
        return LandingReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> LandingStreamReader:
        return LandingStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandingSource)
