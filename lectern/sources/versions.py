"""Published versions of a table in a shared folder.

    root/data/<name>/        the files of one version
    root/versions/<n>.json   {"version": n, "data": name}, written last

A version exists from the moment its manifest does, and the manifest is made
with an exclusive create after the data is complete: a reader finds the newest
whole version, a write that stops half-way is never seen, and of two writers
of one version the second raises.  Older versions stay readable.  Exclusive
creation is what HDFS and local folders give; an object store needs a
committer that gives it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Another writer published this version first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    place, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def _text(spark: SparkSession, path: str) -> str:
    place, fs = _fs(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Published versions and the folder of each; a manifest that is still
    being written is not one."""
    out = {}
    for name in _listed(spark, f"{root}/versions"):
        if re.fullmatch(r"[0-9]+\.json", name):
            try:
                entry = json.loads(_text(spark, f"{root}/versions/{name}"))
            except json.JSONDecodeError:
                continue
            out[entry["version"]] = f"{root}/data/{entry['data']}"
    return dict(sorted(out.items()))


def new_data_path(root: str) -> str:
    """A folder of its own for the files of a version to come."""
    return f"{root}/data/{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, data_path: str, expected: int | None = None) -> int:
    """Make a written folder the newest version and return its number.
    ``expected`` is the version the writer started from; if another has been
    published since, or is published first, :class:`VersionConflict` is raised."""
    newest = max(versions(spark, root), default=0)
    if expected is not None and newest != expected:
        raise VersionConflict(f"version {newest} was published since version {expected}")
    number = (newest if expected is None else expected) + 1
    place, fs = _fs(spark, f"{root}/versions/{number}.json")
    try:
        stream = fs.create(place, False)
    except Exception as exc:
        if "AlreadyExists" in str(exc) or "already exists" in str(exc):
            raise VersionConflict(f"version {number} is already there") from exc
        raise
    try:
        stream.write(json.dumps({"version": number, "data": data_path.rsplit("/", 1)[1]}).encode())
    finally:
        stream.close()
    return number


def save(df: DataFrame, root: str, expected: int | None = None, partition_by: list[str] | None = None) -> int:
    """Write ``df`` as the next version of the table at ``root``."""
    path = new_data_path(root)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return publish(df.sparkSession, root, path, expected)


def current(spark: SparkSession, root: str) -> int:
    """The newest version; 0 where none is published."""
    return max(versions(spark, root), default=0)


def path_of(spark: SparkSession, root: str, version: int | None = None) -> str:
    """The folder of a version (the newest unless named); a missing one raises."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{root} has no version {version or ''}".rstrip())
    return known[max(known) if version is None else version]


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table of a version, the newest unless named."""
    return spark.read.parquet(path_of(spark, root, version))
