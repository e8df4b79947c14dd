"""Session, table access and shared scratch paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Partitions that CPU-heavy tables are spread over; unset or 0: as they are
# scanned.  A file of one row group cannot be split, so a small table of long
# texts is one task; a session over such files may set this to its cores.  It
# is a plain setting: nothing looks at sizes.
SPREAD_SETTING = "spark.lectern.spread"

# Id column of each table with CPU-heavy rows (text or vectors).
SPREAD_KEYS = {
    "documents": "doc_id",
    "pages": "page_id",
    "embeddings": "vec_id",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench.  On a cluster, use the cluster's own
    session; nothing here is required by the operators."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(64 << 20))
        .config(SPREAD_SETTING, "0" if cores == "*" else str(cores))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lectern`` importable in the Python workers.

    UDFs and ``mapInPandas`` functions are pickled by reference to this
    package, so executors need it on their path; the package is zipped once
    per process and added with ``addPyFile`` (what ``--py-files`` does), and
    Spark serves it to every executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="lectern-pkg-"), "lectern.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A driver table.  ``heavy`` marks per-row CPU-heavy use (regexes over
    long texts): such rows are spread where the session asks for it."""
    df = spark.read.parquet("/".join([sf_dir.rstrip("/"), f"{name}.parquet"]))
    n = int(spark.conf.get(SPREAD_SETTING, "0"))
    # hash, not round-robin: no sort is needed to make retries deterministic
    return df.repartition(n, F.col(SPREAD_KEYS[name])) if heavy and n else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach, and
    it is only read.  Only when it is unset (local runs, tests) is a folder
    of our own chosen and set.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a folder that the driver and every executor share; "
            "a machine-local folder is chosen only in local mode"
        )
    local = tempfile.mkdtemp(prefix="lectern-ckpt-")
    sc.setCheckpointDir(local)
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # sessions may refuse core settings at runtime
        pass
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared checkpoint folder; the
    folder's URI scheme is kept."""
    root = ensure_checkpoint_dir(spark)
    return "/".join([root.rstrip("/"), "lectern", name, uuid.uuid4().hex])
