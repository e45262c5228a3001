"""Intermediate tables in the folder that all executors share.

A stage whose result is read more than once, or must not change when an executor is lost, is
written as Parquet below ``spark.checkpoint.dir``. Only where that setting is missing and the master is
local (tests, a single machine) a folder of this process is used instead; on a cluster it is an error,
since a folder of one machine would lose what others write.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_kept: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's, or one of this process where the session names none."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="lodestock-")
            atexit.register(shutil.rmtree, _own, True)
        root = "file://" + _own
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str = "stage", *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it (cuts the lineage)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _kept.append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the tables that ``keep`` wrote so far, once what was made of them has been read or written; how many there were."""
    n = len(_kept)
    while _kept:
        where = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


def small(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small by its nature; refuses to take more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; it can't be held on the driver")
    return rows


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small new file through the file system the path names; it must not exist yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, sorted; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []
