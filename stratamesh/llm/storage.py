"""Shared folders for intermediate tables and archives.

The cluster names one shared folder in ``spark.checkpoint.dir``; it is read from the session. Only a local session without that setting
(as in tests) gets a folder of our own; elsewhere its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in an Arrow batch while an intermediate table is written.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "stratamesh-shared")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for the time of a block."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    Long texts go to Python workers in small batches, and the shuffle files behind the table go when it is written.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if scopes := _scopes():
        scopes[-1].append(path)
    return out


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The open scopes of this thread."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def delete(spark: SparkSession, path: str) -> None:
    """Delete a stored table, wherever the shared folder is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Deletes the tables that this thread stores inside it when it ends, but for those named by ``keep``, which go to the scope around it.

    Only for code whose results don't read the other tables any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def __enter__(self) -> Scratch:
        _scopes().append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df._stored_path)
        return df

    def __exit__(self, kind, value, trace) -> None:
        scopes = _scopes()
        for path in scopes.pop():
            if path in self.kept:
                if scopes:
                    scopes[-1].append(path)
            else:
                delete(self.spark, path)


def numbered(documents: DataFrame, name: str = "row") -> DataFrame:
    """The rows with a number of their own, the same whenever the same files are read again: tables made by a query should be stored first."""
    return documents.withColumn(name, F.monotonically_increasing_id())
