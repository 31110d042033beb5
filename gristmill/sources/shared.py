"""New folders that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir``. Where the session names none, a temporary folder is set if driver and executors are
    one process; on a cluster that is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside = threading.Lock(), []


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files are deleted when it ends; else they stay until the driver happens to collect garbage. Threads may
    overlap: the setting is put back when the last of them leaves."""
    with _lock:
        _inside.append(_inside[0] if _inside else spark.conf.get(_CLEANUP, "false"))
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            before = _inside.pop()
            if not _inside:
                spark.conf.set(_CLEANUP, before)


def persisted(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet and read again: lineage ends there, and generated numbers stay as they are. What was shuffled for them is
    deleted once they are written."""
    path = new_path(df.sparkSession, name)
    with unshuffled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    """A path and its file system, whatever the scheme."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    own, system = _file(spark, path)
    return system.exists(own)


def children(spark: SparkSession, path: str) -> list[str]:
    """The paths right below a folder; none if there is no such folder."""
    own, system = _file(spark, path)
    return sorted(s.getPath().toString() for s in system.listStatus(own)) if system.exists(own) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    own, system = _file(spark, path)
    system.delete(own, True)
