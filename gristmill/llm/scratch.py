"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import unshuffled


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a temporary one is set if driver and executors
    are one process; on a cluster that is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> str:
    """Writes the rows to a new shared Parquet table and returns its path. What was shuffled for it is deleted once it is written."""
    path = new_path(df.sparkSession, name)
    with unshuffled(df.sparkSession):
        df.write.parquet(path)
    return path


def write(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a new shared Parquet table and reads them back: the lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(save(df, name))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later job reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def boxed(df: DataFrame) -> Column:
    """All columns as one struct, so that names of an operator's own can't clash with them; ``select("row.*")`` gives them back."""
    return F.struct(*(column(df, c) for c in df.columns))


#: Bytes of text that a task goes through: the most, about, and what pays for a task of its own.
TEXT_BYTES, LEAST_BYTES = 1 << 24, 1 << 18


def dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, dealt into tasks of about TEXT_BYTES of text where a split holds over twice that, or its share of the cores: a file's one row
    group is one task's, whatever it holds."""
    key, text = column(docs, id_col), column(docs, text_col)
    by_split = docs.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length(text)).alias("n"))  # a row for each split
    most, size = by_split.agg(F.max("n"), F.sum("n")).first()
    tasks = max(1, -(-(size or 0) // TEXT_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // LEAST_BYTES)))
    return docs.repartition(tasks, key, F.xxhash64(text)) if (most or 0) * tasks > 2 * (size or 0) else docs
