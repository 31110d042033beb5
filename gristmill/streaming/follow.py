"""A growing event log as a stream of files."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import shared
from ..sources.tables import EVENT

#: Event numbers of a run that share one integer of what was seen: a bit for each, so 1 KiB at most for so many events.
BLOCK = 8192
#: Groups that blocks are dealt to; each has one state.
GROUPS = 1024
#: Batches after which a table of latest states is written as one.
COMPACT = 16
_STATE = "run_id string, seq long, stage string, payload string"


def read_stream(spark: SparkSession, path: str, after: int = 0, max_files: int = 100) -> DataFrame:
    """The log's events above a sequence number as they were written, repeated ones included; files are JSON lines."""
    log = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", max_files).json(path)
    return log.where(F.col("seq") > after)


def _first_times(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New events of one group of blocks. What was seen is an integer for each block, with a bit for each number; once a block's run is closed
    its integer goes, and with the last one the state."""
    seen = pickle.loads(state.get[0]) if state.exists else {}
    closed = set()
    for rows in parts:
        told = rows["_close"].to_numpy(bool)
        closed.update(zip(rows["run_id"][told], rows["_block"][told]))
        rows = rows[~told]
        fresh = np.zeros(len(rows), bool)
        for i, (run, block, seq) in enumerate(zip(rows["run_id"], rows["_block"].tolist(), rows["seq"].tolist())):
            had, bit = seen.get((run, block), 0), 1 << seq % BLOCK
            if not had & bit:
                fresh[i], seen[run, block] = True, had | bit
        if fresh.any():
            yield rows[fresh].drop(columns=["_close", "_block", "_group"])
    seen = {at: bits for at, bits in seen.items() if at not in closed} if closed else seen
    if seen:
        state.update((pickle.dumps(seen),))
    elif state.exists:
        state.remove()


def follow(spark: SparkSession, path: str, after: int = 0, max_files: int = 100, closes: Column | None = None, groups: int = GROUPS) -> DataFrame:
    """The log's events above a sequence number, old and new, each once, however late they come.

    Events are told apart by run and number. What was seen is kept as one bit for each number, in blocks of numbers, and the blocks are dealt by
    run and number to ``groups`` groups, so neither a long run nor a hot one lands in one task. A batch works group by group and writes the
    states of those that it meets: a thousand open runs a group cost little; for many more of them give more groups. A stream keeps the number
    that it began with. Events without a number are left out.

    An event for which ``closes`` holds is its run's last: it is told to all blocks of the run, which forget what they saw, so that state is
    kept for open runs only. What still comes for a run in a later batch counts as new, and opens it again.
    """
    block = F.floor(F.col("seq") / BLOCK)
    own = F.array(F.struct(block.alias("_block"), F.lit(False).alias("_close")))
    told = F.transform(F.sequence(F.lit(after // BLOCK).cast("long"), block), lambda b: F.struct(b.alias("_block"), F.lit(True).alias("_close")))
    rows = read_stream(spark, path, after, max_files)
    rows = rows.select("*", F.inline(own if closes is None else F.when(F.coalesce(closes, F.lit(False)), F.concat(own, told)).otherwise(own)))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("run_id", "_block"), F.lit(groups)))
    return rows.groupBy("_group").applyInPandasWithState(_first_times, EVENT, "seen binary", "append", GroupStateTimeout.NoTimeout)


def latest_state(log: DataFrame) -> DataFrame:
    """Each run's last stage and payload; the same for a table and, in update or complete mode, for a stream. Repeated events change nothing."""
    last = F.max(F.struct("seq", "stage", "payload"))
    return log.groupBy("run_id").agg(last.alias("last")).select("run_id", "last.seq", "last.stage", "last.payload")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes everything that is there by now to a Parquet table, and stops; the ended query tells of its state."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def keep_latest(log: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Brings the table of :func:`latest_state` below ``path`` up to date with a stream, and returns it.

    Each batch writes the runs that it changed to a folder of its own, or nothing if it is repeated and has done so; nothing comes to the
    driver. Every COMPACT batches the folder holds all runs instead, and those before it are deleted, so that there are never many more.
    """
    spark = log.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        own = f"{path}/batch={number}"
        before = [f for f in shared.children(spark, path) if f.rpartition("=")[2].isdigit() and int(f.rpartition("=")[2]) < number]
        whole = number % COMPACT == COMPACT - 1
        if not shared.exists(spark, f"{own}/_SUCCESS"):
            rows = batch
            if whole and before:
                rows = latest_state(batch.unionByName(batch.sparkSession.read.schema(_STATE).parquet(*before)))
            rows.write.mode("overwrite").parquet(own)
        if whole:
            for folder in before:
                shared.remove(spark, folder)

    latest_state(log).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return latest_state(spark.read.schema(_STATE).parquet(path))
