"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays in one shard. Groups go, largest first, to the shard that
holds the fewest bytes (the lower number on a tie). The heap runs on the driver over the *histogram* of
group sizes and never over the groups themselves: whatever is dealt in whole rounds is written down as one repeating
segment, which gives the same shards as dealing one by one. Different sizes add up, so data of T bytes have fewer than
sqrt(2 T) of them, however many groups there are: a quarter of a million at 30 GB.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: Ranks and slots are numbered inside so many buckets first, so that no task sees all groups of a size or a whole shard.
RANK_BUCKETS, SLOT_BUCKETS = 256, 1024
#: Segments that are broadcast, at most; more are joined.
BROADCAST_SEGMENTS = 1 << 18

_SEGMENT = T.StructType(
    [
        T.StructField("bytes", T.LongType()),
        T.StructField("from_rank", T.LongType()),
        T.StructField("to_rank", T.LongType()),
        T.StructField("shards", T.ArrayType(T.IntegerType())),
    ]
)


def deal(histogram: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, list[int]]]:
    """Longest-processing-time over (bytes of a group, number of groups), sizes in falling order.

    Returns segments (size, from rank, to rank, shards): the group of rank r goes to
    ``shards[(r - from) % len(shards)]``.
    """
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for size, count in sorted(histogram, reverse=True):
        rank, singles = 0, []
        while rank < count:
            loads = sorted(heap) if count - rank > n_shards else None
            rounds = low = 0
            if loads:
                low = sum(load < loads[0][0] + size for load, _ in loads)
                rounds = (count - rank) // n_shards if low == n_shards else min((loads[low][0] - loads[low - 1][0]) // size, (count - rank) // low)
            if rounds >= 2:
                rounds = int(rounds)
                if singles:
                    out.append((size, rank - len(singles), rank, singles))
                    singles = []
                out.append((size, rank, rank + rounds * low, [s for _, s in loads[:low]]))
                rank += rounds * low
                heap = [(load + rounds * size if i < low else load, s) for i, (load, s) in enumerate(loads)]
                heapq.heapify(heap)
            else:
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                singles.append(shard)
                rank += 1
        if singles:
            out.append((size, rank - len(singles), rank, singles))
    return out


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard and its slot there: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    A row's size is its text's UTF-8 bytes plus 8. The law is ``bytes``: shards hold nearly equal numbers of
    bytes, as far as groups that stay together allow. ``slot`` counts from 0 in each shard without gaps.
    ``grown_shard`` is null under this law.

    Null texts count as 0 bytes, have checksum 0 and form a group of their own; empty texts form another. Rows with
    a null id are kept; their slots follow from where they were read. Repeated rows are each kept. Groups of one size go in the
    order of their smallest ids' buckets, of these ids, then of their texts' hashes. A very long text is a group like any other. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = scratch.column(docs, text_col).cast("string")
    rows = docs.select(
        scratch.column(docs, id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("crc"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.min("id").alias("first_id"))
    groups = groups.withColumn("bucket", F.pmod(F.coalesce("first_id", "h1", F.lit(0)), F.lit(RANK_BUCKETS)).cast("int"))
    groups = scratch.write(groups, "shard-groups")
    per_bucket = groups.groupBy("bytes", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = per_bucket.groupBy("bytes").agg(F.sum("n").alias("n")).toArrow()  # a row for each size
    dealt = deal(list(zip(*(c.to_pylist() for c in histogram.select(["bytes", "n"]).columns), strict=True)), n_shards)
    segments = scratch.write(spark.createDataFrame(dealt, _SEGMENT), "segments")
    if len(dealt) <= BROADCAST_SEGMENTS:
        segments = F.broadcast(segments)

    before = Window.partitionBy("bytes").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("bytes", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bytes", "bucket").orderBy(F.asc_nulls_last("first_id"), "h1", "h2")
    ranked = groups.withColumn("in_bucket", F.row_number().over(inside) - 1).join(offsets, ["bytes", "bucket"])
    ranked = ranked.select("h1", "h2", "bytes", (F.col("offset") + F.col("in_bucket")).alias("rank"))
    rank, start = F.col("rank"), F.col("from_rank")
    placed = ranked.join(segments, "bytes").where((rank >= start) & (rank < F.col("to_rank")))
    placed = placed.select("h1", "h2", F.expr("element_at(shards, cast((rank - from_rank) % size(shards) as int) + 1)").alias("shard"))

    # Ids may step by any number, and rows that are equal in all of these are told apart by where they were read.
    copy = F.pmod(F.monotonically_increasing_id(), F.lit(SLOT_BUCKETS))
    rows = rows.withColumn("copy", copy).join(placed, ["h1", "h2"]).select("id", "size", "crc", "shard", "copy")
    own = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("crc", "size", "copy"))
    rows = scratch.write(rows.select("id", "size", "crc", "shard", F.pmod(own, F.lit(SLOT_BUCKETS)).cast("int").alias("bucket")), "shard-rows")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.asc_nulls_last("id"), "size", "crc")
    numbered = rows.withColumn("in_bucket", F.row_number().over(inside) - 1)
    numbered = numbered.join(F.broadcast(offsets), ["shard", "bucket"])  # at most n_shards * SLOT_BUCKETS rows
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("in_bucket")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
