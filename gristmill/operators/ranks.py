"""Exact global ranks without one task that holds all rows.

Rows are bucketed by their order key; counts of buckets, a small table, give each bucket its offset; rows are numbered
inside buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import persisted


def ranked(df: DataFrame, draw: Column, ties: Sequence[Column], groups: Sequence[str] = (), buckets: int = 1024, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank by (draw, ties), inside each group; ``draw`` lies in [0, 1)."""
    rows = df.withColumns({"_draw": draw, "_bucket": F.floor(draw * buckets).cast("int")})
    counts = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    offsets = counts.select(*(F.col(k).alias(f"_of_{k}") for k in (*groups, "_bucket")), offset)
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_draw", *ties)) - 1
    rows = rows.withColumn("_inside", inside)
    joined = rows.join(offsets, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*groups, "_bucket")])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_inside")).cast("long").alias(name))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds 0-based numbers without gaps, in the order of the partitions. Persist the result: numbers are not kept by key."""
    rows = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_offset")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "code") -> DataFrame:
    """Adds 0-based numbers in this order over all rows. Rows are sorted by ranges and written with their place in their range; what
    comes before a range is a small table. Rows that are equal by ``order`` are numbered in no certain order."""
    rows = persisted(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_offset") + F.col("_at") - F.col("_first")).cast("long").alias(name))


def in_ranges(df: DataFrame, value: str, name: str, ranges: int = 1024) -> DataFrame:
    """Adds the number of the range that a value lies in; ranges follow each other and hold about as many rows each, as far as
    equal values allow. Bounds are approximate quantiles."""
    edges = df.approxQuantile(value, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    splits = [-math.inf, *sorted({e for e in edges if math.isfinite(e)}), math.inf]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    made = Bucketizer(splits=splits, inputCol="_value", outputCol="_range", handleInvalid="keep").transform(df.withColumn("_value", F.col(value).cast("double")))
    return made.withColumn(name, F.col("_range").cast("int")).drop("_value", "_range")


#: Values that one aggregation buffer may hold.
EXACT_VALUES = 1 << 20


def quantiles(df: DataFrame, value: str, fractions: Sequence[float]) -> list[float | None]:
    """Exact interpolated quantiles of a column without nulls; None of no values.

    Up to EXACT_VALUES values are one aggregate. Beyond that the ranges that hold the wanted ranks are narrowed, all at once, until
    they have so few distinct values.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = rows.count()
    if n <= EXACT_VALUES:
        return list(rows.agg(F.percentile("v", F.array(*map(F.lit, fractions))).alias("q")).first().q or [None] * len(fractions))
    wanted = sorted({r for f in fractions for r in (math.floor(f * (n - 1)), math.ceil(f * (n - 1)))})
    found: dict[int, float] = {}
    _select(rows, wanted, 0, found)
    low, high = (lambda f: found[math.floor(f * (n - 1))]), (lambda f: found[math.ceil(f * (n - 1))])
    return [low(f) + (high(f) - low(f)) * (f * (n - 1) - math.floor(f * (n - 1))) for f in fractions]


def _select(rows: DataFrame, ranks: Sequence[int], before: int, found: dict[int, float]) -> None:
    """The values of these ranks; ``before`` rows are smaller than all of ``rows``."""
    parts = in_ranges(rows, "v", "_part")
    sizes = sorted((r["_part"], r.n, r.k) for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("k")).collect())  # a row for each range
    for part, n, distinct in sizes:
        own = [r for r in ranks if before <= r < before + n]
        if own:
            inside = parts.where(F.col("_part") == part).select("v")
            if distinct > EXACT_VALUES and len(sizes) > 1:
                _select(inside, own, before, found)
            else:
                at = before
                for r in inside.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").toLocalIterator():
                    found |= {x: r.v for x in own if at <= x < at + r.n}
                    at += r.n
                    if at > own[-1]:
                        break
        before += n
