"""Small relational operators that the larger ones are made of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def features(df: DataFrame, target: str, drops: Sequence[str] = (), listed: Sequence[str] = ()) -> list[str]:
    """The listed columns that exist, else all but the target and the drops."""
    return [c for c in listed if c in df.columns] if listed else [c for c in df.columns if c != target and c not in drops]


def narrowed(df: DataFrame) -> DataFrame:
    """Doubles as floats and booleans as bytes."""
    to = {"double": "float", "boolean": "byte"}
    return df.select(*(F.col(c).cast(to.get(kind, kind)).alias(c) for c, kind in df.dtypes))


def subsample(df: DataFrame, draw: Column, rows: int, cap: int) -> DataFrame:
    """The rows whose draw is below cap / rows: smaller caps give subsets of larger ones."""
    return df if rows <= cap else df.where(draw < F.lit(cap / rows))


def finite(column: Column) -> Column:
    """NaN and infinities as 0; null stays null."""
    bad = F.isnan(column) | column.isin(float("inf"), float("-inf"))
    return F.when(bad, 0.0).otherwise(column)


def null_safe_members(rows: DataFrame, among: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that occur in ``among``; nulls equal nulls. A 64-bit hash carries the join, equality decides."""
    a = rows.withColumn("_hash", F.xxhash64(*columns)).alias("a")
    b = among.select(*columns).withColumn("_hash", F.xxhash64(*columns)).distinct().alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    return a.join(b, reduce(lambda x, y: x & y, same, F.col("a._hash") == F.col("b._hash")), "left_semi").drop("_hash")


def lookup(rows: DataFrame, statistics: DataFrame, key: str, value: str, prior: Column) -> DataFrame:
    """Adds ``value`` from ``statistics`` by key, and the prior where the key is unknown."""
    return rows.join(statistics.select(key, value), key, "left").withColumn(value, F.coalesce(value, prior))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def first_wins(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of tables of equal columns; of rows with one key the first table's stays."""
    numbered = [df.withColumn("_priority", F.lit(i)) for i, df in enumerate(frames)]
    return top_per_group(reduce(DataFrame.unionByName, numbered), [key], [F.col("_priority")]).drop("_priority")


def strided(df: DataFrame, row_id: str, step: int) -> DataFrame:
    return df.where(F.pmod(F.col(row_id), F.lit(step)) == 0)


def block_sample(df: DataFrame, row_id: str, rows: int, blocks: int, sample: int) -> DataFrame:
    """``blocks`` evenly spaced blocks of ``sample // blocks`` consecutive rows."""
    if rows <= sample:
        return df
    stride, width = rows // blocks, sample // blocks
    at = F.col(row_id)
    return df.where((F.pmod(at, F.lit(stride)) < width) & (at < stride * blocks))


def matches(columns: Sequence[str], patterns: Sequence[str]) -> Column:
    """Whether the columns, joined by ":", equal one of the patterns; ``*`` stands for any part."""
    tests = []
    for pattern in patterns:
        parts = [p for p in pattern.split(":")] + ["*"] * (len(columns) - pattern.count(":") - 1)
        equal = [F.col(c) == p for c, p in zip(columns, parts, strict=False) if p != "*"]
        tests.append(reduce(lambda a, b: a & b, equal, F.lit(True)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def selected(df: DataFrame, columns: Sequence[str], include: Sequence[str] = ("*",), exclude: Sequence[str] = ()) -> DataFrame:
    return df.where(matches(columns, include) & ~matches(columns, exclude))
