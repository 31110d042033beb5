"""Connected components of links, by alternating large and small stars over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, among these links alone."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        np.minimum.at(new, label[ia], low)
        np.minimum.at(new, label[ib], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


#: Links that a task contracts at a time.
AT_ONCE = 1 << 18


def contracted(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Links as (node, root) of their components, roots left out."""
    nodes, roots = local_components(np.concatenate(a), np.concatenate(b))
    keep = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to links (node, root) of the components of every AT_ONCE links of a task."""
    a, b, rows = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield contracted(a, b)
            a, b, rows = [], [], 0
    if rows:
        yield contracted(a, b)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """AT_ONCE links at most to (node, component) of all their nodes."""
    held = list(batches)
    if sum(b.num_rows for b in held):
        a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_components(a, b)], ["node", "component"])


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links (a long, b long): the smallest node that it is joined to.

    Each round takes every node's neighbours to the smallest of them (large star: the larger ones; small star: the
    others), which needs O(log n) rounds on nearly all graphs. A round is written to the shared folder, the one before it is
    deleted then, and nothing but a count comes to the driver. Once no more links are left than a task contracts at a time, one task does the
    rest. Nulls and links of a node with itself are left out.
    """
    spark = links.sparkSession
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(contract, "a long, b long").distinct()
    path = scratch.save(edges, "links")
    while True:
        edges = spark.read.schema("a long, b long").parquet(path)
        if edges.count() <= AT_ONCE:
            return scratch.write(edges.coalesce(1).mapInArrow(_finished, "node long, component long"), "components")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()  # a > b in every link from here on
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        before, path = path, scratch.save(small.where("a <> b").distinct(), "links")
        scratch.remove(spark, before)
        edges = spark.read.schema("a long, b long").parquet(path)
        # Done once every link ends at a node that has no smaller neighbour, and no node has two such.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(False).alias("is_end")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("n"), F.lit(True).alias("is_end")))
        if ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("is_end").alias("is_end")).where("n > 1 or n > 0 and is_end").isEmpty():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
