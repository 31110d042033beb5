"""Exact nearest rows: pivots, bounds by the triangle inequality, and queries routed to the cells that can hold a neighbour.

Up to QUERY_BYTES of queries go to all rows in one pass. More are routed. Rows are dealt to cells by their nearest pivot and written
with their distance to it. A query is first compared with its own cell, which bounds how far its k-th neighbour can be. By the triangle
inequality a cell whose rows lie between two distances from its pivot can be ruled out, and so can a cell on the far side of the plane halfway
between two pivots; the query goes to the others. Inside a cell only rows within the same bound of the query's own distance are
compared. Cells are cut into tiles of bounded rows and queries, so neither a hot cell nor a hot query lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import persisted

#: Bytes of queries that are compared with all rows in one pass, and rows that are compared at a time.
QUERY_BYTES, ROWS_AT_ONCE = 16 << 20, 1024
#: The most cells, and the rows and queries of a tile.
PIVOTS, TILE = 256, 4096


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


class _Best:
    """The k nearest rows seen so far of each query; of each group only its nearest, if there are groups."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int, grouped: bool, limit: np.ndarray | None = None):
        self.names, self.vectors, self.k, self.grouped = names, vectors, k, grouped
        self.squares = (vectors * vectors).sum(1)
        self.kept: list[list[tuple]] = [[] for _ in names]
        self.limit = np.full(len(names), np.inf) if limit is None else limit * limit * (1 + 1e-9)
        self.compared = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, extra: list, who: np.ndarray | None = None) -> None:
        """Compares the queries ``who``, or all, with some rows."""
        who = np.arange(len(self.names)) if who is None else who
        squares = (vectors * vectors).sum(1)
        own = self.squares[who, None]
        rough = own + squares - 2 * (self.vectors[who] @ vectors.T)
        rough -= 1e-9 * (own + squares)  # rounding of the product; the distances kept are exact ones
        self.compared += rough.size
        near = rough <= self.limit[who, None]
        for i in np.flatnonzero(near.any(axis=1)):
            q = who[i]
            found = np.flatnonzero(near[i] & (ids != self.names[q]))
            exact = ((vectors[found] - self.vectors[q]) ** 2).sum(1)
            rows = sorted([*self.kept[q], *((float(d), int(ids[j]), extra[j]) for d, j in zip(exact, found, strict=True))], key=lambda r: r[:2])
            if self.grouped:
                first: dict = {}
                for r in rows:
                    first.setdefault(r[2], r)
                rows = list(first.values())
            self.kept[q] = rows[: self.k]
            if len(self.kept[q]) == self.k:
                self.limit[q] = min(self.limit[q], self.kept[q][-1][0])

    def rows(self, extra_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        out = [(int(name), i, x, math.sqrt(d)) for name, kept in zip(self.names, self.kept, strict=True) for d, i, x in kept]
        if out:
            q, i, x, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(x, extra_type), pa.array(d, pa.float64())], ["query", "id", "extra", "dist"])


def _matrix(column) -> np.ndarray:
    """A list column without nulls as rows of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _passed(queries: DataFrame, rows: DataFrame, k: int, grouped: bool, schema: str) -> DataFrame:
    """Every task's best of all queries, which are small and go to all of them."""
    spark = rows.sparkSession
    own = queries.toArrow()  # QUERY_BYTES at most
    if not own.num_rows:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((own.column(0).to_numpy(), _matrix(own.column(1))))

    def run(batches):
        best = None
        for batch in batches:
            best = best or _Best(*shared.value, k, grouped)
            ids, found, more = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_pylist()
            for a in range(0, len(ids), ROWS_AT_ONCE):
                best.add(ids[a : a + ROWS_AT_ONCE], found[a : a + ROWS_AT_ONCE], more[a : a + ROWS_AT_ONCE])
        if best:
            yield from best.rows(batch.schema.field(2).type)

    return rows.mapInArrow(run, schema)


def _spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each as far as can be from those before it."""
    chosen, away = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((vectors * vectors).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (vectors @ pivots.T), 0.0))


def _celled(pivots: np.ndarray):
    """Adds the nearest pivot's number and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1)), pivots) if batch.num_rows else np.zeros((0, len(pivots)))
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "away"])

    return run


def _routed_cells(pivots: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Rows (query, vec, limit) to (query, vec, limit, cell, away) for every other cell that may hold a row within the limit."""
    apart = _distances(pivots, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, limit = _distances(_matrix(batch.column(1)), pivots), batch.column(2).to_numpy(zero_copy_only=False)
            own = d.argmin(1)
            ring = np.maximum(low - d, d - high)
            plane = (d * d - (d[np.arange(len(d)), own] ** 2)[:, None]) / (2 * np.maximum(apart[own], 1e-300))
            reach = np.maximum(ring, plane) <= limit[:, None] * (1 + 1e-9) + 1e-7  # a little for rounding
            reach[np.arange(len(d)), own] = False
            row, cell = np.nonzero(reach & np.isfinite(low))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(cell, pa.int32()), pa.array(d[row, cell])], ["query", "vec", "limit", "cell", "away"])

    return run


def _tile(k: int, grouped: bool, extra_type: pa.DataType, work: Accumulator | None):
    """The best of a tile: its queries against its rows, in runs of rows of like distance from the pivot."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("extra", extra_type), ("dist", pa.float64())])
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("away")
        away, at = rows.column("away").to_numpy(), queries.column("away").to_numpy()
        best = _Best(queries.column("query").to_numpy(), _matrix(queries.column("vec")), k, grouped, queries.column("limit").to_numpy().copy())
        ids, vectors, extra = rows.column("id").to_numpy(), _matrix(rows.column("vec")), rows.column("extra").to_pylist()
        step = max(32, min(ROWS_AT_ONCE, len(ids) // 16))
        for a in range(0, len(ids), step):
            b = min(len(ids), a + step)
            limit = np.sqrt(best.limit) * (1 + 1e-9) + 1e-7
            who = np.flatnonzero((at - limit <= away[b - 1]) & (at + limit >= away[a]))
            if len(who):
                best.add(ids[a:b], vectors[a:b], extra[a:b], who)
        if work is not None:
            work.add(best.compared)
        return pa.Table.from_batches(list(best.rows(extra_type)), schema)

    return run


def _tiled(queries: DataFrame, rows: DataFrame, k: int, grouped: bool, schema: str, work: Accumulator | None) -> DataFrame:
    """The best of every tile: queries (query, vec, limit, cell, away) against the rows of the same cell."""
    extra_type = pa.field("x", _arrow_type(rows)).type
    sizes = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name))  # noqa: E731  a row for each cell
    counts = F.broadcast(persisted(sizes(queries, "_down").join(sizes(rows, "_across"), "cell"), "tiles"))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.join(counts, "cell").withColumn("_q", F.pmod(F.xxhash64("query"), "_down").cast("int")).withColumn("_r", others("_across"))
    held = rows.join(counts, "cell").withColumn("_r", F.pmod(F.xxhash64("id"), "_across").cast("int")).withColumn("_q", others("_down"))
    keys = ("cell", "_q", "_r")
    return asked.select(*keys, "query", "vec", "limit", "away").groupBy(*keys).cogroup(held.select(*keys, "id", "vec", "extra", "away").groupBy(*keys)).applyInArrow(_tile(k, grouped, extra_type, work), schema)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["extra"].dataType)


def _merged(found: DataFrame, k: int, grouped: bool) -> DataFrame:
    if grouped:
        first = F.row_number().over(Window.partitionBy("query", "extra").orderBy("dist", "id"))
        found = found.withColumn("_r", first).where("_r = 1").drop("_r")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _routed(queries: DataFrame, rows: DataFrame, k: int, grouped: bool, schema: str, work: Accumulator | None) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(4 * PIVOTS).select("vec").toArrow()  # a bounded sample; every row is dealt
    if not sample.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    pivots = _spread_out(_matrix(sample.column(0)), max(1, min(PIVOTS, math.isqrt(rows.count()))))
    cells = ", cell int, away double"
    dealt = persisted(rows.mapInArrow(_celled(pivots), f"id long, vec array<double>, extra {rows.schema['extra'].dataType.simpleString()}{cells}"), "cells")
    own = persisted(queries.mapInArrow(_celled(pivots), f"query long, vec array<double>{cells}"), "queries")
    # A query whose own cell is empty has no bound yet; the tiles of its own cell are empty then.
    near = persisted(_merged(_tiled(own.withColumn("limit", F.lit(math.inf)), dealt, k, grouped, schema, work), k, grouped).drop("rank"), "near")
    bound = near.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("limit"))
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in dealt.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high")).collect():  # a row for each cell
        low[r.cell], high[r.cell] = r.low, r.high
    limited = own.select("query", "vec").join(bound, "query", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf)))
    going = persisted(limited.mapInArrow(_routed_cells(pivots, low, high), f"query long, vec array<double>, limit double{cells}"), "routes")
    return near.unionByName(_tiled(going, dealt, k, grouped, schema, work))


def nearest(queries: DataFrame, rows: DataFrame, k: int, group: str | None = None, carry: str | None = None, work: Accumulator | None = None) -> DataFrame:
    """(query, id, dist, rank): the k nearest rows (id, vec) of each query (query, vec); with ``group`` the nearest of each group
    only. The group, or else the column ``carry``, is returned too. Of equal distances the smaller ids count.

    Up to QUERY_BYTES of queries are broadcast and compared in one pass, in which every task keeps its best k; more are routed to cells,
    and ``work`` then counts the distances computed. Bounds only pay where the rows have structure: between points spread evenly in many
    dimensions nearly all distances are alike and nearly all are computed. Rows or queries without a vector are left out; a query's own id is
    no neighbour. Queries have one row each.
    """
    extra = group or carry
    queries = queries.where("query is not null and vec is not null").select(F.col("query").cast("long"), F.col("vec").cast("array<double>"))
    rows = rows.where("id is not null and vec is not null").select(F.col("id").cast("long"), F.col("vec").cast("array<double>"), (F.col(extra) if extra else F.lit(None).cast("boolean")).alias("extra"))
    schema = f"query long, id long, extra {rows.schema['extra'].dataType.simpleString()}, dist double"
    size = queries.agg(F.sum(F.size("vec").cast("long") * 8)).first()[0] or 0
    found = _passed(queries, rows, k, bool(group), schema) if size <= QUERY_BYTES else _routed(queries, rows, k, bool(group), schema, work)
    out = _merged(found, k, bool(group))
    return out.withColumnRenamed("extra", extra) if extra else out.drop("extra")
