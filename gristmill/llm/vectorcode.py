"""Product codes of vectors: Lloyd's method over the parts of all vectors, with the members of an entry kept where they are.

A vector is cut into consecutive parts; each position has a codebook of entries. The members of the (position, entry) pairs live in
partitions dealt by (position, entry, salt). Each round, a task gives its members their nearest entries, hands on only those
whose entry has changed, and the owners of the entries add up what they then hold. An entry of a third of all vectors is spread
over a quarter of the partitions by its salt. Codebooks are small (256 entries a position) and go through the driver.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that a partition is planned for, and that are compared with a codebook at once.
PARTITION_PARTS, AT_ONCE = 1 << 18, 4096
_LONG = (1 << 63) - 1


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) exactly: 32-bit numbers where they are small, Python's otherwise."""
    if not values.size or np.abs(values).max() < 1 << 16:
        return np.floor(values * float(SCALE)).astype(np.int32)
    return np.array([int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in values.ravel().tolist()], object).reshape(values.shape)


def bounds(dim: int) -> list[int]:
    """Where the parts of a vector begin, and its length; equal parts if it can be divided."""
    return [i * dim // PARTS for i in range(PARTS + 1)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each part's nearest entry, the first of equally near ones, and its squared distance; exact."""
    at, far = [np.zeros(0, np.int64)], []
    kind = object if object in (parts.dtype, entries.dtype) else np.int64
    if kind is not object:
        most = max((int(np.abs(x).max()) if x.size else 0) for x in (parts, entries))
        bound = 4 * most * most * max(1, parts.shape[1])
        kind = np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object  # whole numbers below 2**53 are exact
    own, wanted = entries.astype(kind), parts.astype(kind)
    squares = (own * own).sum(1)
    for a in range(0, len(wanted), AT_ONCE):
        x = wanted[a : a + AT_ONCE]
        d = (x * x).sum(1)[:, None] - 2 * (x @ own.T) + squares
        best = d.argmin(1)
        at.append(best)
        far.append(d[np.arange(len(x)), best])
    far = np.concatenate(far) if far else np.zeros(0, np.int64)
    return np.concatenate(at), far if kind is object else far.astype(np.int64)


class Owners:
    """Which partition owns the members of (position, entry, salt)."""

    def __init__(self, partitions: int):
        self.partitions, self.salts = partitions, max(1, partitions // 4)

    def __call__(self, position: int, entry: np.ndarray, salt: np.ndarray) -> np.ndarray:
        first = (entry.astype(np.int64) * PARTS + position) * 0x9E3779B1 % 0x7FFFFFFF
        return (first + salt % self.salts) % self.partitions


#: Members of one position that lie together: position, their entries, salts and parts.
Members = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def dealt(members: Iterable[Members], codebooks: list[np.ndarray], owners: Owners) -> Iterator[tuple[int, bool, Members]]:
    """Members with their nearest entries, by owner: (owner, whether they stay with their entry, members)."""
    for position, entry, salt, parts in members:
        new, _ = nearest(parts, codebooks[position])
        stays = new == entry
        if stays.any():
            yield 0, True, (position, entry[stays], salt[stays], parts[stays])
        new, salt, parts = new[~stays].astype(np.int16), salt[~stays], parts[~stays]
        owner = owners(position, new, salt)
        order = np.argsort(owner, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            if len(group):
                yield int(owner[group[0]]), False, (position, new[group], salt[group], parts[group])


def joined(members: Iterable[Members]) -> Iterator[Members]:
    """Members of a position put together, so that pieces don't get smaller from round to round."""
    by: dict[int, list[Members]] = {}
    for m in members:
        by.setdefault(m[0], []).append(m)
    for position, own in by.items():
        yield position, *(np.concatenate([m[i] for m in own]) for i in (1, 2, 3))


def sums(members: Iterable[Members]) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """((position, entry), [count, sums by component]) of what a partition holds."""
    total: dict[tuple[int, int], list[int]] = {}
    for position, entry, _, parts in members:
        if not parts.size:
            continue
        order = np.argsort(entry, kind="stable")
        starts = np.flatnonzero(np.r_[True, entry[order][1:] != entry[order][:-1]])
        added = np.add.reduceat(parts[order] if parts.dtype == object else parts[order].astype(np.int64), starts)
        for e, n, row in zip(entry[order[starts]].tolist(), np.diff(np.r_[starts, len(order)]).tolist(), added.tolist(), strict=True):
            total[position, e] = _added(total[position, e], [n, *row]) if (position, e) in total else [n, *row]
    return iter(total.items())


def _added(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def _same(owner: int) -> int:
    return owner


def _first_members(codebooks: list[np.ndarray], cuts: list[int], owners: Owners):
    """Rows (vec, salt) to (owner, block): the first assignment takes every part to its owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, salt = _matrix(batch.column(0), cuts[-1]), batch.column(1).to_numpy().astype(np.int32)
            made = [(owner, pickle.dumps(m)) for p in range(PARTS) for owner, _, m in dealt([(p, np.full(len(salt), -1, np.int16), salt, vectors[:, cuts[p] : cuts[p + 1]])], codebooks, owners)]
            owner, block = zip(*made, strict=True) if made else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(block, pa.binary())], ["owner", "block"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as whole numbers."""
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim))


def trained(vectors: DataFrame, first: np.ndarray) -> list[np.ndarray]:
    """The codebook of each position after ROUNDS rounds over all ``vectors`` (vec array<double>, all of one length, salt long).

    ``first`` holds the first entries as whole vectors of whole numbers, one a row.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    cuts = bounds(first.shape[1])
    codebooks = [first[:, a:b] for a, b in zip(cuts, cuts[1:])]
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() * PARTS // PARTITION_PARTS))
    owners = Owners(wanted)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch.shared_dir(spark))
    placed = vectors.select("vec", "salt").mapInArrow(_first_members(codebooks, cuts, owners), "owner int, block binary").rdd
    resident, done = placed.map(lambda r: (r[0], pickle.loads(r[1]))).partitionBy(wanted, _same).map(_members, preservesPartitioning=True).mapPartitions(joined, preservesPartitioning=True), []
    for last in range(1, ROUNDS + 1):
        resident = resident.persist(StorageLevel.MEMORY_AND_DISK)
        resident.checkpoint()
        totals = dict(resident.mapPartitions(sums).reduceByKey(_added).collect())  # a row for each entry
        codebooks = [_updated(c, position, totals) for position, c in enumerate(codebooks)]
        for old in done:
            old.unpersist()
        done = [resident]
        if last < ROUNDS:
            changed = resident.mapPartitions(lambda members, c=codebooks: dealt(members, c, owners), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            done.append(changed)
            stay = changed.filter(lambda x: x[1]).map(lambda x: x[2], preservesPartitioning=True)
            go = changed.filter(lambda x: not x[1]).map(lambda x: (x[0], x[2])).partitionBy(wanted, _same).map(_members, preservesPartitioning=True)
            # Both sides have the same partitioner, so the union is one of partitions with the same number and moves nothing.
            resident = stay.union(go).mapPartitions(joined, preservesPartitioning=True)
    resident.unpersist()
    return codebooks


def _members(row: tuple[int, Members]) -> Members:
    return row[1]


def _updated(entries: np.ndarray, position: int, totals: dict[tuple[int, int], list[int]]) -> np.ndarray:
    """The means of the entries' members, rounded down; entries without any stay."""
    rows = [[x // n for x in more] if (n := (own := totals.get((position, e), [0]))[0]) and (more := own[1:]) else old for e, old in enumerate(entries.tolist())]
    out = np.array(rows, object).reshape(entries.shape)
    return out.astype(np.int32) if not out.size or max(abs(int(x)) for x in out.ravel()) < SCALE << 16 else out


def _encoded(codebooks: list[np.ndarray], cuts: list[int]):
    """Rows (vec_id, label, vec) to (vec_id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), cuts[-1])
            found = [nearest(vectors[:, a:b], c) for a, b, c in zip(cuts, cuts[1:], codebooks)]
            digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            codes = [row.tobytes().hex() for row in digits]
            errors = [min(sum(own), _LONG) for own in zip(*(far.tolist() for _, far in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` of vectors (vec_id, label, vec), all as long as the entries of the codebooks together."""
    cuts = [0, *np.cumsum([c.shape[1] for c in codebooks]).tolist()]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec_id", "label", "vec").mapInArrow(_encoded(codebooks, cuts), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` for every row with a whole vector.

    Components x become floor(1024 x); vectors are cut into four consecutive parts. A position's codebook starts as that part of the 256
    rows with the smallest ids (fewer if there are fewer; rows of equal ids by their vectors, null ids last). Four times every part goes to the
    nearest entry of its position, by squared distance and then by number, and each entry becomes the mean of its parts, rounded
    down; an entry without parts stays. Then parts are assigned once more: ``code`` has two hexadecimal digits for each, ``error`` is the
    squared distances' sum, ``label_error`` its sum over rows of the same label (nulls are one label), ``codebooks_sha256`` is over
    all components of all entries.

    Rows whose vector is null, or holds a null, infinite or NaN, are left out; so are those whose vector is not as long as that of
    the row with the smallest id. Where four does not divide the length, later parts are one longer. Sums that pass 64 bits are held at the
    largest long. Repeated rows count each. Further columns of any name are ignored. An empty table, or one without a whole vector,
    gives an empty result.
    """
    spark = rows.sparkSession
    vec = scratch.column(rows, vector_col).cast("array<double>")
    kept = rows.select(scratch.column(rows, id_col).alias("vec_id"), scratch.column(rows, label_col).alias("label"), vec.alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # The salt comes from the row, so that a task that runs again deals alike.
    kept = scratch.write(kept.where("vec is not null").where(whole).withColumn("salt", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 31))), "whole-vectors")
    order = [F.asc_nulls_last("vec_id"), F.asc("vec")]
    start = kept.orderBy(*order).limit(1).select(F.size("vec").alias("dim")).first()
    schema = f"{_quoted(id_col)} {kept.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if start is None:
        return spark.createDataFrame([], schema)
    kept = kept.where(F.size("vec") == start.dim)
    first = [r.vec for r in kept.orderBy(*order).limit(ENTRIES).select("vec").collect()]  # ENTRIES rows
    codebooks = trained(kept, whole_numbers(np.array(first, np.float64).reshape(len(first), start.dim)))
    digest = hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.ravel()).encode()).hexdigest()
    made = scratch.write(encode(kept, codebooks), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = made.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    out = made.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
