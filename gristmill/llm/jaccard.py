"""Exact near-duplicate join on n-gram sets: size-banded tiles, bitmap bounds, sorted-array intersection.

Sets of sizes a <= b can reach similarity t only if b <= a / t, so bands of sizes that grow by 1 / t are compared with
themselves and the next. Two such sets differ in at most h = (1 - t) / (1 + t) * (a + b) elements. A tile (two bands)
cuts the range of hashes into slightly more than h parts, enough that a set leaves fewer parts empty than it
could differ in (chance of failure under 1e-15, the size of a hash collision); so two linked sets agree on all of at
least one part that is not empty. Tiles are therefore made of the sets that share a part's hash, directly or
through others: nothing outside a tile can link into it, and unrelated texts hardly ever meet.

Inside a tile, parity bitmaps of the hashed shingles bound the overlap from above: popcount(x xor y) of the bitmaps
is at most the number of differing shingles. Pairs that pass are intersected exactly. The search spreads from
one set over the sets not reached yet, so a tight group of n copies costs n comparisons, not n * n, and gives n - 1
links; no pair list is ever made.

A tile with many shingles or sets is cut. Its sets are dealt, each to one block, by their smallest hash, so that close ones mostly
meet; blocks are searched as small tiles are, and give components. Links between blocks can only matter between two of these
components. So bitmaps alone, a fiftieth of a text, are compared block by block with each other, and only sets whose bound reaches
one of another component are looked at again, with their texts, two blocks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, scratch, words

#: A task holds the sets of one tile: at most two blocks of so many shingles and sets (and one set more).
BLOCK_SHINGLES, BLOCK_SETS = 1 << 21, 8192
#: A task that compares bitmaps holds at most two blocks of so many bytes and sets.
BLOCK_BYTES, BLOCK_MAPS = 1 << 23, 1 << 16
#: Sets whose texts are wanted up to which these rows are broadcast, about 50 bytes each; more are joined.
FEW_WANTED = 1 << 18
_FLUSH_ROWS = 1 << 19


@lru_cache(maxsize=None)
def _bounds(percent: int) -> list[int]:
    """The smallest sizes of all bands up to 2**40."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


def band_of(size: int, percent: int) -> int:
    return int(np.searchsorted(_bounds(percent), size, "right")) - 1


@lru_cache(maxsize=None)
def parts_of(band: int, percent: int) -> int:
    """The number of parts of the tile of this band and the next; 0 if no two different sets can link there."""
    bounds = _bounds(percent)
    low, high = bounds[band], bounds[band + 2] - 1
    differ = lambda n: (100 - percent) * 2 * n // (100 + percent)
    if differ(high) == 0:
        return 0
    # Of the sizes that can differ in k elements the smallest is the worst.
    k = np.arange(max(1, differ(low)), differ(high) + 1, dtype=np.float64)
    n = np.maximum(low, np.ceil(k * (100 + percent) / (2 * (100 - percent))))

    def fails(parts: int) -> bool:
        """Whether a bound on the chance that n elements lie in k parts at most is too high for any size."""
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, parts + 1)))])
        at = k.astype(np.int64)
        return float((logs[parts] - logs[at] - logs[parts - at] + n * np.log(k / parts)).max()) > math.log(1e-15)

    least = high_enough = differ(high) + 1
    step = 1
    while fails(high_enough):
        least, high_enough, step = high_enough + 1, high_enough + step, 2 * step
    while least < high_enough:
        middle = (least + high_enough) // 2
        least, high_enough = (middle + 1, high_enough) if fails(middle) else (least, middle)
    return high_enough


_TILE, _PART, _CHECK = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        return int(words.mix(s.sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64)), int(words.mix(words.mix(s ^ _CHECK).sum(dtype=np.uint64)).view(np.int64))


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a sorted set must meet every other set that it links with."""
    band = band_of(len(s), percent)
    mixed, out = words.mix(s + _PART), []
    for tile in (band - 1, band):
        parts = parts_of(tile, percent) if tile >= 0 else 0
        if parts:
            part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            out.append(words.mix(np.add.reduceat(mixed, starts) + part[starts] * _PART + np.uint64(tile * int(_TILE) % (1 << 64))))
    return np.concatenate(out) if out else s[:0]


#: Bytes of text whose keys meet in one group: about half a million keys, which a task holds at once.
GROUP_BYTES, LEAST_BYTES = 1 << 22, 1 << 18
_SET = ["id", "h1", "h2", "n_shingles", "s1", "s2", "low"]
_FOUND = ", ".join(f"{c} long" for c in _SET)


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group, of 0 to groups - 1, of 64-bit hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _with_keys(k: int, percent: int, groups: int):
    """Rows (id, h1, h2, text) to their sets (id, h1, h2, n_shingles, s1, s2, low), low the smallest shingle hash, and to the sets' keys, each text
    hashed once. Within a task a set counts once, and of the sets that share a key one keeps it; the others are linked to that hub at once. The keys
    of a group are one row of two packed arrays, keys and their nodes; links are one of nodes and hubs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, rows = [], [], 0

        def packed(group: np.ndarray, sets: list[pa.Array] | None = None, **binary: list[bytes]) -> pa.RecordBatch:
            sets = sets or [pa.nulls(len(group), pa.int64())] * len(_SET)
            parts = [pa.array(binary.get(c, [None] * len(group)), pa.binary()) for c in ("keys", "nodes", "hubs")]
            return pa.RecordBatch.from_arrays([pa.array(group), *sets, *parts], ["group", *_SET, "keys", "nodes", "hubs"])

        def flush() -> Iterator[pa.RecordBatch]:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            first = np.r_[True, key[1:] != key[:-1]]
            hub = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            again = ~first & (node != hub)
            linked, roots = components.local_components(node[again], hub[again]) if again.any() else (node[:0], node[:0])
            moved = linked != roots
            if moved.any():
                yield packed(_group(roots[moved][:1].view(np.uint64), groups), nodes=[linked[moved].tobytes()], hubs=[roots[moved].tobytes()])
            # Keys that rise are in order of their groups; inside a group they go by node, which packs better.
            key, node = key[first], node[first]
            group = _group(key, groups)
            at = np.lexsort((order[first], group))
            key, node = key[at], node[at]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(group)]
            yield packed(group[starts], keys=[key[i:j].tobytes() for i, j in zip(starts, ends)], nodes=[node[i:j].tobytes() for i, j in zip(starts, ends)])

        for batch in batches:
            sets = []
            for s in words.shingle_sets(batch.column(3), k):
                name, check = set_hashes(s)
                sets.append((len(s), name, check, int(s[:1].view(np.int64)[0]) if len(s) else 0))
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                key = signatures(s, percent)
                if len(key):
                    keys.append(key)
                    nodes.append(np.full(len(key), name, np.int64))
                    rows += len(key)
                if rows >= _FLUSH_ROWS:
                    yield from flush()
                    keys, nodes, rows = [], [], 0
                    seen = set()
            if sets:
                made = [pa.array(x, pa.int64()) for x in zip(*sets, strict=True)]
                dealt = words.mix(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
                yield packed(_group(dealt, groups), [*batch.columns[:3], *made])
        if rows:
            yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`_with_keys` gives, sorted by group, to the sets as they are and links between the nodes that share a key, as (node, root) in
    (a, b); some links at a time."""
    a, b, held, own, group = [], [], 0, [], None

    def links() -> pa.RecordBatch:
        found = components.contracted(a, b)
        a.clear()
        b.clear()
        none = [pa.nulls(found.num_rows, pa.int64())] * len(_SET)
        return pa.RecordBatch.from_arrays([*none, *found.columns], [*_SET, "a", "b"])

    def close() -> int:
        """The links of a group's keys."""
        if not own:
            return 0
        key, node = (np.concatenate(x) for x in zip(*own, strict=True))
        own.clear()
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        a.append(node[same + 1])
        b.append(node[same])
        return len(same)

    for batch in batches:
        is_set = batch.column(1 + _SET.index("n_shingles")).is_valid()
        sets = batch.filter(is_set)
        if sets.num_rows:
            none = [pa.nulls(sets.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*sets.columns[1 : 1 + len(_SET)], *none], [*_SET, "a", "b"])
        others = batch.filter(pa.compute.invert(is_set))
        for at, keys, nodes, hubs in zip(*(others.column(c).to_pylist() for c in ("group", "keys", "nodes", "hubs")), strict=True):
            if at != group:
                held += close()
                group = at
            if hubs is None:
                own.append((np.frombuffer(keys, np.uint64), np.frombuffer(nodes, np.int64)))
            else:
                a.append(np.frombuffer(nodes, np.int64))
                b.append(np.frombuffer(hubs, np.int64))
                held += len(a[-1])
            if held >= components.AT_ONCE:
                yield links()
                held = 0
    held += close()
    if held:
        yield links()


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """Parity of the number of elements that hash to each of ``width`` bits, packed."""
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).view(np.uint64)


def width_of(size: int) -> int:
    """Bits of the bitmap of a set of this size."""
    return min(1 << 15, max(64, 1 << int(size - 1).bit_length()))


def folded(maps: np.ndarray, words_wide: int) -> np.ndarray:
    """Bitmaps of the same sets in fewer bits: the halves' parities add up."""
    while maps.shape[1] > words_wide:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def boundary(sizes: np.ndarray, groups: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Numbers of the sets whose bitmaps allow a link with a set of another group. Bitmaps are as wide as their sets' sizes ask for."""
    order = np.argsort(sizes, kind="stable")
    sizes, groups, maps = sizes[order], groups[order], [maps[i] for i in order]
    wide = np.array([len(m) for m in maps])
    runs = [(lo, hi) for lo, hi in zip(*(np.searchsorted(wide, np.unique(wide), side) for side in ("left", "right")))]
    stacks = [np.stack(maps[lo:hi]) for lo, hi in runs]
    narrow: dict[tuple[int, int], np.ndarray] = {}
    found = np.zeros(len(sizes), bool)
    for own, (lo_x, hi_x) in enumerate(runs):
        w = stacks[own].shape[1]
        for x in range(lo_x, hi_x):
            n = int(sizes[x])
            last = int(np.searchsorted(sizes, n * 100 // percent, "right"))
            for other in range(own, len(runs)):
                lo, hi = max(runs[other][0], x + 1), min(runs[other][1], last)
                if lo >= hi:
                    break
                among = np.flatnonzero(groups[lo:hi] != groups[x]) + lo
                if not len(among):
                    continue
                if (other, w) not in narrow:
                    narrow[other, w] = folded(stacks[other], w)
                differ = np.bitwise_count(narrow[other, w][among - runs[other][0]] ^ stacks[own][x - lo_x]).sum(axis=1, dtype=np.int64)
                both = sizes[among] + n
                overlap = (both - differ) // 2  # at most
                near = among[100 * overlap >= percent * (both - overlap)]
                if len(near):
                    found[near] = found[x] = True
    return order[found]


def tile_links(names: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the sets of a tile just as all its pairs of similarity >= percent / 100 would."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets, names = [sets[i] for i in order], [int(names[i]) for i in order]
    sizes = np.array([len(s) for s in sets])
    widths = np.array([width_of(int(n)) for n in sizes])
    runs = []  # sizes rise, so sets of one bitmap width are neighbours
    for width in np.unique(widths):
        lo, hi = np.searchsorted(widths, width), np.searchsorted(widths, width, "right")
        runs.append((int(width), int(lo), int(hi), np.stack([bitmap(s, int(width)) for s in sets[lo:hi]])))
    free = np.ones(len(sets), bool)
    links = []
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            n = int(sizes[x])
            first, last = np.searchsorted(sizes, -(-n * percent // 100)), np.searchsorted(sizes, n * 100 // percent, "right")
            for width, lo, hi, maps in runs:
                lo_x, hi_x = max(lo, first), min(hi, last)
                if lo_x >= hi_x:
                    continue
                among = np.flatnonzero(free[lo_x:hi_x]) + lo_x
                if not len(among):
                    continue
                own = maps[x - lo] if lo <= x < hi else bitmap(sets[x], width)
                differ = np.bitwise_count(maps[among - lo] ^ own).sum(axis=1, dtype=np.int64)
                both = sizes[among] + n
                overlap = (both - differ) // 2  # at most
                for y in among[100 * overlap >= percent * (both - overlap)]:
                    shared = n + int(sizes[y]) - len(np.union1d(sets[x], sets[y]))
                    if 100 * shared >= percent * (n + int(sizes[y]) - shared):
                        links.append((names[x], names[y]))
                        free[y] = False
                        queue.append(int(y))
    return links


def _links_of_tiles(k: int, percent: int):
    """Rows (tile, node, text, large), sorted by tile, to links (a, b, null); from blocks of large tiles to (node, component in its block,
    bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, maps, found, out, held = None, False, {}, [], 0

        def close():
            nonlocal held
            names, sets = np.array(list(found), np.int64), list(found.values())
            links = tile_links(names, sets, percent) if len(found) > 1 else []
            if maps:
                a, b = (np.array(x, np.int64) for x in zip(*links, strict=True)) if links else (names[:0], names[:0])
                group = dict(zip(*(x.tolist() for x in components.local_components(a, b)), strict=True)) if links else {}
                out.extend((name, group.get(name, name), bitmap(s, width_of(len(s))).tobytes()) for name, s in zip(names.tolist(), sets, strict=True))
                held += sum(len(x[2]) for x in out[-len(sets) :]) if sets else 0
            else:
                out.extend((a, b, None) for a, b in links)
            found.clear()

        def flush() -> pa.RecordBatch:
            nonlocal held
            a, b, c = zip(*out, strict=True)
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["a", "b", "map"])

        for batch in batches:
            tiles, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for own, name, large, s in zip(tiles, names, batch.column(3).to_pylist(), words.shingle_sets(batch.column(2), k), strict=True):
                if own != tile:
                    close()
                    tile, maps = own, large
                    if held >= 1 << 24:
                        yield flush()
                if name not in found:
                    found[name] = s
            if len(out) >= 1 << 16:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def _boundaries(percent: int):
    """Rows (pair, node, n_shingles, group, map), sorted by pair, to the nodes that may link with one of another group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows = None, []

        def close() -> pa.RecordBatch:
            names, sizes, groups = (np.array(x, np.int64) for x in zip(*(r[:3] for r in rows), strict=True))
            at = boundary(sizes, groups, [np.frombuffer(r[3], np.uint64) for r in rows], percent)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(names[at])], ["s1"])

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != pair and rows:
                    yield close()
                pair = own
                rows.append(row)
        if rows:
            yield close()

    return run


def _searched(texts: DataFrame, percent: int, k: int) -> DataFrame:
    """What :func:`_links_of_tiles` finds in each group of (pair, s1, text, large)."""
    return texts.select("pair", "s1", "text", "large").repartition("pair").sortWithinPartitions("pair").mapInArrow(_links_of_tiles(k, percent), "a long, b long, map binary")


def _paired(rows: DataFrame, percent: int, weight: Column, most: int, most_rows: int) -> DataFrame:
    """Rows (tile, n_shingles, s1, ...) with ``pair``, once for each two blocks that a row's block is one of. Blocks hold rows of one tile and
    band, and are paired with those of the same band and the next."""
    bounds = F.array(*(F.lit(b) for b in _bounds(percent)))
    rows = rows.withColumn("band", F.size(F.filter(bounds, lambda b: b <= F.col("n_shingles"))) - 1)
    blocks = rows.groupBy("tile", "band").agg(F.ceil(F.greatest(F.sum(weight) / most, F.count(F.lit(1)) / most_rows)).alias("blocks"))
    near = lambda by, name: blocks.select("tile", (F.col("band") + by).alias("band"), F.col("blocks").alias(name))
    rows = rows.join(blocks, ["tile", "band"]).join(near(1, "below"), ["tile", "band"], "left").join(near(-1, "above"), ["tile", "band"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("s1"), "blocks"))
    others = lambda n, make: F.transform(F.when(F.col(n).isNull(), F.array().cast("array<long>")).otherwise(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)), make)
    pairs = F.concat(
        others("blocks", lambda o: F.xxhash64("tile", "band", F.lit(0), F.least(o, "block"), F.greatest(o, "block"))),
        others("below", lambda o: F.xxhash64("tile", F.col("band") - 1, F.lit(1), o, F.col("block"))),
        others("above", lambda o: F.xxhash64("tile", "band", F.lit(1), F.col("block"), o)),
    )
    return rows.withColumn("pair", F.explode(F.array_distinct(pairs)))


def _blocked(large: DataFrame) -> DataFrame:
    """Rows (tile, s1, low, n_shingles, ...) with ``pair``: one block for each row, close rows together."""
    full = lambda: F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS))
    rows = large.join(large.groupBy("tile").agg(full().alias("blocks")), "tile").withColumn("block", F.pmod(F.xxhash64("low"), "blocks"))
    # Sets of one smallest hash that are too many for a block are cut by themselves.
    rows = rows.join(rows.groupBy("tile", "block").agg(full().alias("cuts")), ["tile", "block"])
    return rows.withColumn("pair", F.xxhash64("tile", "block", F.pmod(F.xxhash64(F.lit(2), "s1"), "cuts")))


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row: which texts are joined by chains of links.

    Two rows link when their sets of distinct k-word shingles have 100 * intersection >= percent * union; equality is
    enough. A text of fewer words has one shingle, the whole sequence; a null, empty or blank text has none and links with
    nothing. ``component_id`` is the smallest id in the row's component, its own included. Null ids are no smallest ids, but
    their texts link like others: such a row takes its component's id, or null if no row there has one. Repeated rows, and
    different texts of one id, are rows like others. A very long text is hashed whole, in slices. Further columns, whatever
    their names, are ignored. An empty table gives an empty result.
    """
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), scratch.column(docs, text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, size // GROUP_BYTES, min(docs.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES))
    keys = rows.mapInArrow(_with_keys(k, percent, groups), f"group long, {_FOUND}, keys binary, nodes binary, hubs binary")
    found = scratch.write(keys.repartition("group").sortWithinPartitions("group").mapInArrow(_meet, f"{_FOUND}, a long, b long"), "sets")
    sets, met = found.where("a is null").select(*_SET), found.where("a is not null").select("a", "b")
    tiles = components.connected_components(met).select(F.col("node").alias("s1"), F.col("component").alias("tile"))

    text_of = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")).alias("of")  # one row for each set
    classes = scratch.write(sets.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("id").alias("id"), F.min("low").alias("low"), text_of), "classes")
    members = scratch.write(classes.join(tiles, "s1").select("s1", "tile", "n_shingles", "low", "of.id", "of.h1", "of.h2"), "members")
    whole = members.groupBy("tile").agg(F.sum("n_shingles").alias("shingles"), F.count(F.lit(1)).alias("sets"))
    is_large = (F.col("shingles") > 2 * BLOCK_SHINGLES) | (F.col("sets") > 2 * BLOCK_SETS)
    members = scratch.write(members.join(whole, "tile").select(*members.columns, is_large.alias("large")), "tiles")

    def with_texts(wanted: DataFrame) -> DataFrame:
        """(pair, s1, text, large) of (pair, s1, id, h1, h2, large)."""
        wanted = scratch.write(wanted, "wanted")
        few = F.broadcast if wanted.count() <= FEW_WANTED else lambda df: df
        texts = rows.where("id is not null").join(few(wanted.where("id is not null")), ["id", "h1", "h2"]).select("pair", "s1", "text", "large")
        # Copies with a null id are one row before they meet.
        nameless = rows.where("id is null").groupBy("h1", "h2").agg(F.min("text").alias("text"))
        return texts.unionByName(nameless.join(few(wanted.where("id is null").drop("id")), ["h1", "h2"]).select("pair", "s1", "text", "large"))

    columns = ["pair", "s1", "id", "h1", "h2", "large"]
    large = members.where("large")
    first = members.where("not large").withColumn("pair", F.col("tile")).select(*columns).unionByName(_blocked(large).select(*columns))
    first = scratch.write(_searched(with_texts(first), percent, k), "first-links")
    links = first.where("a <> b").select("a", "b")
    maps = first.where("map is not null").select(F.col("a").alias("s1"), F.col("b").alias("group"), "map")
    if not maps.isEmpty():
        maps = maps.join(large.select("s1", "tile", "n_shingles"), "s1")
        maps = _paired(maps, percent, F.octet_length("map"), BLOCK_BYTES, BLOCK_MAPS)
        maps = maps.select("pair", "s1", "n_shingles", "group", "map").repartition("pair").sortWithinPartitions("pair")
        again = scratch.write(maps.mapInArrow(_boundaries(percent), "s1 long").distinct(), "boundary")
        wanted = _paired(large.join(again, "s1", "left_semi").withColumn("large", F.lit(False)), percent, F.col("n_shingles"), BLOCK_SHINGLES, BLOCK_SETS)
        links = links.unionByName(_searched(with_texts(wanted.select(*columns)), percent, k).select("a", "b"))
    joined = components.connected_components(links).select(F.col("node").alias("s1"), "component")

    named = classes.join(joined, "s1", "left").withColumn("component", F.coalesce("component", "s1"))
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(lowest, "component").select("n_shingles", "s1", "s2", "component_id")
    out = sets.join(named, ["n_shingles", "s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its component, and those with a null id.

    Rows that repeat such an id are the same document and stay together. Null, empty and blank texts link with nothing and
    stay; very long ones are compared whole. Any column names will do. An empty table gives an empty result.
    """
    found = ngram_components(docs, k, percent, id_col, text_col)
    first = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), scratch.boxed(docs).alias("row"))
    kept = rows.join(first, "id", "left_semi")
    return kept.select("row.*").unionByName(rows.where("id is null").select("row.*"))
