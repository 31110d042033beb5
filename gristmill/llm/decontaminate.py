"""Benchmark decontamination by spaced seeds.

A mask marks which of a window's token positions count; the others may hold anything. Test items and training
texts are hashed under every mask, equal hashes are joined, and around each hit the item is laid over the text without
gaps: the stretch with the best balance of agreeing tokens (+1) and substitutions (-3) is an overlap, and so are the best ones
of what lies before and behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, words

#: Six tokens of windows of six to ten. Substituted tokens at most masks' gaps do no harm, and
#: windows free of them are found at every rate up to about one in five.
MASKS = ("111111", "11011011", "1100110011")
PENALTY = 3
#: Bytes of test items that are broadcast at a time; further items make further passes over the texts.
BLOCK_BYTES = 32 << 20
#: An overlap needs ``min_matches`` agreeing tokens, or this share of a shorter item's, but LEAST at any rate. Items of
#: fewer tokens than that are found where all of them stand one after another, from SHORTEST tokens on.
ITEM_SHARE, LEAST, SHORTEST = 0.6, 8, 2
#: Hits that are looked at in one go.
_HITS = 1 << 20
#: Characters of scripts that do not write spaces (Thai, Lao, Burmese, Khmer, Kana, Han), as ranges, which are quicker to
#: test than scripts: each character is a token of its own.
_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}]"
_FILTER_BITS = 22
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
OVERLAP = "id long, item_id long, doc_start long, item_start long, length long, matches long"


def seed_hashes(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash at each position where the mask's window starts."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return tokens[:0]
    offsets = [i for i, c in enumerate(mask) if c == "1"]
    total = np.full(n, _FACTORS[-1 - number], np.uint64)
    for factor, o in zip(_FACTORS, offsets, strict=False):
        total += tokens[o : o + n] * factor
    return total


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing tokens of the stretch with the highest balance."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def stretches(same: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The best stretch, then those of what lies before and behind it, with ``least`` agreeing tokens or more each."""
    todo = [(0, len(same))]
    while todo:
        first, last = todo.pop()
        if np.count_nonzero(same[first:last]) >= least:
            start, end, matches = best_stretch(same[first:last])
            if matches >= least:
                yield first + start, first + end, matches
            todo += [(first + end, last), (first, first + start)]


class Seeds:
    """The seeds of a block of items, sorted by hash behind a bit filter.

    A seed is a mask's hash of a window of a long item, or the hash of all tokens of a short one, for each length a mask of its own.
    """

    def __init__(self, ids: list[int], texts: list[str]):
        tokens, offsets = words.word_hashes(pa.array(texts, pa.string()), signs=True)
        self.ids = np.array(ids, np.int64)
        self.items = [tokens[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.masks = [*MASKS, *("1" * n for n in sorted({len(x) for x in self.items if SHORTEST <= len(x) < LEAST}))]
        hashes, item, at = [tokens[:0]], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, own in enumerate(self.items):
            for n, mask in enumerate(self.masks):
                if len(own) >= LEAST if n < len(MASKS) else len(own) == len(mask):
                    h = seed_hashes(own, mask, n)
                    hashes.append(h)
                    item.append(np.full(len(h), i))
                    at.append(np.arange(len(h)))
        hashes, item, at = np.concatenate(hashes), np.concatenate(item), np.concatenate(at)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _hits(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position in ``tokens``, item and position in the item of every equal seed, _HITS at a time or those of one position."""
        for n, mask in enumerate(self.masks):
            h = seed_hashes(tokens, mask, n)
            where = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[where]), np.searchsorted(self.hashes, h[where], "right")
            count = hi - lo
            where, lo, count = where[count > 0], lo[count > 0], count[count > 0]
            ends = np.cumsum(count)
            a = 0
            while a < len(where):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _HITS, "right")))
                c = count[a:b]
                each = np.repeat(lo[a:b] - np.cumsum(c) + c, c) + np.arange(c.sum())
                yield np.repeat(where[a:b], c), self.item[each], self.at[each]
                a = b

    def overlaps(self, tokens: np.ndarray, bounds: np.ndarray, min_matches: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, start in the text, start in the item, length, matches) for texts that lie one after another."""
        found = np.zeros((3, 0), np.int64)
        for where, item, at in self._hits(tokens):  # a diagonal counts once
            text = np.searchsorted(bounds, where, "right") - 1
            found = np.unique(np.concatenate([found, np.stack([text, item, where - at])], axis=1), axis=1)
        for t, i, diagonal in found.T:
            own = self.items[i]
            least = len(own) if len(own) < LEAST else max(LEAST, min(min_matches, -int(-ITEM_SHARE * len(own) // 1)))
            first, last = max(int(bounds[t]), int(diagonal)), min(int(bounds[t + 1]), int(diagonal) + len(own))
            if last - first < least:
                continue
            for start, end, matches in stretches(tokens[first:last] == own[first - diagonal : last - diagonal], least):
                yield int(t), int(self.ids[i]), first + start - int(bounds[t]), first + start - int(diagonal), end - start, matches


def _spaced(text: Column) -> Column:
    """The text with spaces around each character of a script that writes none."""
    return F.when(text.rlike(_UNSPACED), F.regexp_replace(text, f"({_UNSPACED})", " $1 ")).otherwise(text)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_matches: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every overlap of a text with a test item: ``id_col, item_id, doc_start, item_start, length, matches``.

    Tokens are runs of ASCII letters, digits and bytes from 0x80, with A to Z lower-cased, and single characters of scripts
    without spaces; starts and lengths count tokens. An overlap has at least ``min_matches`` agreeing tokens (of a shorter item
    0.6 of its tokens, but never under 8), at most one substitution to three of them in balance, and no gaps; the same
    pair has one for each place. Of an item of 2 to 7 tokens all of them must stand one after another; one word, or none, is no
    passage and is never found. Null and empty texts overlap with nothing. Null ids are kept as null. Equal items are each
    reported; of stretches with equal balance the first ending counts; repeated rows give their overlaps again. A very long
    text is searched whole. Either table may be empty, which gives an empty result; further columns, whatever their
    names, are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(scratch.column(benchmark, item_col).cast("long").alias("item_id"), _spaced(scratch.column(benchmark, item_text_col).cast("string")).alias("text")).where("text is not null")
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), _spaced(scratch.column(docs, text_col).cast("string")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = spark.createDataFrame([], OVERLAP)
    for block in range(blocks if total else 0):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast(Seeds([x.item_id for x in own], [x.text for x in own]))
        out = out.unionByName(rows.mapInArrow(_search(shared, min_matches), OVERLAP))
    return out.withColumnRenamed("id", id_col)


def _search(shared, min_matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        types = [pa.int64()] * 6
        for batch in batches:
            ids, found = batch.column(0), []
            for first, part in words.slices(batch.column(1)):
                tokens, offsets = words.word_hashes(part, signs=True)
                found += [(ids[first + t].as_py(), *rest) for t, *rest in seeds.overlaps(tokens, offsets, min_matches)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["id", "item_id", "doc_start", "item_start", "length", "matches"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, min_matches: int = 13, **columns: str) -> DataFrame:
    """One row a (text id, item): its longest overlap and the number of them. See :func:`overlaps`."""
    id_col = columns.get("id_col", "doc_id")
    best = F.max(F.struct("matches", "length", -F.col("doc_start"), -F.col("item_start"))).alias("best")
    found = overlaps(docs, benchmark, min_matches, **columns).groupBy(id_col, "item_id").agg(best, F.count(F.lit(1)).alias("n_overlaps"))
    return found.select(id_col, "item_id", (-F.col("best.col3")).alias("doc_start"), (-F.col("best.col4")).alias("item_start"), "best.length", "best.matches", "n_overlaps")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_matches: int = 13, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows, with all their columns, whose id has no overlap with an item; rows with a null id stay. Any column names will do."""
    bad = overlaps(docs, benchmark, min_matches, id_col=id_col, **columns).select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), scratch.boxed(docs).alias("row"))
    return rows.join(bad, "id", "left_anti").select("row.*")
