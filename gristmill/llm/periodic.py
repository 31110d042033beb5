"""Periodic runs of words: maximal stretches that repeat themselves at least four times.

Suffixes of a text are sorted and their longest common prefixes (LCP) taken. Neighbours in that order are united from the longest LCP
down, as Kruskal's method unites trees: a union-find class holds the positions, in order, whose suffixes agree on at least the
current LCP. When two classes meet at LCP L, each pair of positions p < p + q that are newly next to each other and lie within
L is a seed: words q apart agree on exactly L words from p on. A seed whose agreement cannot begin a word earlier
is the start of a run of period q and length q + L. As runs here are at least four periods long, no smaller period and no
position between p and p + q is possible (Fine and Wilf), so every run is seeded exactly once and with its smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scratch

#: A run has at least so many words and periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: No seed of a run has a shorter LCP: period 1 needs five words, period 2 six, and so on.
LEAST_LCP = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in range(1, LEAST_WORDS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_grams(words: np.ndarray, k: int = LEAST_LCP) -> np.ndarray:
    """Whether the k words from each position on may occur elsewhere too; by hash, so no repeated one is missed."""
    n = len(words) - k + 1
    if n < 2:
        return np.zeros(max(n, 0), bool)
    total = np.zeros(n, np.uint64)
    wide = words.astype(np.uint64) + np.uint64(1)
    for i in range(k):
        total = (total ^ (total >> np.uint64(29))) * _ODD + wide[i : i + n]
    total = (total ^ (total >> np.uint64(32))) * _ODD
    order = np.sort(total)
    again = order[1:][order[1:] == order[:-1]]
    return np.isin(total, again) if len(again) else np.zeros(n, bool)


def suffix_neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes next to each other in sorted order, and the length of their common prefix, by doubling of ranks."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = fresh
        width *= 2
        if rank[order[-1]] == n - 1:
            break
        ranks.append(rank)
    left, right = order[:-1], order[1:]
    a, b, lcp = left.copy(), right.copy(), np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        own, step = ranks[level], 1 << level
        alike = np.flatnonzero(np.maximum(a, b) < n)
        alike = alike[own[a[alike]] == own[b[alike]]]
        # Equal ranks of suffixes shorter than the step would be equal suffixes, of which a text has none.
        a[alike] += step
        b[alike] += step
        lcp[alike] += step
    return left, right, lcp


def seeds(left: np.ndarray, right: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(p, q, L): positions p and p + q that become neighbours in one class when classes are united by falling LCP, q <= L."""
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for i in np.argsort(-lcp, kind="stable").tolist():
        level = int(lcp[i])
        a, b = find(int(left[i])), find(int(right[i]))
        big, small = members.get(a) or [a], members.get(b) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        root[b] = a
        members.pop(b, None)
        members[a] = big
        if 8 * len(small) < len(big):
            for i, p in enumerate(small):  # in order, so that only the next one can still come between p and what follows
                at = bisect_left(big, p)
                if at and p - big[at - 1] <= level and not (i and big[at - 1] == small[i - 1]):
                    yield big[at - 1], p - big[at - 1], level
                if at < len(big) and big[at] - p <= level and (i + 1 == len(small) or small[i + 1] > big[at]):
                    yield p, big[at] - p, level
                big.insert(at, p)
        else:
            own = set(small)
            big += small
            big.sort()
            for p, after in zip(big, big[1:]):
                if after - p <= level and (p in own) != (after in own):
                    yield p, after - p, level


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of whole numbers, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS or not repeated_grams(words).any():
        return []
    left, right, lcp = suffix_neighbours(words)
    long_enough = lcp >= LEAST_LCP
    out = []
    for p, q, same in seeds(left[long_enough], right[long_enough], lcp[long_enough]):
        if same >= (LEAST_PERIODS - 1) * q and same + q >= LEAST_WORDS and (p == 0 or words[p - 1] != words[p + q - 1]):
            out.append((p, q + same, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def described(words: list[bytes]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text's words."""
    numbers: dict[bytes, int] = {}
    found = find_runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))) if len(words) >= LEAST_WORDS else []
    if not found:
        return 0, None, None, None, None, _digest(b""), _digest(b" ".join(words))
    best = found[0]
    for run in found[1:]:  # by start, then period: an equal exponent is no better
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return len(found), *best, 1000 * best[1] // best[2], _digest(lines.encode()), _digest(b" ".join([words[i] for i in kept]))


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted repetition: in every tenth document, by a checksum of its id, words from one on become periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (1 + (n - a) // p))[: n - a]


def _runs(change: Callable[[int | None, list[bytes]], list[bytes]] | None):
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at 0x20 and 0x09 to 0x0D
                rows.append((name, *described(change(name, words) if change else words)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` for every row.

    Words are what stands between blanks (0x20 and 0x09 to 0x0D), numbered from 0. A run is a stretch with smallest period q, at least
    ``max(6, 4 q)`` words long, that cannot be longer on either side. The columns of one run tell that of greatest exact length over
    period, of equal ones the first, then the shortest period; they are null where there is none. ``runs_sha256`` is over
    ``start,length,period`` lines of all runs, by start, then period; ``collapsed_sha256`` over the words, joined by single spaces, that
    are left when each run keeps its first period only. ``change`` may alter a text's words (with its id) before the search.

    A null or empty text has no words. Ids may be null or repeated; every row is answered by itself. A text is one row's work, whole
    and at any length, in time n log^2 n and some 200 bytes a word; rows are never shuffled. Further columns of any name are
    ignored. An empty table gives an empty result.
    """
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), scratch.column(docs, text_col).cast("string").alias("text"))
    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(_runs(change), schema).withColumnRenamed("id", id_col)
