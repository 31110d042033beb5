"""Context-tree weighting over bytes, as array arithmetic on the n-gram counts of a subtree.

A byte is eight binary decisions, each at a node named by the bits before it. Every node has, for each of the contexts
of 0 to DEPTH bytes before the byte, a Krichevsky-Trofimov estimate from its counts of zeros and ones; the weighted
probability of a context is the mean of its own estimate and of the product over its longer contexts. From that
follows the weight with which a context's own estimate, and not a longer one's, predicts.

A gram is a number of DEPTH + 1 bytes: the context's bytes from the nearest on, then the byte itself. So grams of
one context are neighbours in order, and the grams that share their TOP nearest bytes hold a whole subtree.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
#: Contexts of so many bytes head the subtrees; the nodes of shorter ones, at most 255 * 65536 and in texts a small part of
#: that, are merged on the driver.
TOP = 3

_SMALL = 4096
_LOG_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))])  # log of gamma(n + 1/2) / gamma(1/2)
_LOG_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL + 1)))])  # log of n!


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; for large x."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""

    def log_half(n):
        return np.where(n < _SMALL, _LOG_HALVES[np.minimum(n, _SMALL)], _log_gamma(np.maximum(n, 1) + 0.5) - 0.5723649429247001)

    n = zeros + ones
    whole = np.where(n < _SMALL, _LOG_WHOLES[np.minimum(n, _SMALL)], _log_gamma(n + 1.0))
    return log_half(zeros) + log_half(ones) - whole


def grams(data: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The gram at each byte of a text; before its start lie end bytes (0x0A), or the DEPTH bytes given."""
    padded = np.concatenate([np.full(DEPTH, 10, np.uint8) if before is None else before, data]).astype(np.int64)
    out = padded[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        out |= padded[DEPTH - back : len(padded) - back] << (8 * (DEPTH + 1 - back))
    return out


def _reduced(keys: np.ndarray, order: np.ndarray | None, *values: np.ndarray):
    """Distinct sorted keys, the sums of the values, and where each row went."""
    if order is None:
        order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    at = np.empty(len(keys), np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    return ordered[first], [np.add.reduceat(v[order], first) for v in values], at


def _shorter(keys: np.ndarray) -> np.ndarray:
    """The keys without their contexts' farthest byte."""
    return (keys >> 16 << 8) | (keys & 255)


class Subtree:
    """Estimates and weights of the contexts of ``top`` to DEPTH bytes over distinct sorted grams with counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, top: int = TOP):
        self.codes, self.counts, self.top = codes, counts, top
        self.head, self.ahead = [], []
        levels = []  # of each depth, deepest first: contexts with symbols, counts, and the place of each gram
        keys, sums, at = codes, counts, np.arange(len(codes))
        for depth in range(DEPTH, top - 1, -1):
            levels.append((keys, sums, at))
            if depth > top:
                keys, (sums,), to = _reduced(_shorter(keys), None, sums)
                at = to[at]
        for j in range(8):
            below = None
            for keys, sums, at in levels:
                symbol = keys & 255
                node_keys = (keys >> 8 << 8) | (1 << j) | (symbol >> (8 - j))
                bit = (symbol >> (7 - j)) & 1
                nodes, (ones, both), to = _reduced(node_keys, np.arange(len(keys)), sums * bit, sums)
                zeros = both - ones
                own = log_kt(zeros, ones)
                if below is None:
                    weighted, share = own, np.ones(len(own))
                else:
                    child_nodes, child_weighted = below
                    parent = np.searchsorted(nodes, _shorter(child_nodes))
                    total = np.bincount(parent, child_weighted, len(nodes))
                    weighted = np.logaddexp(own, total) - np.log(2)
                    share = np.exp(own - np.log(2) - weighted)
                p_one = (ones + 0.5) / (both + 1)
                mine = to[at]
                p_bit = np.where((codes >> (7 - j)) & 1, p_one[mine], 1 - p_one[mine])
                ahead = p_bit if below is None else share[mine] * p_bit + (1 - share[mine]) * ahead
                below = nodes, weighted
            self.head.append((nodes, zeros, ones, weighted))
            self.ahead.append(ahead)

    def heads(self) -> tuple[np.ndarray, ...]:
        """Of the nodes that head the subtrees: the nearer bytes with the node, zeros, ones, log weighted; summed over the farthest byte."""
        nodes, zeros, ones, weighted = (np.concatenate(x) for x in zip(*self.head, strict=True))
        keys = _shorter(nodes)
        found, (zeros, ones, weighted), _ = _reduced(keys, None, zeros, ones, weighted)
        return found, zeros, ones, weighted

    def log10(self, top: "TopLevels") -> np.ndarray:
        """Log of each gram's byte's probability, mixed over all depths."""
        total = np.zeros(len(self.codes))
        symbol = self.codes & 255
        for j in range(8):
            node, bit = (1 << j) | (symbol >> (8 - j)), (symbol >> (7 - j)) & 1
            p = self.ahead[j]
            for depth, (keys, share, p_one) in zip(range(self.top - 1, -1, -1), top.levels, strict=True):
                at = np.searchsorted(keys, (self.codes >> (8 * (DEPTH + 1 - depth)) << 8) | node)
                own = np.where(bit, p_one[at], 1 - p_one[at])
                p = share[at] * own + (1 - share[at]) * p
            total += np.log10(p)
        return total


class TopLevels:
    """The contexts of under TOP bytes, longest first, from the summed heads of all subtrees in order of their keys."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        self.levels = []
        for _ in range(TOP):
            own = log_kt(zeros, ones)
            mixed = np.logaddexp(own, weighted) - np.log(2)
            self.levels.append((keys, np.exp(own - np.log(2) - mixed), (ones + 0.5) / (zeros + ones + 1)))
            keys, (zeros, ones, weighted), _ = _reduced(_shorter(keys), None, zeros, ones, mixed)


class GramTable:
    """Values by number (from 0 on) in open addressing over arrays; 0 for others."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(codes)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        slot, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            s = slot[left]
            free = self.keys[s] < 0
            take, first = np.unique(s[free], return_index=True)
            won = left[free][first]
            self.keys[take], self.values[take] = codes[won], values[won]
            left = left[self.keys[s] != codes[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        found = self.keys[slot]
        out = np.where(found == codes, self.values[slot], self.values.dtype.type(0))
        left = np.flatnonzero((found != codes) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            same = found == codes[left]
            out[left[same]] = self.values[slot[same]]
            more = ~same & (found >= 0)
            left, slot = left[more], slot[more]
        return out
