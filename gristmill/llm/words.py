"""Hashes of words and word shingles, for many texts at once, in numpy inside a task.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D, with A to Z lower-cased. Its hash is a
polynomial over random byte values modulo 2**64, finished by a mixer; words of a stretch of text are hashed by one
pass of prefix sums. Two different words or shingles share a hash with a chance near 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that end a word when only ASCII letters, digits and all bytes from 0x80 make up words.
_SIGN = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE = _VALUE[_LOWER]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, _CHUNK + 1)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers = tuple(made)
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array, signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets at which each text's words start (one more than texts).

    With ``signs``, ASCII signs also end a word and belong to none.
    """
    breaks = _SIGN if signs else _SPACE
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    hashes, starts_of = [], []
    at = 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not border[end] and not breaks[data[end]]:  # never inside a word
            step = data[end : end + 4096]
            stop = np.flatnonzero(breaks[step] | border[end : end + len(step)])
            end += int(stop[0]) if len(stop) else len(step)
            if len(stop):
                break
        part = data[at:end]
        space = breaks[part]
        cut = border[at:end]
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, space[:-1]
        starts = np.flatnonzero(~space & (before | cut))
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = space[1:] | border[at + 1 : end]
        ends = np.flatnonzero(~space & after) + 1
        power, inverse = _powers_to(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[part] * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
        starts_of.append(starts + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_of), offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words in one text, in order; of the whole sequence if it is shorter; none of none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total) + words[i : n - width + 1 + i]
    return mix(total)


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """A string array in parts of about so many bytes (one text at least), each with the number of its first row."""
    _, offsets = text_bytes(texts)
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1))
        yield a, texts.slice(a, b - a)
        a = b


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part in slices(texts):
        words, offsets = word_hashes(part)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield np.unique(shingle_hashes(words[a:b], k))
