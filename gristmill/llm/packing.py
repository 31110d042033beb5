"""Packing of texts into sequences of fixed length, each next to texts that it is lexically close to.

Texts are dealt into shards of bounded size by the words that set them apart, so that close texts meet. A shard has a BM25 index of its own. The text that a window starts
with is its seed; the index returns the seed's unused neighbours, best first, and they fill the window. The last one
is cut where the window ends, and what is left of it starts the next window as its seed. So only a shard's last
window is padded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, words

#: Text of a shard, about; a task holds one shard (half as much again at most, or one text).
SHARD_BYTES = 8 << 20
#: Cells of texts that share the word of a min-hash; cells of over half a shard are split by the next key.
CELLS = 4096
#: Rows of the small tables that deal texts to shards up to which they are broadcast; larger ones are joined.
BROADCAST_CELLS = 1 << 20
_DF_BITS = 18
K1, B = 1.2, 0.75
#: Share of a shard's texts up to which a word is indexed: all words are, as their idf weighs the common ones.
COMMON = 1.0
#: Words in more than this share of a shard's texts are held as a row over all texts, which is summed faster than postings.
DENSE = 0.125
#: Postings of used texts go when no more than this share of the texts held is free.
STILL_FREE = 0.75
PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Runs so long that only the slower library is sure to take them in linear time.
_LONG_RUN = re.compile(r"\S{4000}|\s{4000}")
_BOTH = re.compile(r"\s"), re.compile(r"\S")
#: The pattern of byte-level BPE's words: a fixed value that goes with the vocabulary.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Stretches of text that are encoded in one call, and texts whose ids are put together at once.
_TOGETHER, _TEXTS = 1 << 15, 1 << 10
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids as bytes (32-bit, little-endian) by a byte-level BPE definition of ``tokenizers``.

    Most texts go through ``tiktoken`` with the definition's own vocabulary, where a merge's rank is the id it makes, which
    gives the same ids faster; texts with special tokens or very long runs go through ``tokenizers``.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        # Bytes that do not print are written as the characters from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in plain]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
        vocabulary = json.loads(definition)["model"]["vocab"]
        ranks = {bytes(of[c] for c in piece): n for piece, n in vocabulary.items() if piece not in self.special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.widths[list(ranks.values())] = [len(piece) for piece in ranks]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or has_long_run(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def encode_all(self, texts: list[str]) -> dict[str, bytes]:
        """The ids of many texts. Words that recur are encoded once: no piece of the pattern goes on after a space that another character than
        white space follows, so a text's ids are those of its stretches between such spaces. Other texts are encoded by themselves."""
        plain = [text for text in texts if not (any(s in text for s in self.special) or has_long_run(text))]
        numbers, out, bounds = _Numbers(), [], [0]
        for text in plain:
            first, *rest = text.split(" ")
            out.append(numbers[first + " "])  # no space comes before it
            out += map(numbers.__getitem__, rest)
            bounds.append(len(out))
        stretches = list(numbers)
        odd = np.array([not s or s[0].isspace() for s in stretches], bool)  # the space before it is no cut; an empty first one is done alone as well
        size, at = np.zeros(len(stretches), np.int64), np.zeros(len(stretches), np.int64)
        after, opening = [], []
        for i, s in enumerate(stretches):
            if not odd[i]:
                (opening if s[-1] == " " else after).append(i)
        made, done = [], 0
        for i in opening:
            made.append(np.array(self.fast.encode_ordinary(stretches[i][:-1]), "<u4"))
            at[i], size[i] = done, len(made[-1])
            done += len(made[-1])
        for k in range(0, len(after), _TOGETHER):
            part = after[k : k + _TOGETHER]
            joined = [" " + stretches[i] for i in part]
            ids = np.frombuffer(array("I", self.fast.encode_ordinary("".join(joined))), "<u4")
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(s.encode()) for s in joined])) + 1
            at[part], size[part] = done + np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])
            made.append(ids)
            done += len(ids)
        table = np.concatenate(made) if made else np.zeros(0, "<u4")
        found = {}
        for k in range(0, len(plain), _TEXTS):
            group = plain[k : k + _TEXTS]
            own = np.array(out[bounds[k] : bounds[k + len(group)]], np.int64)
            starts = np.array(bounds[k : k + len(group)]) - bounds[k]
            count = size[own]
            places = np.repeat(at[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            ids, cuts = table[places], np.r_[0, np.cumsum(np.add.reduceat(count, starts))]
            alone = np.logical_or.reduceat(odd[own], starts)
            for i, text in enumerate(group):
                found[text] = self.encode(text) if alone[i] else ids[cuts[i] : cuts[i + 1]].tobytes()
        return found | {text: self.encode(text) for text in texts if text not in found}


def encoder(definition: str) -> Encoder:
    """One encoder in each worker process, with its memory."""
    if definition not in _loaded:
        _loaded.clear()
        _loaded[definition] = Encoder(definition)
    return _loaded[definition]


def has_long_run(text: str) -> bool:
    """Whether 4,000 characters in a row are white space, or none of them is: only then half as many from a multiple of 2,000 on are."""
    blocks = range(0, len(text) - 1999, 2000)
    return any(not kind.search(text, at, at + 2000) for at in blocks for kind in _BOTH) and _LONG_RUN.search(text) is not None


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def numbered_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of each text, and the offsets of the texts."""
    numbers, out, bounds = _Numbers(), [], [0]
    for text in texts:
        out += map(numbers.__getitem__, text.encode().translate(_LOWER).split())
        bounds.append(len(out))
    return np.array(out, np.int32), np.array(bounds)


class Index:
    """BM25 over the distinct texts of a shard; ``copies`` tells how many texts each stands for (one, if not given)."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, copies: np.ndarray | None = None):
        n = len(bounds) - 1
        # A word and its text are one number, so that one plain sort orders both; hashes lose the first bits of the texts' numbers.
        bits = np.uint64(max(1, (n - 1).bit_length()))
        both = tokens.astype(np.uint64) << bits | np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
        both.sort()
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[first, len(both)])
        both = both[first]
        word, doc = both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.r_[True, word[1:] != word[:-1]] if len(word) else np.zeros(0, bool)
        term = np.cumsum(new) - 1
        df = np.bincount(term) if len(term) else np.zeros(0, np.int64)
        length = np.diff(bounds)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        keep = (df[term] > 1) & (df[term] <= COMMON * n)  # a word of one text finds that text alone
        if copies is not None:
            keep |= copies[doc] > 1
        term, doc, tf = term[keep], doc[keep], tf[keep]
        by_doc = np.argsort(doc.astype(np.uint16) if n <= 1 << 16 else doc, kind="stable")
        self.n, self.columns = n, np.arange(n)
        self.terms, self.terms_of = term[by_doc], np.searchsorted(doc[by_doc], np.arange(n + 1))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        common = df > DENSE * n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.table = np.zeros((int(common.sum()), n), np.float32)
        many = common[term]
        self.table[self.row[term[many]], doc[many]] = weight[many]
        self.doc, self.weight = doc[~many], weight[~many]
        self.start = np.searchsorted(term[~many], np.arange(len(df) + 1))

    def drop_used(self, free: np.ndarray) -> None:
        """Used texts are not scored any more; df and lengths stay those of all texts."""
        held = free[self.columns]
        keep = held[self.doc]
        self.start = np.r_[0, np.cumsum(keep)][self.start]
        self.doc, self.weight = (np.cumsum(held) - 1)[self.doc[keep]], self.weight[keep]
        self.table, self.columns = self.table[:, held], self.columns[held]

    def scores(self, seed: int) -> np.ndarray:
        """The score of every text for the words of one; 0 for texts that were dropped."""
        out = np.zeros(self.n)
        terms = self.terms[self.terms_of[seed] : self.terms_of[seed + 1]]
        if not len(terms):
            return out
        rows = self.row[terms]
        rare = terms[rows < 0]
        lo, count = self.start[rare], self.start[rare + 1] - self.start[rare]
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out[self.columns] = np.bincount(self.doc[at], self.weight[at], len(self.columns)) + self.table[rows[rows >= 0]].sum(axis=0)
        return out


def order_texts(lengths: np.ndarray, copies: np.ndarray, index: Index, size: int) -> list[int]:
    """The order in which a shard's distinct texts fill its windows, each as often as it has copies."""
    left, free = copies.copy(), np.ones(len(lengths), bool)
    out, at, lowest, n_free, total = [], 0, 0, len(lengths), int(copies.sum())
    scores = None
    while len(out) < total:
        if scores is None or at % size == 0:
            while not free[lowest]:
                lowest += 1
            text, scores = lowest, None
        else:
            text = int(np.argmax(scores))
            if not free[text] or scores[text] <= 0:
                while not free[lowest]:
                    lowest += 1
                text = lowest
        left[text] -= 1
        out.append(text)
        started = at // size
        at += int(lengths[text])
        if not left[text]:
            free[text] = False
            n_free -= 1
            if scores is not None:
                scores[text] = -1
            if n_free <= STILL_FREE * len(index.columns):
                index.drop_used(free)
        if at % size and (scores is None or at // size != started):  # it starts an open window: its neighbours come next
            scores = np.where(free, index.scores(text), -1)
    return out


def shard_pieces(ids: list, texts: list[str], encode, size: int, first_sequence: int) -> list[tuple]:
    """The rows of PIECE for a shard's texts; equal texts are encoded and indexed once."""
    members: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        members.setdefault(text, []).append(i)
    distinct, copies = list(members), np.array([len(x) for x in members.values()])
    encoded = [encode(text) for text in distinct]
    order = order_texts(np.array([len(x) // 4 for x in encoded]), copies, Index(*words.word_hashes(pa.array(distinct, pa.large_string())), copies), size)
    each = [iter(x) for x in members.values()]
    return pieces([ids[next(each[row])] for row in order], [encoded[row] for row in order], size, first_sequence)


def pieces(ids: list, encoded: list[bytes], size: int, first_sequence: int) -> list[tuple]:
    """The rows of PIECE for texts that fill one window after the other."""
    out, at = [], 0
    for id_, data in zip(ids, encoded, strict=True):
        start = 0
        total = len(data) // 4
        while start < total:
            offset = at % size
            length = min(total - start, size - offset)
            out.append((id_, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total, first_sequence + at // size, offset))
            start += length
            at += length
    return out


def _batch_words(batch: pa.RecordBatch, column: str):
    for first, part in words.slices(batch.column(column)):
        tokens, offsets = words.word_hashes(part)
        yield first, len(part), tokens, np.repeat(np.arange(len(part)), np.diff(offsets))


def _count_words(batches):
    """Texts by the first bits of their words' hashes."""
    df, n = np.zeros(1 << _DF_BITS, np.int64), 0
    for batch in batches:
        for _, size, tokens, text in _batch_words(batch, "text"):
            own = text << _DF_BITS | (tokens >> np.uint64(64 - _DF_BITS)).astype(np.int64)
            own.sort()
            own = own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own
            df += np.bincount(own & ((1 << _DF_BITS) - 1), minlength=1 << _DF_BITS)
            n += size
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], ["word", "n"])


def min_words(tokens: np.ndarray, text: np.ndarray, size: int, idf: np.ndarray, number: int) -> np.ndarray:
    """For each text the word that a weighted min-hash draws: two texts draw the same one as often as their idf overlaps."""
    out = np.zeros(size, np.int64)
    if len(tokens):
        draw = (words.mix(tokens + np.uint64(0x9E3779B97F4A7C15 * (number + 1) % (1 << 64))) >> np.uint64(11)).astype(np.float64) + 0.5
        value = -np.log(draw / (1 << 53)) / idf[(tokens >> np.uint64(64 - _DF_BITS)).astype(np.int64)]
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        least = np.repeat(np.minimum.reduceat(value, first), np.diff(np.r_[first, len(text)]))
        hit = np.flatnonzero(value == least)
        out[text[hit]] = (words.mix(tokens[hit]) >> np.uint64(1)).astype(np.int64)
    return out


def dealt(rows: DataFrame, total: int) -> DataFrame:
    """``id, text, shard`` of (id, text) with ``total`` bytes: close texts share a shard, whose size stays bounded."""
    spark = rows.sparkSession
    if total <= SHARD_BYTES:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    counts = rows.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df, word, n = np.zeros(1 << _DF_BITS), counts.column("word").to_numpy(), counts.column("n").to_numpy()
    df[word[word >= 0]] = n[word >= 0]
    seen = max(n[word < 0].sum(), df.max())
    shared = spark.sparkContext.broadcast(np.log1p((seen - df + 0.5) / (df + 0.5)))

    def keys(batches):
        for batch in batches:
            found = [[min_words(tokens, text, size, shared.value, i) for i in range(2)] for _, size, tokens, text in _batch_words(batch, "text")]
            found = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *map(pa.array, found)], ["id", "text", "k0", "k1"])

    keyed = scratch.write(rows.select("id", "text").mapInArrow(keys, "id long, text string, k0 long, k1 long").withColumn("row", F.monotonically_increasing_id()), "keyed")
    levels = [F.col("k0"), F.col("k1"), F.xxhash64("text"), F.xxhash64("text", "id"), F.xxhash64("row")]
    cell = [f"c{i}" for i in range(len(levels))]
    keyed = keyed.select("id", "text", "k0", "k1", "row", F.pmod("k0", F.lit(CELLS)).alias("c0"), *(F.lit(0).cast("long").alias(c) for c in cell[1:]))
    size = F.sum(F.octet_length("text").cast("long") + 8).alias("bytes")
    for i in range(1, len(levels)):  # large cells are split by the next key, equal texts by their ids, and rows that are equal by their numbers
        large = keyed.groupBy(cell).agg(size).where(F.col("bytes") > SHARD_BYTES // 2).withColumn("parts", F.ceil(F.col("bytes") * 8 / SHARD_BYTES)).drop("bytes")
        large = scratch.write(large, "large-cells")  # a few for each shard at most
        keyed = keyed.join(_small(large), cell, "left").withColumn(cell[i], F.coalesce(F.pmod(levels[i], F.col("parts")) + 1, F.lit(0))).drop("parts")
    sizes = scratch.write(keyed.groupBy(cell).agg(size), "cell-sizes")
    # A cell's place is what the first keys before its own hold, CELLS rows, and what comes before it inside its first key.
    firsts = sizes.groupBy("c0").agg(F.sum("bytes").alias("all"))
    firsts = firsts.select("c0", (F.sum("all").over(Window.orderBy("c0")) - F.col("all")).alias("offset"))
    inside = F.sum("bytes").over(Window.partitionBy("c0").orderBy(*cell)) - F.col("bytes")
    shards = sizes.withColumn("inside", inside).join(F.broadcast(firsts), "c0").select(*cell, F.floor((F.col("offset") + F.col("inside")) / SHARD_BYTES).alias("shard"))
    return keyed.join(_small(scratch.write(shards, "cells")), cell).select("id", "text", "shard")


def _small(table: DataFrame) -> DataFrame:
    """The table, for a broadcast if it is known to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_CELLS else table


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row for each piece of a text.

    A text's token ids are followed by ``end_id``; its pieces hold each of them once, and ``offset`` counts the ids of a
    sequence without gaps. Sequences hold ``size`` ids, but for each shard's last. A null or empty text is its end id
    alone; a very long one is encoded whole and cut into many pieces. Repeated rows and rows with null ids are packed like
    others; of neighbours with equal scores the one with the smallest id comes first. Other columns, whatever their names, are
    ignored. An empty table gives an empty result. The tokenizer's file is read on the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), F.coalesce(scratch.column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 0
    rows = dealt(rows, total)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        texts, ids = table.column("text").to_pylist(), table.column("id").to_pylist()
        end = np.array([end_id], "<u4").tobytes()
        coder = encoder(definition.value)
        encoded = coder.encode_all(list(dict.fromkeys(texts)))
        found = shard_pieces(ids, texts, lambda text: encoded[text] + end, size, table.column("shard")[0].as_py() << 32)
        names = [c.split()[0] for c in PIECE.split(", ")]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    return rows.groupBy("shard").applyInArrow(run, PIECE).withColumnRenamed("id", id_col)
