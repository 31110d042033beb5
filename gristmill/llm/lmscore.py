"""Scores of whole texts by a context-tree model of bytes, and by a word unigram base.

The model's text is the lower-cased words joined by single spaces, and one end byte; the base's tokens are the words
and one end. Counts of byte grams and of words are gathered from all training texts by one aggregation. Subtrees of
the context tree are weighted in parallel (:mod:`.ctw`); the predictions for all grams that occur are then looked up
for every text, in one pass. Grams and words are looked up in two ways: those so frequent that few can be are
broadcast, the others are joined, so that no task needs the whole model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ctw, scratch, words

#: Grams and words counted as frequent, at most: bounds of what is broadcast.
FREQUENT_GRAMS, FREQUENT_WORDS = 1 << 21, 1 << 20
_FLUSH = 1 << 22
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD, _GRAM = 0, 1
_HEAD_SHIFT = 8 * (ctw.DEPTH + 1 - ctw.TOP)
_SCORED = "uid long, id long, held_out boolean, n_tokens long, n_known long, base double, n_bytes long, score double, rare array<long>, rare_grams array<struct<key:long,n:long>>"


def _gram_slices(text) -> Iterator[np.ndarray]:
    """The grams of a text, some megabytes at a time."""
    found = bytes(text.as_buffer()) if text.is_valid else b""
    data = np.frombuffer(b" ".join(found.translate(_LOWER).split()) + b"\n", np.uint8)
    for at in range(0, len(data), _FLUSH):
        yield ctw.grams(data[at : at + _FLUSH], data[at - ctw.DEPTH : at] if at else None)


def _word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, offsets = words.word_hashes(texts)
    return (hashes >> np.uint64(1)).astype(np.int64), offsets


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (held_out, text) to (kind, key, n): counts in the training texts; grams of the others with 0."""
    held: dict[tuple[int, bool], list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (kind, counted), arrays in held.items():
            keys, n = np.unique(np.concatenate(arrays), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n if counted else np.zeros_like(n))], ["kind", "key", "n"])
        held.clear()

    parts = (part for batch in batches for first, texts in words.slices(batch.column(1)) for part in [(batch.column(0)[first : first + len(texts)], texts)])
    for flags, texts in parts:
        keys, offsets = _word_keys(texts)
        for i, (held_out, text) in enumerate(zip(flags.to_pylist(), texts, strict=True)):
            if not held_out:
                held.setdefault((_WORD, True), []).append(keys[offsets[i] : offsets[i + 1]].copy())
            for grams in _gram_slices(text):
                held.setdefault((_GRAM, not held_out), []).append(grams)
                size += len(grams)
                if size >= _FLUSH:
                    yield from flush()
                    size = 0
    yield from flush()


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[ctw.Subtree]:
    """Rows (key, n), sorted by key, to groups of whole subtrees."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        k, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        cut = int(np.searchsorted(k >> _HEAD_SHIFT, k[-1] >> _HEAD_SHIFT))  # the last subtree may go on
        ended = cut > 0 or held and held[-1][0][-1] >> _HEAD_SHIFT != k[0] >> _HEAD_SHIFT
        if ended and rows + cut >= 1 << 18:
            held.append((k[:cut], n[:cut]))
            yield ctw.Subtree(*map(np.concatenate, zip(*held, strict=True)))
            held, rows, k, n = [], 0, k[cut:], n[cut:]
        held.append((k, n))
        rows += len(k)
    if held:
        yield ctw.Subtree(*map(np.concatenate, zip(*held, strict=True)))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for subtree in _subtrees(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in subtree.heads()], ["key", "zeros", "ones", "weighted"])


def _predictions(top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for subtree in _subtrees(batches):
            yield pa.RecordBatch.from_arrays([pa.array(subtree.codes), pa.array(subtree.counts), pa.array(subtree.log10(top.value).astype(np.float32))], ["key", "n", "log_p"])

    return run


def _score(table, frequent, end_value: float):
    """Rows (uid, id, held_out, text) to _SCORED: what the frequent grams and words give, and which others there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = table.value, frequent.value
        parts = (batch.slice(first, len(texts)) for batch in batches for first, texts in words.slices(batch.column(3)))
        for batch in parts:
            texts = batch.column(3)
            score, n_bytes, others, ends = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], [0]
            for i, text in enumerate(texts):
                n = 0
                for x in _gram_slices(text):
                    found = grams.get(x)
                    score[i] += found.sum(dtype=np.float64)
                    n_bytes[i] += len(x)
                    others.append(x[found == 0])
                    n += len(others[-1])
                ends.append(ends[-1] + n)
            others = np.concatenate(others)
            # Each of a text's other grams once, with its count.
            text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
            order = np.lexsort((others, text_of))
            others, text_of = others[order], text_of[order]
            first = np.flatnonzero(np.r_[True, (others[1:] != others[:-1]) | (text_of[1:] != text_of[:-1])][: len(others)])
            times = np.diff(np.r_[first, len(others)])
            pairs = pa.StructArray.from_arrays([pa.array(others[first]), pa.array(times)], ["key", "n"])
            keys, offsets = _word_keys(texts)
            values = known.get(keys)
            hit = values != 0
            sums, hits = np.concatenate([[0.0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(hit)])
            arrays = [
                batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets) + 1),
                pa.array(hits[offsets[1:]] - hits[offsets[:-1]] + (end_value > -1)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]] + end_value),
                pa.array(n_bytes), pa.array(score),
                pa.ListArray.from_arrays(pa.array((offsets - hits[offsets]).astype(np.int32)), pa.array(keys[~hit])),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of[first], np.arange(len(texts) + 1)).astype(np.int32)), pairs),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "id", "held_out", "n_tokens", "n_known", "base", "n_bytes", "score", "rare", "rare_grams"])

    return run


def _least_digits(facts, kind: int, room: int) -> int:
    """The binary digits from which on a count is frequent, so that at most ``room`` keys are."""
    digits = 64
    for x in sorted((x for x in facts if x.kind == kind), key=lambda x: -x.digits):
        if (room := room - x["keys"]) < 0:
            break
        digits = x.digits
    return digits


def score_texts(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row.

    Rows whose id, as text, has a CRC-32 divisible by ``folds`` are held out; all others are learned from (an id that
    is null counts as an empty text and is held out). ``score`` is the log10 probability of the text under the
    context-tree model and ``bits_per_byte`` its code length over the model's bytes, the end among them; ``base_score`` is
    that under the unigram base with 0.1 added to each count; ``n_known`` counts tokens seen in training, the end among
    them. A null or blank text is an empty one: only the end. Repeated rows count as often as they occur and have equal
    scores. A very long text is read whole, some megabytes at a time. Without training rows every byte has its prior
    probability. Further columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), scratch.column(docs, text_col).cast("string").alias("text"))
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", held_out.alias("held_out"), "text")

    counts = rows.select("held_out", "text").mapInArrow(_counts, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "counts")
    digits = F.length(F.bin("n"))
    facts = counts.groupBy("kind", digits.alias("digits")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).collect()
    ends = rows.where("not held_out").count()
    n_train = sum(x.n for x in facts if x.kind == _WORD) + ends
    n_words = sum(x["keys"] for x in facts if x.kind == _WORD)
    normal = math.log10(n_train + 0.1 * (n_words + (ends > 0) + 1))

    is_frequent = digits >= _least_digits(facts, _WORD, FREQUENT_WORDS)
    vocabulary = counts.where(F.col("kind") == _WORD)
    frequent = vocabulary.where(is_frequent).select("key", "n").toArrow()  # at most FREQUENT_WORDS rows
    values = np.log10(frequent.column("n").to_numpy().astype(float) + 0.1)
    frequent = spark.sparkContext.broadcast(ctw.GramTable(frequent.column("key").to_numpy().astype(np.int64), values))
    other_words = vocabulary.where(~is_frequent).select("key", "n")

    grams = counts.where(F.col("kind") == _GRAM).select("key", "n")
    trees = grams.repartition(F.shiftright("key", _HEAD_SHIFT)).sortWithinPartitions("key")
    heads = trees.mapInArrow(_heads, "key long, zeros long, ones long, weighted double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")))
    heads = heads.orderBy("key").toArrow()  # see ctw.TOP
    top = spark.sparkContext.broadcast(ctw.TopLevels(*(heads.column(c).to_numpy() for c in ("key", "zeros", "ones", "weighted"))) if heads.num_rows else None)
    model = scratch.write(trees.mapInArrow(_predictions(top), "key long, n long, log_p float"), "model")
    is_frequent = digits >= _least_digits(facts, _GRAM, FREQUENT_GRAMS)
    part = model.where(is_frequent).select("key", "log_p").toArrow()  # at most FREQUENT_GRAMS rows
    table = spark.sparkContext.broadcast(ctw.GramTable(part.column("key").to_numpy(), part.column("log_p").to_numpy()))
    scored = scratch.write(rows.mapInArrow(_score(table, frequent, math.log10(ends + 0.1)), _SCORED), "scored")

    rare = scored.select("uid", F.explode("rare").alias("key")).join(other_words, "key", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rare_base"), F.count("n").alias("rare_known"))
    rest = scored.select("uid", F.explode("rare_grams").alias("g")).select("uid", "g.key", "g.n").join(model.where(~is_frequent).select("key", "log_p"), "key")
    rest = rest.groupBy("uid").agg(F.sum(F.col("n") * F.col("log_p").cast("double")).alias("rare_score"))
    out = scored.drop("rare", "rare_grams").join(rare, "uid", "left").join(rest, "uid", "left")
    out = out.withColumn("score", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(normal)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
