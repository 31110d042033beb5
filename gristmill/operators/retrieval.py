"""Lexical top-k retrieval: a block-max inverted index, and a pruned pass where one search does not pay for an index.

The index. Passages are dealt to blocks, close ones together. The index has a row for each term and block with the passages there; without
those lists it is the small table that tells how much a term can add to a score inside a block. A search is a plan of joins on terms:

1. Probes: passages of a query's rarest terms, scored in full. The k-th best score found is the query's threshold.
2. The query's commonest terms are set aside as long as all of them together stay below the threshold: a passage with nothing
   else cannot be among the best. The other terms are essential.
3. A block counts only if the essential terms it holds, and all those set aside, could reach the threshold.
4. Passages of the essential terms in those blocks count only if they could reach it too; what is left is scored in full.

The pass. As long as all queries together are small, each task turns them into an inverted index of its own and goes through its
passages in blocks: a block's words bound every query's score there, and only queries whose bound reaches their k-th best score so far
are scored against it.

Both are exact: bounds are never below a score, and a score that equals the threshold still counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..sources.shared import persisted

#: Passages a block is planned for; how many postings of its rarest terms a query looks at for its threshold, for each wanted passage.
BLOCK_PASSAGES, PROBES = 64, 16
#: Bytes of query text up to which queries go to all passages; scores that a task holds at once.
QUERY_BYTES, SCORES_AT_ONCE = 16 << 20, 1 << 22
#: What a shared word and a shared tag add to a score.
WORD_WEIGHT, TAG_WEIGHT = 1, 2
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


@dataclass(frozen=True)
class LexicalIndex:
    """``passages`` (passage, words, tags, block) and ``postings`` (term, block, weight, passages), both written tables. A tag's term
    starts with ``#``, which no word has."""

    passages: DataFrame
    postings: DataFrame


def _asked(queries: DataFrame) -> DataFrame:
    """(query, words): distinct words of queries with an id and a text."""
    return queries.where("query is not null and text is not null").select(F.col("query").cast("long"), F.array_distinct(word_tokens(F.col("text"))).alias("words"))


def _terms(words, tags):
    """(term, weight) entries of words and tags."""
    return F.concat(F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(WORD_WEIGHT).alias("weight"))), F.transform(tags, lambda t: F.struct(F.concat(F.lit("#"), t).alias("term"), F.lit(TAG_WEIGHT).alias("weight"))))


def _with_words(passages: DataFrame, tags: DataFrame | None) -> DataFrame:
    """(passage, words, tags) of passages with an id; words and tags each once, none where there is no text or tag."""
    none, own = F.array().cast("array<string>"), passages.where("passage is not null").select(F.col("passage").cast("long"), "text")
    if tags is not None:
        listed = tags.where("passage is not null and tag is not null").groupBy(F.col("passage").cast("long").alias("passage")).agg(F.collect_set("tag").alias("tags"))
        own = own.join(listed, "passage", "left")
    return own.select("passage", F.coalesce(F.array_distinct(word_tokens(F.col("text"))), none).alias("words"), (none if tags is None else F.coalesce("tags", none)).alias("tags"))


def lexical_index(passages: DataFrame, tags: DataFrame | None = None, only: DataFrame | None = None) -> LexicalIndex:
    """The index of (passage, text), each id once, with tags (passage, tag); with ``only`` (query, words) just of terms that these ask for.

    A passage's block comes from the smallest hash of its words, so that close texts share blocks, and in part from its own hash, so
    that no block of n passages in all holds more than about sqrt(n * BLOCK_PASSAGES), however many are alike.
    """
    own = _with_words(passages, tags)
    side = max(1, math.isqrt(-(-passages.count() // BLOCK_PASSAGES)))
    lowest = F.array_min(F.transform("words", lambda w: F.xxhash64(w)))
    # Blocks are written with the words: above an explode they would be worked out for each word.
    own = persisted(own.withColumn("block", (F.pmod(F.xxhash64(lowest), F.lit(side)) * side + F.pmod(F.xxhash64("passage"), F.lit(side))).cast("int")), "passages")
    rows = own.select("passage", "block", F.explode(_terms(F.col("words"), F.col("tags"))).alias("entry")).select("passage", "block", "entry.*")
    if only is not None:
        wanted = only.select(F.explode("words").alias("word")).distinct()
        rows = rows.join(wanted.unionByName(wanted.select(F.concat(F.lit("#"), "word").alias("word"))).withColumnRenamed("word", "term"), "term", "left_semi")
    postings = rows.groupBy("term", "block").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.collect_list("passage").alias("passages"))
    return LexicalIndex(own, persisted(postings, "postings"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "passage"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _scored(pairs: DataFrame, asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """Distinct (query, passage) with their whole scores."""
    words = lambda df, key, *more: df.select(key, *(F.col(c).alias(f"_{c}_{key}") for c in ("words", *more)))
    both = pairs.join(words(asked, "query"), "query").join(words(index.passages, "passage", "tags"), "passage")
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    score = WORD_WEIGHT * shared("_words_query", "_words_passage") + TAG_WEIGHT * shared("_words_query", "_tags_passage")
    return both.select("query", "passage", score.cast("long").alias("score")).where("score > 0")


def _query_terms(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query, term, weight, df, before): the terms of each query that occur; ``before`` counts the postings of its rarer ones."""
    df = index.postings.groupBy("term").agg(F.sum("n").alias("df"))
    words = F.transform(F.col("words"), lambda w: F.array(F.struct(w.alias("term"), F.lit(WORD_WEIGHT).alias("weight")), F.struct(F.concat(F.lit("#"), w).alias("term"), F.lit(TAG_WEIGHT).alias("weight"))))
    rows = asked.select("query", F.inline(F.flatten(words))).join(df, "term")
    rarer = Window.partitionBy("query").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    # What the query's commoner terms can add, the term's own share included.
    commoner = Window.partitionBy("query").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", F.coalesce(F.sum("df").over(rarer), F.lit(0)).alias("before"), F.sum("weight").over(commoner).alias("reach"))


def candidates(asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """(query, passage): every passage that can be among a query's k best, and few others."""
    terms = persisted(_query_terms(asked, index), "query-terms")
    postings = index.postings
    probes = terms.where(F.col("before") < PROBES * k).join(postings, "term").select("query", F.explode("passages").alias("passage")).distinct()
    # A query with fewer than k probes has no threshold: all of its terms are rare then, and all are looked up.
    threshold = _best(_scored(probes, asked, index), k).groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0).alias("least"))
    bounded = terms.join(threshold, "query", "left").withColumn("least", F.coalesce("least", F.lit(0)))
    aside = F.max(F.when(F.col("reach") < F.col("least"), F.col("reach"))).over(Window.partitionBy("query"))
    essential = bounded.select("query", "term", "least", "reach", F.coalesce(aside, F.lit(0)).alias("aside")).where("reach >= least")
    # The lists are not read here: which blocks can hold a passage at all.
    heads = essential.select("query", "term", "least", "aside").join(postings.select("term", "block", F.col("weight").alias("most")), "term")
    blocks = heads.groupBy("query", "block").agg(F.sum("most").alias("bound"), F.first("aside").alias("aside"), F.first("least").alias("least")).where("bound + aside >= least")
    held = essential.select("query", "term").join(blocks.select("query", "block", "aside", "least"), "query").join(postings.select("term", "block", "weight", "passages"), ["term", "block"])
    found = held.select("query", "aside", "least", "weight", F.explode("passages").alias("passage"))
    reached = found.groupBy("query", "passage").agg(F.sum("weight").alias("part"), F.first("aside").alias("aside"), F.first("least").alias("least"))
    return reached.where("part + aside >= least").select("query", "passage")


def search(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query, passage, score, rank): the k passages of the highest scores of each query (query, text), ids each once; of equal scores the
    smaller ids. Passages that share nothing are not returned; null ids and texts are left out."""
    asked = _asked(queries)
    return _best(_scored(candidates(asked, index, k), asked, index), k)


class _Asked:
    """Queries by their words: ``starts[t]`` to ``starts[t + 1]`` are the ``numbers`` of queries with the t-th word."""

    def __init__(self, names: np.ndarray, words: pa.ListArray):
        flat = words.flatten().dictionary_encode()
        self.names, self.vocabulary = names, flat.dictionary
        terms = flat.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(terms, kind="stable")
        self.numbers = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(self.vocabulary) + 1))

    def among(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of the live queries alone."""
        kept = live[self.numbers]
        return np.concatenate([[0], np.cumsum(kept)])[self.starts], self.numbers[kept]


def _spread(starts: np.ndarray, numbers: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every term the queries that have it, and how many these are."""
    n = starts[terms + 1] - starts[terms]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return numbers[np.repeat(starts[terms], n) + at], n


class _TopPassages:
    """The k passages of the highest scores so far of each query; of equal scores the smaller ids."""

    def __init__(self, asked: _Asked, k: int):
        self.asked, self.k = asked, k
        self.least = np.ones(len(asked.names), np.int64)  # a score must reach it
        self.kept = [np.zeros(0, np.int64)] * 3  # query, passage, score
        self.fresh: list[list[np.ndarray]] = []
        self.scored = 0

    def add(self, passages: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Passages with the weights of their terms (numbers of ``rows`` in order)."""
        present = np.zeros((2, len(self.asked.vocabulary)), bool)
        present[(weights == TAG_WEIGHT).astype(int), terms] = True
        most = WORD_WEIGHT * present[0] + TAG_WEIGHT * present[1]
        bound = np.zeros(len(self.asked.names), np.int64)
        np.add.at(bound, self.asked.numbers, np.repeat(most, np.diff(self.asked.starts)))
        live = bound >= self.least
        if not live.any():
            return
        place = np.cumsum(live) - 1
        starts, numbers = self.asked.among(live)
        at, n = _spread(starts, numbers, terms)
        width = int(live.sum())
        self.scored += width * len(passages)
        scores = np.bincount(np.repeat(rows, n) * width + place[at], np.repeat(weights, n), width * len(passages)).astype(np.int64).reshape(len(passages), width)
        who = np.flatnonzero(live)
        row, column = np.nonzero(scores >= self.least[who])
        self.fresh.append([who[column], passages[row], scores[row, column]])
        if sum(len(f[0]) for f in self.fresh) > 4 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        query, passage, score = (np.concatenate(x) for x in zip(self.kept, *self.fresh))
        self.fresh = []
        order = np.lexsort((passage, -score, query))
        query, passage, score = query[order], passage[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.kept = [query[keep], passage[keep], score[keep]]
        last = place == self.k - 1
        self.least[query[last]] = score[last]


def _scan(asked: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """(query, passage, score): every task's best of all queries, which are small and go to all of them."""
    spark = own.sparkSession
    found = asked.where(F.size("words") > 0).toArrow()  # QUERY_BYTES of text at most
    schema = "query long, passage long, score long"
    if not found.num_rows:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(_Asked(found.column(0).to_numpy(), found.column(1).combine_chunks()))

    def run(batches):
        top = None
        for batch in batches:
            top = top or _TopPassages(shared.value, k)
            entries = []
            for lists, weight in ((batch.column(1), WORD_WEIGHT), (batch.column(2), TAG_WEIGHT)):
                terms = pc.index_in(lists.flatten(), value_set=top.asked.vocabulary)
                rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                known = terms.is_valid().to_numpy(zero_copy_only=False)
                entries.append((rows[known], terms.drop_null().to_numpy(), np.full(known.sum(), weight)))
            rows, terms, weights = (np.concatenate(x) for x in zip(*entries))
            order = np.argsort(rows, kind="stable")
            rows, terms, weights = rows[order], terms[order], weights[order]
            ids = batch.column(0).to_numpy()
            step = max(1, min(BLOCK_PASSAGES, SCORES_AT_ONCE // len(top.asked.names)))
            for a in range(0, len(ids), step):
                i, j = np.searchsorted(rows, [a, a + step])
                top.add(ids[a : a + step], rows[i:j] - a, terms[i:j], weights[i:j])
        if top:
            top.settle()
            query, passage, score = top.kept
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (top.asked.names[query], passage, score)], ["query", "passage", "score"])

    return own.mapInArrow(run, schema)


def overlaps(queries: DataFrame, passages: DataFrame, k: int, tags: DataFrame | None = None) -> DataFrame:
    """(query, passage, score, rank): the k passages with the most distinct words of each query, and two for each shared tag.

    Tables have (query, text) and (passage, text), each id once; ``tags`` has (passage, tag). Passages that share nothing are not returned;
    null ids and null queries are left out. Up to QUERY_BYTES of queries are one pass over the passages; for more an index of their terms is
    made, and the search is joins. :func:`lexical_index` and :func:`search` keep an index for many searches.
    """
    asked = _asked(queries)
    size = queries.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > QUERY_BYTES:
        return search(lexical_index(passages, tags, asked), queries, k)
    return _best(_scan(asked, _with_words(passages, tags), k), k)


def retrieve_all(retrievers: Sequence[Retriever], queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """Any retrievers (queries, passages, k) -> (query, passage, score, rank), the earlier ones' answers winning."""
    frames = [f(queries, passages, k).withColumn("_priority", F.lit(i)) for i, f in enumerate(retrievers)]
    rows = reduce(DataFrame.unionByName, frames)
    first = F.row_number().over(Window.partitionBy("query", "passage").orderBy("_priority"))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first", "_priority")
