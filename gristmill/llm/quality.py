"""Quality rules: plain text statistics, and a log-likelihood ratio of hashed n-grams between trusted and raw texts.

Tokens are runs of letters, digits and underscores and runs of other signs. Their unigrams and bigrams, hashed into
buckets, are counted over the trusted texts and over all texts; a text's score is the mean over its n-grams of
log(p_trusted / p_raw). Every text is scored and compared with one fixed threshold. All of it is built-in functions on
a scan: texts are not shuffled; what is shuffled is a count for each bucket and task, and what is broadcast is a bounded
sample of trusted ids and one weight for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

BUCKETS = 10_000
#: Trusted rows used, at most: those whose ids hash lowest.
TRUSTED_ROWS = 100_000
#: Texts of a lower mean log ratio are rejected.
THRESHOLD = -0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
_SPACES = r"[\x20\x09-\x0D]+"


def _pairs(array: Column, make) -> Column:
    """``make`` of each element and the one after it."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n), make)


def with_statistics(rows: DataFrame, text: str = "text", verdict: bool = False) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text that is not null.

    Steps are columns of their own where a later one uses them twice, so that no step is computed again. For a ``verdict`` the number of
    repeated words is worked out only where its bounds lie on both sides of the limit; else it is one on the right side.
    """
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumns({"_words": F.split(F.nullif(trimmed, F.lit("")), _SPACES), "_lines": F.filter(F.split(text, "\n"), has_word)})
    rows = rows.withColumn("_words", F.coalesce("_words", F.array().cast("array<string>")))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # Windows of three words are pairs of neighbouring pairs.
    rows = rows.withColumn("_pairs", _pairs(F.col("_hashes"), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("_windows", _pairs(F.col("_pairs"), lambda a, b: F.xxhash64(a, b)))
    # Windows that occur again, by position: neighbours in order of their hashes.
    placed = F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("_again", F.size("_windows") - F.size(F.array_distinct("_windows")))
    # Of n windows that are equal, n - 1 count as again: they hold 3 * n words at most, 6 * (n - 1), and all such windows 3 + again at least.
    most, limit = F.when(F.col("_again") > 0, 6 * F.col("_again")).otherwise(0), MAX_REPEAT_PERCENT * F.size("_words")
    sure = (100 * most <= limit) | (100 * (F.col("_again") + 3) > limit) if verdict else F.lit(False)
    rows = rows.withColumn("_placed", F.when((F.col("_again") > 0) & ~sure, placed).otherwise(F.array().cast("array<struct<w:bigint,i:int>>")))
    repeated = F.flatten(_pairs(F.col("_placed"), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn("_repeated", F.sort_array(F.array_distinct(repeated)))
    steps = _pairs(F.col("_repeated"), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step) + F.when(F.size("_repeated") > 0, 3).otherwise(0)
    if verdict:
        covered = F.when(sure, F.when(100 * most <= limit, 0).otherwise(F.size("_words"))).otherwise(covered)
    out = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }
    return rows.withColumns(out).drop("_words", "_lines", "_hashes", "_pairs", "_windows", "_again", "_placed", "_repeated")


def with_ngrams(rows: DataFrame, text: Column | str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``_ngrams``: the buckets of all unigrams and bigrams."""
    rows = rows.withColumn("_tokens", F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), lambda t: F.xxhash64(t)))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    ngrams = F.concat(F.transform("_tokens", bucket), _pairs(F.col("_tokens"), lambda a, b: bucket(F.xxhash64(a, b))))
    return rows.withColumn("_ngrams", ngrams).drop("_tokens")


def weights(rows: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """log(p_trusted / p_raw) of every bucket, with one added to each count; 0 if no row is trusted.

    ``rows`` has ``id`` and ``_ngrams``; ``trusted`` has ``id``.
    """
    sample = trusted.where("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(trusted_rows)
    marked = rows.join(F.broadcast(sample.withColumn("_trusted", F.lit(1))), "id", "left")
    # An outer explode: for an inner one a filter on the array's size would compute all n-grams twice.
    counts = marked.select("_trusted", F.explode_outer("_ngrams").alias("bucket")).groupBy("bucket").agg(F.count("_trusted").alias("trusted"), F.count(F.lit(1)).alias("raw"))
    found = counts.where("bucket is not null").select("bucket", "trusted", "raw", F.sum("trusted").over(_all()).alias("all_trusted"), F.sum("raw").over(_all()).alias("all_raw"))
    ratio = F.log((F.col("trusted") + 1) / (F.col("all_trusted") + buckets)) - F.log((F.col("raw") + 1) / (F.col("all_raw") + buckets))
    out = [0.0] * buckets
    for x in found.where("all_trusted > 0").select("bucket", ratio.alias("ratio")).collect():  # at most ``buckets`` rows
        out[x.bucket] = x.ratio
    return out


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # over at most ``buckets`` rows


def score(values: list[float]) -> Column:
    """The mean weight of a row's ``_ngrams``; null without any."""
    table = F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")  # folded to a constant
    total = F.aggregate("_ngrams", F.lit(0.0), lambda sum_, b: sum_ + F.get(table, b))
    return F.when(F.size("_ngrams") > 0, total / F.size("_ngrams"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, statistics, ``base_failed``, ``llr`` and ``kept`` for every row.

    ``labels`` has ``doc_id`` and ``quality``; rows of quality 1 are trusted. A text fails the base rules with under 50
    words, or if more than half of its words lie in windows of three words that it has more than once. ``kept`` is false
    for those, else true from ``threshold`` on; without any trusted text, or any token, ``llr`` is 0 or null and the base
    rules decide. A null text has no words; a very long one is scored whole. Null ids are kept and never trusted. Repeated
    rows are each scored and each count; a ratio that equals the threshold is kept. Other columns of either table, whatever
    their names, are ignored; empty tables give an empty result.
    """
    out = _judged(docs, labels, threshold, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that :func:`quality` keeps."""
    # The rows' numbers hold the filter back: moved below the steps, it would compute each of them again and again.
    docs = scratch.dealt(docs, id_col, text_col)
    return _judged(docs, labels, threshold, id_col, text_col, verdict=True).where("kept and _number >= 0").select("row.*")


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, id_col: str, text_col: str, verdict: bool = False) -> DataFrame:
    columns = {"row": scratch.boxed(docs), "id": scratch.column(docs, id_col).cast("long"), "text": F.coalesce(scratch.column(docs, text_col).cast("string"), F.lit(""))}
    rows = docs.select(*(v.alias(k) for k, v in columns.items()))
    trusted = labels.where(labels["quality"] == 1).select(labels["doc_id"].cast("long").alias("id"))
    values = weights(with_ngrams(rows.select("id", "text")).select("id", "_ngrams"), trusted)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = with_statistics(rows, verdict=verdict).withColumn("base_failed", failed)
    # For a verdict, what fails the base rules needs no score.
    out = with_ngrams(out, F.when(~F.col("base_failed"), F.col("text")) if verdict else "text")
    out = out.withColumns({"llr": score(values), "_number": F.monotonically_increasing_id()})
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(True)))
