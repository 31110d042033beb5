"""What describes a table, and summaries of past runs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weight of each meta-feature.
WEIGHTS = {
    "log_rows": 0.6, "log_cols": 0.6, "frac_numeric": 1.0, "frac_categorical": 1.0, "frac_text": 1.5,
    "frac_missing": 0.8, "log_classes": 0.8, "log_imbalance": 0.8,
}


def meta_features(profile: DataFrame, target: str, top: DataFrame | None = None, classes: bool = True) -> DataFrame:
    """The eight numbers that describe a table and its target, in one row."""
    own = F.col("name") != target
    kind = lambda *kinds: F.count_if(own & F.col("kind").isin(*kinds)) / F.greatest(F.count_if(own), F.lit(1))
    n_rows, n_cols = F.max("n_rows"), F.count(F.lit(1))
    n_classes = F.max(F.when(~own, F.col("n_unique"))) if classes else F.lit(0)
    out = profile.agg(
        F.log10(F.greatest(n_rows, F.lit(1))).alias("log_rows"),
        F.log10(n_cols).alias("log_cols"),
        kind("numeric").alias("frac_numeric"),
        kind("categorical", "boolean").alias("frac_categorical"),
        kind("text").alias("frac_text"),
        (F.sum("n_missing") / F.greatest(n_rows * n_cols, F.lit(1))).alias("frac_missing"),
        F.when(n_classes > 1, F.log2(n_classes)).otherwise(0.0).alias("log_classes"),
    )
    if top is None:
        return out.withColumn("log_imbalance", F.lit(0.0))
    ratio = top.where(F.col("name") == target).agg(F.coalesce(F.log10(F.max("share") / F.min("share")), F.lit(0.0)).alias("log_imbalance"))
    return out.crossJoin(F.broadcast(ratio))


def weighted_distance(a: Mapping[str, Column], b: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    terms = [F.lit(w) * (a[k] - b[k]) * (a[k] - b[k]) for k, w in weights.items()]
    return F.sqrt(reduce(lambda x, y: x + y, terms))


def fingerprint(profile: DataFrame) -> DataFrame:
    """The first 16 hex digits of the SHA-1 of all names, types and the row count."""
    columns = F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "dtype"))), lambda c: F.concat_ws(":", c["name"], c["dtype"]))
    text = F.concat(F.array_join(columns, "|"), F.lit("#"), F.max("n_rows").cast("string"))
    return profile.agg(F.substring(F.sha1(text), 1, 16).alias("fingerprint"))


def run_summary(rows: DataFrame, key: str, name: str, score: str, k: int = 5) -> DataFrame:
    """Of each key: its k best names by score as one text, and the names that have no score."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(score), name))
    ranked = rows.withColumn("_rank", rank)
    best = F.array_sort(F.collect_list(F.when((F.col("_rank") <= k) & F.col(score).isNotNull(), F.struct("_rank", F.col(name).cast("string").alias("name")))))
    failed = F.array_sort(F.collect_set(F.when(F.col(score).isNull(), F.col(name).cast("string"))))
    return ranked.groupBy(key).agg(F.array_join(F.transform(best, lambda x: x["name"]), ", ").alias("best"), F.array_join(failed, ", ").alias("failed"))


def best_experience(rows: DataFrame, key: str, name: str, score: str, tie: str) -> DataFrame:
    """Of each key: the name of its best score, the later ``tie`` first among equal ones, and how many rows it has."""
    return rows.groupBy(key).agg(F.max_by(name, F.struct(score, tie)).alias("best"), F.count(F.lit(1)).alias("n"))


def recent_fixes(rows: DataFrame, key: str, time: str, is_fix: Column, k: int, carry: str, but: int | None = None) -> DataFrame:
    """(key, carry) of the rows that are fixes, for the k keys seen last; ``but`` is a key left out."""
    others = rows if but is None else rows.where(F.col(key) != but)
    last = others.groupBy(key).agg(F.max(time).alias("_last")).orderBy(F.desc("_last"), key).limit(k)
    return rows.where(is_fix).join(F.broadcast(last.select(key)), key, "left_semi").select(key, carry)  # k rows
