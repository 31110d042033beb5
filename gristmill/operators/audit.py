"""Audit of a table before learning: leakage, identifiers, quality. Findings share one schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.text import plain_name
from .metrics import auc
from .ranks import ranked
from .relational import null_safe_members

FINDING = "check string, severity string, name string, action string, value double"
#: Name parts that mark identifiers, and affixes that mark copies of a target.
ID_PATTERN = r"(?i)(^|_)(id|uuid|guid|key|index|hash|token|code|pk)($|_)"
TARGET_AFFIXES = ("pred", "target", "true", "actual", "outcome", "label", "result", "post", "copy", "leak", "after")
POWER = 0.98


def _findings(rows: DataFrame, check: str, severity: Column | str, action: str, value: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(F.lit(check).alias("check"), severity.alias("severity"), "name", F.lit(action).alias("action"), value.cast("double").alias("value"))


def identifiers(profile: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """Columns that name rows. Measured numbers are near-unique by nature and are left alone."""
    measured = (F.col("kind") == "numeric") & ~F.col("dtype").isin("tinyint", "smallint", "int", "bigint")
    named = F.col("name").rlike(ID_PATTERN) & (F.col("unique_share") >= 0.9)
    unique = (F.col("unique_share") > 0.99) & (F.col("n_rows") > 100) & F.col("kind").isin("identifier", "categorical")
    rows = profile.where(~F.col("name").isin(*protected) & ~measured & (named | unique))
    return _findings(rows, "id_leakage", "high", "drop", F.round("unique_share", 4))


def mirrors_target(target: str) -> Column:
    """Whether a column's name is the target's with something suspicious or little else."""
    t = "".join(c for c in target.strip().lower() if c.isascii() and c.isalnum())
    raw = F.lower(F.trim("name"))
    plain = plain_name(F.col("name"))
    inside = plain.contains(t) | (F.lit(t).contains(plain))
    affix = reduce(lambda a, b: a | b, (raw.contains(x) for x in TARGET_AFFIXES))
    near = F.char_length(plain) - F.lit(len(t)) <= 4
    return (raw == F.lit(target.strip().lower())) | (F.lit(len(t) >= 3) & inside & (affix | near))


def target_names(profile: DataFrame, target: str, protected: Sequence[str] = ()) -> DataFrame:
    rows = profile.where(~F.col("name").isin(target, *protected) & mirrors_target(target))
    return _findings(rows, "target_name_leakage", "high", "drop", F.lit(1.0))


def constants(profile: DataFrame) -> DataFrame:
    return _findings(profile.where("n_unique <= 1"), "constant", "medium", "drop", F.col("n_unique"))


def near_constants(profile: DataFrame, top: DataFrame) -> DataFrame:
    """``top`` has (name, share) of the most frequent values."""
    rows = profile.join(top.groupBy("name").agg(F.max("share").alias("share")), "name")
    return _findings(rows.where("share >= 0.995 and n_rows > 200 and n_unique > 1"), "near_constant", "low", "flag", F.col("share"))


def missingness(profile: DataFrame) -> DataFrame:
    share = F.col("n_missing") / F.greatest("n_rows", F.lit(1))
    drop = _findings(profile.where(share >= 0.8), "missing", "medium", "drop", F.round(share, 4))
    return drop.unionByName(_findings(profile.where((share >= 0.5) & (share < 0.8)), "missing", "low", "flag", F.round(share, 4)))


def high_cardinality(profile: DataFrame) -> DataFrame:
    rows = profile.where("kind = 'categorical' and n_unique > 200 and unique_share > 0.3")
    return _findings(rows, "high_cardinality", "low", "flag", F.col("n_unique"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """The smallest class's share, over all classes."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg((F.min("n") / F.sum("n")).alias("share"), F.count(F.lit(1)).alias("k")).where("k >= 2 and share < 0.05").withColumn("name", F.lit(target))
    return _findings(one, "imbalance", F.when(F.col("share") < 0.01, "high").otherwise("medium"), "flag", F.round("share", 4))


def categorical_power(df: DataFrame, key: str, names: Sequence[str], target: str, task: str) -> DataFrame:
    """(name, power): how well each column alone tells the target on a held-out fifth, through a lookup fitted on the rest.

    ``binary`` (0/1 target): AUC of the mean target; ``multiclass``: accuracy of the most frequent class;
    ``regression``: R2 of the mean. All columns are scored in one job over (name, value, y) rows.
    """
    parts = ranked(df, uniform(F.col(key), "power"), [F.col(key)], name="_rank")
    n = df.count()
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in names))
    long = parts.where(F.col(target).isNotNull()).select((F.col("_rank") + 1 > F.lit(n * 0.8)).alias("held"), F.col(target).alias("y"), F.inline(cells))
    fit, held = long.where("not held"), long.where("held")
    if task == "multiclass":
        counts = fit.groupBy("name", "value", "y").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("name", "value").agg(F.max_by("y", F.struct("n", "y")).alias("p"))
        prior = fit.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("y", F.struct("n", "y")).alias("prior"))
        rows = held.join(best, ["name", "value"], "left").crossJoin(F.broadcast(prior))
        return rows.groupBy("name").agg(F.avg((F.coalesce("p", "prior") == F.col("y")).cast("double")).alias("power"))
    means = fit.groupBy("name", "value").agg(F.avg("y").alias("p"))
    prior = fit.agg(F.avg("y").alias("prior"))
    rows = held.join(means, ["name", "value"], "left").crossJoin(F.broadcast(prior)).select("name", "y", F.coalesce("p", "prior").alias("p"))
    if task == "binary":
        return auc(rows, F.col("y") == 1, F.col("p"), ["name"]).select("name", F.greatest("auc", 1 - F.col("auc")).alias("power"))
    error = F.col("p") - F.col("y")
    return rows.groupBy("name").agg((1 - F.sum(error * error) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("power"))


def _depth_two(x: np.ndarray, y: np.ndarray) -> list:
    """A regression tree of depth two over one feature: [threshold, left, right] or a mean."""

    def grow(x, y, depth):
        if depth == 0 or len(y) < 4:
            return float(y.mean())
        order = np.argsort(x, kind="stable")
        xs, ys = x[order], y[order]
        total, n = ys.sum(), len(ys)
        left = np.cumsum(ys)[:-1]
        i = np.arange(1, n)
        gain = left**2 / i + (total - left) ** 2 / (n - i)
        gain[xs[1:] == xs[:-1]] = -np.inf
        k = int(np.argmax(gain))
        if not np.isfinite(gain[k]):
            return float(y.mean())
        cut = (xs[k] + xs[k + 1]) / 2
        return [cut, grow(xs[: k + 1], ys[: k + 1], depth - 1), grow(xs[k + 1 :], ys[k + 1 :], depth - 1)]

    return grow(x, y, 2)


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    return np.where(x <= tree[0], _predict(tree[1], x), _predict(tree[2], x))


def numeric_power(df: DataFrame, key: str, names: Sequence[str], target: str, sample: int = 10_000, rows: int | None = None) -> DataFrame:
    """(name, power): R2 on a held-out fifth of a depth-two tree over each numeric column alone, on a nested sample.

    A 0/1 target gives the share of variance told; each column's sample, of bounded size, is one group.
    """
    rows = df.count() if rows is None else rows
    draw = uniform(F.col(key), "numeric-power")
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in names))
    small = df.where(draw < F.lit(min(1.0, sample / max(1, rows)))).where(F.col(target).isNotNull())
    long = small.select(F.col(key).cast("string").alias("k"), F.col(target).cast("double").alias("y"), F.inline(cells))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = np.nan_to_num(pdf["x"].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
        y = pdf["y"].to_numpy(float)
        held = np.random.default_rng(0).permutation(len(y)) < len(y) // 5
        power = float("nan")
        if len(y) >= 50 and y[held].var() > 0:
            p = _predict(_depth_two(x[~held], y[~held]), x[held])
            power = 1 - ((p - y[held]) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum()
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "power": [power]})

    return long.groupBy("name").applyInPandas(fit, "name string, power double")


def power_findings(power: DataFrame, threshold: float = POWER) -> DataFrame:
    return _findings(power.where(F.col("power") >= threshold), "predictive_leakage", "critical", "drop", F.round("power", 4))


def duplicates(df: DataFrame, split: str, columns: Sequence[str], train: int = 0, test: int = 2) -> DataFrame:
    """(n_test, n_duplicate, percent, severity): test rows whose columns all equal a train row's."""
    held = df.where(F.col(split) == test)
    found = null_safe_members(held, df.where(F.col(split) == train), columns).agg(F.count(F.lit(1)).alias("n_duplicate"))
    one = held.agg(F.count(F.lit(1)).alias("n_test")).crossJoin(F.broadcast(found))
    percent = F.when(F.col("n_test") > 0, 100 * F.col("n_duplicate") / F.col("n_test")).otherwise(0.0)
    return one.withColumn("percent", percent).withColumn("severity", F.when(percent >= 10, "high").when(percent >= 1, "medium").otherwise("low"))


def roll_up(findings: DataFrame, earlier: Iterable[str] = ()) -> DataFrame:
    """(name, reason, leakage): columns to drop that are not dropped yet, with one reason each, worst first."""
    order = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("severity"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(order, "check"))
    rows = findings.where(F.col("action") == "drop").where(~F.col("name").isin(*earlier)).withColumn("_rank", rank).where("_rank = 1")
    leak = F.col("check").contains("leakage") & F.col("severity").isin("critical", "high")
    return rows.select("name", F.col("check").alias("reason"), leak.alias("leakage"))
