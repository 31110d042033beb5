"""Metrics of predictions, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import persisted
from .ranks import in_ranges, quantiles

#: Metrics of each task, the first being its default; losses are better when smaller.
METRICS = {
    "classification": ("f1_macro", "accuracy", "balanced_accuracy", "f1_weighted", "roc_auc"),
    "regression": ("rmse", "mae", "r2", "mape", "rmsle"),
    "forecasting": ("smape", "mae", "rmse", "mape"),
}
LOSSES = ("rmse", "mae", "mape", "rmsle", "smape")
EPSILON = 2.220446049250313e-16


def valid_metric(task: str, metric: str | None) -> str:
    return metric if metric in METRICS[task] else METRICS[task][0]


def higher_is_better(metric: str) -> bool:
    return metric not in LOSSES


def target_met(metric: Column, score: Column, target: Column) -> Column:
    return F.when(metric.isin(*LOSSES), score <= target).otherwise(score >= target)


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n) for every pair of labels, zeros included."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select("y").union(counts.select("p")).distinct()
    pairs = labels.crossJoin(F.broadcast(labels.withColumnRenamed("y", "p")))
    return pairs.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1, support); undefined ones are 0."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    rows = counts.select(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).alias("called"), hit.alias("hits"))
    rows = rows.unionByName(counts.select(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("hits")))
    rows = rows.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "called", "hits")))
    share = lambda of: F.when(F.col(of) > 0, F.col("hits") / F.col(of)).otherwise(0.0)
    rows = rows.withColumns({"precision": share("called"), "recall": share("support")})
    both = F.col("precision") + F.col("recall")
    return rows.select("label", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"), "support")


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall over true classes), macro and weighted F1, in one row."""
    c = per_class(df, y, p)
    return c.agg(
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


#: Distinct scores up to which one task orders them.
FEW_SCORES = 1 << 19


def auc(df: DataFrame, positive: Column, score: Column, groups: Sequence[str] = (), buckets: int = 1024) -> DataFrame:
    """Tie-aware area under the ROC curve (``auc``), of each group. Distinct scores are counted first and prefix sums run
    inside ranges of scores, which hold about as many scores each, and whose totals are summed up in turn; so no task
    holds all of a group's scores."""
    counts = df.select(*groups, score.alias("_s"), positive.cast("long").alias("_y")).where("_s is not null and _y is not null")
    counts = counts.groupBy(*groups, "_s").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    counts = persisted(counts, "scores")
    # Few distinct scores need no ranges, and no pass that finds their bounds.
    counts = in_ranges(counts, "_s", "_bucket", buckets) if counts.count() > FEW_SCORES else counts.withColumn("_bucket", F.lit(0))
    totals = counts.groupBy(*groups, "_bucket").agg(F.sum("_neg").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(totals, [*groups, "_bucket"])
    won = F.sum(F.col("_pos") * (F.col("_offset") + F.col("_below") + F.col("_neg") / 2))
    return counts.groupBy(*groups).agg((won / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("auc"))


def auc_one_vs_rest(scores: DataFrame, y: str, label: str, score: str) -> DataFrame:
    """The unweighted mean of each label's AUC; ``scores`` has a row for each example and label."""
    each = auc(scores, F.col(y) == F.col(label), F.col(score), [label])
    return each.agg(F.avg("auc").alias("auc_ovr"))


def regression(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2, MAPE (a fraction), and RMSLE where no y is negative."""
    y_, p_ = F.col(y), F.col(p)
    error = p_ - y_
    logs = F.log1p(F.greatest(p_, F.lit(0.0))) - F.log1p(F.when(y_ >= 0, y_))
    return df.groupBy(*groups).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / F.nullif(F.var_pop(y_) * F.count(y_), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(error) / F.greatest(F.abs(y_), F.lit(EPSILON))).alias("mape"),
        F.when(F.min(y_) >= 0, F.sqrt(F.avg(logs * logs))).alias("rmsle"),
    )


def forecast_errors(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """sMAPE and MAPE in percent, MAE, RMSE, and the rows without a forecast, which count for nothing else."""
    y_, p_ = F.col(y), F.col(p)
    error, size = F.abs(p_ - y_), F.abs(y_) + F.abs(p_)
    return df.groupBy(*groups).agg(
        F.count(p_).alias("n_forecast"),
        F.count_if(p_.isNull()).alias("n_unforecast"),
        (100 * F.avg(F.when(size < 1e-12, 0.0).otherwise(2 * error / size))).alias("smape"),
        (100 * F.avg(error / F.greatest(F.abs(y_), F.lit(1e-8)))).alias("mape"),
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def reliability(df: DataFrame, y: Column, p: Column, bins: int = 10) -> DataFrame:
    """(bin, mean_predicted, observed, n) over equal bins of probability, closed on the right; empty ones are left out."""
    at = F.greatest(F.ceil(p * bins) - 1, F.lit(0))
    return df.groupBy(at.cast("long").alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed"), F.count(F.lit(1)).alias("n"))


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    """MAE, RMSE, R2, the largest absolute residual and five quantiles of prediction minus truth."""
    error = F.col(p) - F.col(y)
    own = df.select((error).alias("e"), F.col(y).alias("y"))
    fractions = (0.05, 0.25, 0.5, 0.75, 0.95)
    found = quantiles(own, "e", fractions)
    return own.agg(
        F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (1 - F.sum(F.col("e") * F.col("e")) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("r2"),
        F.max(F.abs("e")).alias("largest"),
        *(F.lit(v).cast("double").alias(f"q{int(100 * x):02d}") for x, v in zip(fractions, found, strict=True)),
    )
