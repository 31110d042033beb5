"""Comparison of predicted and observed scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import LOSSES

#: Rows of a task that compares whole groups.
TASK_ROWS = 1 << 19


def success_rate(success: Column, target_met: Column) -> Column:
    return F.when(~success, 0.0).when(target_met, 1.0).otherwise(0.5)


def normalized(metric: Column, score: Column, rmsle: Column | None = None) -> Column:
    """Scores in [0, 1]: losses as 1 / (1 + s), RMSLE in place of scale-bound losses where it is known; missing ones 0."""
    if rmsle is not None:
        swap = metric.isin("rmse", "mae", "mape") & rmsle.isNotNull()
        metric, score = F.when(swap, "rmsle").otherwise(metric), F.when(swap, rmsle).otherwise(score)
    missing = score.isNull() | metric.isNull() | F.isnan(score)
    loss = 1 / (1 + F.greatest(score, F.lit(0.0)))
    return F.when(missing, 0.0).when(metric.isin(*LOSSES), loss).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def combined(success: Column, performance: Column) -> Column:
    return 0.5 * success + 0.5 * performance


def dealt(df: DataFrame, groups: Sequence[str], rows: int | None = None) -> DataFrame:
    """The rows by group, in as many tasks as keep each to about TASK_ROWS of them, so that a task's memory does not grow with the table. What
    is then grouped or ranked by at least ``groups`` needs no other shuffle. ``rows`` is how many there are, if known."""
    rows = df.count() if rows is None else rows
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *groups)


def calibration(df: DataFrame, groups: Sequence[str], plan: str, predicted: str, observed: str, fidelity: str | None = None, bounded: Column | None = None) -> DataFrame:
    """Of each group at its lowest fidelity: Spearman's rho (three plans or more), whether the plan predicted best is the
    observed best (two or more; the lowest plan on ties), and the mean absolute error where the metric is bounded.

    Rows that :func:`dealt` has spread by group are not shuffled again."""
    rows = df.where(F.col(predicted).isNotNull() & F.col(observed).isNotNull())
    if fidelity:
        lowest = F.min(fidelity).over(Window.partitionBy(*groups))
        rows = rows.withColumn("_low", lowest).where(F.col(fidelity) == F.col("_low"))

    def rank(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, c))
        return F.rank().over(Window.partitionBy(*groups).orderBy(c)) + (ties - 1) / 2

    rows = rows.withColumns({"_p": rank(predicted), "_o": rank(observed)})
    best = lambda c: F.max_by(plan, F.struct(F.col(c), -F.col(plan)))
    error = F.abs(F.col(predicted) - F.col(observed))
    varied = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("_p") > 0) & (F.stddev_pop("_o") > 0)
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(varied, F.corr("_p", "_o")).alias("spearman"),
        F.when(F.count(F.lit(1)) >= 2, (best(predicted) == best(observed)).cast("double")).alias("top1_hit"),
        F.avg(error if bounded is None else F.when(bounded, error)).alias("mae"),
    )
