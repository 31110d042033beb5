"""Choice among plans by measuring them on growing nested samples."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .models import ROW_LIMITS

OBSERVATION = "plan string, family string, rung int, fidelity_rows long, score double, seconds double, error string, final boolean"
FULL_SHARE = 0.99


def schedule(n_train: int, n_plans: int, min_rows: int = 20_000, growth: int = 4, eta: int = 2) -> list[int]:
    """The sample sizes of the rungs: until one plan is left or all rows are used."""
    out, rows, plans = [], min_rows, n_plans
    while True:
        out.append(min(rows, n_train))
        plans = math.ceil(plans / eta)
        if plans <= 1 or rows >= n_train:
            return out
        rows *= growth


def survivors(n: int, eta: int = 2) -> int:
    return math.ceil(n / eta)


def ranking(higher: bool) -> list[Column]:
    """Furthest rung, then those that worked, then the score."""
    return [F.desc("rung"), F.col("error").isNotNull(), F.desc_nulls_last("score") if higher else F.asc_nulls_last("score"), F.col("plan")]


def leaderboard(observations: DataFrame, higher: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Each plan's last observation, with its place."""
    last = F.row_number().over(Window.partitionBy(*keys, "plan").orderBy(F.desc("rung")))
    rows = observations.withColumn("_last", last).where("_last = 1").drop("_last")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*ranking(higher))))


def by_prediction(plans: DataFrame, limit_seconds: float, higher: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Plans within the time limit first, then the better prediction, then the faster."""
    order = [F.col("seconds") > limit_seconds, F.desc_nulls_last("score") if higher else F.asc_nulls_last("score"), F.col("seconds"), F.col("plan")]
    return plans.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_attempt(attempts: DataFrame, key: str, higher: bool = True) -> DataFrame:
    """The attempt with the best validation score; test scores are never looked at."""
    order = F.col("valid_score") if higher else -F.col("valid_score")
    return attempts.groupBy(key).agg(F.max_by("attempt", F.struct(order, -F.col("attempt"))).alias("attempt"), (F.max("valid_score") if higher else F.min("valid_score")).alias("valid_score"))


def outcome_issues(results: DataFrame, floor: float, higher: bool, seconds: float) -> DataFrame:
    """(attempt, issue): no score, no better than the naive floor, target missed, over time."""
    better = F.col("score") > floor if higher else F.col("score") < floor
    met = F.col("score") >= F.col("target") if higher else F.col("score") <= F.col("target")
    tests = {"no_score": F.col("score").isNull() | F.isnan("score"), "not_above_floor": ~better, "target_missed": F.col("target").isNotNull() & ~met, "over_time": F.col("seconds") > seconds}
    found = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in tests.items())))
    return results.select("attempt", F.explode(found).alias("issue"))


def successive_halving(
    spark: SparkSession,
    plans: Sequence[tuple[str, str]],
    n_train: int,
    fit_score: Callable[[str, int], float | tuple[float, int]],
    higher: bool = True,
    min_rows: int = 20_000,
    growth: int = 4,
    eta: int = 2,
    seconds: float = math.inf,
    clock: Callable[[], float] = time.monotonic,
) -> tuple[str, DataFrame]:
    """The chosen plan and the table of OBSERVATION.

    ``plans`` are (plan, family); ``fit_score(plan, rows)`` fits on the nested sample of so many training rows, scores on
    validation, and returns the score, or the score and how many rows it really fitted on. Families over their row limit are left out where the final fit is too large for them. A rung is not
    begun when the mean time so far, grown with the rows, would not fit in what is left. The last row is the final fit,
    which must use nearly all training rows.
    """
    began = clock()
    alive = [(p, f) for p, f in plans if n_train <= ROW_LIMITS.get(f, n_train)]
    if not alive:
        raise ValueError("no plan can take this many rows")
    rungs, rows = schedule(n_train, len(alive), min_rows, growth, eta), []
    mean = 0.0
    for rung, size in enumerate(rungs):
        if rung and mean * (size / rungs[rung - 1]) * len(alive) > seconds - (clock() - began):
            break
        scored, took = [], []
        for plan, family in alive:
            t, score, error = clock(), None, None
            try:
                score, _ = _scored(fit_score(plan, size), size)
            except Exception as e:  # a plan that fails ranks last; the error is kept
                error = f"{type(e).__name__}: {e}"[:200]
            took.append(clock() - t)
            rows.append((plan, family, rung, size, score, took[-1], error, False))
            scored.append((error is not None, -score if higher and score is not None else score if score is not None else math.inf, plan, family))
        mean = sum(took) / len(took)
        alive = [(p, f) for _, _, p, f in sorted(scored)][: survivors(len(alive), eta)]
        if len(alive) == 1:
            break
    plan, family = alive[0]
    t = clock()
    score, used = _scored(fit_score(plan, n_train), n_train)
    rows.append((plan, family, len(rungs), require_full(used, n_train), score, clock() - t, None, True))
    return plan, spark.createDataFrame(rows, OBSERVATION)


def _scored(found: float | tuple[float, int], size: int) -> tuple[float, int]:
    """A score, and the rows of its fit; a bare score is taken at its word."""
    score, used = found if isinstance(found, tuple) else (found, size)
    return float(score), int(used)


def require_full(used: int, n_train: int) -> int:
    if used < FULL_SHARE * n_train:
        raise ValueError(f"the final fit used {used} of {n_train} training rows")
    return used
