"""Forecasting of many series, by position: ``sid, ts, y``. Lags and seasons count observations, never calendar steps."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import parts, step
from ..functions.text import composite_key
from ..sources.shared import persisted
from .ranks import numbered

WARM_UP = 13
ALPHA, BETA, GAMMA = 0.2, 0.05, 0.1


def _order():
    return Window.partitionBy("sid").orderBy("ts")


def to_series(df: DataFrame, time: Column, value: Column, keys: Iterable[Column]) -> DataFrame:
    """Long rows as series; rows without a usable time or value are dropped."""
    rows = df.select(composite_key(*keys).alias("sid"), time.try_cast("timestamp").alias("ts"), value.try_cast("double").alias("y"))
    return rows.where("ts is not null and y is not null and not isnan(y)")


def positioned(series: DataFrame) -> DataFrame:
    return series.withColumn("idx", (F.row_number().over(_order()) - 1).cast("long"))


def origin_features(series: DataFrame) -> DataFrame:
    """What is known at each position: lags, and means and deviations of the last 7 and 14. One sort serves all frames."""
    y = F.col("y")
    last = lambda k: _order().rowsBetween(1 - k, 0)
    first = F.first("y").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return positioned(series).withColumns(
        {
            "lag1": F.coalesce(F.lag("y", 1).over(_order()), y),
            "lag6": F.coalesce(F.lag("y", 6).over(_order()), first),
            "lag13": F.coalesce(F.lag("y", 13).over(_order()), first),
            "mean7": F.avg("y").over(last(7)),
            "mean14": F.avg("y").over(last(14)),
            "std7": F.stddev_pop("y").over(last(7)),
            "std14": F.stddev_pop("y").over(last(14)),
        }
    )


def leads(series: DataFrame, horizon: int) -> DataFrame:
    """(sid, idx, h, target): the value h steps on, for each h up to the horizon that has one."""
    rows = positioned(series).select("sid", "idx", *(F.lead("y", h).over(_order()).alias(f"y{h}") for h in range(1, horizon + 1)), *(F.lead("ts", h).over(_order()).alias(f"t{h}") for h in range(1, horizon + 1)))
    ahead = F.array(*(F.struct(F.lit(h).cast("long").alias("h"), F.col(f"y{h}").alias("target"), F.col(f"t{h}").alias("target_ts")) for h in range(1, horizon + 1)))
    return rows.select("sid", "idx", F.inline(ahead)).where("target is not null")


def series_codes(series: DataFrame) -> DataFrame:
    """(sid, code): numbers of the sorted series names."""
    return numbered(series.select("sid").distinct(), ["sid"])


def seasonal_index(idx: Column, h: Column, season: int) -> Column:
    """The newest position of the season's phase of ``idx + h`` that is not after ``idx``."""
    return (idx + h - season * F.ceil(h / season)).cast("long")


def seasonal_lag(rows: DataFrame, series: DataFrame, season: int) -> DataFrame:
    """Adds ``seasonal``: the value of the same phase, else the value at the origin (``y``)."""
    past = positioned(series).select("sid", F.col("idx").alias("_at"), F.col("y").alias("_past"))
    rows = rows.withColumn("_at", seasonal_index(F.col("idx"), F.col("h"), season))
    return rows.join(past, ["sid", "_at"], "left").withColumn("seasonal", F.coalesce("_past", "y")).drop("_at", "_past")


def training_set(series: DataFrame, horizon: int, season: int) -> DataFrame:
    """Origins from the warm-up on, with every step ahead, its features and the target date's calendar."""
    rows = origin_features(series).where(F.col("idx") >= WARM_UP).join(leads(series, horizon), ["sid", "idx"])
    return seasonal_lag(rows, series, season).withColumns(parts(F.col("target_ts")))


def rolling_origins(history: DataFrame, block: DataFrame, horizon: int) -> DataFrame:
    """The block's rows, in windows of ``horizon``: ``sid, ts, y, h, origin``. The origin is the position, in history and
    block together, of the last row before the window; it is -1 where there is none."""
    n = history.groupBy("sid").agg(F.count(F.lit(1)).alias("_n"))
    rows = positioned(block).join(n, "sid", "left")
    i, before = F.col("idx"), F.coalesce(F.col("_n"), F.lit(0))
    window = F.floor(i / horizon) * horizon
    return rows.select("sid", "ts", "y", (F.pmod(i, F.lit(horizon)) + 1).cast("long").alias("h"), (before + window - 1).cast("long").alias("origin"))


def naive_forecast(history: DataFrame, block: DataFrame, horizon: int, season: int) -> DataFrame:
    """(sid, ts, y, p): the newest value of the same phase known at each window's origin, else the last value; null without any."""
    whole = positioned(history.select("sid", "ts", "y").unionByName(block.select("sid", "ts", "y"))).select("sid", "idx", F.col("y").alias("_y"))
    rows = rolling_origins(history, block, horizon)
    rows = rows.withColumn("_at", seasonal_index(F.col("origin"), F.col("h"), season))
    phase = whole.select("sid", F.col("idx").alias("_at"), F.col("_y").alias("_phase"))
    last = whole.select("sid", F.col("idx").alias("origin"), F.col("_y").alias("_last"))
    return rows.join(phase, ["sid", "_at"], "left").join(last, ["sid", "origin"], "left").select("sid", "ts", "y", F.coalesce("_phase", "_last").alias("p"))


#: What the boosted forecaster learns from, besides the series itself.
BOOSTED_FEATURES = ("lag1", "lag6", "lag13", "mean7", "mean14", "std7", "std14", "seasonal", "h", "dow", "month")


def backtest_rows(history: DataFrame, block: DataFrame, horizon: int, season: int) -> DataFrame:
    """The block's rows by rolling origin, each with what is known at its origin: the features of :func:`training_set`, ``target`` and
    ``target_ts``. Rows whose origin lies in the warm-up are left out."""
    whole = history.select("sid", "ts", "y").unionByName(block.select("sid", "ts", "y"))
    rows = rolling_origins(history, block, horizon).select("sid", F.col("ts").alias("target_ts"), F.col("y").alias("target"), "h", F.col("origin").alias("idx"))
    rows = rows.where(F.col("idx") >= WARM_UP).join(origin_features(whole), ["sid", "idx"])
    return seasonal_lag(rows, whole, season).withColumns(parts(F.col("target_ts")))


def boosted_forecast(train: DataFrame, valid: DataFrame, block: DataFrame, horizon: int, season: int, params: dict | None = None) -> tuple[DataFrame, list[float]]:
    """(sid, ts, y, p) of the block's rows by one boosted model over all series and steps, and its error by round.

    Rounds are fitted on the training block; after each one the rolling-origin backtest of the validation block gives the mean absolute
    error, and the model stops at the round with the smallest. ``p`` is null where there is too little history for the features.
    """
    from .models import pipeline, staged

    # Months are levels: a pattern of months need not rise or fall with their numbers.
    levels = ["sid", "month"]
    names = [c for c in BOOSTED_FEATURES if c not in levels]
    # Rounds step by residuals (squared loss): those of Spark's absolute loss are a fixed share of the unit, as leaves are not set anew to
    # medians, so it gets no closer than that to series that vary little. The cut goes by the absolute error.
    unit = train.agg(F.stddev_pop("y")).first()[0] or 1.0
    shaped = lambda df, *more: persisted(df.select("sid", *more, (F.col("target") / F.lit(unit)).alias("label"), *(F.col(c).cast("double").alias(c) for c in BOOSTED_FEATURES)), "origins")
    own = {"lossType": "squared", "maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 10, "subsamplingRate": 0.8, "featureSubsetStrategy": "all"} | (params or {})
    learned = shaped(training_set(train, horizon, season))
    model, errors = staged(lambda rounds: pipeline(names, levels, "boosted", "regression", own | {"maxIter": rounds}), own["maxIter"], learned, shaped(backtest_rows(train, valid, horizon, season)), "absolute")
    known = train.select("sid", "ts", "y").unionByName(valid.select("sid", "ts", "y"))
    made = model.transform(shaped(backtest_rows(known, block, horizon, season), F.col("target_ts").alias("ts"))).select("sid", "ts", (F.col("prediction") * F.lit(unit)).alias("p"))
    errors = [e * unit for e in errors]
    return block.select("sid", "ts", "y").join(made, ["sid", "ts"], "left"), errors


#: Positions of a chunk of a long series are at least so many, and at least the square root of the longest series.
CHUNK = 4096
#: Equal ranges of time in which positions are counted first.
TIME_RANGES = 1024


def counted_positions(series: DataFrame) -> DataFrame:
    """Adds ``idx`` as :func:`positioned` does, but no task holds a whole series: rows are counted by range of time, then inside it."""
    at = F.unix_micros("ts")
    span = series.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    width = max(1, -(-((span.high or 0) - (span.low or 0) + 1) // TIME_RANGES))
    rows = series.withColumn("_range", F.floor((at - F.lit(span.low or 0)) / F.lit(width)))
    before = Window.partitionBy("sid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # TIME_RANGES rows of a series
    offsets = rows.groupBy("sid", "_range").agg(F.count(F.lit(1)).alias("_n")).select("sid", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("sid", "_range").orderBy("ts")) - 1
    return rows.withColumn("_inside", inside).join(offsets, ["sid", "_range"]).select(*series.columns, (F.col("_offset") + F.col("_inside")).cast("long").alias("idx"))


def _struct(level: Column, trend: Column, seasonal: Column, *more: Column) -> Column:
    return F.struct(level.alias("level"), trend.alias("trend"), seasonal.alias("seasonal"), *more)


def _step(state: Column, idx: Column, y: Column, season: int) -> tuple[Column, Column, Column]:
    """Level, trend and season after one more value."""
    phase = (idx % season).cast("int")
    level = ALPHA * (y - F.get(state["seasonal"], phase)) + (1 - ALPHA) * (state["level"] + state["trend"])
    trend = BETA * (level - state["level"]) + (1 - BETA) * state["trend"]
    seasonal = F.transform(state["seasonal"], lambda v, k: F.when(k == phase, GAMMA * (y - level) + (1 - GAMMA) * v).otherwise(v))
    return level, trend, seasonal


def season_matrix(season: int, steps: int) -> np.ndarray:
    """What ``steps`` values of zero make of (level, trend, season): as smoothing is linear, a chunk's values add the same to any state."""
    state, one = np.eye(season + 2), []
    for phase in range(season):
        level = ALPHA * -state[2 + phase] + (1 - ALPHA) * (state[0] + state[1])
        trend = BETA * (level - state[0]) + (1 - BETA) * state[1]
        state = state.copy()
        state[2 + phase] = GAMMA * -level + (1 - GAMMA) * state[2 + phase]
        state[0], state[1] = level, trend
        one = state
    return np.linalg.matrix_power(one, steps // season)


def smoothing_states(series: DataFrame, season: int, chunk: int | None = None) -> DataFrame:
    """(sid, origin, level, trend, seasonal): the state after position ``origin`` of additive smoothing, at the rows before those with
    ``opens``, of rows (sid, idx, y, opens). It begins with the second season's last value; there is none before.

    A step is an affine map of the state, and so is a chunk of steps. Chunks of a series are folded apart, from a state of zero; their
    maps are composed in order, which gives each chunk the state that it begins with; then chunks are folded once more. A series of n
    values is n / chunk chunks, and by default neither is much more than the square root of the longest.
    """
    begin = 2 * season
    if chunk is None:
        longest = series.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        chunk = max(CHUNK, math.isqrt(longest))
    chunk = -(-chunk // season) * season
    in_order = lambda *cols: F.array_sort(F.collect_list(F.struct("idx", *cols)))
    early = series.where(F.col("idx") < begin).groupBy("sid").agg(in_order("y").alias("v")).where(F.size("v") == begin).select("sid", F.transform("v", lambda x: x["y"]).alias("v"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    one, two = F.slice("v", 1, season), F.slice("v", season + 1, season)
    first = early.select("sid", _struct(total(two) / season, (total(two) - total(one)) / season**2, F.zip_with(one, two, lambda a, b: (a + b) / 2 - total(F.col("v")) / begin)).alias("state"))
    late = series.where(F.col("idx") >= begin).withColumn("chunk", F.floor((F.col("idx") - begin) / chunk))
    chunks = late.groupBy("sid", "chunk").agg(in_order("y", "opens").alias("rows"))
    none = F.array().cast("array<struct<origin:bigint,level:double,trend:double,seasonal:array<double>>>")

    def folded(state: Column, keep: bool) -> Column:
        start = _struct(state["level"], state["trend"], state["seasonal"], none.alias("out"))

        def merge(acc: Column, x: Column) -> Column:
            own = F.struct((x["idx"] - 1).alias("origin"), acc["level"].alias("level"), acc["trend"].alias("trend"), acc["seasonal"].alias("seasonal"))
            out = F.when(x["opens"], F.concat(acc["out"], F.array(own))).otherwise(acc["out"]) if keep else acc["out"]
            return _struct(*_step(acc, x["idx"], x["y"], season), out.alias("out"))

        return F.aggregate("rows", start, merge)

    if longest_chunk(late) == 0:  # no series has a second chunk
        starts = first.withColumn("chunk", F.lit(0).cast("long"))
    else:
        zero = F.struct(F.lit(0.0).alias("level"), F.lit(0.0).alias("trend"), F.array_repeat(F.lit(0.0), season).alias("seasonal"))
        added = chunks.where(F.size("rows") == chunk).withColumn("b", folded(zero, False)).select("sid", "chunk", F.concat(F.array("b.level", "b.trend"), "b.seasonal").alias("b"))
        matrix = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in season_matrix(season, chunk)))
        times = lambda s: F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
        maps = added.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("chunk", "b"))).alias("maps"))
        vector = F.concat(F.array("state.level", "state.trend"), "state.seasonal")
        scanned = F.aggregate(
            F.coalesce("maps", F.array().cast("array<struct<chunk:bigint,b:array<double>>>")), F.array(vector),
            lambda acc, m: F.concat(acc, F.array(F.zip_with(times(F.element_at(acc, -1)), m["b"], lambda a, b: a + b))),
        )
        found = first.join(maps, "sid", "left").select("sid", F.posexplode(scanned).alias("chunk", "s"))
        starts = found.select("sid", F.col("chunk").cast("long").alias("chunk"), F.struct(F.col("s")[0].alias("level"), F.col("s")[1].alias("trend"), F.slice("s", 3, season).alias("seasonal")).alias("state"))
    out = chunks.where(F.exists("rows", lambda x: x["opens"])).join(starts, ["sid", "chunk"])
    return out.select("sid", F.inline(folded(F.col("state"), True)["out"]))


def longest_chunk(late: DataFrame) -> int:
    return late.agg(F.max("chunk")).first()[0] or 0


def smoothing_forecast(history: DataFrame, block: DataFrame, horizon: int, season: int, chunk: int | None = None) -> DataFrame:
    """(sid, ts, y, p) by additive exponential smoothing. Nothing after an origin is used: one with under two seasons behind it
    repeats its last value, and without any there is no forecast."""
    n = history.groupBy("sid").agg(F.count(F.lit(1)).alias("_n"))
    past = counted_positions(history.select("sid", "ts", "y")).select("sid", "idx", "y", F.lit(False).alias("opens"))
    rows = counted_positions(block.select("sid", "ts", "y")).join(n, "sid", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    window = F.floor(F.col("idx") / horizon) * horizon
    rows = rows.select("sid", "ts", "y", (F.col("idx") % horizon + 1).alias("h"), (F.col("_n") + window - 1).cast("long").alias("origin"), (F.col("_n") + F.col("idx")).alias("idx"))
    rows = persisted(rows, "block-rows")
    series = persisted(past.unionByName(rows.select("sid", "idx", "y", (F.col("h") == 1).alias("opens"))), "positions")
    states = smoothing_states(series, season, chunk)
    last = series.select("sid", F.col("idx").alias("origin"), F.col("y").alias("_last")).where(F.col("origin") < 2 * season - 1)
    made = F.col("level") + F.col("h") * F.col("trend") + F.get("seasonal", ((F.col("origin") + F.col("h")) % season).cast("int"))
    return rows.join(states, ["sid", "origin"], "left").join(last, ["sid", "origin"], "left").select("sid", "ts", "y", F.coalesce(made, "_last").alias("p"))


def serving_state(series: DataFrame, season: int) -> DataFrame:
    """(sid, last_ts, values): the newest values that a forecast of any horizon within a season may need."""
    keep = max(2 * season, 14 + season, 28)
    newest = Window.partitionBy("sid").orderBy(F.desc("ts"))
    rows = series.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= keep)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda x: x["y"])
    return rows.groupBy("sid").agg(F.max("ts").alias("last_ts"), ordered.alias("values"))


def forecast(state: DataFrame, requests: DataFrame, horizon: int, season: int, frequency: str) -> DataFrame:
    """(sid, h, ts, p) past the end, for requests (sid, h). Unknown series and steps outside the horizon are errors."""
    bad = requests.where(~F.col("h").between(1, horizon)).unionByName(requests.join(state, "sid", "left_anti")).limit(1).collect()
    if bad:
        raise ValueError(f"cannot forecast series {bad[0]['sid']} {bad[0]['h']} steps on")
    n = F.size("values")
    at = n - 1 + F.col("h") - season * F.ceil(F.col("h") / season)
    value = F.coalesce(F.when(at >= 0, F.get("values", at.cast("int"))), F.element_at("values", -1))
    return requests.join(state, "sid").select("sid", "h", step(F.col("last_ts"), F.col("h").cast("int"), frequency).alias("ts"), value.alias("p"))
