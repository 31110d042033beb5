"""Frequencies, seasons and steps of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many observations make a season.
SEASONS = {"1min": 60, "H": 24, "D": 7, "B": 5, "W": 52, "M": 12, "Q": 4}


def season_length(frequency: str | None) -> int:
    return SEASONS.get(frequency or "", 1)


def frequency(seconds: Column) -> Column:
    """The frequency whose band the median step in seconds lies in; null outside all bands."""
    day = 86400
    return (
        F.when(seconds.between(30, 90), "1min")
        .when(seconds.between(1800, 5400), "H")
        .when(seconds.between(0.5 * day, 1.5 * day), "D")
        .when(seconds.between(5 * day, 9 * day), "W")
        .when(seconds.between(25 * day, 35 * day), "M")
    )


def calendar_frequency(series: DataFrame, keys: Sequence[str], time: str, steps: DataFrame) -> DataFrame:
    """(keys, frequency) of series, from their days where the step alone does not tell: ``steps`` has (keys, median step ``m`` in seconds).

    One aggregate takes each series' residues as bits: its weekdays, its months by three, and whether all its times are midnights, firsts or
    lasts of a month. Daily steps without a Saturday or Sunday are business days (``B``), steps of about three months on firsts or
    lasts of months of one residue are quarters (``Q``), and months (``M``) and weeks (``W``) need their own anchor: a first or last day, one
    weekday. What has no anchor has no frequency; hours and minutes go by their step.
    """
    t, day = F.col(time), 86400
    bit = lambda n: F.bit_or(F.call_function("shiftleft", F.lit(1), n))
    facts = series.where(t.isNotNull()).groupBy(*keys).agg(
        bit(F.weekday(t)).alias("_weekdays"), bit(F.month(t) % 3).alias("_residues"), F.every(t == F.date_trunc("day", t)).alias("_midnight"),
        (F.every(F.dayofmonth(t) == 1) | F.every(F.to_date(t) == F.last_day(t))).alias("_anchored"), F.countDistinct(F.to_date(t)).alias("_days"),
    )
    m = F.col("m")
    one = lambda c: F.bit_count(c) == 1
    business = m.between(0.5 * day, 1.5 * day) & (F.col("_weekdays").bitwiseAND(F.lit(0b1100000)) == 0) & (F.bit_count("_weekdays") == 5) & (F.col("_days") > 5)
    found = (
        F.when(~F.col("_midnight") | (m < 0.5 * day), frequency(m))
        .when(business, "B")
        .when(m.between(0.5 * day, 1.5 * day), "D")
        .when(m.between(5 * day, 9 * day) & one("_weekdays"), "W")
        .when(m.between(25 * day, 35 * day) & F.col("_anchored"), "M")
        .when(m.between(85 * day, 95 * day) & F.col("_anchored") & one("_residues"), "Q")
    )
    joined = facts.join(steps.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "m"), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return joined.select(*keys, found.alias("frequency"))


def step(ts: Column, n: Column, frequency: str) -> Column:
    """``n`` steps after a timestamp. Weeks end on Sundays and months begin on their first day: the first step goes to
    the next such day, however near."""
    if frequency == "1min":
        return ts + F.make_dt_interval(mins=n)
    if frequency == "H":
        return ts + F.make_dt_interval(hours=n)
    if frequency == "D":
        return ts + F.make_dt_interval(days=n)
    if frequency == "W":
        return F.next_day(ts, "SUN").cast("timestamp") + F.make_dt_interval(days=7 * (n - 1))
    if frequency == "M":
        return F.add_months(F.trunc(ts, "month"), n).cast("timestamp")
    raise ValueError(f"unknown frequency {frequency}")


def parts(ts: Column) -> dict[str, Column]:
    """Day of week (Monday 0), month, day of month, weekend flag."""
    weekday = F.weekday(ts)
    return {"dow": weekday, "month": F.month(ts), "dom": F.dayofmonth(ts), "weekend": (weekday >= 5).cast("int")}
