"""Analytics over an append-only log of many runs: ``run_id, seq, ts, stage, payload`` (JSON)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import error_signature


def as_log(events: DataFrame) -> DataFrame:
    """Any table of ``event_id, ts, user_id, event_type, props`` as a log; events are numbered per run from 1."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(F.col("user_id").cast("string").alias("run_id"), seq.alias("seq"), "ts", F.col("event_type").alias("stage"), F.col("props").alias("payload"))


def stage_spans(log: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Of each run and stage: first and last seen, and its end: the first start of a later stage, else last seen."""
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage")).cast("int")
    spans = log.where(F.col("stage").isin(*stages)).groupBy("run_id", "stage").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_events"))
    later = Window.partitionBy("run_id").orderBy("stage_no").rowsBetween(1, Window.unboundedFollowing)
    spans = spans.withColumn("stage_no", order).withColumn("next_start", F.min("first_seq").over(later))
    return spans.select("run_id", "stage", "first_seq", "last_seq", F.coalesce("next_start", "last_seq").alias("end_seq"), "n_events", F.col("next_start").isNotNull().alias("done"))


def calls(log: DataFrame, key: str, amount: str) -> DataFrame:
    """Calls of each run and stage: how many, how many whose payload has ``key``, and the sum of ``amount`` in payloads."""
    value = F.get_json_object("payload", f"$.{amount}").try_cast("double")
    return log.groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count(F.get_json_object("payload", f"$.{key}")).alias("with_key"), F.coalesce(F.sum(value), F.lit(0.0)).alias("amount")
    )


def job_spans(log: DataFrame, key: Column) -> DataFrame:
    """Jobs by a key made of each event: first and last event and their number."""
    return log.withColumn("job", key).groupBy("run_id", "job").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_events"))


def samples(log: DataFrame, stage: str, field: str) -> DataFrame:
    """A payload's number over time, for the events of one stage that have it."""
    value = F.get_json_object("payload", f"$.{field}").try_cast("double")
    return log.where(F.col("stage") == stage).select("run_id", "seq", value.alias("value")).where("value is not null")


def latest_payload(log: DataFrame, key: str) -> DataFrame:
    """Of each run and stage, the payload of the last event that has the key."""
    return log.where(F.get_json_object("payload", f"$.{key}").isNotNull()).groupBy("run_id", "stage").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))


def latest_round(log: DataFrame, start: str) -> DataFrame:
    """The events of each run from its last ``start`` event on; all of them if it has none."""
    begins = log.where(F.col("stage") == start).groupBy("run_id").agg(F.max("seq").alias("_begin"))
    return log.join(begins, "run_id", "left").where(F.col("_begin").isNull() | (F.col("seq") >= F.col("_begin"))).drop("_begin")


def replay(log: DataFrame, after: int) -> DataFrame:
    return log.where(F.col("seq") > after)


def errors(log: DataFrame, text: Column) -> DataFrame:
    """How often each kind of error occurs."""
    return log.select(error_signature(text).alias("signature")).where("signature is not null").groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
