"""Profiles: one row for each column of a table, from one aggregate and one count of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import frequency
from ..functions.text import date_like
from ..sources.shared import persisted
from .ranks import quantiles

#: Beyond so many rows distinct values are estimated, with this relative deviation at most: a tenth off is five of them.
EXACT_ROWS, DEVIATION = 2_000_000, 0.02
TOP_VALUES, TOP_DISTINCT = 10, 50
#: Names of targets and of identifiers.
TARGET_NAMES = ("target", "label", "labels", "class", "y", "outcome", "churn", "sentiment", "category", "quality", "price", "species")
ID_NAMES = ("id", "uuid", "index", "key")
DATE_NAMES = ("date", "datetime", "timestamp", "time", "ds", "month", "year")


def _kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "string"
    return "nested"


def column_facts(df: DataFrame) -> DataFrame:
    """``position, name, dtype, base, n_rows, n_missing, mean_length, has_space, date_share`` in one pass over the rows."""
    facts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        text = c.cast("string") if _kind_of(f.dataType) == "string" else F.lit(None).cast("string")
        facts.append(
            F.struct(
                F.count_if(c.isNull()).alias("n_missing"),
                F.avg(F.char_length(text)).alias("mean_length"),
                F.avg(text.contains(" ").cast("double")).alias("has_space"),
                F.avg(date_like(F.trim(text)).cast("double")).alias("date_share"),
            ).alias(f.name)
        )
    one = df.agg(F.count(F.lit(1)).alias("__n"), *facts)
    rows = F.array(
        *(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(_kind_of(f.dataType)).alias("base"), F.col("__n").alias("n_rows"), F.col(f"`{f.name}`").alias("f")) for i, f in enumerate(df.schema))
    )
    return one.select(F.inline(rows)).select("position", "name", "dtype", "base", "n_rows", "f.*")


def long_values(df: DataFrame) -> DataFrame:
    """(name, value) of every cell but nested ones; values as text."""
    flat = [f for f in df.schema if _kind_of(f.dataType) != "nested"]
    cells = [F.struct(F.lit(f.name).alias("name"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in flat]
    cells = F.array(*cells) if cells else F.array().cast("array<struct<name:string,value:string>>")
    return df.select(F.inline(cells))


def value_counts(df: DataFrame) -> DataFrame:
    """(name, value, n) with null as a value, from one shuffle over all columns."""
    return long_values(df).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, rows: int, exact: bool | None = None) -> DataFrame:
    """(name, n_unique): null counts as a value; estimated beyond EXACT_ROWS, unless ``exact`` says otherwise."""
    if rows <= EXACT_ROWS if exact is None else exact:
        return value_counts(df).groupBy("name").agg(F.count(F.lit(1)).alias("n_unique"))
    one = df.agg(*(F.struct((F.approx_count_distinct(f"`{c}`", DEVIATION) + F.max(F.col(f"`{c}`").isNull().cast("long"))).alias("n")).alias(c) for c in df.columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`.n").alias("n_unique")) for c in df.columns))))


def kind(unique: Column, rows: Column) -> Column:
    """The semantic kind of a column from its facts, first rule first."""
    share = unique / F.greatest(rows, F.lit(1))
    name = F.lower("name")
    is_id = (name.isin(*ID_NAMES) | name.endswith("id")) & (share >= 0.95)
    maybe_date = name.isin(*DATE_NAMES) | name.rlike("_(date|time|datetime|timestamp)$") | (share > 0.01)
    return (
        F.when(F.col("base").isin("boolean", "datetime", "nested"), F.col("base"))
        .when(is_id, "identifier")
        .when(F.col("base") == "numeric", "numeric")
        .when(maybe_date & (F.col("date_share") >= 0.7), "datetime")
        .when((F.col("mean_length") >= 30) & (F.col("has_space") > 0.5), "text")
        .when((share > 0.98) & (rows > 50), "identifier")
        .otherwise("categorical")
    )


def top_values(df: DataFrame, profile: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """(name, value, share): the k most frequent values of columns of few values, shares to four digits."""
    few = profile.where((F.col("n_unique") <= TOP_DISTINCT) & (F.col("kind").isin("categorical", "boolean") | ((F.col("kind") == "numeric") & (F.col("n_unique") <= 20))))
    names = [r.name for r in few.select("name").collect()]  # columns of the table
    counts = value_counts(df.select(*(f"`{c}`" for c in df.columns if c in names))).where("value is not null")
    total = F.sum("n").over(Window.partitionBy("name"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))
    rows = counts.withColumns({"_rank": rank, "share": F.round(F.col("n") / total, 4)})
    return rows.where(F.col("_rank") <= k).select("name", "value", "share")


def column_profile(df: DataFrame, rows: int | None = None, exact: bool | None = None) -> DataFrame:
    """``position, name, dtype, kind, n_rows, n_missing, n_unique, unique_share`` of each column; ``exact`` as in :func:`distinct_counts`."""
    rows = df.count() if rows is None else rows
    facts = column_facts(df).join(distinct_counts(df, rows, exact), "name", "left")
    facts = facts.withColumn("kind", kind(F.coalesce("n_unique", F.lit(0)), F.col("n_rows")))
    return facts.select("position", "name", "dtype", "kind", "n_rows", "n_missing", "n_unique", (F.col("n_unique") / F.greatest("n_rows", F.lit(1))).alias("unique_share"))


def target_guess(profile: DataFrame) -> DataFrame:
    """The first column with a target's name, else the last that can be modelled."""
    named = F.min(F.when(F.lower("name").isin(*TARGET_NAMES), F.struct("position", "name")))
    last = F.max(F.when(F.col("kind").isin("numeric", "categorical", "boolean"), F.struct("position", "name")))
    return profile.agg(F.coalesce(named["name"], last["name"]).alias("target"))


def scale_tier(rows: Column) -> Column:
    return F.when(rows < 100_000, "small").when(rows < 2_000_000, "medium").otherwise("large")


def memory_estimate(df: DataFrame, row_id: str, step: int = 97) -> DataFrame:
    """Bytes of all rows, from the text length of every ``step``-th."""
    width = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns))
    sampled = F.when(F.pmod(F.col(row_id), F.lit(step)) == 0, width)
    return df.agg((F.avg(sampled) * F.count(F.lit(1))).alias("bytes"))


#: Names of columns that tell series apart.
SERIES_NAMES = ("store", "store_id", "item", "item_id", "series", "series_id", "id", "symbol")


def time_and_series(profile: DataFrame) -> tuple[str | None, str | None]:
    """The column of time, and the one whose values are series, of a table's profile; None where there is none.

    Time is the first datetime column with a name of time, else the first at all. The series' column is the first one with an identifier's name
    whose values are at least two, and at most half as many as rows: what differs from row to row is no series. The bound is a share of the
    rows, as tables that grow have more series. Distinct values come with the profile, from one pass (estimated by sketches in large tables).
    """
    columns = profile.orderBy("position").collect()  # a row for each column
    times = [c.name for c in columns if c.kind == "datetime"]
    if not times:
        return None, None
    time = next((c for c in times if c.lower() in DATE_NAMES), times[0])
    for c in columns:
        named = c.name.lower() in SERIES_NAMES or c.name.lower().endswith("id")
        kinds = c.kind in ("categorical", "identifier", "numeric")
        if c.name != time and named and kinds and 1 < c.n_unique <= c.n_rows / 2:
            return time, c.name
    return time, None


def time_steps(df: DataFrame, time: str, series: str | None) -> DataFrame:
    """(series, d): seconds between the different times of a series that follow each other. Times are ordered day by day, and days among each
    other, so that no task holds a long series."""
    key = (F.col(f"`{series}`") if series else F.lit(None)).cast("string").alias("series")
    seconds = df.select(key, F.unix_timestamp(F.col(f"`{time}`").try_cast("timestamp")).alias("s")).where("s is not null").distinct().withColumn("day", F.floor(F.col("s") / 86400))
    inside = seconds.select("series", F.col("s") - F.lag("s").over(Window.partitionBy("series", "day").orderBy("s")))
    days = seconds.groupBy("series", "day").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    between = days.select("series", F.col("first") - F.lag("last").over(Window.partitionBy("series").orderBy("day")))
    return inside.unionByName(between.toDF(*inside.columns)).toDF("series", "d").where("d is not null")


def series_profile(df: DataFrame, time: str | None = None, series: str | None = None, profile: DataFrame | None = None) -> DataFrame:
    """``time_column, series_column, n_series, shortest, longest, n_gaps, median_step, frequency`` in one row: how many series there are, their
    lengths, the median step in seconds, its frequency, and the number of gaps (steps over 1.5 medians of their own series).

    Without a column of time it is inferred, and the series' column with it, see :func:`time_and_series`; a table without one gives no row.
    Without a series' column all rows are one series.
    """
    if time is None:
        time, series = time_and_series(column_profile(df) if profile is None else profile)
        if time is None:
            return df.sparkSession.createDataFrame([], "time_column string, series_column string, n_series long, shortest long, longest long, n_gaps long, median_step double, frequency string")
    lengths = df.groupBy(F.col(f"`{series}`") if series else F.lit(1)).agg(F.count(F.lit(1)).alias("n"))
    steps = persisted(time_steps(df, time, series), "steps")
    medians = steps.groupBy(F.col("series").alias("of")).agg(F.percentile("d", F.lit(0.5)).alias("m"))  # a buffer holds different steps, not rows
    gaps = steps.join(medians, F.col("series").eqNullSafe(F.col("of"))).agg(F.count_if(F.col("d") > 1.5 * F.col("m")).alias("n_gaps")).withColumn("median_step", F.lit(quantiles(steps, "d", [0.5])[0]).cast("double"))
    one = lengths.agg(F.count(F.lit(1)).alias("n_series"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    named = one.select(F.lit(time).alias("time_column"), F.lit(series).cast("string").alias("series_column"), "*")
    return named.crossJoin(gaps).withColumn("frequency", frequency(F.col("median_step")))  # one row each


def suitability(profile: DataFrame, target: str, task: str, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """Issues (issue, column) that keep a target from being modelled."""
    t = profile.where(F.col("name") == target)
    issue = lambda rows, name, column: rows.select(F.lit(name).alias("issue"), column.alias("column"))
    missing = profile.agg(F.count_if(F.col("name") == target).alias("n")).where("n = 0")
    found = [issue(missing, "no_such_target", F.lit(target))]
    if "classification" in task:
        found.append(issue(t.where("n_unique < 2"), "single_class", F.col("name")))
        found.append(issue(t.where(F.col("n_unique") > F.greatest(F.lit(50), F.col("n_rows") / 2)), "too_many_classes", F.col("name")))
    else:
        found.append(issue(t.where("kind <> 'numeric'"), "target_not_numeric", F.col("name")))
    for c in text_columns:
        found.append(issue(profile.agg(F.count_if(F.col("name") == c).alias("n")).where("n = 0"), "no_such_column", F.lit(c)))
    found.append(issue(profile.where("n_rows < 20").limit(1), "too_few_rows", F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, found)
