"""Queries of profiles, splits, metrics and card figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_sql
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import split as S
from .registry import query, table


def _count():
    return F.count(F.lit(1)).alias("n")


@query("SELECT count(*) AS n FROM lineitem")
def agg1_row_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(_count())


def _with_nulls(spark, sf_dir):
    """customer with nulls planted by key."""
    c = F.col
    key = c("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(key % 20 != 0, c("c_acctbal")).alias("c_acctbal"), F.when(key % 7 != 0, c("c_mktsegment")).alias("c_mktsegment"))


_NULLS = "WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 20 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"


@query(f"{_NULLS} SELECT 'c_acctbal' AS name, count(*) - count(c_acctbal) AS n_missing FROM c UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment) FROM c UNION ALL SELECT 'c_custkey', 0 FROM c GROUP BY 1 UNION ALL SELECT 'c_name', 0 FROM c GROUP BY 1")
def agg2_null_counts(spark, sf_dir):
    return P.column_facts(_with_nulls(spark, sf_dir)).select("name", "n_missing")


@query(f"{_NULLS} SELECT 'c_acctbal' AS name, count(DISTINCT c_acctbal) + max(CAST(c_acctbal IS NULL AS BIGINT)) AS n_unique FROM c UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) + max(CAST(c_mktsegment IS NULL AS BIGINT)) FROM c UNION ALL SELECT 'c_custkey', count(DISTINCT c_custkey) FROM c UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM c")
def agg3_distinct_with_null(spark, sf_dir):
    return P.distinct_counts(_with_nulls(spark, sf_dir), 0)


@query(f"{_NULLS} SELECT unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']) AS name, true AS near")
def agg4_approximate_distinct(spark, sf_dir):
    """Estimates are within a tenth of the exact numbers."""
    df = _with_nulls(spark, sf_dir)
    rough = P.distinct_counts(df, P.EXACT_ROWS + 1).withColumnRenamed("n_unique", "rough")
    return rough.join(P.distinct_counts(df, 0), "name").select("name", (F.abs(F.col("rough") - F.col("n_unique")) <= 0.1 * F.col("n_unique") + 1).alias("near"))


@query("SELECT o_orderpriority AS value, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1")
def agg5_top_value_shares(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey")
    return P.top_values(df, P.column_profile(df)).where("name = 'o_orderpriority'").select("value", "share")


@query("SELECT lang, round(avg(length(text)), 4) AS mean_length, round(avg(CAST(contains(text, ' ') AS DOUBLE)), 6) AS has_space FROM documents GROUP BY lang")
def agg6_text_length(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.groupBy("lang").agg(F.round(F.avg(F.char_length("text")), 4).alias("mean_length"), F.round(F.avg(F.col("text").contains(" ").cast("double")), 6).alias("has_space"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def agg7_group_mean(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def agg8_class_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(_count())


_SERIES = """WITH l AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT DISTINCT event_type, floor(epoch(ts))::BIGINT AS s FROM events), d AS (SELECT event_type, (s - lag(s) OVER (PARTITION BY event_type ORDER BY s))::DOUBLE AS d FROM s),
m AS (SELECT event_type, quantile_cont(d, 0.5) AS m FROM d WHERE d IS NOT NULL GROUP BY 1)"""


@query(f"{_SERIES} SELECT count(*) AS n_series, min(n) AS shortest, max(n) AS longest FROM l")
def agg9_series_lengths(spark, sf_dir):
    return P.series_profile(table(spark, sf_dir, "events"), "ts", "event_type").select("n_series", "shortest", "longest")


@query(f"{_SERIES} SELECT quantile_cont(d, 0.5) AS median_step, count(*) FILTER (d > 1.5 * m) AS n_gaps FROM d JOIN m USING (event_type) WHERE d IS NOT NULL")
def agg10_median_step(spark, sf_dir):
    return P.series_profile(table(spark, sf_dir, "events"), "ts", "event_type").select("median_step", "n_gaps")


@query("SELECT round(min(n)::DOUBLE / sum(n), 6) AS smallest_share, round(max(n)::DOUBLE / min(n), 6) AS ratio FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def agg11_class_imbalance(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(_count())
    return counts.agg(F.round(F.min("n") / F.sum("n"), 6).alias("smallest_share"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"))


_PRED = "WITH x AS (SELECT l_linestatus || l_returnflag AS y, CASE WHEN l_quantity > 25 THEN l_linestatus || l_returnflag ELSE 'O' || l_returnflag END AS p FROM lineitem)"
_CELLS = f"{_PRED}, l AS (SELECT y AS c FROM x UNION SELECT p FROM x), k AS (SELECT c, (SELECT count(*) FROM x WHERE y = c) AS support, (SELECT count(*) FROM x WHERE p = c) AS called, (SELECT count(*) FROM x WHERE y = c AND p = c) AS hits FROM l), pc AS (SELECT c AS label, CASE WHEN called > 0 THEN hits::DOUBLE / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall, support FROM k), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pc)"


def _predictions(spark, sf_dir):
    y = F.concat("l_linestatus", "l_returnflag")
    return table(spark, sf_dir, "lineitem").select(y.alias("y"), F.when(F.col("l_quantity") > 25, y).otherwise(F.concat(F.lit("O"), "l_returnflag")).alias("p"))


@query(f"{_CELLS} SELECT a.c AS y, b.c AS p, (SELECT count(*) FROM x WHERE x.y = a.c AND x.p = b.c) AS n FROM l a CROSS JOIN l b")
def agg12_confusion(spark, sf_dir):
    return M.confusion(_predictions(spark, sf_dir), "y", "p")


@query(f"{_CELLS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def agg13_per_class(spark, sf_dir):
    return M.per_class(_predictions(spark, sf_dir), "y", "p").select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


_RESIDUALS = "WITH x AS (SELECT l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS p FROM lineitem)"


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))


@query(f"{_RESIDUALS} SELECT round(quantile_cont(p - y, 0.05), 4) AS q05, round(quantile_cont(p - y, 0.25), 4) AS q25, round(quantile_cont(p - y, 0.5), 4) AS q50, round(quantile_cont(p - y, 0.75), 4) AS q75, round(quantile_cont(p - y, 0.95), 4) AS q95 FROM x")
def agg14_residual_quantiles(spark, sf_dir):
    return M.residuals(_prices(spark, sf_dir), "y", "p").select(*(F.round(c, 4).alias(c) for c in ("q05", "q25", "q50", "q75", "q95")))


_BINS = "greatest(ceil(l_tax * 12.5::DOUBLE * 10) - 1, 0)::BIGINT"


@query(f"SELECT {_BINS} AS bin, round(avg(l_tax * 12.5::DOUBLE), 6) AS mean_predicted, round(avg(CAST(l_returnflag = 'R' AS DOUBLE)), 6) AS observed, count(*) AS n FROM lineitem GROUP BY 1")
def agg15_reliability_bins(spark, sf_dir):
    out = M.reliability(table(spark, sf_dir, "lineitem"), (F.col("l_returnflag") == "R").cast("double"), F.col("l_tax") * 12.5)
    return out.select("bin", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("observed", 6).alias("observed"), "n")


@query("SELECT DISTINCT o_orderpriority AS label FROM orders ORDER BY 1")
def agg18_label_list(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label")).distinct().orderBy("label")


# --- windows ---

_DAILY = "d AS (SELECT event_type AS sid, CAST(ts AS DATE) AS day, sum(value) AS y FROM events GROUP BY ALL)"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sid"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))


@query(f"WITH {_DAILY}, w AS (SELECT *, lag(y) OVER s AS l1, lag(y, 6) OVER s AS l6, lag(y, 13) OVER s AS l13, first_value(y) OVER s AS f FROM d WINDOW s AS (PARTITION BY sid ORDER BY day)) SELECT sid, CAST(day AS VARCHAR) AS day, round(y, 6) AS y, round(coalesce(l1, y), 6) AS lag1, round(coalesce(l6, f), 6) AS lag6, round(coalesce(l13, f), 6) AS lag13 FROM w")
def win1_lags(spark, sf_dir):
    from ..operators.forecast import origin_features

    out = origin_features(_daily(spark, sf_dir).withColumnRenamed("day", "ts"))
    return out.select("sid", F.col("ts").cast("string").alias("day"), *(F.round(c, 6).alias(c) for c in ("y", "lag1", "lag6", "lag13")))


@query(f"WITH {_DAILY} SELECT sid, CAST(day AS VARCHAR) AS day, round(avg(y) OVER (PARTITION BY sid ORDER BY day ROWS 6 PRECEDING), 6) AS mean7, round(avg(y) OVER (PARTITION BY sid ORDER BY day ROWS 13 PRECEDING), 6) AS mean14 FROM d")
def win2_rolling_mean(spark, sf_dir):
    from ..operators.forecast import origin_features

    out = origin_features(_daily(spark, sf_dir).withColumnRenamed("day", "ts"))
    return out.select("sid", F.col("ts").cast("string").alias("day"), F.round("mean7", 6).alias("mean7"), F.round("mean14", 6).alias("mean14"))


@query(f"WITH {_DAILY} SELECT sid, CAST(day AS VARCHAR) AS day, round(stddev_pop(y) OVER (PARTITION BY sid ORDER BY day ROWS 6 PRECEDING), 4) AS std7, round(stddev_pop(y) OVER (PARTITION BY sid ORDER BY day ROWS 13 PRECEDING), 4) AS std14 FROM d")
def win3_rolling_std(spark, sf_dir):
    from ..operators.forecast import origin_features

    out = origin_features(_daily(spark, sf_dir).withColumnRenamed("day", "ts"))
    return out.select("sid", F.col("ts").cast("string").alias("day"), F.round("std7", 4).alias("std7"), F.round("std14", 4).alias("std14"))


@query(f"WITH {_DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY day) - 1 AS idx FROM d) SELECT a.sid, a.idx::BIGINT AS idx, (b.idx - a.idx)::BIGINT AS h, round(b.y, 6) AS target FROM i a JOIN i b ON a.sid = b.sid AND b.idx - a.idx BETWEEN 1 AND 3")
def win4_multi_step_lead(spark, sf_dir):
    from ..operators.forecast import leads

    return leads(_daily(spark, sf_dir).withColumnRenamed("day", "ts"), 3).select("sid", "idx", "h", F.round("target", 6).alias("target"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def win5_position(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("idx"))


@query("SELECT o_custkey, s, s - lag(s) OVER (PARTITION BY o_custkey ORDER BY s) AS step FROM (SELECT DISTINCT o_custkey, epoch(o_orderdate)::BIGINT AS s FROM orders)")
def win6_time_delta(spark, sf_dir):
    seconds = table(spark, sf_dir, "orders").select("o_custkey", F.unix_timestamp("o_orderdate").alias("s")).distinct()
    return seconds.select("o_custkey", "s", (F.col("s") - F.lag("s").over(Window.partitionBy("o_custkey").orderBy("s"))).alias("step"))


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, sum(n) OVER (ORDER BY o_orderdate)::BIGINT AS up_to FROM (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1)")
def win7_cumulative_by_date(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(_count())  # a row for each date
    return counts.select(F.to_date("o_orderdate").cast("string").alias("day"), F.sum("n").over(Window.orderBy("o_orderdate")).alias("up_to"))


_TEMPORAL = """WITH d AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY o_orderdate) - 1 AS i, sum(n) OVER (ORDER BY o_orderdate) AS cum FROM d),
t AS (SELECT max(cum) AS total, count(*) AS nd FROM c), e AS (SELECT nd, (SELECT count(*) FROM c, t WHERE cum <= total * (1.0::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE)) AS te, (SELECT count(*) FROM c, t WHERE cum <= total * (1.0::DOUBLE - 0.15::DOUBLE)) AS ve FROM t),
e2 AS (SELECT CASE WHEN nd >= 3 THEN least(greatest(te, 1), nd - 2) ELSE te END AS te, ve, nd FROM e), e3 AS (SELECT te, CASE WHEN nd >= 3 THEN least(greatest(ve, te + 1), nd - 1) ELSE ve END AS ve FROM e2),
b AS (SELECT o_orderdate, n, CASE WHEN i < te THEN 0 WHEN i < ve THEN 1 ELSE 2 END AS split FROM c, e3),
r AS (SELECT o_orderdate, split, (coalesce(sum(n) OVER (PARTITION BY split ORDER BY o_orderdate DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE) / sum(n) OVER (PARTITION BY split) AS r FROM b)"""


@query(f"{_TEMPORAL} SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, split::BIGINT AS split, round(r, 9) AS r FROM r")
def win8_strictly_newer(spark, sf_dir):
    out = S.temporal_cuts(table(spark, sf_dir, "orders"), "o_orderdate")
    return out.select(F.to_date("o_orderdate").cast("string").alias("day"), F.col("split").cast("long").alias("split"), F.round("r", 9).alias("r"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem")
def win10_average_tie_rank(spark, sf_dir):
    ties = F.count(F.lit(1)).over(Window.partitionBy("l_suppkey", "l_quantity"))
    rank = F.rank().over(Window.partitionBy("l_suppkey").orderBy("l_quantity")) + (ties - 1) / 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", rank.alias("r"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def win11_latest_row(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def win12_sequence_number(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("seq"))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey DESC) = 1")
def win14_dedupe_best(spark, sf_dir):
    from ..operators.relational import top_per_group

    best = top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.col("c_acctbal"), F.desc("c_custkey")])
    return best.select(F.col("c_nationkey").cast("long"), "c_custkey")


# --- profiles ---


@query(f"""{_NULLS}, u AS (
SELECT 0 AS position, 'c_custkey' AS name, 'identifier' AS kind, count(*) - count(c_custkey) AS n_missing, count(DISTINCT c_custkey) AS n_unique, count(*) AS n FROM c
UNION ALL SELECT 1, 'c_name', CASE WHEN count(DISTINCT c_name) > 0.98::DOUBLE * count(*) AND count(*) > 50 THEN 'identifier' ELSE 'categorical' END, 0, count(DISTINCT c_name), count(*) FROM c
UNION ALL SELECT 2, 'c_acctbal', 'numeric', count(*) - count(c_acctbal), count(DISTINCT c_acctbal) + 1, count(*) FROM c
UNION ALL SELECT 3, 'c_mktsegment', 'categorical', count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) + 1, count(*) FROM c)
SELECT position::BIGINT AS position, name, CASE WHEN name = 'c_custkey' THEN 'numeric' ELSE kind END AS kind, n_missing, n_unique, round(n_unique::DOUBLE / n, 6) AS unique_share FROM u""")
def prof1_column_profile(spark, sf_dir):
    out = P.column_profile(_with_nulls(spark, sf_dir))
    return out.select(F.col("position").cast("long"), "name", "kind", "n_missing", "n_unique", F.round("unique_share", 6).alias("unique_share"))


#: Facts of the documents' columns, and their kinds by rule.
_KINDS = """WITH c AS (SELECT 1 AS position, 'doc_id' AS name, true AS number, CAST(doc_id AS VARCHAR) AS v FROM documents UNION ALL SELECT 2, 'text', false, text FROM documents UNION ALL SELECT 3, 'lang', false, lang FROM documents
UNION ALL SELECT 4, 'source', false, source FROM documents UNION ALL SELECT 5, 'n_chars', true, CAST(n_chars AS VARCHAR) FROM documents),
f AS (SELECT name, any_value(number) AS number, count(*) AS n, (count(DISTINCT v) + max((v IS NULL)::INT))::DOUBLE / count(*) AS share, avg(length(v)) AS long, avg(contains(v, ' ')::INT) AS spaced FROM c GROUP BY position, name),
k AS (SELECT name, CASE WHEN (name IN ('id', 'uuid', 'index', 'key') OR name LIKE '%id') AND share >= 0.95::DOUBLE THEN 'identifier' WHEN number THEN 'numeric' WHEN long >= 30 AND spaced > 0.5::DOUBLE THEN 'text' WHEN share > 0.98::DOUBLE AND n > 50 THEN 'identifier' ELSE 'categorical' END AS kind FROM f)"""


@query(f"{_KINDS} SELECT name, kind FROM k")
def prof2_kind_inference(spark, sf_dir):
    return P.column_profile(table(spark, sf_dir, "documents")).select("name", "kind")


@query("WITH c AS (SELECT 'lang' AS name, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2) SELECT name, value, round(n::DOUBLE / sum(n) OVER (PARTITION BY name), 4) AS share FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, value) <= 10")
def prof3_top_values(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return P.top_values(df.select("lang", "source"), P.column_profile(df))


@query("SELECT arg_min(column_name, ordinal_position) AS target FROM information_schema.columns WHERE table_name = 'labels' AND lower(column_name) IN ('target', 'label', 'labels', 'class', 'y', 'outcome', 'churn', 'sentiment', 'category', 'quality', 'price', 'species')")
def prof4_target_guess(spark, sf_dir):
    return P.target_guess(P.column_profile(table(spark, sf_dir, "labels")))


@query(f"{_KINDS} SELECT name FROM k WHERE kind = 'text'")
def prof5_text_columns(spark, sf_dir):
    return P.column_profile(table(spark, sf_dir, "documents")).where("kind = 'text'").select("name")


@query("SELECT avg(length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) + length(o_orderstatus) + length(o_orderpriority)) FILTER (o_orderkey % 97 = 0) * count(*) AS bytes FROM orders")
def prof6_memory_estimate(spark, sf_dir):
    return P.memory_estimate(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


@query("SELECT CASE WHEN count(*) < 100000 THEN 'small' WHEN count(*) < 2000000 THEN 'medium' ELSE 'large' END AS tier FROM lineitem")
def prof7_scale_tier(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(P.scale_tier(F.count(F.lit(1))).alias("tier"))


def _series_sql(table: str, time: str, series: str | None) -> str:
    """The profile of a table's series, once its columns are known."""
    key, name = (series, f"'{series}'") if series else ("'all'", "NULL")
    return f"""SELECT '{table}' AS name, '{time}' AS time_column, CAST({name} AS VARCHAR) AS series_column, n_series, shortest, longest, n_gaps, median_step, CASE WHEN median_step BETWEEN 30 AND 90 THEN '1min' WHEN median_step BETWEEN 1800 AND 5400 THEN 'H' WHEN median_step BETWEEN 43200 AND 129600 THEN 'D' WHEN median_step BETWEEN 432000 AND 777600 THEN 'W' WHEN median_step BETWEEN 2160000 AND 3024000 THEN 'M' END AS frequency
FROM (SELECT count(*) AS n_series, min(n) AS shortest, max(n) AS longest FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})),
(WITH d AS (SELECT k, s - lag(s) OVER (PARTITION BY k ORDER BY s) AS d FROM (SELECT DISTINCT {key} AS k, CAST(floor(epoch({time})) AS BIGINT) AS s FROM {table})), m AS (SELECT k, quantile_cont(d, 0.5) AS m FROM d WHERE d IS NOT NULL GROUP BY k)
 SELECT count(*) FILTER (d > 1.5 * m) AS n_gaps, quantile_cont(d, 0.5) AS median_step FROM d JOIN m USING (k) WHERE d IS NOT NULL)"""


@query(f"{_series_sql('events', 'ts', 'user_id')} UNION ALL {_series_sql('orders', 'o_orderdate', None)}")
def prof8_series_profile(spark, sf_dir):
    """Which columns of two tables are time and series, and what their series are like; no column is named."""
    parts = [P.series_profile(table(spark, sf_dir, name)).select(F.lit(name).alias("name"), "*") for name in ("events", "orders")]
    return parts[0].unionByName(parts[1])


@query("SELECT 'too_many_classes' AS issue, 'o_orderkey' AS \"column\" FROM orders HAVING count(DISTINCT o_orderkey) > greatest(50, count(*) / 2) UNION ALL SELECT 'no_such_column', 'body' WHERE NOT EXISTS (FROM information_schema.columns WHERE table_name = 'orders' AND column_name = 'body') UNION ALL SELECT 'too_few_rows', NULL FROM orders HAVING count(*) < 20")
def prof9_suitability(spark, sf_dir):
    return P.suitability(P.column_profile(table(spark, sf_dir, "orders")), "o_orderkey", "classification", ("body",))


# --- splits ---

_SPLIT = """WITH k AS (SELECT o_orderkey, {strata} AS g, {draw} AS d, {r} AS r FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, o_orderkey) - 1 AS rank, count(*) OVER (PARTITION BY g) AS n FROM k),
s AS (SELECT *, CASE WHEN n >= 3 THEN greatest(round_even(n * 0.15::DOUBLE, 0), 1) ELSE round_even(n * 0.15::DOUBLE, 0) END AS b FROM n)
SELECT o_orderkey, CASE WHEN rank < b THEN 1 WHEN rank < 2 * b THEN 2 ELSE 0 END::BIGINT AS split{more} FROM s"""
_DRAWS = {"draw": uniform_sql("o_orderkey", "split"), "r": uniform_sql("o_orderkey", "r")}


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {uniform_sql('o_orderkey', 'split')}, o_orderkey) - 1 AS rank FROM orders")
def win15_stratum_rank(spark, sf_dir):
    """The rank in its stratum by which a row's block is cut to an exact size."""
    from ..operators.ranks import ranked

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ranked(rows, uniform(F.col("o_orderkey"), "split"), [F.col("o_orderkey")], ["o_orderpriority"]).select("o_orderkey", "rank")


@query(_SPLIT.format(strata="1", more="", **_DRAWS))
def split1_random(spark, sf_dir):
    return S.random_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", F.col("split").cast("long"))


@query(_SPLIT.format(strata="o_orderpriority", more="", **_DRAWS))
def split2_stratified(spark, sf_dir):
    return S.random_split(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderpriority"]).select("o_orderkey", F.col("split").cast("long"))


@query(_SPLIT.format(strata="1", more=", round(r, 12) AS r", **_DRAWS))
def split3_independent_draw(spark, sf_dir):
    return S.random_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", F.col("split").cast("long"), F.round("r", 12).alias("r"))


@query(f"{_TEMPORAL} SELECT o_orderkey, split::BIGINT AS split FROM orders JOIN r USING (o_orderdate)")
def split4_temporal(spark, sf_dir):
    return S.temporal_split(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", F.col("split").cast("long"))


@query(f"{_TEMPORAL} SELECT o_orderkey, split::BIGINT AS split, round(r, 9) AS r FROM orders JOIN r USING (o_orderdate)")
def split4_default_time(spark, sf_dir):
    """No column is named: the table's only column of time is found."""
    return S.temporal_split(table(spark, sf_dir, "orders")).select("o_orderkey", F.col("split").cast("long"), F.round("r", 9).alias("r"))


@query("""WITH i AS (SELECT c_custkey, row_number() OVER () - 1 AS i FROM customer), n AS (SELECT count(*) AS n, CAST(floor(count(*) * (1.0::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE)) AS BIGINT) AS a, CAST(floor(count(*) * (1.0::DOUBLE - 0.15::DOUBLE)) AS BIGINT) AS b FROM customer)
SELECT c_custkey, CASE WHEN i < a THEN 0 WHEN i < b THEN 1 ELSE 2 END::BIGINT AS split, round((CASE WHEN i < a THEN a - i - 0.5 WHEN i < b THEN b - i - 0.5 ELSE n - i - 0.5 END) / (CASE WHEN i < a THEN a WHEN i < b THEN b - a ELSE n - b END), 9) AS r FROM i, n""")
def split4_file_order(spark, sf_dir):
    """A table without time is split in the order of its file."""
    return S.temporal_split(table(spark, sf_dir, "customer")).select("c_custkey", F.col("split").cast("long"), F.round("r", 9).alias("r"))


@query(f"{_TEMPORAL} SELECT o_orderkey, round(r, 9) AS r FROM orders JOIN r USING (o_orderdate)")
def split5_suffix_window(spark, sf_dir):
    return S.temporal_split(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", F.round("r", 9).alias("r"))


@query(f"{_TEMPORAL} SELECT split::BIGINT AS split, count(*) AS n FROM orders JOIN r USING (o_orderdate) GROUP BY 1")
def split6_sizes(spark, sf_dir):
    return S.split_sizes(S.temporal_split(table(spark, sf_dir, "orders"), "o_orderdate")).select(F.col("split").cast("long"), "n")


# --- metrics ---

_ONE = f"{_CELLS} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f"


def _one(spark, sf_dir, *names):
    out = M.classification(_predictions(spark, sf_dir), "y", "p")
    return out.select(*(F.round(c, 6).alias(c) for c in names))


@query(f"SELECT accuracy FROM ({_ONE})")
def met1_accuracy(spark, sf_dir):
    return _one(spark, sf_dir, "accuracy")


@query(f"SELECT balanced_accuracy FROM ({_ONE})")
def met2_balanced_accuracy(spark, sf_dir):
    return _one(spark, sf_dir, "balanced_accuracy")


@query(f"SELECT f1_macro, f1_weighted FROM ({_ONE})")
def met3_f1(spark, sf_dir):
    return _one(spark, sf_dir, "f1_macro", "f1_weighted")


_AUC = "r AS (SELECT {g} AS g, y, rank() OVER (PARTITION BY {g} ORDER BY s) + (count(*) OVER (PARTITION BY {g}, s) - 1) / 2.0::DOUBLE AS k FROM x), a AS (SELECT g, (sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc FROM r GROUP BY g)"


@query("WITH x AS (SELECT l_returnflag = 'R' AS y, l_extendedprice AS s FROM lineitem), " + _AUC.format(g="1") + " SELECT round(auc, 9) AS auc FROM a")
def met4_auc(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return M.auc(df, F.col("l_returnflag") == "R", F.col("l_extendedprice")).select(F.round("auc", 9).alias("auc"))


_OVR = "WITH b AS (SELECT l_returnflag AS f, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem), x AS (SELECT f = 'A' AS y, 'A' AS c, q AS s FROM b UNION ALL SELECT f = 'N', 'N', d FROM b UNION ALL SELECT f = 'R', 'R', t FROM b), "


@query(_OVR + _AUC.format(g="c") + " SELECT round(avg(auc), 9) AS auc_ovr FROM a")
def met5_auc_one_vs_rest(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    score = lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).alias("score"))
    long = df.select("l_returnflag", F.inline(F.array(score("A", "l_quantity"), score("N", "l_discount"), score("R", "l_tax"))))
    return M.auc_one_vs_rest(long, "l_returnflag", "label", "score").select(F.round("auc_ovr", 9).alias("auc_ovr"))


_REG = f"{_RESIDUALS} SELECT round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 9) AS r2, round(avg(abs(p - y) / greatest(abs(y), 2.220446049250313e-16)), 9) AS mape, round(sqrt(avg((ln(1 + greatest(p, 0)) - ln(1 + y)) ** 2)), 9) AS rmsle FROM x"


@query(f"SELECT rmse, mae, r2 FROM ({_REG})")
def met6_regression(spark, sf_dir):
    return M.regression(_prices(spark, sf_dir), "y", "p").select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round("r2", 9).alias("r2"))


@query(f"SELECT mape FROM ({_REG})")
def met7_mape(spark, sf_dir):
    return M.regression(_prices(spark, sf_dir), "y", "p").select(F.round("mape", 9).alias("mape"))


@query(f"SELECT rmsle FROM ({_REG})")
def met8_rmsle(spark, sf_dir):
    return M.regression(_prices(spark, sf_dir), "y", "p").select(F.round("rmsle", 9).alias("rmsle"))


@query("SELECT l_suppkey, round(100 * avg(2 * abs(p - y) / (abs(y) + abs(p))), 6) AS smape, round(100 * avg(abs(p - y) / greatest(abs(y), 1e-8)), 6) AS mape FROM (SELECT l_suppkey, l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS p FROM lineitem) GROUP BY 1")
def met9_smape(spark, sf_dir):
    out = M.forecast_errors(_prices(spark, sf_dir), "y", "p", ["l_suppkey"])
    return out.select("l_suppkey", F.round("smape", 6).alias("smape"), F.round("mape", 6).alias("mape"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice <= 100000 ELSE o_totalprice >= 100000 END AS met FROM orders")
def met10_target_met(spark, sf_dir):
    metric = F.when(F.col("o_orderkey") % 2 == 0, M.valid_metric("regression", "nonsense")).otherwise(M.valid_metric("classification", "roc_auc"))
    return table(spark, sf_dir, "orders").select("o_orderkey", M.target_met(metric, F.col("o_totalprice"), F.lit(100000.0)).alias("met"))


# --- card figures ---


@query(f"{_CELLS} SELECT label, support, round(recall, 6) AS recall FROM f WHERE support > 0")
def card4_confusion_report(spark, sf_dir):
    return M.per_class(_predictions(spark, sf_dir), "y", "p").where("support > 0").select("label", "support", F.round("recall", 6).alias("recall"))


@query("SELECT round(avg((l_tax * 12.5::DOUBLE - CAST(l_returnflag = 'R' AS DOUBLE)) ** 2), 9) AS brier FROM lineitem")
def card5_brier(spark, sf_dir):
    miss = F.col("l_tax") * 12.5 - (F.col("l_returnflag") == "R").cast("double")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg(miss * miss), 9).alias("brier"))


@query(f"{_RESIDUALS} SELECT round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(max(abs(p - y)), 6) AS largest, round(quantile_cont(p - y, 0.5), 4) AS q50 FROM x")
def card6_residual_report(spark, sf_dir):
    out = M.residuals(_prices(spark, sf_dir), "y", "p")
    return out.select(*(F.round(c, 6).alias(c) for c in ("mae", "rmse", "largest")), F.round("q50", 4).alias("q50"))
