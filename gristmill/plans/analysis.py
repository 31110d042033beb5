"""Queries of audits, forecasts, features, selection, memory, comparison and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_sql
from ..operators import audit as A
from ..operators import evaluation as V
from ..operators import features as X
from ..operators import forecast as T
from ..operators import halving as H
from ..operators import memory as Y
from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import profile as P
from ..operators import retrieval as R
from ..operators import runlog as L
from ..operators import split as S
from ..sources.shared import persisted
from .registry import query, table

# --- audit ---


def _part(spark, sf_dir):
    """part with a constant, a sparse, a nearly constant and a copied column planted."""
    c = F.col
    key = c("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_size", F.lit("x").alias("same"), F.when(key % 10 == 0, c("p_type")).alias("sparse"),
        F.when(key % 400 == 1, "odd").otherwise("even").alias("mostly"), c("p_retailprice").alias("price_copy"), c("p_retailprice").alias("price"),
    )


@query("SELECT 'part_key' AS name, round(count(DISTINCT p_partkey)::DOUBLE / count(*), 4) AS value FROM part UNION ALL SELECT 'o_code', 1.0 FROM part GROUP BY 1")
def aud1_identifiers(spark, sf_dir):
    df = _part(spark, sf_dir).select(F.col("p_partkey").alias("part_key"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("o_code"), "p_name", "p_size")
    return A.identifiers(P.column_profile(df)).select("name", "value")


@query(r"""
WITH n AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN w || '_id' WHEN 1 THEN 'copy of ' || w WHEN 2 THEN upper(w) WHEN 3 THEN w || '_key_' || p_size WHEN 4 THEN w || '_and_much_more' ELSE split_part(p_name, ' ', 1) || w END AS name FROM (SELECT *, split_part(p_name, ' ', 2) AS w FROM part)),
p AS (SELECT name, lower(trim(name)) AS raw, regexp_replace(lower(trim(name)), '[^a-z0-9]', '', 'g') AS plain FROM n)
SELECT name, regexp_matches(name, '(?i)(^|_)(id|uuid|guid|key|index|hash|token|code|pk)($|_)') AS names_rows,
  raw = 'widget' OR ((contains(plain, 'widget') OR contains('widget', plain)) AND (regexp_matches(raw, 'pred|target|true|actual|outcome|label|result|post|copy|leak|after') OR length(plain) - 6 <= 4)) AS names_target FROM p
""")
def prj12_name_predicates(spark, sf_dir):
    key, words = F.col("p_partkey") % 6, F.split("p_name", " ")
    w = words[1]
    name = F.when(key == 0, F.concat(w, F.lit("_id"))).when(key == 1, F.concat(F.lit("copy of "), w)).when(key == 2, F.upper(w)).when(key == 3, F.concat(w, F.lit("_key_"), "p_size")).when(key == 4, F.concat(w, F.lit("_and_much_more")))
    names = table(spark, sf_dir, "part").select(name.otherwise(F.concat(words[0], w)).alias("name")).distinct()
    return names.select("name", F.col("name").rlike(A.ID_PATTERN).alias("names_rows"), A.mirrors_target("widget").alias("names_target"))


@query("SELECT 'price_copy' AS name")
def aud2_target_names(spark, sf_dir):
    return A.target_names(P.column_profile(_part(spark, sf_dir)), "price").select("name")


@query("SELECT 'same' AS name, 'drop' AS action")
def aud3_constant(spark, sf_dir):
    return A.constants(P.column_profile(_part(spark, sf_dir))).select("name", "action")


@query("SELECT 'mostly' AS name, round(avg(CAST(p_partkey % 400 <> 1 AS DOUBLE)), 4) AS value FROM part HAVING count(*) > 200")
def aud4_near_constant(spark, sf_dir):
    df = _part(spark, sf_dir)
    profile = P.column_profile(df)
    return A.near_constants(profile, P.top_values(df, profile)).select("name", "value")


@query("SELECT 'sparse' AS name, 'drop' AS action, round(avg(CAST(p_partkey % 10 <> 0 AS DOUBLE)), 4) AS value FROM part")
def aud5_missingness(spark, sf_dir):
    return A.missingness(P.column_profile(_part(spark, sf_dir))).select("name", "action", "value")


@query("WITH o AS (SELECT concat('c', o_custkey, '-', year(o_orderdate), '-', month(o_orderdate)) AS c FROM orders) SELECT 'month_of_customer' AS name, count(DISTINCT c)::DOUBLE AS value FROM o HAVING count(DISTINCT c) > 200 AND count(DISTINCT c) > 0.3::DOUBLE * count(*) AND count(DISTINCT c) <= 0.98::DOUBLE * count(*)")
def aud6_high_cardinality(spark, sf_dir):
    part = lambda f: f("o_orderdate").cast("string")
    month = F.concat_ws("-", F.concat(F.lit("c"), "o_custkey"), part(F.year), part(F.month))
    df = table(spark, sf_dir, "orders").select(month.alias("month_of_customer"), "o_orderstatus")
    return A.high_cardinality(P.column_profile(df, exact=True)).select("name", "value")


@query("SELECT 'rare' AS name, round(min(n)::DOUBLE / sum(n), 4) AS value, CASE WHEN min(n)::DOUBLE / sum(n) < 0.01 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT o_orderkey % 50 = 0 AS rare, count(*) AS n FROM orders GROUP BY 1)")
def aud7_imbalance(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50 == 0).alias("rare"))
    return A.imbalance(df, "rare").select("name", "value", "severity")


_POWER = f"""WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(o_orderstatus = 'F' AS DOUBLE) AS y, row_number() OVER (ORDER BY {uniform_sql('o_orderkey', 'power')}, o_orderkey) > (SELECT count(*) FROM orders) * 0.8::DOUBLE AS held FROM orders),
l AS (SELECT 'o_orderpriority' AS name, o_orderpriority AS value, y, held FROM o UNION ALL SELECT 'o_orderstatus', o_orderstatus, y, held FROM o),
m AS (SELECT name, value, avg(y) AS p FROM l WHERE NOT held GROUP BY ALL), pr AS (SELECT avg(y) AS prior FROM l WHERE NOT held),
x AS (SELECT name, y, coalesce(p, prior) AS s FROM l LEFT JOIN m USING (name, value) CROSS JOIN pr WHERE held),
r AS (SELECT name, y, rank() OVER (PARTITION BY name ORDER BY s) + (count(*) OVER (PARTITION BY name, s) - 1) / 2.0::DOUBLE AS k FROM x),
a AS (SELECT name, (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY name)
SELECT name, round(greatest(auc, 1 - auc), 6) AS power FROM a"""


def _power(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("double"))
    return A.categorical_power(df, "o_orderkey", ["o_orderpriority", "o_orderstatus"], "y", "binary")


@query(_POWER)
def aud8_categorical_power(spark, sf_dir):
    return _power(spark, sf_dir).select("name", F.round("power", 6).alias("power"))


@query("SELECT name, abs(c) > 0.9 AS tells FROM (SELECT 'p_size' AS name, corr(p_size, p_retailprice) AS c FROM part UNION ALL SELECT 'copy', corr(p_retailprice * 2, p_retailprice) FROM part)")
def aud9_numeric_power(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("copy", F.col("p_retailprice") * 2)
    return A.numeric_power(df, "p_partkey", ["p_size", "copy"], "p_retailprice").select("name", (F.col("power") > 0.8).alias("tells"))


_DUP = "WITH x AS (SELECT CASE WHEN l_orderkey % 10 < 7 THEN 0 WHEN l_orderkey % 10 < 9 THEN 1 ELSE 2 END AS split, l_quantity AS q, l_discount AS d, l_tax AS t, l_returnflag AS f FROM lineitem)"


@query(f"{_DUP}, n AS (SELECT count(*) AS n_test, count(*) FILTER ((q, d, t, f) IN (SELECT (q, d, t, f) FROM x WHERE split = 0)) AS n_duplicate FROM x WHERE split = 2) SELECT n_test, n_duplicate, round(100.0::DOUBLE * n_duplicate / n_test, 4) AS percent, CASE WHEN 100.0 * n_duplicate / n_test >= 10 THEN 'high' WHEN 100.0 * n_duplicate / n_test >= 1 THEN 'medium' ELSE 'low' END AS severity FROM n")
def aud10_train_test_duplicates(spark, sf_dir):
    digit = F.col("l_orderkey") % 10
    df = table(spark, sf_dir, "lineitem").withColumn("split", F.when(digit < 7, 0).when(digit < 9, 1).otherwise(2))
    out = A.duplicates(df, "split", ["l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return out.select("n_test", "n_duplicate", F.round("percent", 4).alias("percent"), "severity")


@query("SELECT * FROM (VALUES ('o_orderstatus', 'predictive_leakage', true)) t(name, reason, leakage)")
def aud11_roll_up(spark, sf_dir):
    return A.roll_up(A.power_findings(_power(spark, sf_dir)))


# --- forecasts ---

_WEEKLY = """w AS (SELECT o_orderpriority AS sid, date_trunc('week', o_orderdate) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
d AS (SELECT ts, count(*) AS n FROM w GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, sum(n) OVER (ORDER BY ts) AS cum FROM d), t AS (SELECT max(cum) AS total FROM c),
e AS (SELECT (SELECT count(*) FROM c, t WHERE cum <= total * (1.0::DOUBLE - 0.15::DOUBLE)) AS ve),
b AS (SELECT w.*, c.i >= e.ve AS test FROM w JOIN c USING (ts), e),
x AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS idx, count(*) FILTER (NOT test) OVER (PARTITION BY sid) AS n FROM b),
q AS (SELECT sid, ts, y, idx, n, ((idx - n) % 4) + 1 AS h, n + ((idx - n) // 4) * 4 - 1 AS origin FROM x WHERE test),
f AS (SELECT q.*, coalesce(s.y, l.y) AS p FROM q LEFT JOIN x s ON s.sid = q.sid AND s.idx = q.origin + q.h - 52 * CAST(ceil(q.h / 52.0) AS BIGINT) LEFT JOIN x l ON l.sid = q.sid AND l.idx = q.origin)"""


def weekly(spark, sf_dir):
    """Weekly order value of each priority, with its block."""
    orders = table(spark, sf_dir, "orders")
    weeks = orders.groupBy(F.col("o_orderpriority").alias("sid"), F.date_trunc("week", "o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("y"))
    return persisted(S.temporal_split(persisted(weeks, "weeks"), "ts"), "weeks-in-blocks")


def _naive(spark, sf_dir):
    rows = weekly(spark, sf_dir)
    return T.naive_forecast(rows.where(F.col("split") < S.TEST), rows.where(F.col("split") == S.TEST), 4, 52)


@query(f"WITH {_WEEKLY} SELECT sid, count(p) AS n_forecast, count(*) - count(p) AS n_unforecast, round(100 * avg(CASE WHEN abs(y) + abs(p) < 1e-12 THEN 0 ELSE 2 * abs(p - y) / (abs(y) + abs(p)) END), 6) AS smape, round(avg(abs(p - y)), 4) AS mae FROM f GROUP BY sid")
def seasonal_naive_backtest(spark, sf_dir):
    """How far off a seasonal-naive forecast of weekly order value is, by priority."""
    out = M.forecast_errors(_naive(spark, sf_dir), "y", "p", ["sid"])
    return out.select("sid", "n_forecast", "n_unforecast", F.round("smape", 6).alias("smape"), F.round("mae", 4).alias("mae"))


@query("SELECT CASE WHEN o_custkey % 5 = 0 THEN 'nan' ELSE o_orderpriority END AS sid, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1")
def ts1_long_to_series(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise(F.col("o_totalprice").cast("string"))
    series = T.to_series(table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("string"), value, [F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority"))])
    return series.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("total"))


_DAILY = "d AS (SELECT event_type AS sid, date_trunc('day', ts) AS ts, sum(value) AS y FROM events GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS idx FROM d)"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sid"), F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("y"))


@query(f"WITH {_DAILY} SELECT a.sid, a.idx::BIGINT AS idx, a.idx >= 13 AS warm, round(avg(b.y), 6) AS mean7 FROM i a JOIN i b ON a.sid = b.sid AND b.idx BETWEEN a.idx - 6 AND a.idx GROUP BY ALL")
def ts2_origin_features(spark, sf_dir):
    return T.origin_features(_daily(spark, sf_dir)).select("sid", "idx", (F.col("idx") >= T.WARM_UP).alias("warm"), F.round("mean7", 6).alias("mean7"))


_TRAIN = f"WITH {_DAILY}, p AS (SELECT a.sid, a.idx, b.idx - a.idx AS h, a.y, b.y AS target, b.ts AS target_ts FROM i a JOIN i b ON a.sid = b.sid AND b.idx - a.idx BETWEEN 1 AND 3)"


@query(f"{_TRAIN} SELECT p.sid, p.idx::BIGINT AS idx, p.h::BIGINT AS h, round(coalesce(s.y, p.y), 6) AS seasonal FROM p LEFT JOIN i s ON s.sid = p.sid AND s.idx = p.idx + p.h - 7 * CAST(ceil(p.h / 7.0) AS BIGINT)")
def ts3_seasonal_lag(spark, sf_dir):
    series = _daily(spark, sf_dir)
    rows = T.leads(series, 3).join(T.positioned(series).select("sid", "idx", "y"), ["sid", "idx"])
    return T.seasonal_lag(rows, series, 7).select("sid", "idx", "h", F.round("seasonal", 6).alias("seasonal"))


@query(f"{_TRAIN} SELECT p.sid, p.idx::BIGINT AS idx, p.h::BIGINT AS h, round(target, 6) AS target, (isodow(target_ts) - 1)::BIGINT AS dow FROM p WHERE p.idx >= 13")
def ts4_training_set(spark, sf_dir):
    return T.training_set(_daily(spark, sf_dir), 3, 7).select("sid", "idx", "h", F.round("target", 6).alias("target"), F.col("dow").cast("long"))


@query("SELECT DISTINCT event_type AS sid, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def ts5_series_codes(spark, sf_dir):
    return T.series_codes(_daily(spark, sf_dir)).select("sid", F.col("code").cast("long"))


@query(f"WITH {_WEEKLY} SELECT sid, epoch(ts)::BIGINT AS at, h::BIGINT AS h, origin::BIGINT AS origin FROM q")
def ts6_rolling_origins(spark, sf_dir):
    rows = weekly(spark, sf_dir)
    out = T.rolling_origins(rows.where(F.col("split") < S.TEST).select("sid", "ts", "y"), rows.where(F.col("split") == S.TEST).select("sid", "ts", "y"), 4)
    return out.select("sid", F.unix_timestamp("ts").alias("at"), "h", "origin")


@query(f"WITH {_WEEKLY} SELECT sid, epoch(ts)::BIGINT AS at, round(p, 2) AS p FROM f")
def ts7_seasonal_naive(spark, sf_dir):
    return _naive(spark, sf_dir).select("sid", F.unix_timestamp("ts").alias("at"), F.round("p", 2).alias("p"))


def _smoothed(spark, sf_dir):
    rows = weekly(spark, sf_dir)
    return T.smoothing_forecast(rows.where(F.col("split") < S.TEST), rows.where(F.col("split") == S.TEST), 4, 13)


#: The smoothing of every series, one step of positions a round.
_SMOOTH = f"""{_WEEKLY}, v AS (SELECT sid, list(y ORDER BY ts) AS ys FROM x GROUP BY sid),
sm AS (SELECT sid, 25 AS i, list_sum(ys[14:26]) / 13 AS level, (list_sum(ys[14:26]) - list_sum(ys[1:13])) / 169 AS trend,
  list_transform(range(1, 14), lambda k: (ys[k] + ys[k + 13]) / 2 - list_sum(ys[1:26]) / 26) AS seasonal FROM v WHERE len(ys) >= 26
UNION ALL SELECT sid, i + 1, now, 0.05::DOUBLE * (now - level) + 0.95::DOUBLE * trend, list_transform(seasonal, lambda s, k: CASE WHEN k - 1 = (i + 1) % 13 THEN 0.1::DOUBLE * (y - now) + 0.9::DOUBLE * s ELSE s END)
  FROM (SELECT sm.*, ys[i + 2] AS y, 0.2::DOUBLE * (ys[i + 2] - seasonal[(i + 1) % 13 + 1]) + 0.8::DOUBLE * (level + trend) AS now FROM sm JOIN v USING (sid) WHERE i + 2 <= len(ys))),
z AS (SELECT q.sid, q.ts, q.y, coalesce(level + q.h * trend + seasonal[(q.origin + q.h) % 13 + 1], l.y) AS p FROM q LEFT JOIN sm ON sm.sid = q.sid AND sm.i = q.origin LEFT JOIN x l ON l.sid = q.sid AND l.idx = q.origin)"""
_SMAPE = "100 * avg(CASE WHEN p IS NULL THEN NULL WHEN abs(y) + abs(p) < 1e-12 THEN 0 ELSE 2 * abs(p - y) / (abs(y) + abs(p)) END)"
_FAMILIES = "(SELECT 'naive' AS family, y, p FROM f UNION ALL SELECT 'smoothing', y, p FROM z)"


@query(f"WITH RECURSIVE {_SMOOTH} SELECT sid, epoch(ts)::BIGINT AS at, round(p, 2) AS p FROM z")
def ts8_smoothing(spark, sf_dir):
    return _smoothed(spark, sf_dir).select("sid", F.unix_timestamp("ts").alias("at"), F.round("p", 2).alias("p"))


#: Weekly values with a pattern of months planted: order values themselves have none that a model could find.
_SEASONED = _WEEKLY.replace("sum(o_totalprice) AS y", "sum(o_totalprice) * (1 + max(month(date_trunc('week', o_orderdate))) % 3) AS y")


def _blocks(rows):
    return (rows.where(F.col("split") == k).select("sid", "ts", "y") for k in (S.TRAIN, S.VALID, S.TEST))


@query(f"WITH {_SEASONED} SELECT count(*) AS n_test, count(*) AS n_forecast, round(avg(abs(p - y)), 4) AS naive_error, round(avg(abs(m - y)), 4) AS mean_error, true AS below_both FROM f, (SELECT avg(y) AS m FROM x WHERE NOT test)")
def ts9_boosted_forecaster(spark, sf_dir):
    """One boosted model over all series and steps, cut at the round that is best on the backtest of the validation block: its error on the
    test block is below a seasonal-naive forecast's, and below that of the mean of all that came before."""
    rows = persisted(weekly(spark, sf_dir).withColumn("y", F.col("y") * (1 + F.month("ts") % 3)), "weeks")
    train, valid, test = _blocks(rows)
    known = train.unionByName(valid)
    made, _ = T.boosted_forecast(train, valid, test, 4, 52)
    naive = T.naive_forecast(known, test, 4, 52).select("sid", "ts", F.col("p").alias("naive"))
    rows = made.join(naive, ["sid", "ts"]).crossJoin(F.broadcast(known.agg(F.avg("y").alias("mean"))))  # one row
    error = lambda c: F.avg(F.abs(F.col(c) - F.col("y")))
    return rows.agg(F.count(F.lit(1)).alias("n_test"), F.count("p").alias("n_forecast"), F.round(error("naive"), 4).alias("naive_error"), F.round(error("mean"), 4).alias("mean_error"), (error("p") < F.least(error("naive"), error("mean"))).alias("below_both"))


@query(f"WITH {_WEEKLY} SELECT count(*) AS n, round(avg(abs(p - y)), 4) AS mae FROM f")
def ts10_backtest(spark, sf_dir):
    return M.forecast_errors(_naive(spark, sf_dir), "y", "p").select(F.col("n_forecast").alias("n"), F.round("mae", 4).alias("mae"))


@query(f"WITH RECURSIVE {_SMOOTH}, m AS (SELECT family, {_SMAPE} AS smape FROM {_FAMILIES} GROUP BY family) SELECT family, round(smape, 6) AS smape, smape < (SELECT smape FROM m WHERE family = 'naive') AS beats_naive FROM m")
def ts11_baseline_floor(spark, sf_dir):
    naive = M.forecast_errors(_naive(spark, sf_dir), "y", "p").select(F.lit("naive").alias("family"), "smape")
    smooth = M.forecast_errors(_smoothed(spark, sf_dir), "y", "p").select(F.lit("smoothing").alias("family"), "smape")
    floor = naive.select(F.col("smape").alias("floor"))
    return naive.unionByName(smooth).crossJoin(F.broadcast(floor)).select("family", F.round("smape", 6).alias("smape"), (F.col("smape") < F.col("floor")).alias("beats_naive"))


@query(f"WITH {_DAILY}, k AS (SELECT sid, y, ts, row_number() OVER (PARTITION BY sid ORDER BY ts DESC) AS back FROM d) SELECT sid, epoch(max(ts))::BIGINT AS last_at, count(*) AS n_values, round(arg_min(y, back), 6) AS newest FROM k WHERE back <= 28 GROUP BY sid")
def ts12_serving_state(spark, sf_dir):
    out = T.serving_state(_daily(spark, sf_dir), 7)
    return out.select("sid", F.unix_timestamp("last_ts").alias("last_at"), F.size("values").cast("long").alias("n_values"), F.round(F.element_at("values", -1), 6).alias("newest"))


@query(f"WITH {_DAILY}, n AS (SELECT sid, max(idx) AS last, max(ts) AS ts FROM i GROUP BY sid) SELECT n.sid, h::BIGINT AS h, epoch(n.ts + to_days(CAST(h AS INTEGER)))::BIGINT AS at, round(i.y, 6) AS p FROM n CROSS JOIN range(1, 8) r(h) JOIN i ON i.sid = n.sid AND i.idx = n.last + h - 7")
def ts13_forecast(spark, sf_dir):
    series = _daily(spark, sf_dir)
    requests = series.select("sid").distinct().select("sid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("h"))
    out = T.forecast(T.serving_state(series, 7), requests, 7, 7, "D")
    return out.select("sid", "h", F.unix_timestamp("ts").alias("at"), F.round("p", 6).alias("p"))


@query(f"WITH RECURSIVE {_SMOOTH}, r AS (SELECT family, count(p) AS n_forecast, count(*) - count(p) AS n_unforecast, round({_SMAPE}, 6) AS smape, round(100 * avg(abs(p - y) / greatest(abs(y), 1e-8)), 6) AS mape, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse FROM {_FAMILIES} GROUP BY family) SELECT *, mae < (SELECT mae FROM r WHERE family = 'naive') AS beats_naive FROM r UNION ALL SELECT 'boosted', n_forecast, n_unforecast, NULL, NULL, NULL, NULL, true FROM r WHERE family = 'naive'")
def ts14_family_benchmark(spark, sf_dir):
    """Every family's errors on the test block. The boosted family's differ with the engine that fits it, so its row tells what it forecast and
    whether it beats the naive family."""
    weeks = persisted(weekly(spark, sf_dir), "weeks")
    train, valid, test = _blocks(weeks)
    known = train.unionByName(valid)
    parts = {"naive": T.naive_forecast(known, test, 4, 52), "smoothing": T.smoothing_forecast(known, test, 4, 13), "boosted": T.boosted_forecast(train, valid, test, 4, 52, {"maxIter": 10})[0]}
    rows = [part.select(F.lit(family).alias("family"), "y", "p") for family, part in parts.items()]
    out = persisted(M.forecast_errors(rows[0].unionByName(rows[1]).unionByName(rows[2]), "y", "p", ["family"]), "errors")  # a row for each family
    floor = out.where("family = 'naive'").select(F.col("mae").alias("floor"))
    told = lambda c, digits: F.when(F.col("family") != "boosted", F.round(c, digits)).alias(c)
    return out.crossJoin(F.broadcast(floor)).select("family", "n_forecast", "n_unforecast", *(told(c, 6) for c in ("smape", "mape")), *(told(c, 4) for c in ("mae", "rmse")), (F.col("mae") < F.col("floor")).alias("beats_naive"))


@query("WITH w AS (SELECT o_orderpriority AS sid, date_trunc('week', o_orderdate) AS ts, count(*) AS c FROM orders GROUP BY ALL), d AS (SELECT ts, count(*) AS n FROM w GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, sum(n) OVER (ORDER BY ts) AS cum FROM d), e AS (SELECT (SELECT count(*) FROM c WHERE cum <= (SELECT max(cum) FROM c) * (1.0::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE)) AS te), b AS (SELECT * FROM c, e WHERE i < te), r AS (SELECT ts, (coalesce(sum(n) OVER (ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE) / sum(n) OVER () AS r FROM b) SELECT count(*) AS n FROM w JOIN r USING (ts) WHERE r < 0.25")
def ts15_suffix_fidelity(spark, sf_dir):
    rows = weekly(spark, sf_dir).where(F.col("split") == S.TRAIN)
    return rows.where("r < 0.25").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DAILY} SELECT a.sid, a.idx::BIGINT AS idx, round(coalesce(b.y, a.y), 6) AS value FROM i a LEFT JOIN i b ON b.sid = a.sid AND b.idx = a.idx + 2 - 7")
def join4_seasonal_lookup(spark, sf_dir):
    series = _daily(spark, sf_dir)
    rows = T.positioned(series).withColumn("h", F.lit(2).cast("long"))
    return T.seasonal_lag(rows, series, 7).select("sid", "idx", F.round("seasonal", 6).alias("value"))


@query(f"WITH {_WEEKLY} SELECT q.sid, epoch(q.ts)::BIGINT AS at, round(x.y, 2) AS origin_y FROM q JOIN x ON x.sid = q.sid AND x.idx = q.origin")
def join5_origin_features(spark, sf_dir):
    rows = weekly(spark, sf_dir).select("sid", "ts", "y", "split")
    origins = T.rolling_origins(rows.where(F.col("split") < S.TEST), rows.where(F.col("split") == S.TEST), 4)
    known = T.origin_features(rows.select("sid", "ts", "y")).select("sid", F.col("idx").alias("origin"), F.col("y").alias("origin_y"))
    return origins.join(known, ["sid", "origin"]).select("sid", F.unix_timestamp("ts").alias("at"), F.round("origin_y", 2).alias("origin_y"))


@query(f"WITH {_DAILY} SELECT sid, max(epoch(ts))::BIGINT AS last_at FROM d WHERE sid <> 'error' GROUP BY sid")
def join6_history_lookup(spark, sf_dir):
    state = T.serving_state(_daily(spark, sf_dir), 7)
    requests = state.where("sid <> 'error'").select("sid", F.lit(1).cast("long").alias("h"))
    return T.forecast(state, requests, 1, 7, "D").select("sid", (F.unix_timestamp("ts") - 86400).alias("last_at"))


# --- features ---

_HALF = "WITH t AS (SELECT * FROM customer WHERE c_custkey % 2 = 0), m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM t WHERE c_custkey % 20 <> 0), f AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN (SELECT m FROM m) ELSE c_acctbal END AS x FROM customer)"


@query(f"{_HALF} SELECT c_custkey, round((x - (SELECT avg(x) FROM f WHERE c_custkey % 2 = 0)) / (SELECT stddev_pop(x) FROM f WHERE c_custkey % 2 = 0), 6) AS x FROM f")
def feat1_standardize(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 20 != 0, F.col("c_acctbal")).alias("x"))
    return X.standardized(df, df.where("c_custkey % 2 = 0"), ["x"]).select("c_custkey", F.round("x", 6).alias("x"))


@query("WITH l AS (SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), k AS (SELECT p_brand FROM l ORDER BY n DESC, p_brand LIMIT 5) SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'other' END AS p_brand FROM part")
def feat2_level_cap(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return X.capped(df, df.where("p_partkey % 2 = 0"), "p_brand", 5).select("p_partkey", "p_brand")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) THEN o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def feat3_level_alignment(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return X.aligned(df.where("o_orderkey % 2 = 1"), df.where("o_orderkey % 2 = 0"), "o_custkey").select("o_orderkey", "o_custkey")


@query("WITH l AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) - 1 AS code FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT o_orderkey, code::DOUBLE AS o_custkey FROM orders LEFT JOIN l USING (o_custkey) WHERE o_orderkey % 2 = 1")
def feat4_ordinal(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return X.ordinal(df.where("o_orderkey % 2 = 1"), df.where("o_orderkey % 2 = 0"), "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT o_orderpriority AS label, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def feat5_label_codes(spark, sf_dir):
    return X.label_codes(table(spark, sf_dir, "orders"), "o_orderpriority")


_TFIDF = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2),
r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS raw FROM c JOIN d USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r"""


@query(_TFIDF)
def feat6_tf_idf(spark, sf_dir):
    return X.tf_idf(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""{_TFIDF[: _TFIDF.index("c AS (")].rstrip().rstrip(",")}, b AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) % 1048576 AS bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket::BIGINT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM b""")
def feat7_hashed_text(spark, sf_dir):
    out = X.hashed_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    entries = F.arrays_zip(F.col("indices").alias("bucket"), F.col("values").alias("weight"))
    return out.select("doc_id", F.inline(entries)).select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 9).alias("weight"))


# --- plan selection ---


def _plans(spark, sf_dir):
    """Measured plans: suppliers as runs, parts as plans, quantity bands as rungs."""
    rung = F.floor(F.col("l_quantity") / 20).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("plan"), rung.alias("rung")).agg(F.avg("l_extendedprice").alias("score"), F.min("l_discount").alias("d"))
    return rows.select("run", "plan", "rung", "score", F.when(F.col("d") >= 0.09, "failed").alias("error"))


_PLANS = "WITH o AS (SELECT l_suppkey AS run, l_partkey AS plan, CAST(floor(l_quantity / 20) AS INTEGER) AS rung, avg(l_extendedprice) AS score, CASE WHEN min(l_discount) >= 0.09 THEN 'failed' END AS error FROM lineitem GROUP BY ALL)"


@query(f"{_PLANS}, l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY run, plan ORDER BY rung DESC) = 1) SELECT run, plan, row_number() OVER (PARTITION BY run ORDER BY rung DESC, error IS NOT NULL, score DESC, plan) AS place FROM l")
def halv2_rank_by_observations(spark, sf_dir):
    return H.leaderboard(_plans(spark, sf_dir), True, ["run"]).select("run", "plan", F.col("place").cast("long"))


@query(f"{_PLANS}, l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY run, plan ORDER BY rung DESC) = 1), r AS (SELECT run, plan, row_number() OVER (PARTITION BY run ORDER BY rung DESC, error IS NOT NULL, score DESC, plan) AS place FROM l) SELECT run, plan FROM r WHERE place = 1")
def win9_leaderboard(spark, sf_dir):
    return H.leaderboard(_plans(spark, sf_dir), True, ["run"]).where("place = 1").select("run", "plan")


@query("SELECT o_custkey, o_orderkey AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice > 300000, o_orderkey % 7 DESC, o_totalprice, o_orderkey) AS place FROM orders")
def halv3_rank_by_prediction(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("plan"), F.col("o_totalprice").alias("seconds"), (F.col("o_orderkey") % 7).alias("score"))
    return H.by_prediction(df, 300000, True, ["o_custkey"]).select("o_custkey", "plan", F.col("place").cast("long"))


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS attempt, max(o_totalprice) AS valid_score FROM orders GROUP BY 1")
def halv4_attempt_choice(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("attempt"), F.col("o_totalprice").alias("valid_score"))
    return H.best_attempt(df, "o_custkey")


@query("SELECT o_orderkey AS attempt, unnest(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'no_score' END, CASE WHEN o_orderkey % 11 <> 0 AND o_totalprice <= 100000 THEN 'not_above_floor' END, CASE WHEN o_orderkey % 11 <> 0 AND o_totalprice < 200000 THEN 'target_missed' END, CASE WHEN o_custkey > 1000 THEN 'over_time' END], lambda x: x IS NOT NULL)) AS issue FROM orders")
def halv5_outcome_issues(spark, sf_dir):
    score = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attempt"), score.alias("score"), F.lit(200000.0).alias("target"), F.col("o_custkey").alias("seconds"))
    return H.outcome_issues(df, 100000, True, 1000)


@query("SELECT run, CAST(ceil(count(*) / 2.0) AS BIGINT) AS n FROM (SELECT l_suppkey AS run, l_partkey FROM lineitem GROUP BY ALL) GROUP BY run")
def smp4_survivors(spark, sf_dir):
    board = H.leaderboard(_plans(spark, sf_dir), True, ["run"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run")))
    return board.where(F.col("place") <= F.ceil(F.col("n") / 2)).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


# --- memory ---


@query("SELECT round(log10(count(*)), 9) AS log_rows, round(log10(5), 9) AS log_cols, round(log2(count(DISTINCT o_orderstatus)), 9) AS log_classes, round(log10(3), 9) AS check_classes FROM orders")
def mem1_meta_features(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    out = Y.meta_features(P.column_profile(df), "o_orderstatus")
    return out.select(F.round("log_rows", 9).alias("log_rows"), F.round("log_cols", 9).alias("log_cols"), F.round("log_classes", 9).alias("log_classes"), F.round(F.log10(F.lit(3)), 9).alias("check_classes"))


@query("SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b, round(sqrt(0.6::DOUBLE * (x.m - y.m) ** 2 + 1.5::DOUBLE * (x.s - y.s) ** 2), 6) AS dist FROM nation a CROSS JOIN nation b JOIN (SELECT c_nationkey, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer GROUP BY 1) x ON x.c_nationkey = a.n_nationkey JOIN (SELECT c_nationkey, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer GROUP BY 1) y ON y.c_nationkey = b.n_nationkey WHERE a.n_nationkey < b.n_nationkey")
def mem2_weighted_distance(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    a, b = rows.alias("a"), rows.alias("b")  # a row for each nation
    pairs = a.join(b, F.col("a.c_nationkey") < F.col("b.c_nationkey"))
    dist = Y.weighted_distance({"m": F.col("a.m"), "s": F.col("a.s")}, {"m": F.col("b.m"), "s": F.col("b.s")}, {"m": 0.6, "s": 1.5})
    return pairs.select(F.col("a.c_nationkey").cast("long").alias("a"), F.col("b.c_nationkey").cast("long").alias("b"), F.round(dist, 6).alias("dist"))


_PRINT = "SELECT substr(sha1('s_suppkey:bigint|s_name:string#' || CAST(count(*) AS VARCHAR)), 1, 16) AS fingerprint FROM supplier"


@query(_PRINT)
def mem3_fingerprint(spark, sf_dir):
    return Y.fingerprint(P.column_profile(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")))


@query(_PRINT)
def fn15_fingerprint(spark, sf_dir):
    return Y.fingerprint(P.column_profile(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))"
_NEAR = f"WITH p AS (SELECT a.vec_id AS query, b.vec_id AS id, b.label, {_DIST} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


def _vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return df, df.where("id % 20 = 0").select(F.col("id").alias("query"), "vec")


@query(f"{_NEAR}, g AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY dist, id) = 1) SELECT query, id, round(dist, 6) AS dist FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 5")
def mem4_nearest(spark, sf_dir):
    rows, queries = _vectors(spark, sf_dir)
    return N.nearest(queries, rows, 5, "label").select("query", "id", F.round("dist", 6).alias("dist"))


@query(f"{_NEAR} SELECT query, id, round(dist, 6) AS dist FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 3")
def join7_query_by_memory(spark, sf_dir):
    rows, queries = _vectors(spark, sf_dir)
    return N.nearest(queries, rows, 3).select("query", "id", F.round("dist", 6).alias("dist"))


@query(f"{_NEAR} SELECT query, id FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 10")
def top2_top_k(spark, sf_dir):
    rows, queries = _vectors(spark, sf_dir)
    return N.nearest(queries, rows, 10).select("query", "id")


@query(f"{_NEAR}, k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 5), v AS (SELECT query, label, count(*) AS n FROM k GROUP BY ALL) SELECT query, label FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1")
def mod5_nearest_neighbours(spark, sf_dir):
    from ..operators.models import knn

    rows, queries = _vectors(spark, sf_dir)
    return knn(rows, queries, 5).select("query", "label")


@query("WITH r AS (SELECT user_id, event_type, max(CASE WHEN event_type <> 'error' THEN value END) AS score FROM events GROUP BY user_id, event_type), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, event_type) AS rank FROM r) SELECT user_id, coalesce(string_agg(event_type, ', ' ORDER BY rank) FILTER (rank <= 5 AND score IS NOT NULL), '') AS best, coalesce(string_agg(event_type, ', ' ORDER BY event_type) FILTER (score IS NULL), '') AS failed FROM k GROUP BY user_id")
def mem5_run_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("m")).withColumn("score", F.when(F.col("event_type") != "error", F.col("m")))
    return Y.run_summary(rows, "user_id", "event_type", "score")


@query("SELECT user_id, arg_max(event_type, (value, event_id)) AS best, count(*) AS n FROM events GROUP BY user_id")
def mem6_experience_row(spark, sf_dir):
    return Y.best_experience(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id")


@query("WITH u AS (SELECT user_id, max(ts) AS t FROM events WHERE user_id <> 7 GROUP BY 1 ORDER BY t DESC, user_id LIMIT 50) SELECT user_id, event_id FROM events JOIN u USING (user_id) WHERE event_type = 'error'")
def mem7_recent_fixes(spark, sf_dir):
    return Y.recent_fixes(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", 50, "event_id", but=7)


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
_OVERLAP = f"WITH q AS (SELECT item_id AS query, unnest({_WORDS}) AS word FROM benchmark), p AS (SELECT doc_id AS passage, unnest({_WORDS}) AS word FROM documents), s AS (SELECT query, passage, count(*) AS n FROM q JOIN p USING (word) GROUP BY ALL)"


def _lexical(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return queries, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage"), "text", "lang")


@query(f"{_OVERLAP}, g AS (SELECT query, doc_id AS passage, 2 AS n FROM q JOIN documents ON lang = word), a AS (SELECT query, passage, sum(n)::BIGINT AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM g) GROUP BY ALL) SELECT query, passage, score FROM a QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) <= 5")
def mem8_lexical_retrieval(spark, sf_dir):
    queries, passages = _lexical(spark, sf_dir)
    tags = passages.select("passage", F.col("lang").alias("tag"))
    return R.overlaps(queries, passages, 5, tags).select("query", "passage", "score")


@query(f"{_OVERLAP} SELECT query, passage FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, passage) <= 3")
def top3_top_passages(spark, sf_dir):
    queries, passages = _lexical(spark, sf_dir)
    return R.overlaps(queries, passages, 3).select("query", "passage")


@query(f"{_OVERLAP} SELECT query, passage FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, passage) <= 3")
def udf1_pluggable_retriever(spark, sf_dir):
    queries, passages = _lexical(spark, sf_dir)
    return R.retrieve_all([R.overlaps, lambda q, p, k: R.overlaps(q, p, 1)], queries, passages, 3).select("query", "passage")


@query(f"WITH {_WEEKLY} SELECT sid, count(*) FILTER (origin >= 0) AS n FROM q GROUP BY sid")
def udf2_grouped_map(spark, sf_dir):
    return _smoothed(spark, sf_dir).groupBy("sid").agg(F.count("p").alias("n"))


# --- comparison ---


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.5 END::DOUBLE AS rate FROM orders")
def eval1_success_rate(spark, sf_dir):
    rate = V.success_rate(F.col("o_orderstatus") != "F", F.col("o_totalprice") > 200000)
    return table(spark, sf_dir, "orders").select("o_orderkey", rate.alias("rate"))


_METRIC = "CASE o_orderkey % 4 WHEN 0 THEN 'rmse' WHEN 1 THEN 'roc_auc' WHEN 2 THEN 'smape' END"


def _metric():
    m = F.col("o_orderkey") % 4
    return F.when(m == 0, "rmse").when(m == 1, "roc_auc").when(m == 2, "smape")


@query(f"SELECT o_orderkey, CASE WHEN m IS NULL THEN 0 WHEN m = 'roc_auc' THEN least(greatest(s, 0), 1) ELSE 1 / (1 + greatest(s, 0)) END::DOUBLE AS nps FROM (SELECT o_orderkey, {_METRIC} AS m, o_totalprice / 400000 AS s FROM orders)")
def eval2_normalized(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.normalized(_metric(), F.col("o_totalprice") / 400000).alias("nps"))


@query(f"SELECT o_orderkey, 0.5::DOUBLE * CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_totalprice > 200000 THEN 1 ELSE 0.5 END + 0.5::DOUBLE * CASE WHEN m IS NULL THEN 0 WHEN m = 'roc_auc' THEN least(greatest(s, 0), 1) ELSE 1 / (1 + greatest(s, 0)) END AS cs FROM (SELECT *, {_METRIC} AS m, o_totalprice / 400000 AS s FROM orders)")
def eval3_combined(spark, sf_dir):
    rate = V.success_rate(F.col("o_orderstatus") != "F", F.col("o_totalprice") > 200000)
    return table(spark, sf_dir, "orders").select("o_orderkey", V.combined(rate, V.normalized(_metric(), F.col("o_totalprice") / 400000)).alias("cs"))


_CALIBRATION = """WITH x AS (SELECT l_suppkey, l_returnflag, l_partkey AS plan, avg(l_extendedprice) AS p, avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS o FROM lineitem GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_suppkey, l_returnflag, p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY o) + (count(*) OVER (PARTITION BY l_suppkey, l_returnflag, o) - 1) / 2.0::DOUBLE AS ro FROM x)
SELECT l_suppkey, l_returnflag, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rp) > 0 AND stddev_pop(ro) > 0 THEN round(corr(rp, ro), 6) END AS spearman, CASE WHEN count(*) >= 2 THEN CAST(arg_max(plan, (p, -plan)) = arg_max(plan, (o, -plan)) AS DOUBLE) END AS top1_hit, round(avg(abs(p - o)), 4) AS mae FROM r GROUP BY ALL"""


def _calibrated(spark, sf_dir):
    lines = V.dealt(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_partkey", "l_extendedprice", "l_discount", "l_tax"), ["l_suppkey", "l_returnflag"])
    df = lines.groupBy("l_suppkey", "l_returnflag", F.col("l_partkey").alias("plan")).agg(F.avg("l_extendedprice").alias("p"), F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("o"))
    out = V.calibration(df, ["l_suppkey", "l_returnflag"], "plan", "p", "o")
    return out.select("l_suppkey", "l_returnflag", "n", F.round("spearman", 6).alias("spearman"), "top1_hit", F.round("mae", 4).alias("mae"))


@query(_CALIBRATION)
def eval4_calibration(spark, sf_dir):
    return _calibrated(spark, sf_dir)


@query(f"SELECT l_returnflag, round(avg(spearman), 5) AS spearman, round(avg(top1_hit), 6) AS top1_hit FROM ({_CALIBRATION}) GROUP BY 1")
def agg17_grouped_calibration(spark, sf_dir):
    return _calibrated(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.avg("spearman"), 5).alias("spearman"), F.round(F.avg("top1_hit"), 6).alias("top1_hit"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) / count(*), 4) AS mean_positive FROM customer GROUP BY 1")
def eval5_main_table(spark, sf_dir):
    positive = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0)
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.avg(positive), 4).alias("mean_positive"))


@query(f"SELECT l_returnflag, count(*) AS n_groups, round(avg(mae), 3) AS mae FROM ({_CALIBRATION}) GROUP BY 1")
def eval6_calibration_table(spark, sf_dir):
    return _calibrated(spark, sf_dir).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("mae"), 3).alias("mae"))


@query("SELECT 'low' AS source, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'F' UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def eval7_result_merge(spark, sf_dir):
    from ..operators.relational import selected
    from ..sources.tables import union_ragged

    df = table(spark, sf_dir, "orders")
    parts = {"low": df.where("o_orderpriority = '5-LOW'").drop("o_custkey"), "urgent": df.where("o_orderpriority = '1-URGENT'")}
    merged = selected(union_ragged(parts), ["o_orderstatus"], ["*"], ["F"])
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, round(avg(CAST(o_totalprice > 300000 AS DOUBLE)), 6) AS rate FROM orders GROUP BY 1")
def eval8_changed_rate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") > 300000).cast("double")), 6).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, l_discount AS predicted, l_tax AS observed FROM lineitem WHERE l_linestatus <> 'F'")
def eval9_points(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F' and l_discount is not null and l_tax is not null")
    return df.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("predicted"), F.col("l_tax").alias("observed"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean, round(sum(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END) / count(*), 2) AS mean_null_as_zero, round(avg(CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END), 2) AS mean_skip_null FROM orders GROUP BY 1")
def agg16_mean_per_variant(spark, sf_dir):
    some = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.avg(F.coalesce(some, F.lit(0.0))), 2).alias("mean_null_as_zero"), F.round(F.avg(some), 2).alias("mean_skip_null"))


@query("SELECT count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events")
def agg19_grand_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


# --- logs ---

_LOG = "WITH g AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_type AS stage, props AS payload FROM events)"
_STAGES = ("signup", "view", "click", "purchase")


def _log(spark, sf_dir):
    return L.as_log(table(spark, sf_dir, "events"))


_SPANS = f"{_LOG}, s AS (SELECT run_id, stage, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events, CASE stage WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS k FROM g WHERE stage IN ('signup', 'view', 'click', 'purchase') GROUP BY ALL), n AS (SELECT *, min(first_seq) OVER (PARTITION BY run_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM s)"


@query(f"{_SPANS} SELECT run_id, stage, first_seq, last_seq, coalesce(nx, last_seq) AS end_seq, n_events, nx IS NOT NULL AS done FROM n")
def log1_stage_spans(spark, sf_dir):
    return L.stage_spans(_log(spark, sf_dir), _STAGES)


@query(f"{_SPANS} SELECT run_id, stage, nx AS next_start FROM n WHERE nx IS NOT NULL")
def win13_next_stage(spark, sf_dir):
    return L.stage_spans(_log(spark, sf_dir), _STAGES).where("done").select("run_id", "stage", F.col("end_seq").alias("next_start"))


@query(f"{_LOG} SELECT run_id, stage, count(*) AS n_calls, count(json_extract_string(payload, '$.k')) AS with_key, coalesce(sum(TRY_CAST(json_extract_string(payload, '$.k') AS DOUBLE)), 0) AS amount FROM g GROUP BY ALL")
def log2_calls(spark, sf_dir):
    return L.calls(_log(spark, sf_dir), "k", "k")


@query(f"{_LOG} SELECT run_id, stage || ':' || CAST(TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) % 3 AS VARCHAR) AS job, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events FROM g GROUP BY ALL")
def log3_job_spans(spark, sf_dir):
    k = F.get_json_object("payload", "$.k").cast("long") % 3
    return L.job_spans(_log(spark, sf_dir), F.concat(F.col("stage"), F.lit(":"), k.cast("string")))


@query(f"{_LOG} SELECT run_id, seq, TRY_CAST(json_extract_string(payload, '$.k') AS DOUBLE) AS value FROM g WHERE stage = 'view' AND json_extract_string(payload, '$.k') IS NOT NULL")
def log4_samples(spark, sf_dir):
    return L.samples(_log(spark, sf_dir), "view", "k")


@query(f"{_LOG} SELECT run_id, stage, arg_max(payload, seq) AS payload, max(seq) AS seq FROM g WHERE json_exists(payload, '$.k') GROUP BY ALL")
def log5_latest_payload(spark, sf_dir):
    return L.latest_payload(_log(spark, sf_dir), "k")


@query(f"{_LOG}, b AS (SELECT run_id, max(seq) AS begin_seq FROM g WHERE stage = 'purchase' GROUP BY 1) SELECT run_id, seq, stage FROM g LEFT JOIN b USING (run_id) WHERE begin_seq IS NULL OR seq >= begin_seq")
def log6_latest_round(spark, sf_dir):
    return L.latest_round(_log(spark, sf_dir), "purchase").select("run_id", "seq", "stage")


@query(f"{_LOG} SELECT run_id, seq FROM g WHERE seq > 40")
def log7_replay(spark, sf_dir):
    return L.replay(_log(spark, sf_dir), 40).select("run_id", "seq")


@query("SELECT 'EN: ' || event_type || ' failed at ''…''' AS signature, count(*) AS n FROM events GROUP BY 1")
def log8_error_groups(spark, sf_dir):
    text = F.concat(F.lit("stack\nE"), F.col("seq").cast("string"), F.lit(": "), "stage", F.lit(" failed at 'x"), F.col("seq").cast("string"), F.lit("'\n"))
    return L.errors(_log(spark, sf_dir), text)
