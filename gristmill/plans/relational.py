"""Queries of projections, joins, set operations, samples and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar, text
from ..functions.hashing import row_hash, uniform, uniform_sql
from ..operators import ranks
from ..operators import relational as R
from ..operators import split as P
from ..operators.profile import time_steps
from .registry import query, table

_R = uniform_sql("o_orderkey", "r")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def prj1_feature_selection(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select(R.features(df, "o_totalprice", ["o_orderdate"])).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(f"SELECT o_orderkey FROM orders WHERE {uniform_sql('o_orderkey', 'cut')} >= 0.85")
def prj2_split_filter(spark, sf_dir):
    draw = uniform(F.col("o_orderkey"), "cut")
    split = F.when(draw < 0.7, P.TRAIN).when(draw < 0.85, P.VALID).otherwise(P.TEST)
    return table(spark, sf_dir, "orders").withColumn("split", split).where(F.col("split") == P.TEST).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE {_R} < 1000.0::DOUBLE / (SELECT count(*) FROM orders)")
def prj3_nested_subsample(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return R.subsample(df, uniform(F.col("o_orderkey"), "r"), df.count(), 1000).select("o_orderkey")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price, CAST(o_totalprice > 100000 AS BIGINT) AS dear FROM orders")
def prj4_type_narrowing(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_totalprice") > 100000).alias("dear"))
    return R.narrowed(df).select("o_orderkey", F.col("price").cast("double"), F.col("dear").cast("long"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 255 ELSE 0 END::BIGINT AS split FROM orders")
def prj5_null_target_exclusion(spark, sf_dir):
    target = F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.excluding_null(F.lit(P.TRAIN), target).cast("long").alias("split"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def prj6_unseen_label_drop(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    seen = df.where("o_orderkey % 2 = 0").select("o_custkey").distinct()
    return df.where("o_orderkey % 2 = 1").join(seen, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN '' ELSE text END AS body, CAST(n_chars AS VARCHAR) AS label FROM documents")
def prj7_text_null_fill(spark, sf_dir):
    body = F.when(F.col("doc_id") % 20 != 0, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(body, F.lit("")).alias("body"), F.col("n_chars").cast("string").alias("label"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def prj8_scoring_projection(spark, sf_dir):
    from ..operators.scoring import checked_columns

    return checked_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"])


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_linestatus = 'O' AS DOUBLE) AS flag FROM lineitem")
def prj9_numeric_coercion(spark, sf_dir):
    from ..operators.scoring import numeric

    df = table(spark, sf_dir, "lineitem")
    df = df.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("l_quantity"), F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("flag"))
    return numeric(df, ["l_quantity", "flag"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 30 < 3 THEN 0 ELSE o_totalprice END AS price FROM orders")
def prj10_finite_values(spark, sf_dir):
    key = F.col("o_orderkey") % 30
    price = F.when(key == 0, float("nan")).when(key == 1, float("inf")).when(key == 2, float("-inf")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.finite(price).alias("price"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderpriority = '1-URGENT') AND NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def prj11_run_selector(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return R.selected(df, ["o_orderstatus", "o_orderpriority"], ["O:*", "*:1-URGENT"], ["F:1-URGENT"]).select("o_orderkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join1_data_with_key(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").join(customer, "o_custkey").select("o_orderkey", "c_name")


_HALVES = "WITH x AS (SELECT l_orderkey, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, l_returnflag AS f, l_discount AS d FROM lineitem)"


@query(f"{_HALVES} SELECT l_orderkey, q, f, d FROM x a WHERE l_orderkey % 10 = 0 AND EXISTS (SELECT 1 FROM x b WHERE b.l_orderkey % 10 <> 0 AND a.q IS NOT DISTINCT FROM b.q AND a.f IS NOT DISTINCT FROM b.f AND a.d IS NOT DISTINCT FROM b.d)")
def join2_duplicate_membership(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("q"), F.col("l_returnflag").alias("f"), F.col("l_discount").alias("d"))
    return R.null_safe_members(df.where("l_orderkey % 10 = 0"), df.where("l_orderkey % 10 <> 0"), ["q", "f", "d"])


@query("""
WITH s AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey), p AS (SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, round(coalesce(s.m, p.m), 4) AS m FROM orders LEFT JOIN s USING (o_custkey) CROSS JOIN p WHERE o_orderkey % 5 = 0
""")
def join3_lookup_with_prior(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    train, held = df.where("o_orderkey % 5 <> 0"), df.where("o_orderkey % 5 = 0")
    prior = train.agg(F.avg("o_totalprice")).first()[0]
    means = train.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return R.lookup(held, means, "o_custkey", "m", F.lit(prior)).select("o_orderkey", F.round("m", 4).alias("m"))


@query("SELECT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase') GROUP BY ALL")
def join8_exclusion(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return df.join(df.where("event_type = 'purchase'").select("user_id"), "user_id", "left_anti")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW')")
def join9_selected_members(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    chosen = R.selected(df, ["o_orderpriority"], ["5-LOW"]).select("o_custkey", "o_orderstatus")
    return df.join(chosen, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 7 < 6 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 < 5) AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 5) GROUP BY o_custkey")
def join10_history_merge(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    train, valid = df.where("o_orderkey % 7 < 5"), df.where("o_orderkey % 7 = 5")
    both = train.unionByName(valid).join(train.select("o_custkey"), "o_custkey", "left_semi").join(valid.select("o_custkey"), "o_custkey", "left_semi")
    return both.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def top1_sort_by_series(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey FROM orders WHERE {_R} < 500.0::DOUBLE / (SELECT count(*) FROM orders)")
def top6_unbiased_cap(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return R.subsample(df, uniform(F.col("o_orderkey"), "r"), df.count(), 500).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0")
def smp1_strided(spark, sf_dir):
    return R.strided(table(spark, sf_dir, "orders"), "o_orderkey", 13).select("o_orderkey")


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id FROM events, n WHERE event_id % (n // 100) < 2000 // 100 AND event_id < (n // 100) * 100")
def smp2_block_sample(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return R.block_sample(df, "event_id", df.count(), 100, 2000).select("event_id")


_DRAW = uniform_sql("o_orderkey", "holdout")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_DRAW}, o_orderkey) > (SELECT count(*) FROM orders) * 0.8::DOUBLE AS held FROM orders")
def smp3_shuffled_holdout(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rows = ranks.ranked(df.select("o_orderkey"), uniform(F.col("o_orderkey"), "holdout"), [F.col("o_orderkey")])
    return rows.select("o_orderkey", (F.col("rank") + 1 > F.lit(df.count() * 0.8)).alias("held"))


@query("SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1)")
def set1_union_all(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.where("o_orderkey % 2 = 0").unionByName(df.where("o_orderkey % 2 = 1")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS key, s_name AS name, NULL::DOUBLE AS balance, 'supplier' AS source FROM supplier UNION ALL SELECT c_custkey, NULL, c_acctbal, 'customer' FROM customer")
def set2_ragged_union(spark, sf_dir):
    from ..sources.tables import union_ragged

    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return union_ragged({"supplier": supplier, "customer": customer}).select("key", "name", "balance", "source")


@query("SELECT o_custkey AS id, min(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END)::BIGINT AS came_from FROM orders GROUP BY 1")
def set3_first_wins(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    frame = lambda cond, i: df.where(cond).select(F.col("o_custkey").alias("id"), F.lit(i).cast("long").alias("came_from"))
    return R.first_wins([frame("o_orderstatus = 'F'", 0), frame("o_orderstatus <> 'F'", 1)], "id")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def set4_difference(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.where("o_orderstatus = 'F'").select("o_custkey").distinct().join(df.where("o_orderpriority = '5-LOW'"), "o_custkey", "left_anti")


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"SELECT doc_id, CAST(len(list_intersect({_TOKENS.format('text')}, {_TOKENS.format('source || lang')})) AS BIGINT) AS shared FROM documents")
def set5_token_overlap(spark, sf_dir):
    both = F.array_intersect(text.word_tokens(F.col("text")), text.word_tokens(F.concat("source", "lang")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(both).cast("long").alias("shared"))


@query("SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9]', '', 'g') AS plain FROM customer")
def fn1_plain_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.plain_name(F.col("c_name")).alias("plain"))


@query("SELECT p_partkey, length(p_name) AS n, contains(p_type, 'STEEL') AS steel, starts_with(p_brand, 'Brand') AS brand, suffix(p_name, 'e') AS ends FROM part")
def fn2_string_predicates(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", F.char_length("p_name").cast("long").alias("n"), c("p_type").contains("STEEL").alias("steel"), c("p_brand").startswith("Brand").alias("brand"), c("p_name").endswith("e").alias("ends"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M')
  WHEN 4 THEN strftime(o_orderdate, '%Y-13-%d') WHEN 5 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey END AS t FROM orders)
SELECT o_orderkey, try_strptime(t, ['%Y-%m-%d', '%Y/%m', '%d/%m/%Y', '%Y-%m-%d %H:%M']) IS NOT NULL AS is_date FROM t
""")
def fn3_date_pattern(spark, sf_dir):
    written = lambda form: F.date_format("o_orderdate", form)
    forms = [written("yyyy-MM-dd"), written("yyyy/MM"), written("dd/MM/yyyy"), written("yyyy-MM-dd HH:mm"), written("yyyy-'13'-dd"), F.col("o_orderpriority")]
    raw = F.concat_ws("-", written("yyyy-MM-dd"), F.col("o_custkey").cast("string"))
    for i, form in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 7 == i, form).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_like(raw).alias("is_date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))::BIGINT END AS seconds FROM orders")
def fn4_lenient_timestamp(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 9 == 0, "soon").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    parsed = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")), F.try_to_timestamp(raw, F.lit("yyyy/MM/dd")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(parsed).alias("seconds"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price FROM orders")
def fn5_lenient_number(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.try_cast("double").alias("price"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n_tokens FROM documents")
def fn6_word_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(text.word_tokens(F.col("text")))).cast("long").alias("n_tokens"))


@query("SELECT CASE WHEN o_custkey % 5 = 0 THEN 'nan' ELSE o_orderpriority END || '-' || o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1")
def fn7_composite_key(spark, sf_dir):
    key = text.composite_key(F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, substr(text, 1, 80) AS sample FROM documents")
def fn8_sample_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.col("text").cast("string"), 1, 80).alias("sample"))


@query(r"""
WITH t AS (SELECT event_id, CASE WHEN event_type = 'view' THEN concat('Traceback', chr(10), '  File "x.py", line 7', chr(10), 'KeyError: ''', user_id, '''', chr(10), chr(10))
  WHEN event_type = 'click' THEN concat('lib.io.DiskWarning: ', event_id, ' of "', user_id, '" lost', chr(10), 'note: 12 more above', chr(10))
  WHEN event_type = 'purchase' THEN concat('step ', event_id, chr(10), ' killed at ', user_id, ' by ''oom''') ELSE ' ' END AS log FROM events),
l AS (SELECT event_id, list_filter(list_transform(string_split(log, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
n AS (SELECT event_id, coalesce(list_filter(lines, lambda x: regexp_matches(x, '^[\w.]+(Error|Exception|Warning)\b'))[-1], lines[-1], 'unknown error') AS line FROM l)
SELECT event_id, substr(regexp_replace(regexp_replace(line, '''[^'']*''|"[^"]*"', '''…''', 'g'), '\d+', 'N', 'g'), 1, 200) AS signature FROM n
""")
def fn9_error_signature(spark, sf_dir):
    kind, number, user = F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    log = F.when(kind == "view", F.concat(F.lit("Traceback\n  File \"x.py\", line 7\nKeyError: '"), user, F.lit("'\n\n")))
    log = log.when(kind == "click", F.concat(F.lit("lib.io.DiskWarning: "), number, F.lit(' of "'), user, F.lit('" lost\nnote: 12 more above\n')))
    log = log.when(kind == "purchase", F.concat(F.lit("step "), number, F.lit("\n killed at "), user, F.lit(" by 'oom'"))).otherwise(" ")
    return table(spark, sf_dir, "events").select("event_id", text.error_signature(log).alias("signature"))


@query("SELECT o_orderkey, (isodow(o_orderdate) - 1)::BIGINT AS dow, month(o_orderdate)::BIGINT AS month, day(o_orderdate)::BIGINT AS dom, CAST(isodow(o_orderdate) >= 6 AS BIGINT) AS weekend FROM orders")
def fn10_calendar_parts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *(v.cast("long").alias(k) for k, v in calendar.parts(F.col("o_orderdate")).items()))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN 60 WHEN 1 THEN 24 WHEN 2 THEN 7 WHEN 3 THEN 52 WHEN 4 THEN 12 ELSE 4 END AS BIGINT) AS season FROM orders")
def fn11_season_length(spark, sf_dir):
    names = ["1min", "H", "D", "W", "M", "Q"]
    seasons = F.array(*(F.lit(calendar.season_length(x)) for x in names))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(seasons, F.pmod("o_orderkey", F.lit(6)).cast("int")).cast("long").alias("season"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS VARCHAR) AS day_after, CAST(CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 5 AS INTEGER)) AS DATE) AS VARCHAR) AS month_after, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) + CASE WHEN isodow(o_orderdate) = 7 THEN 13 ELSE 6 END AS VARCHAR) AS sunday FROM orders")
def fn12_date_steps(spark, sf_dir):
    k, ts = F.pmod("o_orderkey", F.lit(5)).cast("int"), F.col("o_orderdate")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", day(calendar.step(ts, k, "D")).alias("day_after"), day(calendar.step(ts, k, "M")).alias("month_after"), day(calendar.step(ts, F.lit(1), "W")).alias("sunday"))


@query("SELECT o_orderkey, round(log10(o_totalprice), 6) AS l10, round(log2(o_totalprice), 6) AS l2, round(sqrt(o_totalprice), 4) AS root, ceil(o_totalprice)::BIGINT AS up, round(ln(1 + o_totalprice), 6) AS l1p, greatest(o_totalprice, 1000.0::DOUBLE) AS clipped, CAST(round_even(o_orderkey * 0.5::DOUBLE, 0) AS BIGINT) AS half FROM orders")
def fn13_numeric_functions(spark, sf_dir):
    x = F.col("o_totalprice")
    half = F.bround(F.col("o_orderkey") * F.lit(0.5), 0).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.log10(x), 6).alias("l10"), F.round(F.log2(x), 6).alias("l2"), F.round(F.sqrt(x), 4).alias("root"), F.ceil(x).cast("long").alias("up"), F.round(F.log1p(x), 6).alias("l1p"), F.greatest(x, F.lit(1000.0)).alias("clipped"), half.alias("half"))


@query("SELECT c_custkey, md5(concat(c_name, chr(31), c_nationkey, chr(31), CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(round(c_acctbal * 100) AS BIGINT) || '' END)) AS row_hash FROM customer")
def fn14_row_hash(spark, sf_dir):
    cents = F.when(F.col("c_custkey") % 7 != 0, F.round(F.col("c_acctbal") * 100).cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", row_hash(F.col("c_name"), F.col("c_nationkey"), cents).alias("row_hash"))


@query("""
SELECT user_id, round(m, 4) AS step, CASE WHEN m BETWEEN 30 AND 90 THEN '1min' WHEN m BETWEEN 1800 AND 5400 THEN 'H' WHEN m BETWEEN 43200 AND 129600 THEN 'D' WHEN m BETWEEN 432000 AND 777600 THEN 'W' WHEN m BETWEEN 2160000 AND 3024000 THEN 'M' END AS frequency
FROM (SELECT user_id, quantile_cont(d, 0.5) AS m FROM (SELECT user_id, (s - lag(s) OVER (PARTITION BY user_id ORDER BY s))::DOUBLE AS d FROM (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS s FROM events)) WHERE d IS NOT NULL GROUP BY user_id)
""")
def fn16_frequency(spark, sf_dir):
    seconds = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("s")).distinct()
    steps = seconds.select("user_id", (F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("s"))).alias("d")).where("d is not null")
    medians = steps.groupBy("user_id").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    return medians.select("user_id", F.round("m", 4).alias("step"), calendar.frequency(F.col("m")).alias("frequency"))


#: Order dates as series of six kinds: days, weekdays, weeks, months, middles of months, quarters.
_KINDS = """k AS (SELECT DISTINCT unnest(['day', 'weekday', 'week', 'month', 'middle', 'quarter']) AS kind, o_orderdate AS t FROM orders),
s AS (SELECT DISTINCT kind, CASE kind WHEN 'day' THEN date_trunc('day', t) WHEN 'weekday' THEN CASE WHEN isodow(t) <= 5 THEN date_trunc('day', t) END WHEN 'week' THEN date_trunc('week', t) WHEN 'month' THEN date_trunc('month', t) WHEN 'middle' THEN date_trunc('month', t) + INTERVAL 14 DAY ELSE date_trunc('quarter', t) END AS t FROM k),
d AS (SELECT kind, quantile_cont(d, 0.5) / 86400 AS m FROM (SELECT kind, epoch(t) - lag(epoch(t)) OVER (PARTITION BY kind ORDER BY t) AS d FROM s WHERE t IS NOT NULL) WHERE d IS NOT NULL GROUP BY kind),
f AS (SELECT kind, count(DISTINCT isodow(t)) AS weekdays, max(isodow(t)) AS last, count(DISTINCT month(t) % 3) AS residues, bool_and(day(t) = 1) OR bool_and(t = last_day(t)) AS anchored, count(*) AS days FROM s WHERE t IS NOT NULL GROUP BY kind)"""


@query(f"WITH {_KINDS} SELECT kind, CASE WHEN m < 0.5 THEN NULL WHEN m <= 1.5 AND last <= 5 AND weekdays = 5 AND days > 5 THEN 'B' WHEN m <= 1.5 THEN 'D' WHEN m BETWEEN 5 AND 9 AND weekdays = 1 THEN 'W' WHEN m BETWEEN 25 AND 35 AND anchored THEN 'M' WHEN m BETWEEN 85 AND 95 AND anchored AND residues = 1 THEN 'Q' END AS frequency FROM d JOIN f USING (kind)")
def fn16_calendar_frequency(spark, sf_dir):
    """Business days are told from days, quarters from months, and months from steps of a month that begin in its middle."""
    t = F.col("o_orderdate")
    day, month = F.date_trunc("day", t), F.date_trunc("month", t)
    kinds = {"day": day, "weekday": F.when(F.weekday(t) < 5, day), "week": F.date_trunc("week", t), "month": month, "middle": month + F.make_dt_interval(days=F.lit(14)), "quarter": F.date_trunc("quarter", t)}
    rows = table(spark, sf_dir, "orders").select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("t")) for k, v in kinds.items())))).where("t is not null").distinct()
    steps = time_steps(rows, "t", "kind").groupBy(F.col("series").alias("kind")).agg(F.percentile("d", F.lit(0.5)).alias("m"))
    return calendar.calendar_frequency(rows, ["kind"], "t", steps)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has FROM events")
def fn17_json_access(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.isNotNull().alias("has"))


@query("SELECT o_custkey, round(max(n)::DOUBLE / sum(n), 6) AS best, round(min(n)::DOUBLE / sum(n), 6) AS worst FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def fn18_share_map(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("o_custkey"))
    shares = counts.withColumn("share", F.col("n") / total).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "share"))).alias("shares"))
    values = F.map_values("shares")
    return shares.select("o_custkey", F.round(F.array_max(values), 6).alias("best"), F.round(F.array_min(values), 6).alias("worst"))
