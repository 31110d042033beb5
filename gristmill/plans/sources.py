"""Source and sink queries: tables are written in a format and read back from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as S
from ..sources.shared import new_path
from .registry import query, table

_CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("long"), F.col("c_acctbal").cast("double"), "c_mktsegment")


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


@query(_CUSTOMER)
def src1_csv_scan(spark, sf_dir):
    path = new_path(spark, "src1")
    _customer(spark, sf_dir).write.option("header", True).csv(path)
    return _typed(S.load_table(spark, path, suffix=".csv"))


@query(_CUSTOMER)
def src2_tsv_scan(spark, sf_dir):
    path = new_path(spark, "src2")
    _customer(spark, sf_dir).write.option("header", True).option("sep", "\t").csv(path)
    return _typed(S.load_table(spark, path, suffix=".tsv"))


@query(_CUSTOMER)
def src3_json_lines_scan(spark, sf_dir):
    path = new_path(spark, "src3")
    _customer(spark, sf_dir).write.json(path)
    return _typed(S.load_table(spark, path, suffix=".jsonl"))


@query("SELECT o_custkey, count(*) AS n_orders, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey")
def src4_json_documents(spark, sf_dir):
    """Each customer's orders as one JSON document, an array of records; many documents, so that no file holds a table."""
    path = new_path(spark, "src4")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    documents = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_custkey", "o_orderkey")).alias("records"))
    documents.select(F.to_json("records").alias("value")).write.text(path)
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<o_custkey:bigint,o_orderkey:bigint>>")).alias("r")).select("r.*")
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("last_order"))


@query(_CUSTOMER)
def src5_parquet_scan(spark, sf_dir):
    return _typed(S.load_table(spark, f"{sf_dir}/customer.parquet"))


@query(_CUSTOMER)
def src6_gzip_csv_scan(spark, sf_dir):
    path = new_path(spark, "src6")
    _customer(spark, sf_dir).write.option("header", True).option("compression", "gzip").csv(path)
    return _typed(S.load_table(spark, path, suffix=S.source_suffix("customers.csv.gz")))


@query("SELECT CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 997 = 0 THEN 'x' ELSE '' END AS code, o_orderkey FROM orders")
def src7_late_type_change(spark, sf_dir):
    """A column that looks whole-numbered in nearly every row must come back as text."""
    path = new_path(spark, "src7")
    code = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 997 == 0, "x").otherwise(""))
    table(spark, sf_dir, "orders").select(code.alias("code"), "o_orderkey").write.option("header", True).csv(path)
    return S.load_csv_checked(spark, path, 0.05).select(F.col("code").cast("string"), F.col("o_orderkey").cast("long"))


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer)")
def src8_format_dispatch(spark, sf_dir):
    path = new_path(spark, "src8")
    _customer(spark, sf_dir).write.json(path)
    frames = [S.load_table(spark, f"{sf_dir}/customer.parquet"), S.load_table(spark, path, suffix=".ndjson")]
    both = frames[0].select("c_custkey").unionByName(frames[1].select("c_custkey"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def src9_parquet_sink(spark, sf_dir):
    path = new_path(spark, "src9")
    S.save_table(table(spark, sf_dir, "lineitem"), path)
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM orders")
def src10_empty_guard(spark, sf_dir):
    return S.require_rows(table(spark, sf_dir, "orders")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS supplier, s_name AS title FROM supplier")
def src11_header_names(spark, sf_dir):
    path = new_path(spark, "src11")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.csv(path)
    named = S.with_header(spark.read.csv(path), ["key", "title"], {"key": "supplier"})
    return named.select(F.col("supplier").cast("long"), "title")


@query("SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders")
def src12_register(spark, sf_dir):
    catalogue = new_path(spark, "catalogue")
    S.register(spark, f"{sf_dir}/orders.parquet", new_path(spark, "orders"), catalogue)
    return spark.read.parquet(catalogue).select("n_rows", F.col("n_columns").cast("long"))


@query("SELECT o_orderkey, o_totalprice > 200000 AS prediction FROM orders")
def src13_scored_sink(spark, sf_dir):
    path = new_path(spark, "src13")
    scored = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 200000).alias("prediction"))
    S.save_table(scored, path, "csv")
    return S.load_table(spark, path, "o_orderkey long, prediction boolean", suffix=".csv")


_EVENT_COLUMNS = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CAST(user_id AS VARCHAR) AS run_id, event_type AS stage, props AS payload"


@query(f"SELECT {_EVENT_COLUMNS} FROM events")
def src14_event_log_scan(spark, sf_dir):
    from ..operators.runlog import as_log

    path = new_path(spark, "src14")
    log = as_log(table(spark, sf_dir, "events")).select("seq", "run_id", "ts", "stage", "payload")
    lines = log.select(F.to_json(F.struct("*")).alias("value"))
    lines.withColumn("value", F.explode(F.array("value", F.lit("")))).write.text(path)  # a blank line after each
    return S.read_events(spark, path).where("seq is not null").select("seq", "run_id", "stage", "payload")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal > 0 AS positive, c_acctbal FROM customer")
def src15_results_csv_scan(spark, sf_dir):
    path = new_path(spark, "src15")
    rows = _customer(spark, sf_dir).select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") > 0).alias("positive"), "c_acctbal")
    rows.write.option("header", True).option("nullValue", "").csv(path)
    return S.read_results(spark, path, "c_custkey long, segment string, positive boolean, c_acctbal double")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def src16_observation_sink(spark, sf_dir):
    path = new_path(spark, "src16")
    orders = table(spark, sf_dir, "orders")
    for part in (0, 1):
        S.append_known(orders.where(F.col("o_orderkey") % 2 == part), path, ["o_orderkey", "o_custkey", "o_orderpriority", "unknown"])
    return spark.read.parquet(path).where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")


@query("SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS region, CAST(NULL AS BIGINT) AS nation, 'region' AS source FROM region UNION ALL SELECT n_name, NULL, CAST(n_nationkey AS BIGINT), 'nation' FROM nation")
def src17_ragged_sink(spark, sf_dir):
    path = new_path(spark, "src17")
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("region"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("nation"))
    S.save_table(S.union_ragged({"region": region, "nation": nation}), path, "csv")
    return S.load_table(spark, path, "name string, region long, source string, nation long", suffix=".csv").select("name", "region", "nation", "source")
