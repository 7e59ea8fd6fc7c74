"""The driver tables seen as the tables of the matching engine, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(column: str):
    return F.col(column).cast("string")


def with_sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


# products

CATALOG = """catalog AS (
  SELECT 'P' || p_partkey AS product_id, p_partkey,
         p_name || ' ' || p_size AS name, p_name || ' ' || p_size AS normalized_name,
         lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS article,
         'C' || p_name AS code, 'M-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS manufacturer_code,
         p_brand AS brand, lower(p_brand) AS normalized_brand,
         p_type AS category_id, p_type AS category_path,
         p_name || ' ' || p_size || ' | ' || p_brand || ' | ' || p_type AS search_document,
         p_size <> 13 AS is_active,
         TIMESTAMP '2024-01-01' + to_seconds(CAST(p_partkey AS BIGINT)) AS created_at
  FROM part)"""


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    key = F.lpad(text("p_partkey"), 8, "0")
    name = F.concat_ws(" ", "p_name", text("p_size"))
    none = F.lit(None).cast("string")
    return part.select(
        F.concat(F.lit("P"), text("p_partkey")).alias("product_id"),
        "p_partkey",
        name.alias("name"),
        name.alias("normalized_name"),
        key.alias("article"),
        F.concat(F.lit("C"), "p_name").alias("code"),
        F.concat(F.lit("M-"), key).alias("manufacturer_code"),
        F.col("p_brand").alias("brand"),
        F.lower("p_brand").alias("normalized_brand"),
        F.col("p_type").alias("category_id"),
        F.col("p_type").alias("category_path"),
        F.concat_ws(" | ", name, "p_brand", "p_type").alias("search_document"),
        (F.col("p_size") != 13).alias("is_active"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey")).alias("created_at"),
        none.alias("unit"),
        none.alias("packaging"),
    )


# requests and their items

REQUESTS = """requests AS (
  SELECT 'R' || o_orderkey AS request_id, 'S' || o_custkey AS supplier_id,
         CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'pending' END AS status,
         CASE WHEN o_orderpriority < '3' THEN 'batch_match' ELSE 'match_sync' END AS job_name,
         'file-' || o_orderkey || '.csv' AS file_name,
         CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS started_at,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(o_orderdate AS TIMESTAMP) + to_milliseconds(CAST(floor(o_totalprice) AS BIGINT)) END AS finished_at
  FROM orders)"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.concat(F.lit("R"), text("o_orderkey")).alias("request_id"),
        F.concat(F.lit("S"), text("o_custkey")).alias("supplier_id"),
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"),
        F.when(F.col("o_orderpriority") < "3", "batch_match").otherwise("match_sync").alias("job_name"),
        F.concat(F.lit("file-"), text("o_orderkey"), F.lit(".csv")).alias("file_name"),
        created.alias("created_at"),
        created.alias("started_at"),
        F.when(
            F.col("o_orderstatus") == "F",
            F.timestamp_micros(F.unix_micros(created) + F.floor("o_totalprice") * 1000),
        ).alias("finished_at"),
    )


ITEMS = """items AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_item_id,
         'R' || l_orderkey AS request_id, l_linenumber AS position,
         'Line ' || l_partkey || ' qty ' || CAST(l_quantity AS BIGINT) AS raw_text,
         'line ' || l_partkey AS normalized_text,
         CASE l_returnflag WHEN 'A' THEN 'auto_match' WHEN 'R' THEN 'review_needed' ELSE 'no_match' END AS status,
         'P' || l_partkey AS best_product_id, round(1 - l_discount * 5, 4) AS confidence,
         CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_tax < 0.03 THEN 'accepted' WHEN l_tax < 0.06 THEN 'corrected' ELSE 'rejected' END AS final_decision,
         CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_tax < 0.03 THEN 'P' || l_partkey WHEN l_tax < 0.06 THEN 'P' || l_suppkey END AS final_product_id,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'reviewer' || (l_suppkey % 3) END AS reviewed_by,
         CAST(l_shipdate AS TIMESTAMP) AS created_at
  FROM lineitem)"""


def items(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")
    product = F.concat(F.lit("P"), text("l_partkey"))
    decided = F.col("l_linestatus") != "O"
    return l.select(
        F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("request_item_id"),
        F.concat(F.lit("R"), text("l_orderkey")).alias("request_id"),
        F.col("l_linenumber").alias("position"),
        F.concat(F.lit("Line "), text("l_partkey"), F.lit(" qty "), F.col("l_quantity").cast("bigint").cast("string")).alias("raw_text"),
        F.concat(F.lit("line "), text("l_partkey")).alias("normalized_text"),
        F.when(F.col("l_returnflag") == "A", "auto_match").when(F.col("l_returnflag") == "R", "review_needed").otherwise("no_match").alias("status"),
        product.alias("best_product_id"),
        F.round(1 - F.col("l_discount") * 5, 4).alias("confidence"),
        F.when(decided, F.when(F.col("l_tax") < 0.03, "accepted").when(F.col("l_tax") < 0.06, "corrected").otherwise("rejected")).alias("final_decision"),
        F.when(decided, F.when(F.col("l_tax") < 0.03, product).when(F.col("l_tax") < 0.06, F.concat(F.lit("P"), text("l_suppkey")))).alias("final_product_id"),
        F.when(decided, F.concat(F.lit("reviewer"), (F.col("l_suppkey") % 3).cast("string"))).alias("reviewed_by"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.lit(None).cast("string").alias("review_notes"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


# supplier mappings: what a supplier delivered

MAPPINGS = """mappings AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS mapping_id,
         'S' || l_suppkey AS supplier_id, 'sku' || l_partkey AS supplier_sku,
         lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS supplier_article, 'Line ' || l_partkey AS supplier_raw_text,
         'line ' || l_partkey AS normalized_supplier_text, 'P' || l_partkey AS product_id,
         CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'R' THEN 'approved' ELSE CASE l_linestatus WHEN 'O' THEN 'manual' ELSE 'learned' END END AS mapping_type,
         round(l_discount * 9, 4) AS confidence, l_quantity > 5 AS is_active, CAST(l_shipdate AS TIMESTAMP) AS created_at
  FROM lineitem)"""


def mappings(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")
    return l.select(
        F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("mapping_id"),
        F.concat(F.lit("S"), text("l_suppkey")).alias("supplier_id"),
        F.concat(F.lit("sku"), text("l_partkey")).alias("supplier_sku"),
        F.lpad(text("l_partkey"), 8, "0").alias("supplier_article"),
        F.concat(F.lit("Line "), text("l_partkey")).alias("supplier_raw_text"),
        F.concat(F.lit("line "), text("l_partkey")).alias("normalized_supplier_text"),
        F.concat(F.lit("P"), text("l_partkey")).alias("product_id"),
        F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "R", "approved")
        .when(F.col("l_linestatus") == "O", "manual").otherwise("learned").alias("mapping_type"),
        F.round(F.col("l_discount") * 9, 4).alias("confidence"),
        (F.col("l_quantity") > 5).alias("is_active"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


# model calls

LOG = """calls AS (
  SELECT event_id, event_type AS provider,
         CASE WHEN k < 20 THEN 'gpt-4o' WHEN k < 40 THEN 'gpt-4o-mini-2024' WHEN k < 60 THEN 'qwen3-235b-a22b'
              WHEN k < 80 THEN 'rerank-multilingual-v3.0' ELSE 'unknown-model' END AS model,
         CASE WHEN user_id % 2 = 0 THEN 'embed' ELSE 'llm_match' END AS operation,
         k * 10 AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens, created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS TIMESTAMP) AS created_at FROM events)),
prices(ord, price_model, prompt_price, completion_price) AS (VALUES
  (0, 'gpt-4o', 2.50, 10.00), (1, 'gpt-4o-mini', 0.15, 0.60), (2, 'gpt-4.1-mini', 0.40, 1.60),
  (3, 'gpt-4.1-nano', 0.10, 0.40), (4, 'text-embedding-3-small', 0.02, 0.0), (5, 'text-embedding-3-large', 0.13, 0.0),
  (6, 'meta-llama/llama-4-maverick', 0.20, 0.20), (7, 'qwen/qwen3-235b-a22b', 0.20, 0.20),
  (8, 'rerank-multilingual-v3.0', 0.01, 0.0)),
model_price AS (
  SELECT m.model, coalesce(arg_min(p.prompt_price, CASE WHEN p.price_model = m.model THEN -1 ELSE p.ord END), 0.5) AS pp,
         coalesce(arg_min(p.completion_price, CASE WHEN p.price_model = m.model THEN -1 ELSE p.ord END), 1.5) AS cp
  FROM (SELECT DISTINCT model FROM calls) m
  LEFT JOIN prices p ON contains(m.model, p.price_model) OR contains(p.price_model, m.model) GROUP BY m.model),
log AS (
  SELECT c.*, c.prompt_tokens + c.completion_tokens AS total_tokens,
         CAST(round(c.prompt_tokens * CAST(pp AS DECIMAL(10,2)) + c.completion_tokens * CAST(cp AS DECIMAL(10,2))) AS DOUBLE) / 1000000 AS estimated_cost_usd
  FROM calls c JOIN model_price USING (model))"""


def calls(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("provider"),
        F.when(k < 20, "gpt-4o").when(k < 40, "gpt-4o-mini-2024").when(k < 60, "qwen3-235b-a22b")
        .when(k < 80, "rerank-multilingual-v3.0").otherwise("unknown-model").alias("model"),
        F.when(F.col("user_id") % 2 == 0, "embed").otherwise("llm_match").alias("operation"),
        (k * 10).alias("prompt_tokens"),
        F.floor("value").cast("bigint").alias("completion_tokens"),
        F.lit(None).cast("bigint").alias("total_tokens"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def log(spark: SparkSession, folder: str) -> DataFrame:
    from linewright.operators import reporting as R

    return R.token_log(calls(spark, folder)).withColumn(
        "estimated_cost_usd", F.col("estimated_cost_usd").cast("double")
    )


def seconds(column: str):
    """Timestamps leave as whole microseconds, so that both engines print the same."""
    return F.unix_micros(F.col(column).cast("timestamp")).alias(column)
