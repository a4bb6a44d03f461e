"""Telemetry tables derived from the test tables, in Spark and as SQL common tables.

Each derivation is row-wise or an ordinary aggregate over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import hash_prefix
from ..session import table

AS_OF = "2024-01-30 12:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def rounded(expr: str, scale: int) -> str:
    """SQL twin of ``half_up``."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,9)), {scale}) AS DOUBLE)"


def dsum(expr: str, scale: int = 6) -> str:
    """SQL twin of ``exact_sum``."""
    return f"CAST(COALESCE(SUM(CAST({expr} AS DECIMAL(28,{scale}))), 0) AS DOUBLE)"


def davg(expr: str, scale: int = 6) -> str:
    """SQL twin of ``exact_avg``."""
    return f"(CAST(SUM(CAST({expr} AS DECIMAL(28,{scale}))) AS DOUBLE) / COUNT({expr}))"


# -- conversions, errors, security events -------------------------------------------------


def conversions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("file_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("file_size"),
        hash_prefix(F.col("user_id"), 16).alias("ip_hash"),
        F.col("ts").alias("created_at"),
    )


CONVERSIONS = """conversions AS (
  SELECT event_id AS id, event_type AS file_type, CAST(ROUND(value * 100) AS BIGINT) AS file_size,
         substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS ip_hash, ts AS created_at
  FROM events)"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.pmod(prop_k(), F.lit(4))
    return table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"),
        F.when(kind > 0, F.concat(F.lit("kind_"), kind.cast("string"))).alias("error_type"),
        F.col("props").alias("error_message"),
        F.col("ts").alias("created_at"),
    )


ERRORS = f"""errors AS (
  SELECT event_id AS id,
         CASE WHEN {K_SQL} % 4 > 0 THEN 'kind_' || CAST({K_SQL} % 4 AS VARCHAR) END AS error_type,
         props AS error_message, ts AS created_at
  FROM events WHERE event_type = 'error')"""


def security(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", F.lit("rate_limit")).otherwise(
        F.concat(F.lit("blocked:reason_"), F.pmod(prop_k(), F.lit(3)).cast("string"))
    )
    return table(spark, sf, "events").filter(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("id"),
        kind.alias("event_type"),
        hash_prefix(F.col("user_id"), 8).alias("ip_hash"),
        F.col("ts").alias("created_at"),
    )


SECURITY = f"""security AS (
  SELECT event_id AS id,
         CASE WHEN event_type = 'view' THEN 'rate_limit'
              ELSE 'blocked:reason_' || CAST({K_SQL} % 3 AS VARCHAR) END AS event_type,
         substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) AS ip_hash, ts AS created_at
  FROM events WHERE event_type IN ('view', 'click'))"""


# -- model requests -----------------------------------------------------------------------


def model_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per conversation with estimated token counts."""
    from ..functions.textstats import estimate_tokens

    tokens = estimate_tokens(F.col("text"))
    answer = F.col("role") == "assistant"
    return (
        table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(
            F.coalesce(F.sum(F.when(~answer, tokens)), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum(F.when(answer, tokens)), F.lit(0)).alias("output_tokens"),
        )
        .select(
            F.col("conv_id").alias("id"),
            F.pmod(F.col("conv_id"), F.lit(9)).cast("int").alias("model_no"),
            "input_tokens",
            "output_tokens",
            (F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(mins=F.pmod(F.col("conv_id") * 37, F.lit(4320)).cast("int"))).alias("created_at"),
        )
    )


TOKENS_SQL = "(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)"

MODEL_REQUESTS = f"""model_requests AS (
  SELECT conv_id AS id, conv_id % 9 AS model_no,
         CAST(COALESCE(SUM(CASE WHEN role <> 'assistant' THEN {TOKENS_SQL} END), 0) AS BIGINT) AS input_tokens,
         CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN {TOKENS_SQL} END), 0) AS BIGINT) AS output_tokens,
         TIMESTAMP '2024-01-28 00:00:00' + INTERVAL 1 MINUTE * ((conv_id * 37) % 4320) AS created_at
  FROM conversations GROUP BY conv_id)"""


# -- agent runs, sandbox requests, evaluations --------------------------------------------


def agents(spark: SparkSession, sf: str) -> DataFrame:
    cost = F.col("o_totalprice") / 1000000
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("agent_type"),
        F.floor("o_totalprice").cast("bigint").alias("total_latency_ms"),
        cost.alias("actual_cost"),
        (cost * 3).alias("savings"),
        F.pmod(F.col("o_orderkey"), F.lit(100)).cast("double").alias("savings_percent"),
        F.pmod(F.col("o_custkey"), F.lit(7)).alias("findings_count"),
        (F.pmod(F.col("o_custkey"), F.lit(10)) + 1).alias("quality_score"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("success"),
        F.col("o_orderdate").alias("created_at"),
    )


AGENTS = """agents AS (
  SELECT o_orderkey AS id, o_orderpriority AS agent_type, CAST(floor(o_totalprice) AS BIGINT) AS total_latency_ms,
         o_totalprice / 1000000 AS actual_cost, o_totalprice / 1000000 * 3 AS savings,
         CAST(o_orderkey % 100 AS DOUBLE) AS savings_percent, o_custkey % 7 AS findings_count,
         o_custkey % 10 + 1 AS quality_score, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS success,
         o_orderdate AS created_at
  FROM orders)"""


def sandbox_requests(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [".csv", ".sql", ".sqlite", ".xlsx", ".db"]
    upload = F.col("o_orderstatus") == "P"
    slot = F.pmod(F.col("o_custkey"), F.lit(6)).cast("int")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(upload, F.lit("upload")).otherwise(F.lit("query")).alias("request_type"),
        F.when(upload, F.get(F.array(*[F.lit(k) for k in kinds]), slot)).alias("file_type"),
        F.when(~upload & (slot > 0), F.floor(F.col("o_totalprice") / 1000).cast("bigint")).alias("query_latency_ms"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(10)) == 0, 0).otherwise(1).alias("success"),
        hash_prefix(F.col("o_custkey")).alias("ip_hash"),
        F.col("o_orderdate").alias("created_at"),
    )


SANDBOX_REQUESTS = """requests AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'upload' ELSE 'query' END AS request_type,
         CASE WHEN o_orderstatus = 'P' THEN
           list_extract(['.csv', '.sql', '.sqlite', '.xlsx', '.db'], CAST(o_custkey % 6 + 1 AS INTEGER)) END AS file_type,
         CASE WHEN o_orderstatus <> 'P' AND o_custkey % 6 > 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END
           AS query_latency_ms,
         CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS success,
         substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 16) AS ip_hash, o_orderdate AS created_at
  FROM orders)"""


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("quality").cast("double")
    bad = F.col("toxic").cast("double")
    size = F.col("n_chars").cast("double")
    overall = 5 + 4 * good - 3 * bad
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").drop("text"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("response_type"),
        overall.alias("overall_score"),
        (6 + 3 * good).alias("relevance_score"),
        (5 + 5 * good).alias("accuracy_score"),
        (7 + good - bad).alias("helpfulness_score"),
        (10 - 8 * bad).alias("safety_score"),
        F.when(size > 500, 8.0).otherwise(4.0).alias("completeness_score"),
        (size / 1000000).alias("eval_cost"),
        (overall >= 7).cast("int").alias("passed_threshold"),
        (F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
         - F.make_dt_interval(days=F.pmod(F.col("doc_id"), F.lit(5)).cast("int"))).alias("created_at"),
    )


EVALUATIONS = """evaluations AS (
  SELECT doc_id AS id, lang AS response_type, 5 + 4.0::DOUBLE * quality - 3.0::DOUBLE * toxic AS overall_score,
         6 + 3.0::DOUBLE * quality AS relevance_score, 5 + 5.0::DOUBLE * quality AS accuracy_score,
         7.0::DOUBLE + quality - toxic AS helpfulness_score, 10 - 8.0::DOUBLE * toxic AS safety_score,
         CASE WHEN n_chars > 500 THEN 8.0::DOUBLE ELSE 4.0::DOUBLE END AS completeness_score,
         n_chars / 1000000.0::DOUBLE AS eval_cost,
         CASE WHEN 5 + 4 * quality - 3 * toxic >= 7 THEN 1 ELSE 0 END AS passed_threshold,
         TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY * (doc_id % 5) AS created_at
  FROM labels JOIN documents USING (doc_id))"""


# requests refused because too many were active
CAPACITY = "capacity AS (SELECT event_id AS id, user_id, ts AS created_at FROM events WHERE event_type = 'signup' AND value > 50)"


def capacity(spark: SparkSession, sf: str) -> DataFrame:
    refused = table(spark, sf, "events").filter((F.col("event_type") == "signup") & (F.col("value") > 50))
    return refused.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"))
