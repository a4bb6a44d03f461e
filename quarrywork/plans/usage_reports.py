"""Usage and telemetry reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..session import table
from .mapping import (
    AGENTS, AS_OF_SQL, CAPACITY, CONVERSIONS, ERRORS, EVALUATIONS, SANDBOX_REQUESTS, SECURITY, agents, as_of, capacity, conversions,
    davg, dsum, errors, evaluations, rounded, sandbox_requests, security,
)
from .registry import query

TODAY = f"CAST(created_at AS DATE) = CAST({AS_OF_SQL} AS DATE)"
WEEK = f"CAST(created_at AS DATE) >= CAST({AS_OF_SQL} AS DATE) - 7"


@query("usage_summary", f"""
WITH {CONVERSIONS}, {ERRORS}, {SECURITY}, {CAPACITY},
c AS (SELECT COUNT(*) AS total_conversions, COUNT(*) FILTER ({TODAY}) AS today_conversions,
             COUNT(*) FILTER ({WEEK}) AS week_conversions,
             CAST(COALESCE(SUM(file_size), 0) AS BIGINT) AS total_bytes,
             COUNT(DISTINCT ip_hash) AS unique_users FROM conversions),
e AS (SELECT COUNT(*) AS errors FROM errors),
s AS (SELECT COUNT(*) FILTER (event_type = 'rate_limit') AS rate_limit_hits,
             COUNT(*) FILTER (event_type LIKE 'blocked:%') AS blocked_requests FROM security),
f AS (SELECT COUNT(*) AS capacity_exceeded FROM capacity)
SELECT c.*, e.errors, s.*, f.capacity_exceeded,
  CASE WHEN total_bytes >= 1073741824 THEN CAST(CAST(ROUND(CAST(total_bytes AS DECIMAL(38,9)) / 1073741824, 2) AS DECIMAL(28,2)) AS VARCHAR) || ' GB'
       WHEN total_bytes >= 1048576 THEN CAST(CAST(ROUND(CAST(total_bytes AS DECIMAL(38,9)) / 1048576, 2) AS DECIMAL(28,2)) AS VARCHAR) || ' MB'
       ELSE CAST(CAST(ROUND(CAST(total_bytes AS DECIMAL(38,9)) / 1024, 2) AS DECIMAL(28,2)) AS VARCHAR) || ' KB' END AS total_data_processed,
  {rounded("CAST(e.errors AS DOUBLE) / greatest(total_conversions, 1) * 100", 1)} AS error_rate_percent
FROM c, e, s, f""")
def usage_summary(spark, sf):
    return reports.usage_summary(conversions(spark, sf), errors(spark, sf), security(spark, sf), capacity(spark, sf), as_of())


@query("by_type", f"WITH {CONVERSIONS} SELECT file_type, COUNT(*) AS cnt FROM conversions GROUP BY file_type")
def by_type(spark, sf):
    return reports.count_by(conversions(spark, sf), "file_type", "file_type").orderBy(F.col("cnt").desc())


@query("by_day", f"""WITH {CONVERSIONS}
SELECT strftime(created_at, '%Y-%m-%d') AS day, COUNT(*) AS cnt FROM conversions WHERE {WEEK} GROUP BY 1""")
def by_day(spark, sf):
    return reports.by_day(conversions(spark, sf), as_of())


@query("by_hour", f"WITH {CONVERSIONS} SELECT strftime(created_at, '%H') AS hour, COUNT(*) AS cnt FROM conversions GROUP BY 1")
def by_hour(spark, sf):
    return reports.by_hour(conversions(spark, sf))


@query("last_event", f"""WITH {CONVERSIONS}
SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS last_conversion, id AS last_id
FROM conversions ORDER BY id DESC LIMIT 1""")
def last_event(spark, sf):
    return reports.last_event(conversions(spark, sf))


@query("recent_events", f"""WITH {SECURITY}
SELECT id, event_type, ip_hash, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM security ORDER BY id DESC LIMIT 10""")
def recent_events(spark, sf):
    return reports.recent_rows(security(spark, sf)).select(
        "id", "event_type", "ip_hash", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at")
    )


@query("recent_errors", f"""WITH {ERRORS}
SELECT id, COALESCE(error_type, 'unknown') AS error_type, error_message FROM errors ORDER BY id DESC LIMIT 10""")
def recent_errors(spark, sf):
    return reports.recent_rows(errors(spark, sf)).select(
        "id", F.coalesce("error_type", F.lit("unknown")).alias("error_type"), "error_message"
    )


@query("errors_by_type", f"WITH {ERRORS} SELECT COALESCE(error_type, 'unknown') AS error_type, COUNT(*) AS cnt FROM errors GROUP BY 1")
def errors_by_type(spark, sf):
    return reports.errors_by_type(errors(spark, sf))


def _features(spark, sf):
    events = table(spark, sf, "events")
    chunks = events.withColumn("chunks_generated", F.get_json_object("props", "$.k").cast("bigint"))
    return {
        "analyze": events.filter(F.col("event_type") == "view"),
        "chunk": chunks.filter(F.col("event_type") == "click"),
        "compare": events.filter(F.col("event_type") == "signup"),
        "contact": events.filter(F.col("event_type") == "purchase"),
    }


FEATURE_SQL = """
SELECT CASE event_type WHEN 'view' THEN 'analyze' WHEN 'click' THEN 'chunk' WHEN 'signup' THEN 'compare'
       ELSE 'contact' END AS feature, COUNT(*) AS requests,
       CAST(SUM(CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END) AS BIGINT)
         AS total_chunks
FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1"""


@query("feature_usage", FEATURE_SQL)
def feature_usage(spark, sf):
    return reports.feature_usage(_features(spark, sf))


@query("variant_union", """
SELECT feature, COUNT(*) AS requests FROM (
  SELECT 'orders' AS feature FROM orders UNION ALL SELECT 'lineitem' FROM lineitem UNION ALL SELECT 'events' FROM events)
GROUP BY feature""")
def variant_union(spark, sf):
    names = ("orders", "lineitem", "events")
    parts = {n: table(spark, sf, n) for n in names}
    return reports.feature_usage(parts, chunk_feature="").select("feature", "requests")


@query("top_types_brief", f"""WITH {CONVERSIONS},
o AS (SELECT COUNT(*) AS total_conversions, COUNT(*) FILTER ({TODAY}) AS today_conversions,
  CAST(COALESCE(SUM(file_size), 0) AS BIGINT) AS total_bytes_processed,
  {rounded("COALESCE(SUM(file_size), 0) / 1048576.0::DOUBLE", 2)} AS total_mb_processed,
  COALESCE({rounded("(CAST(SUM(CASE WHEN file_size > 0 THEN file_size END) AS DOUBLE) / COUNT(CASE WHEN file_size > 0 THEN 1 END)) / 1024", 2)}, 0.0) AS avg_file_size_kb,
  100.0 AS success_rate FROM conversions),
t AS (SELECT file_type, COUNT(*) AS cnt FROM conversions GROUP BY file_type ORDER BY cnt DESC, file_type LIMIT 5)
SELECT t.*, o.* FROM t, o""")
def top_types_brief(spark, sf):
    return reports.top_types_brief(conversions(spark, sf), as_of())


AGENT_DAY = "TIMESTAMP '1998-03-03 00:00:00'"


@query("agent_stats", f"""WITH {AGENTS},
o AS (SELECT COUNT(*) AS total_executions, COUNT(*) FILTER (success = 1) AS successful_executions,
  {rounded("CAST(COUNT(*) FILTER (success = 1) AS DOUBLE) / COUNT(*) * 100", 1)} AS success_rate,
  {rounded(dsum("actual_cost", 9), 6)} AS total_cost, {rounded(dsum("savings", 9), 6)} AS total_savings,
  {rounded(davg("savings_percent", 2), 2)} AS avg_savings_percent,
  CAST(floor({davg("total_latency_ms", 0)}) AS BIGINT) AS avg_latency_ms_overall,
  {rounded(davg("quality_score", 2), 1)} AS avg_quality_score,
  {rounded("CAST(SUM(CASE WHEN success = 1 THEN findings_count END) AS DOUBLE) / COUNT(*) FILTER (success = 1)", 1)} AS avg_findings,
  COUNT(*) FILTER (CAST(created_at AS DATE) = CAST({AGENT_DAY} AS DATE)) AS today_executions
  FROM agents),
t AS (SELECT agent_type, COUNT(*) AS executions, {rounded(dsum("savings", 9), 6)} AS savings,
  CAST(floor({davg("total_latency_ms", 0)}) AS BIGINT) AS avg_latency_ms FROM agents GROUP BY agent_type)
SELECT t.*, o.* FROM t, o""")
def agent_stats(spark, sf):
    day = F.lit("1998-03-03 00:00:00").cast("timestamp_ntz")
    return reports.agent_stats(agents(spark, sf), day)


@query("sandbox_stats", f"""WITH {SANDBOX_REQUESTS}
SELECT COUNT(DISTINCT ip_hash) AS sessions, COUNT(*) FILTER (request_type = 'upload') AS files_ingested,
  COUNT(*) FILTER (request_type = 'query') AS queries_executed,
  COUNT(*) FILTER (request_type = 'query' AND success = 0) AS failed_queries,
  COUNT(*) FILTER (request_type = 'upload' AND file_type IN ('.sqlite', '.db', '.sqlite3')) AS sqlite_files,
  COUNT(*) FILTER (request_type = 'upload' AND file_type = '.sql') AS dump_files,
  COUNT(*) FILTER (request_type = 'upload' AND file_type IN ('.csv', '.xlsx')) AS spreadsheet_files,
  {rounded("CAST(COUNT(*) FILTER (request_type = 'query' AND success = 1) AS DOUBLE) / COUNT(*) FILTER (request_type = 'query') * 100", 1)} AS success_rate,
  {rounded("CAST(SUM(query_latency_ms) AS DOUBLE) / COUNT(query_latency_ms)", 1)} AS avg_latency_ms,
  COUNT(*) FILTER (CAST(created_at AS DATE) = CAST({AGENT_DAY} AS DATE)) AS today_requests
FROM requests""")
def sandbox_stats(spark, sf):
    return reports.sandbox_stats(sandbox_requests(spark, sf), F.lit("1998-03-03 00:00:00").cast("timestamp_ntz"))


@query("quality_stats", f"""WITH {EVALUATIONS},
o AS (SELECT COUNT(*) AS total_evaluations, {rounded(davg("overall_score"), 2)} AS avg_overall_score,
  CAST(SUM(passed_threshold) AS BIGINT) AS passed_count,
  {rounded("CAST(SUM(passed_threshold) AS DOUBLE) / COUNT(*) * 100", 1)} AS pass_rate,
  {", ".join(f"{rounded(davg(d + '_score'), 2)} AS avg_{d}" for d in reports.QUALITY_DIMENSIONS)},
  {rounded(dsum("eval_cost"), 6)} AS total_eval_cost, COUNT(*) FILTER ({TODAY}) AS today_evaluations,
  {rounded("COALESCE(CAST(SUM(CASE WHEN " + TODAY + " THEN CAST(overall_score AS DECIMAL(28,6)) END) AS DOUBLE) / COUNT(*) FILTER (" + TODAY + "), 0)", 2)} AS today_avg_score
  FROM evaluations),
t AS (SELECT response_type, COUNT(*) AS evaluations, {rounded(davg("overall_score"), 2)} AS avg_score,
  {rounded("CAST(SUM(passed_threshold) AS DOUBLE) / COUNT(*) * 100", 1)} AS pass_rate_percent
  FROM evaluations GROUP BY response_type)
SELECT t.*, o.* FROM t, o""")
def quality_stats(spark, sf):
    return reports.quality_stats(evaluations(spark, sf), as_of())


@query("contact_list", """
SELECT o_orderkey AS id, 'customer ' || CAST(o_custkey AS VARCHAR) AS name, o_orderpriority AS use_case,
       strftime(o_orderdate, '%Y-%m-%d') AS created_on
FROM orders""")
def contact_list(spark, sf):
    contacts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("use_case"),
        F.col("o_orderdate").alias("created_at"),
    )
    return reports.contact_list(contacts).select(
        "id", "name", "use_case", F.date_format("created_at", "yyyy-MM-dd").alias("created_on")
    )


@query("memory_status", f"""
SELECT COUNT(DISTINCT conv_id) AS sessions, COUNT(*) AS total_items, CAST(SUM(length(text)) AS BIGINT) AS total_size_chars,
       {rounded("CAST(SUM(length(text)) AS DOUBLE) / 1048576", 2)} AS total_size_mb FROM conversations""")
def memory_status(spark, sf):
    items = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("text").alias("content"))
    return reports.memory_status(items)


@query("retain_last_n", """
SELECT event_id, user_id, rank_in_group FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank_in_group
  FROM events) WHERE rank_in_group <= 1000""")
def retain_last_n(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    kept = reports.retain_last(events, ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 1000)
    return kept.select("event_id", "user_id", "rank_in_group")


@query("topk_global", "SELECT event_type, user_id, COUNT(*) AS cnt FROM events GROUP BY ALL ORDER BY cnt DESC, event_type, user_id LIMIT 10")
def topk_global(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.col("cnt").desc(), "event_type", "user_id").limit(10)


@query("distinct_sources", "SELECT DISTINCT source, lang FROM documents")
def distinct_sources(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct()
