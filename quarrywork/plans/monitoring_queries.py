"""Performance, metric, health and ordered-window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import fixed
from ..functions.numbers import half_up
from ..operators import monitoring, ordered, quantiles
from ..operators.memory import combine_context, session_items, session_listing
from ..session import shared_path, table
from . import sqltext as sx
from .mapping import K_SQL, davg, prop_k, rounded
from .registry import query

METRICS = f"""metrics AS (SELECT event_id, ts, event_type AS file_type, {K_SQL} * 4096 AS file_size_bytes, value / 50 AS duration_seconds,
  event_type <> 'error' AS success, {K_SQL} AS chunks_generated, CASE WHEN {K_SQL} % 4 = 0 THEN 0 ELSE value / 1000 END AS embedding_duration FROM events)"""


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = prop_k()
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("file_type"), (k * 4096).alias("file_size_bytes"),
        (F.col("value") / 50).alias("duration_seconds"), (F.col("event_type") != "error").alias("success"),
        k.alias("chunks_generated"), F.when(F.pmod(k, F.lit(4)) == 0, 0.0).otherwise(F.col("value") / 1000).alias("embedding_duration"),
    )


def p95_sql(src: str, keys: str, value: str, out: str) -> str:
    """Exclusive 95th percentile from the whole sorted list."""
    group = f"GROUP BY {keys}" if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""{out}_l AS (SELECT {cols}list({value} ORDER BY {value}) AS xs, COUNT(*) AS n FROM {src} {group}),
{out} AS (SELECT {cols}CASE WHEN n < 20 THEN xs[n] ELSE
  (xs[greatest(1, least(19 * (n + 1) // 20, n - 1))] * (20 - (19 * (n + 1) - 20 * greatest(1, least(19 * (n + 1) // 20, n - 1))))
   + xs[greatest(1, least(19 * (n + 1) // 20, n - 1)) + 1] * (19 * (n + 1) - 20 * greatest(1, least(19 * (n + 1) // 20, n - 1)))) / 20 END AS p95 FROM {out}_l)"""


@query("perf_report", f"""WITH {METRICS}, won AS (SELECT * FROM metrics WHERE success), {p95_sql('won', '', 'duration_seconds', 'q')},
t AS (SELECT file_type, {rounded(davg('duration_seconds'), 3)} AS avg_latency, COUNT(*) AS cnt FROM won GROUP BY file_type),
o AS (SELECT {rounded(davg('duration_seconds'), 3)} AS avg_seconds, {rounded('MIN(duration_seconds)', 3)} AS min_seconds, {rounded('MAX(duration_seconds)', 3)} AS max_seconds,
  {rounded(davg('file_size_bytes / greatest(duration_seconds, 0.001::DOUBLE)') + ' / 1048576', 2)} AS avg_mb_per_sec, CAST(SUM(chunks_generated) AS BIGINT) AS total_chunks,
  {rounded(f"COALESCE({davg('CASE WHEN embedding_duration > 0 THEN embedding_duration END')}, 0)", 3)} AS avg_embedding_time FROM won),
a AS (SELECT COUNT(*) AS total_processed, {rounded("CAST(COUNT(*) FILTER (success) AS DOUBLE) / COUNT(*) * 100", 1)} AS success_rate FROM metrics)
SELECT t.*, o.*, a.*, {rounded('q.p95', 3)} AS p95_seconds FROM t, o, a, q""")
def perf_report(spark, sf):
    return monitoring.perf_report(metrics(spark, sf))


@query("model_perf_report", f"""WITH {METRICS}, m AS (SELECT file_type AS operation, duration_seconds, chunks_generated AS tokens_processed FROM metrics),
{p95_sql('m', 'operation', 'duration_seconds', 'q')}
SELECT operation, COUNT(*) AS cnt, {rounded(davg('duration_seconds'), 4)} AS avg_latency, CAST(SUM(tokens_processed) AS BIGINT) AS total_tokens,
  {rounded(davg('tokens_processed', 0), 1)} AS avg_tokens_per_req,
  {rounded("SUM(tokens_processed) / CAST(SUM(CAST(duration_seconds AS DECIMAL(28,6))) AS DOUBLE)", 1)} AS throughput_tokens_sec,
  any_value({rounded('q.p95', 4)}) AS p95_latency FROM m JOIN q USING (operation) GROUP BY operation""")
def model_perf_report(spark, sf):
    rows = metrics(spark, sf).select(
        F.col("file_type").alias("operation"), "duration_seconds", F.col("chunks_generated").alias("tokens_processed")
    )
    return monitoring.model_perf_report(rows)


@query("perf_p95_week", f"""WITH {METRICS}, m AS (SELECT file_type, duration_seconds FROM metrics WHERE success AND CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'),
{p95_sql('m', 'file_type', 'duration_seconds', 'q')}
SELECT file_type, n, {rounded('p95', 4)} AS p95 FROM q JOIN (SELECT file_type AS f, COUNT(*) AS n FROM m GROUP BY 1) c ON f = file_type""")
def perf_p95_week(spark, sf):
    """Rows and sketches are stored by day once; a week is answered from its sketches and the top of its values."""
    won = metrics(spark, sf).filter("success").select(F.to_date("ts").alias("day"), "file_type", "duration_seconds")
    path, kept = shared_path(spark, "durations"), shared_path(spark, "duration-sketches")
    won.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    rows = spark.read.parquet(path)
    quantiles.daily_sketches(rows, "day", ["file_type"], "duration_seconds").write.parquet(kept)
    first, last = F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date")
    found = quantiles.p95_of_span(rows, spark.read.parquet(kept), "day", ["file_type"], "duration_seconds", first, last)
    return found.withColumn("p95", half_up(F.col("p95"), 4))


@query("metric_counters", f"SELECT 'GET' AS method, event_type AS endpoint, CASE WHEN {K_SQL} % 10 = 0 THEN 500 ELSE 200 END AS status, COUNT(*) AS total FROM events GROUP BY ALL")
def metric_counters(spark, sf):
    rows = table(spark, sf, "events").select(
        F.lit("GET").alias("method"), F.col("event_type").alias("endpoint"),
        F.when(F.pmod(prop_k(), F.lit(10)) == 0, 500).otherwise(200).alias("status"),
    )
    return monitoring.metric_counters(rows, ["method", "endpoint", "status"])


BOUNDS = ", ".join(f"('{b}', {b}::DOUBLE)" for b in fixed.LATENCY_BUCKETS)


@query("metric_histogram", f"""WITH b(le, bound) AS (VALUES {BOUNDS}, ('+Inf', 'infinity'::DOUBLE)),
s AS (SELECT event_type AS endpoint, value / 50 AS v FROM events),
c AS (SELECT endpoint, COUNT(*) AS series_count, CAST(SUM(CAST(v AS DECIMAL(28,6))) AS DOUBLE) AS series_sum FROM s GROUP BY 1)
SELECT c.endpoint, le, (SELECT COUNT(*) FROM s WHERE s.endpoint = c.endpoint AND s.v <= b.bound) AS bucket_count, series_count, series_sum FROM c, b""")
def metric_histogram(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("endpoint"), (F.col("value") / 50).alias("v"))
    return monitoring.metric_histogram(rows, "endpoint", "v")


@query("metric_gauge", "SELECT event_type, max_by(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY event_type")
def metric_gauge(spark, sf):
    return monitoring.metric_gauge(table(spark, sf, "events"), "event_type", "value", ["ts", "event_id"])


@query("concurrency_profile", """
WITH r AS (SELECT event_id AS id, ts AS started, ts + to_microseconds(CAST(ROUND(value * 20000000) AS BIGINT)) AS ended, event_type IN ('purchase', 'signup') AS heavy FROM events),
l AS (SELECT id, started AS moment, 1 AS step, heavy FROM r UNION ALL SELECT id, ended, -1, heavy FROM r),
w AS (SELECT *, CAST(SUM(step) OVER o AS BIGINT) AS active, CAST(SUM(CASE WHEN heavy THEN step ELSE 0 END) OVER o AS BIGINT) AS heavy_active FROM l WINDOW o AS (ORDER BY moment, step, id ROWS UNBOUNDED PRECEDING))
SELECT id, active, heavy_active, active > 5 AS over_total, heavy AND heavy_active > 2 AS over_heavy FROM w WHERE step = 1""")
def concurrency_profile(spark, sf):
    length = F.make_dt_interval(secs=(F.round(F.col("value") * 20_000_000) / 1_000_000).cast("decimal(18,6)"))
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("started"), (F.col("ts") + length).alias("ended"),
        F.col("event_type").isin("purchase", "signup").alias("heavy"),
    )
    return monitoring.concurrency_profile(rows)


@query("moving_avg_100", f"""SELECT event_id, {rounded("CAST(SUM(CAST(value AS DECIMAL(28,6))) OVER w AS DOUBLE) / COUNT(value) OVER w", 6)} AS mean_100
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def moving_avg_100(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    order = [F.col("ts"), F.col("event_id")]
    dealt = ordered.balanced(events, ["event_type"], order, "moving-average")
    averaged = ordered.moving_average(dealt, ["event_type"], F.col(ordered.PART), order, "value", 100, "mean_100")
    return averaged.select("event_id", half_up(F.col("mean_100"), 6).alias("mean_100"))


HOSTS = """hosts AS (SELECT event_id, value / 5 AS disk_percent, k AS memory_percent, CASE WHEN event_type = 'error' THEN 'unhealthy' WHEN event_type = 'view' THEN 'degraded' ELSE 'healthy' END AS database_status,
  value / 4 AS cpu_percent, k / 1000.0::DOUBLE AS error_rate FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", (F.col("value") / 5).alias("disk_percent"), prop_k().alias("memory_percent"),
        F.when(F.col("event_type") == "error", "unhealthy").when(F.col("event_type") == "view", "degraded").otherwise("healthy").alias("database_status"),
        (F.col("value") / 4).alias("cpu_percent"), (prop_k() / 1000).alias("error_rate"),
    )


@query("health_status", f"""WITH {HOSTS}, g AS (SELECT event_id, database_status, CASE WHEN disk_percent >= 95 THEN 'critical' WHEN disk_percent >= 85 THEN 'warning' ELSE 'healthy' END AS disk_status,
  CASE WHEN memory_percent >= 90 THEN 'critical' WHEN memory_percent >= 75 THEN 'warning' ELSE 'healthy' END AS memory_status FROM hosts)
SELECT *, CASE WHEN database_status = 'unhealthy' OR disk_status = 'critical' OR memory_status = 'critical' THEN 'unhealthy'
  WHEN database_status = 'degraded' OR disk_status = 'warning' OR memory_status = 'warning' THEN 'degraded' ELSE 'healthy' END AS status FROM g""")
def health_status(spark, sf):
    return monitoring.health_status(hosts(spark, sf)).select("event_id", "database_status", "disk_status", "memory_status", "status")


@query("threshold_alerts", f"WITH {HOSTS} " + " UNION ALL ".join(
    f"SELECT event_id, '{m}' AS metric, '{t}' AS title, '{lv}' AS level, CAST({m} AS DOUBLE) AS value FROM hosts WHERE {m} > {limit}" for m, t, limit, lv in fixed.ALERT_LIMITS))
def threshold_alerts(spark, sf):
    return monitoring.threshold_alerts(hosts(spark, sf), ["event_id"])


@query("step_latency", f"""WITH s AS (SELECT unnest(['retrieve', 'analyze', 'validate_iter_1']) AS step, unnest([{K_SQL}, {K_SQL} * 3, user_id % 50]) AS latency_ms FROM events)
SELECT step, COUNT(*) AS runs, CAST(SUM(latency_ms) AS BIGINT) AS total_ms, MAX(latency_ms) AS max_ms FROM s GROUP BY step""")
def step_latency(spark, sf):
    steps = F.create_map(F.lit("retrieve"), prop_k(), F.lit("analyze"), prop_k() * 3, F.lit("validate_iter_1"), F.pmod("user_id", F.lit(50)))
    return monitoring.step_latency(table(spark, sf, "events").select(steps.alias("steps")), "steps")


@query("trace_defaults", f"""
WITH t AS (SELECT event_id, {K_SQL} AS k, user_id FROM events),
d AS (SELECT event_id, CASE WHEN k % 3 > 0 THEN k END AS gateway, k * 7 AS total, CASE WHEN k % 4 > 0 THEN k % 4 END AS results, user_id AS tin, k AS tout FROM t)
SELECT event_id, CASE WHEN gateway > 0 THEN gateway ELSE total END AS ttft_ms, COALESCE(results, 0) = 0 AS vector_search_empty, tin + tout AS tokens_total, gateway IS NULL AS gateway_missing_in_json FROM d""")
def trace_defaults(spark, sf):
    k = prop_k()
    traces = table(spark, sf, "events").select(
        "event_id", F.when(F.pmod(k, F.lit(3)) > 0, k).alias("gateway_latency_ms"), (k * 7).alias("total_latency_ms"),
        F.when(F.pmod(k, F.lit(4)) > 0, F.pmod(k, F.lit(4))).alias("vector_results_count"),
        F.col("user_id").alias("tokens_input"), k.alias("tokens_output"),
    )
    done = monitoring.trace_defaults(traces)
    return done.select("event_id", "ttft_ms", "vector_search_empty", "tokens_total",
                       (~F.contains("trace", F.lit("gateway_latency_ms"))).alias("gateway_missing_in_json"))


# -- session memory -----------------------------------------------------------------------


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("arrival"),
        F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("filename"), F.col("role").alias("type"), F.col("text").alias("content"),
    )


ITEMS = """items AS (SELECT * FROM (SELECT conv_id AS session_id, turn AS arrival, 'turn_' || CAST(turn AS VARCHAR) AS filename, role AS type, left(text, 1048576) AS content,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest FROM conversations) WHERE newest <= 10)"""


@query("session_last_items", f"WITH {ITEMS} SELECT session_id, arrival, filename, length(content) AS content_length FROM items")
def session_last_items(spark, sf):
    return session_items(items(spark, sf)).select("session_id", "arrival", "filename", F.length("content").alias("content_length"))


COMBINED = "string_agg('--- ' || filename || ' (' || type || ') ---' || chr(10) || content, chr(10) || chr(10) ORDER BY arrival)"


@query("combine_context", f"WITH {ITEMS} SELECT session_id, COUNT(*) AS items, md5({COMBINED}) AS digest, length({COMBINED}) AS context_length FROM items GROUP BY session_id")
def combine_context_query(spark, sf):
    rows = combine_context(session_items(items(spark, sf)))
    return rows.select("session_id", "items", F.md5("context").alias("digest"), F.length("context").alias("context_length"))


@query("session_listing", f"""WITH {ITEMS}, c AS (SELECT session_id, COUNT(*) AS item_count, {COMBINED} AS ctx, string_agg(filename || ':' || length(content), ',' ORDER BY arrival) AS listing,
  string_agg(md5(CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END), ',' ORDER BY arrival) AS previews FROM items GROUP BY session_id)
SELECT session_id, item_count, listing, previews, length(ctx) AS combined_length, md5(CASE WHEN length(ctx) > 1000 THEN left(ctx, 1000) || '...' ELSE ctx END) AS preview_digest FROM c""")
def session_listing_query(spark, sf):
    rows = session_listing(session_items(items(spark, sf)))
    return rows.select(
        "session_id", "item_count",
        F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["filename"], i["content_length"].cast("string"))), ",").alias("listing"),
        F.array_join(F.transform("items", lambda i: F.md5(i["content_preview"])), ",").alias("previews"),
        "combined_length", F.md5("combined_preview").alias("preview_digest"),
    )


@query("session_gaps", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, CAST(no AS BIGINT) AS session_no, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_access, COUNT(*) AS events FROM n GROUP BY user_id, no""")
def session_gaps(spark, sf):
    found = ordered.sessions(table(spark, sf, "events").select("user_id", "ts"), ["user_id"], "ts", fixed.SESSION_IDLE_SECONDS)
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return found.select("user_id", "session_no", F.date_format("started", fmt).alias("started"),
                        F.date_format("last_access", fmt).alias("last_access"), "events")
