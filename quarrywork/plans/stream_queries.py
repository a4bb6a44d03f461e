"""Structured Streaming jobs over the tables, and the batch forms of the request guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import half_up
from ..operators import guards, ordered
from ..session import table
from ..streaming import aggregates, stateful
from ..streaming.runner import run_append, run_update, stored, table_stream
from .mapping import prop_k, rounded
from .registry import query

FMT = "yyyy-MM-dd HH:mm:ss"


@query("stream_counts", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS started, event_type, COUNT(*) AS cnt, CAST(SUM(CAST(value AS DECIMAL(28,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def stream_counts(spark, sf):
    rows = run_update(aggregates.counts(table_stream(spark, sf, "events")), "counts", ["started", "event_type"])
    return rows.select(F.date_format("started", FMT).alias("started"), "event_type", "cnt", F.col("total").cast("double").alias("total"))


@query("stream_counts_sliding", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS started, event_type, COUNT(*) AS cnt FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def stream_counts_sliding(spark, sf):
    sliding = aggregates.counts(table_stream(spark, sf, "events"), width="12 hours", slide="6 hours")
    rows = run_update(sliding, "counts-sliding", ["started", "event_type"])
    return rows.select(F.date_format("started", FMT).alias("started"), "event_type", "cnt")


@query("stream_error_alerts", f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS started, COUNT(*) AS requests, COUNT(*) FILTER (event_type = 'error') AS errors,
  {rounded("CAST(COUNT(*) FILTER (event_type = 'error') AS DOUBLE) / COUNT(*)", 4)} AS error_rate FROM events GROUP BY 1 HAVING COUNT(*) FILTER (event_type = 'error') > 0.05 * COUNT(*)""")
def stream_error_alerts(spark, sf):
    rates = run_update(aggregates.error_rates(table_stream(spark, sf, "events")), "error-rates", ["started"])
    return rates.filter("alert").select(
        F.date_format("started", FMT).alias("started"), "requests", "errors", half_up(F.col("error_rate"), 4).alias("error_rate")
    )


BUCKETS = ", ".join(f"COUNT(*) FILTER (value / 50 <= {b}) AS le_{i}" for i, b in enumerate(fixed.LATENCY_BUCKETS))


@query("stream_metrics", f"SELECT event_type, COUNT(*) AS total, CAST(SUM(CAST(value / 50 AS DECIMAL(28,6))) AS DOUBLE) AS sum_value, {BUCKETS} FROM events GROUP BY event_type")
def stream_metrics(spark, sf):
    events = table_stream(spark, sf, "events").withColumn("seconds", F.col("value") / 50)
    rows = run_update(aggregates.metrics(events, "event_type", "seconds"), "metrics", ["event_type"])
    return rows.withColumn("sum_value", F.col("sum_value").cast("double"))


@query("stream_dedup", "SELECT substr(md5(text), 1, 12) AS text_hash FROM (SELECT DISTINCT text FROM documents)")
def stream_dedup(spark, sf):
    docs = table_stream(spark, sf, "documents").select("doc_id", "text")
    return run_append(aggregates.distinct_texts(docs, "doc_id", "text"), "dedup", stateful.STATE_CONF).select("text_hash")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
s AS (SELECT user_id, MIN(ts) AS started, MAX(ts) + INTERVAL 1 HOUR AS ended, COUNT(*) AS events FROM n GROUP BY user_id, no)
SELECT user_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, events,
  ended >= (SELECT MAX(ts) FROM events) AS is_open FROM s""")
def stream_sessions(spark, sf):
    """All sessions; those that a row after the newest one could still prolong are open."""
    parts = run_update(aggregates.session_parts(table_stream(spark, sf, "events").select("user_id", "ts"), "user_id"),
                       "sessions", ["user_id", ordered.BUCKET])
    newest = parts.agg(F.max("_last"))
    found = ordered.merge_session_parts(parts, ["user_id"], fixed.SESSION_IDLE_SECONDS)
    ended = F.col("last_access") + F.make_dt_interval(secs=F.lit(fixed.SESSION_IDLE_SECONDS))
    return found.select(
        "user_id", F.date_format("started", FMT).alias("started"), F.date_format(ended, FMT).alias("ended"), "events",
        (ended >= newest.scalar()).alias("is_open"),
    )


@query("stream_ingest_docs", """SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN greatest(0, CAST(ceil((length(text) - 2048) / 1848.0) AS BIGINT)) + 1
  + CASE WHEN length(text) - 200 > greatest(0, CAST(ceil((length(text) - 2048) / 1848.0) AS BIGINT)) * 1848 THEN 1 ELSE 0 END END AS chunks FROM documents WHERE regexp_matches(text, '\\S')""")
def stream_ingest_docs(spark, sf):
    docs = table_stream(spark, sf, "documents").select("doc_id", "text")
    stored = run_append(aggregates.ingest(docs, "doc_id", "text"), "ingest")
    return stored.groupBy("doc_id").agg(F.count("*").alias("chunks"))


# -- custom state -------------------------------------------------------------------------

# a limit the test events actually reach
LIMIT, WINDOW_SECONDS = 2, 6 * 3600
THRESHOLD = 5


# The twins walk each user's events one by one with a recursive query.
WALK = """o AS (SELECT event_id AS id, user_id, epoch_us(ts) AS at_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""


def rate_sql(name: str) -> str:
    wide = WINDOW_SECONDS * 1_000_000
    return f"""WITH RECURSIVE {WALK},
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, true AS allowed, CAST([] AS BIGINT[]) AS log, CAST(0 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS reset_seconds FROM o
  UNION ALL SELECT user_id, rn, id, len(live) < {LIMIT}, CASE WHEN len(live) < {LIMIT} THEN list_append(live, at_us) ELSE live END,
    CAST(CASE WHEN len(live) < {LIMIT} THEN {LIMIT} - len(live) - 1 ELSE 0 END AS BIGINT),
    CAST(CASE WHEN len(live) > 0 THEN ({wide} - (at_us - live[1])) // 1000000 ELSE {WINDOW_SECONDS} END AS BIGINT)
  FROM (SELECT o.user_id, o.rn, o.id, o.at_us, list_filter(r.log, lambda x: o.at_us - x < {wide}) AS live FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT id AS {name}, allowed, remaining, reset_seconds FROM r WHERE rn > 0"""


def breaker_sql(name: str) -> str:
    return f"""WITH RECURSIVE {WALK},
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, true AS allowed, 'closed' AS state, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS good, CAST(0 AS BIGINT) AS last_bad FROM o
  UNION ALL SELECT user_id, rn, id, NOT refused,
    CASE WHEN refused THEN state WHEN ok AND st = 'half_open' AND sc + 1 >= {fixed.CIRCUIT_SUCCESSES} THEN 'closed' WHEN ok THEN st
         WHEN st = 'half_open' OR failures + 1 >= {fixed.CIRCUIT_FAILURES} THEN 'open' ELSE st END,
    CASE WHEN refused THEN failures WHEN ok AND st = 'half_open' THEN CASE WHEN sc + 1 >= {fixed.CIRCUIT_SUCCESSES} THEN 0 ELSE failures END
         WHEN ok THEN greatest(0, failures - 1) ELSE failures + 1 END,
    CASE WHEN refused THEN good WHEN ok AND st = 'half_open' THEN sc + 1 ELSE sc END,
    CASE WHEN refused OR ok THEN last_bad ELSE at_us END
  FROM (SELECT o.user_id, o.rn, o.id, o.at_us, o.k % 2 = 0 AS ok, r.state, r.failures, r.good, r.last_bad,
      r.state = 'open' AND o.at_us - r.last_bad < {fixed.CIRCUIT_RESET_SECONDS * 1_000_000} AS refused,
      CASE WHEN r.state = 'open' THEN 'half_open' ELSE r.state END AS st, CASE WHEN r.state = 'open' THEN 0 ELSE r.good END AS sc
    FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT id AS {name}, allowed, state, failures FROM r WHERE rn > 0"""


ABUSE_SQL = f"""WITH RECURSIVE {WALK},
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, '' AS verdict, CAST([] AS BIGINT[]) AS log, CAST(0 AS BIGINT) AS refusals, CAST(0 AS BIGINT) AS until FROM o
  UNION ALL SELECT user_id, rn, id,
    CASE WHEN blocked THEN 'blocked' WHEN packed THEN 'rate_limited' WHEN bot THEN 'bot' ELSE 'ok' END,
    CASE WHEN blocked THEN log WHEN packed THEN live ELSE list_append(live, at_us) END,
    CASE WHEN blocked THEN refusals WHEN packed THEN refusals + 1 WHEN bot THEN refusals + {fixed.HONEYPOT_PENALTY} ELSE refusals END,
    CASE WHEN NOT blocked AND packed AND refusals + 1 >= {THRESHOLD} THEN at_us + {fixed.ABUSE_BLOCK_SECONDS * 1_000_000} ELSE until END
  FROM (SELECT *, len(live) >= {LIMIT} AS packed FROM (SELECT o.user_id, o.rn, o.id, o.at_us, o.k % 50 = 0 AS bot, r.log, r.refusals, r.until, o.at_us < r.until AS blocked,
      list_filter(r.log, lambda x: o.at_us - x < {WINDOW_SECONDS * 1_000_000}) AS live FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)))
SELECT id, verdict FROM r WHERE rn > 0"""

ITEMS_SQL = f"""WITH RECURSIVE {WALK},
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS kept, CAST(0 AS BIGINT) AS seen FROM o
  UNION ALL SELECT o.user_id, o.rn, o.id,
    CASE WHEN o.at_us - r.seen > {fixed.SESSION_IDLE_SECONDS * 1_000_000} THEN [o.id] ELSE list_append(r.kept, o.id)[-{fixed.SESSION_MAX_ITEMS}:] END, o.at_us
  FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
SELECT id, len(kept) AS items, kept[1] AS oldest FROM r WHERE rn > 0"""


def verdicts_of(spark, sf, label, verdicts):
    """Every event's verdict in time order, whatever the order of files."""
    found = run_append(verdicts(table_stream(spark, sf, "events")), label, stateful.STATE_CONF)
    return stateful.settled(found, verdicts, stored(spark, sf, "events"), "user_id").drop("late", "key")


@query("stream_rate_limit", rate_sql("id"))
def stream_rate_limit(spark, sf):
    return verdicts_of(spark, sf, "rate-limit", lambda events: stateful.rate_limit(events, "user_id", "event_id", "ts", LIMIT, WINDOW_SECONDS))


@query("rate_limit_batch", rate_sql("event_id"))
def rate_limit_batch(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return guards.rate_limit(events, "user_id", "ts", "event_id", LIMIT, WINDOW_SECONDS)


@query("stream_abuse_block", ABUSE_SQL)
def stream_abuse_block(spark, sf):
    bot = F.pmod(prop_k(), F.lit(50)) == 0
    return verdicts_of(spark, sf, "abuse", lambda events: stateful.abuse_block(
        events, "user_id", "event_id", "ts", bot, LIMIT, WINDOW_SECONDS, THRESHOLD
    ))


@query("stream_circuit_breaker", breaker_sql("id"))
def stream_circuit_breaker(spark, sf):
    ok = F.pmod(prop_k(), F.lit(2)) == 0
    return verdicts_of(spark, sf, "breaker", lambda events: stateful.circuit_breaker(events, "user_id", "event_id", "ts", ok))


@query("circuit_breaker_batch", breaker_sql("event_id"))
def circuit_breaker_batch(spark, sf):
    calls = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.pmod(prop_k(), F.lit(2)) == 0).alias("ok"))
    return guards.circuit_breaker(calls, "user_id", "ts", "event_id", "ok")


@query("stream_session_items", ITEMS_SQL)
def stream_session_items(spark, sf):
    return verdicts_of(spark, sf, "session-items", lambda events: stateful.session_items(events, "user_id", "event_id", "ts"))


@query("stream_retain", """SELECT event_type AS label, COUNT(*) AS retained, arg_min(event_id, {'t': ts, 'e': event_id}) AS oldest, arg_max(event_id, {'t': ts, 'e': event_id}) AS newest FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 1000 GROUP BY event_type""")
def stream_retain(spark, sf):
    stream = stateful.retain_last(table_stream(spark, sf, "events"), "event_type", "event_id", "ts", 1000)
    rows = stateful.retained(run_append(stream, "retain", stateful.STATE_CONF), 1000)
    place = F.struct("at", "id")
    return rows.groupBy("label").agg(
        F.count("*").alias("retained"), F.min_by("id", place).alias("oldest"), F.max_by("id", place).alias("newest")
    )
