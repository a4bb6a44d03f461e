"""Streams made of built-in stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import LATENCY_BUCKETS, SESSION_IDLE_SECONDS
from ..operators import chunking, embedding, ordered

ERROR_RATE_LIMIT = 0.05


def late_after(events: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """Rows later than ``delay`` behind the newest are dropped and their windows forgotten; None keeps everything."""
    return events.withWatermark(ts, delay) if delay else events


def counts(events: DataFrame, kind: str = "event_type", ts: str = "ts", width: str = "1 day",
           slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Live totals per kind and window (tumbling, or sliding with ``slide``), in whatever order rows come."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        late_after(events, ts, delay).groupBy(span.alias("span"), kind)
        .agg(F.count("*").alias("cnt"), F.sum(F.col("value").cast("decimal(28,2)")).alias("total"))
        .select(F.col("span.start").alias("started"), kind, "cnt", "total")
    )


def error_rates(events: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str | None = None,
                limit: float = ERROR_RATE_LIMIT) -> DataFrame:
    """Requests, errors and whether to alert, per window; every change of a window leaves the stream."""
    rate = F.col("errors") / F.col("requests")
    return (
        late_after(events, ts, delay).groupBy(F.window(ts, width).alias("span"))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select(F.col("span.start").alias("started"), "requests", "errors", rate.alias("error_rate"), (rate > limit).alias("alert"))
    )


def metrics(events: DataFrame, label: str, value: str) -> DataFrame:
    """Counter, sum and cumulative buckets per label."""
    v = F.col(value)
    return events.groupBy(label).agg(
        F.count("*").alias("total"), F.sum(v.cast("decimal(28,6)")).alias("sum_value"),
        *[F.count_if(v <= b).alias(f"le_{i}") for i, b in enumerate(LATENCY_BUCKETS)],
    )


def session_parts(events: DataFrame, key: str, ts: str = "ts", idle: int = SESSION_IDLE_SECONDS) -> DataFrame:
    """The parts of each key's sessions; ``ordered.merge_session_parts`` joins them when they are read.

    State is one small row per key and idle-wide bucket of time, so no row comes too late.
    """
    return ordered.session_parts(events, [key], ts, idle)


def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and hash of the first row of each text.

    The whole digest is the identity and is never forgotten; the short hash is for display. The
    text itself is not carried into the state shuffle; join back on the key for the texts.
    """
    hashed = docs.select(key, embedding.text_hash(F.col(text)).alias("text_hash"), F.sha2(F.col(text), 256).alias("digest"))
    return hashed.dropDuplicates(["digest"])


def ingest(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """New documents to embedded chunks; stateless, so it scales with the number of tasks."""
    return embedding.embed_rows(chunking.chunk_fixed(docs, text, [key], size, overlap))
