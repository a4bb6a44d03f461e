"""Streams over many files: state crosses micro-batches and no row is lost."""

import pytest
from check import connect, rows_of

from quarrywork.plans import load_all
from quarrywork.session import shared_path
from quarrywork.streaming import runner, stateful
from quarrywork.streaming.runner import run_append, table_stream
from pyspark.sql import functions as F

FILES = 6
ANY_ORDER = ("stream_counts", "stream_counts_sliding", "stream_error_alerts", "stream_metrics", "stream_dedup", "stream_sessions", "stream_retain")
TIME_ORDER = ("stream_rate_limit", "stream_abuse_block", "stream_circuit_breaker", "stream_session_items")


def in_files(spark, sf, part):
    """The small tables, events and documents dealt into files that arrive one after another."""
    folder = shared_path(spark, "many-files")
    for name, key in (("events", "event_id"), ("documents", "doc_id")):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(FILES)) if name == "documents" else part)
        for k in range(FILES):
            dealt.filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def shuffled(spark, sf):
    return in_files(spark, sf, F.pmod(F.xxhash64("event_id"), F.lit(FILES)))


@pytest.fixture(scope="module")
def by_time(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).approxQuantile("at", [k / FILES for k in range(1, FILES)], 0.0)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return in_files(spark, sf, sum((at >= int(c)).cast("int") for c in cuts))


@pytest.fixture(autouse=True)
def one_file_each(monkeypatch):
    monkeypatch.setattr(runner, "MAX_BYTES", 1)


def same_as_twin(name, spark, folder, sf):
    query = load_all()[name]
    df = query.build(spark, folder)
    cursor = connect(sf).execute(query.sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", ANY_ORDER)
def test_any_order(name, spark, shuffled, sf):
    same_as_twin(name, spark, shuffled, sf)


@pytest.mark.parametrize("name", TIME_ORDER)
def test_time_order(name, spark, by_time, sf):
    same_as_twin(name, spark, by_time, sf)


@pytest.mark.parametrize("name", TIME_ORDER)
def test_verdicts_in_any_order_of_files(name, spark, shuffled, sf):
    same_as_twin(name, spark, shuffled, sf)


def test_late_rows_leave_with_a_flag(spark, shuffled, sf):
    stream = stateful.rate_limit(table_stream(spark, shuffled, "events"), "user_id", "event_id", "ts", 2, 3600)
    rows = run_append(stream, "late", stateful.STATE_CONF)
    ids = [r["id"] for r in rows.select("id").collect()]
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert sorted(ids) == sorted(r["event_id"] for r in events.select("event_id").collect())
    assert rows.filter("late").count() > 0 and rows.filter("late <> (allowed is null)").count() == 0
