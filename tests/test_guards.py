"""Rate limit, breaker and ordered windows against plain loops, with a dominant key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from quarrywork.functions.limits import AbuseGuard, Breaker, SlidingLog
from quarrywork.operators import guards, ordered
from quarrywork.operators.topn import top_n_per_group
from quarrywork.plans import load_all

START = datetime(2024, 1, 1)


def traffic(seed, n, mean_gap):
    """Requests where key 0 holds a third of all rows, with bursts and pauses."""
    rng = random.Random(seed)
    at = {k: 0.0 for k in range(5)}
    rows = []
    for i in range(n):
        k = 0 if rng.random() < 0.33 else rng.randrange(1, 5)
        gap = rng.expovariate(1 / mean_gap) if rng.random() > 0.05 else rng.uniform(0, 200)
        at[k] += round(gap, 3)
        rows.append((i, k, START + timedelta(seconds=at[k]), rng.random() < 0.7))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, k bigint, ts timestamp, ok boolean").repartition(7)


def micros(ts):
    return int((ts - START).total_seconds() * 1_000_000 + 0.5)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[2], r[0]))


@pytest.mark.parametrize("seed, mean_gap, limit", [(1, 4, 10), (2, 1, 10), (3, 20, 50), (4, 0.2, 3), (5, 6, 10)])
def test_rate_limit(spark, seed, mean_gap, limit):
    rows = traffic(seed, 3000, mean_gap)
    logs, want = {}, {}
    for i, k, ts, _ in in_order(rows):
        want[i] = logs.setdefault(k, SlidingLog(limit, 60)).admit(micros(ts))
    got = guards.rate_limit(frame(spark, rows), "k", "ts", "id", limit, 60).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.allowed, r.remaining, r.reset_seconds) for r in got} == want
    assert len({v[0] for v in want.values()}) == (1 if mean_gap == 20 else 2)


def test_exactly_one_window_apart():
    log = SlidingLog(1, 60)
    assert [log.admit(t * 1_000_000)[0] for t in (0, 59, 60, 61, 120)] == [True, False, True, False, True]


@pytest.mark.parametrize("seed, mean_gap", [(1, 2), (2, 30), (3, 400)])
def test_circuit_breaker(spark, seed, mean_gap):
    rows = traffic(seed, 3000, mean_gap)
    breakers, want = {}, {}
    for i, k, ts, ok in in_order(rows):
        b = breakers.setdefault(k, Breaker())
        allowed = b.step(micros(ts), ok)
        want[i] = (allowed, b.state, b.failures)
    got = guards.circuit_breaker(frame(spark, rows), "k", "ts", "id", "ok", 120).collect()
    assert {r.id: (r.allowed, r.state, r.failures) for r in got} == want


def test_breaker_thresholds():
    b = Breaker()
    for t in range(4):
        assert b.step(t, False)
    assert b.state == "closed"
    b.step(5, False)
    assert b.state == "open" and not b.step(1_000_000, True)
    late = 61 * 1_000_000
    assert b.step(late, True) and b.state == "half_open"
    b.step(late + 1, True)
    b.step(late + 2, True)
    assert b.state == "closed" and b.failures == 0


def test_abuse_guard():
    guard = AbuseGuard(SlidingLog(1, 60), threshold=3, block_seconds=100)
    second = 1_000_000
    assert [guard.step(t * second, False) for t in (0, 1, 2, 3, 50, 103, 104)] == [
        "ok", "rate_limited", "rate_limited", "rate_limited", "blocked", "ok", "rate_limited",
    ]
    bots = AbuseGuard(SlidingLog(5, 60), threshold=11, block_seconds=100)
    assert bots.step(0, True) == "bot" and bots.refusals == 10


@pytest.mark.parametrize("stream, batch", [("stream_rate_limit", "rate_limit_batch"), ("stream_circuit_breaker", "circuit_breaker_batch")])
def test_stream_equals_batch(spark, sf, stream, batch):
    queries = load_all()

    def rows(name):
        df = queries[name].build(spark, sf)
        return sorted(tuple(r)[0:] for r in df.select(*[c for c in df.columns if c not in ("id", "event_id")],
                                                       F.col(df.columns[0]).alias("row")).collect())

    assert rows(stream) == rows(batch)


def test_running_sum_previous_and_average(spark):
    rows = traffic(7, 2000, 50)
    df = frame(spark, rows).withColumn("v", F.col("id").cast("double"))
    order = [F.col("ts"), F.col("id")]
    bucket = ordered.time_bucket(F.col("ts"), 600)
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.select(
        "id", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("id").over(w).alias("p"),
        F.avg("v").over(w.rowsBetween(-9, 0)).alias("m"),
    )
    want = {r.id: (r.s, r.p, round(r.m, 9)) for r in plain.collect()}
    sums = {r.id: r.s for r in ordered.running_sum(df, ["k"], bucket, order, {"s": F.col("id")}).collect()}
    prev = {r.id: r.p for r in ordered.previous_value(df, ["k"], bucket, order, F.col("id"), "p").collect()}
    mean = {r.id: round(r.m, 9) for r in ordered.moving_average(df, ["k"], bucket, order, "v", 10, "m", block=64).collect()}
    assert {i: (sums[i], prev[i], mean[i]) for i in want} == want


@pytest.mark.parametrize("gap, parts", [(3600, 1), (3600.001, 2)])
def test_session_gap_edge(spark, gap, parts):
    df = spark.createDataFrame([(1, START), (1, START + timedelta(seconds=gap))], "k int, ts timestamp")
    assert ordered.sessions(df, ["k"], "ts", 3600).count() == parts


def test_asof_same_instant(spark):
    left = spark.createDataFrame([(1, 1, START), (2, 1, START - timedelta(1)), (3, 2, START)], "id bigint, k bigint, ts timestamp")
    right = spark.createDataFrame([(10, 1, START), (11, 1, START), (12, 1, START + timedelta(1))], "id bigint, k bigint, ts timestamp")
    got = ordered.asof_join(left, right, ["k"], "ts", 3600, "id", ["id"]).collect()
    assert {r.id: r.prev_id for r in got} == {1: 11, 2: None, 3: None}


def test_top_n_with_dominant_key(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    got = top_n_per_group(df, ["k"], [F.col("id").desc()], 5)
    w = Window.partitionBy("k").orderBy(F.col("id").desc())
    want = df.withColumn("r", F.row_number().over(w)).filter("r <= 5")
    assert {(r.k, r.id) for r in got.collect()} == {(r.k, r.id) for r in want.collect()}


def test_null_keys_are_a_group_of_their_own(spark):
    rows = [(i, None if k == 0 else k, ts, ok) for i, k, ts, ok in traffic(9, 800, 3)]
    df = frame(spark, rows)
    log, want = {}, {}
    for i, k, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = log.setdefault(k, SlidingLog(5, 60)).admit(micros(ts))
    got = guards.rate_limit(df, "k", "ts", "id", 5, 60).collect()
    assert {r.id: (r.allowed, r.remaining, r.reset_seconds) for r in got} == want
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {r.id: r.s for r in df.select("id", F.sum("id").over(w).alias("s")).collect()}
    summed = ordered.running_sum(df, ["k"], ordered.time_bucket(F.col("ts"), 60), [F.col("ts"), F.col("id")], {"s": F.col("id")})
    assert {r.id: r.s for r in summed.collect()} == plain
