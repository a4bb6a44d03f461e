"""Batch forms of the request guards, cut into independent stretches of time.

Whether a request passes depends on the ones before it, so a key's rows are walked in
order. But the dependence breaks wherever the state is known from the rows alone, and
those places are found with per-bucket counts. Every stretch between two of them is
its own group, walked with bounded memory over sorted Arrow batches; a busy key
becomes as many groups as it has calm moments.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.limits import Breaker, SlidingLog
from .ordered import BUCKET, micros, time_bucket, with_bucket_values

SEGMENT = "_segment"
GROUP = "_group"


def _walk(rows: DataFrame, key: str, order: list[str], schema: str,
          start: Callable[[], object], step: Callable[[object, tuple], tuple | None], inputs: list[str]) -> DataFrame:
    """Walk every ``(key, segment)`` group in order; state passes from one Arrow batch to the next."""
    # a text label, so that a NULL key compares equal to itself in the walk
    label = F.concat_ws("@", F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.col(SEGMENT).cast("string"))
    labelled = rows.withColumn(GROUP, label)
    grouped = labelled.repartition(GROUP).sortWithinPartitions(GROUP, *order).select(GROUP, *inputs)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            columns = [pdf[c].tolist() for c in inputs]
            for group, *values in zip(pdf[GROUP].tolist(), *columns):
                if group != current:
                    current, state = group, start()
                row = step(state, tuple(values))
                if row is not None:
                    out.append(row)
            yield pd.DataFrame(out, columns=names)

    return grouped.mapInPandas(run, schema)


def rate_limit(
    requests: DataFrame, key: str, ts: str, row_id: str,
    limit: int = fixed.RATE_LIMIT_REQUESTS, window: int = fixed.RATE_LIMIT_WINDOW_SECONDS,
) -> DataFrame:
    """Verdict of the sliding-log rate limit on every request: allowed, remaining, reset seconds.

    Time is cut into buckets one window wide. A bucket is calm when it and the one before
    it hold at most ``limit`` requests: then all of its requests pass, and the state at
    its end is just its own rows. So the bucket after a calm or empty one starts a new
    segment, with the calm bucket's rows as run-up. Only overload runs stay together.
    """
    wide = window * 1_000_000
    rows = requests.select(F.col(key), F.col(row_id), micros(F.col(ts)).alias("_at"), time_bucket(F.col(ts), window).alias(BUCKET))
    order = Window.partitionBy(key).orderBy(BUCKET)
    counts = rows.groupBy(key, BUCKET).agg(F.count("*").alias("_n"))
    near = counts.withColumns({
        "_before": F.when(F.lag(BUCKET).over(order) == F.col(BUCKET) - wide, F.lag("_n").over(order)),
        "_next": F.when(F.lead(BUCKET).over(order) == F.col(BUCKET) + wide, F.lead(BUCKET).over(order)),
    }).withColumn("_calm", F.col("_n") + F.coalesce("_before", F.lit(0)) <= limit)
    fresh = F.col("_before").isNull() | F.lag("_calm").over(order)
    segments = near.withColumn("_fresh", fresh).select(
        key, BUCKET,
        F.max(F.when(F.col("_fresh"), F.col(BUCKET))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(SEGMENT),
        F.when(F.col("_calm"), F.col("_next")).alias("_run_up_for"),
    )
    placed = with_bucket_values(rows, segments, [key])
    own = F.struct(F.col(SEGMENT).alias("segment"), F.lit(False).alias("run_up"))
    extra = F.struct(F.col("_run_up_for").alias("segment"), F.lit(True).alias("run_up"))
    copies = placed.withColumn(
        "_in", F.explode(F.when(F.col("_run_up_for").isNull(), F.array(own)).otherwise(F.array(own, extra)))
    ).select(key, row_id, "_at", F.col("_in.segment").alias(SEGMENT), F.col("_in.run_up").alias("_run_up"))

    def step(log: SlidingLog, row: tuple) -> tuple | None:
        request, at, run_up = row
        if run_up:
            log.log.append(at)
            return None
        return (request, *log.admit(at))

    return _walk(
        copies, key, ["_at", row_id], f"{row_id} bigint, allowed boolean, remaining bigint, reset_seconds bigint",
        lambda: SlidingLog(limit, window, deque()), step, [row_id, "_at", "_run_up"],
    )


def circuit_breaker(calls: DataFrame, key: str, ts: str, row_id: str, ok: str, bucket_seconds: int = 3600) -> DataFrame:
    """State of a circuit breaker per service at every call: allowed, state after, failure count.

    A bucket starts a new segment when the breaker is certainly closed with no failure
    counted: either nothing failed before, or enough successes for any state to have
    recovered lie in whole buckets that begin after the reset time of the last failure.
    """
    wide = bucket_seconds * 1_000_000
    enough = max(fixed.CIRCUIT_FAILURES - 1, fixed.CIRCUIT_SUCCESSES)
    if bucket_seconds < fixed.CIRCUIT_RESET_SECONDS:
        raise ValueError("a bucket must be at least as wide as the reset time")
    rows = calls.select(
        F.col(key), F.col(row_id), micros(F.col(ts)).alias("_at"), F.col(ok).alias("_ok"), time_bucket(F.col(ts), bucket_seconds).alias(BUCKET)
    )
    order = Window.partitionBy(key).orderBy(BUCKET)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(key, BUCKET).agg(
        F.count_if("_ok").alias("_good"), F.count_if(~F.col("_ok")).alias("_bad")
    )
    failing = F.when(F.col("_bad") > 0, F.col(BUCKET))
    known = summary.withColumns({
        "_last_bad": F.max(failing).over(earlier),
        "_run": F.coalesce(F.count(failing).over(earlier), F.lit(0)),
    }).withColumn("_sure", F.when(F.col(BUCKET) >= F.col("_last_bad") + 2 * wide, F.col("_good")).otherwise(0))
    in_run = Window.partitionBy(key, "_run").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    recovered = F.coalesce(F.sum("_sure").over(in_run), F.lit(0)) >= enough
    segments = known.withColumn("_fresh", (F.col("_run") == 0) | recovered).select(
        key, BUCKET,
        F.max(F.when(F.col("_fresh"), F.col(BUCKET))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(SEGMENT),
    )
    placed = with_bucket_values(rows, segments, [key]).drop(BUCKET)

    def step(breaker: Breaker, row: tuple) -> tuple:
        call, at, good = row
        allowed = breaker.step(at, bool(good))
        return call, allowed, breaker.state, breaker.failures

    return _walk(
        placed, key, ["_at", row_id], f"{row_id} bigint, allowed boolean, state string, failures bigint",
        Breaker, step, [row_id, "_at", "_ok"],
    )
