"""Ordered work with nearly all rows in one key and one hour."""

import pytest
from pyspark.sql import functions as F

from quarrywork.operators import monitoring, ordered


def hot(spark, n=20_000):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(1).alias("key"),
        (F.lit("2024-01-01 10:00:00").cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * 7919 % 3600).cast("decimal(18,6)"))).alias("at"),
    )


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small partitions are otherwise put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_buckets_follow_the_counts(spark):
    rows = ordered.balanced(hot(spark).repartition(8), ["key"], [F.col("at"), F.col("id")], "skew-test")
    sizes = [r["count"] for r in rows.groupBy(ordered.PART).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_running_sum_over_a_hot_key(spark):
    rows = ordered.balanced(hot(spark), ["key"], [F.col("at"), F.col("id")], "skew-test")
    summed = ordered.running_sum(rows, ["key"], F.col(ordered.PART), [F.col("at"), F.col("id")], {"total": F.col("id")})
    got = {r["id"]: r["total"] for r in summed.collect()}
    want, totals = {}, {}
    for r in sorted(hot(spark).collect(), key=lambda r: (r["key"], r["at"], r["id"])):
        totals[r["key"]] = want[r["id"]] = totals.get(r["key"], 0) + r["id"]
    assert got == want


def test_concurrency_in_one_hour(spark):
    requests = hot(spark, 3000).select(
        "id", F.col("at").alias("started"), (F.col("at") + F.expr("INTERVAL 5 SECONDS")).alias("ended"), (F.col("key") == 1).alias("heavy")
    )
    got = {r["id"]: (r["active"], r["heavy_active"]) for r in monitoring.concurrency_profile(requests).collect()}
    line = []
    for r in requests.collect():
        line += [(r["started"], 1, r["id"], r["heavy"]), (r["ended"], -1, r["id"], r["heavy"])]
    active = heavy = 0
    want = {}
    for _, step, i, h in sorted(line):
        active, heavy = active + step, heavy + step * h
        if step == 1:
            want[i] = (active, heavy)
    assert got == want
