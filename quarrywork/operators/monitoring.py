"""Performance reports, exact quantiles, metric series, health and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.numbers import exact_avg, half_up
from .ordered import PART, balanced, running_sum
from .reports import grouped_with_overall, with_overall

RANGES = 1000
#: Ranks, in thousandths, at which the approximate percentile is asked: one below the answer, the others at or above it.
_BELOW, _ABOVE = 949, 951


def p95_place(n: Column) -> Column:
    """The answer lies between the sorted value of this rank, from one, and the next: ``19 m // 20`` with ``m = n + 1``."""
    return F.least(F.greatest(F.floor((n + 1) * 19 / 20), F.lit(1)), F.greatest(n - 1, F.lit(1)))


def p95_value(n: Column, at: Column, after: Column, largest: Column) -> Column:
    """The 95th percentile by the exclusive rule from the two values around it; the maximum below 20 values."""
    delta = ((n + 1) * 19 - p95_place(n) * 20).cast("double")
    return F.when(n >= 20, (at * (20 - delta) + after * delta) / 20).otherwise(largest)


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys of two aliased frames; a NULL key is a key like any other."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def p95_exclusive(df: DataFrame, keys: list[str], value: str, name: str = "p95") -> DataFrame:
    """Exact 95th percentile of each key by the exclusive rule; the maximum below 20 values.

    No group is sorted whole: an approximate percentile brackets the two ranks around
    the answer, the rows below the bracket are only counted, and just the distinct values
    inside it (about a fifth of a percent of a large group, up to the maximum of a small
    one) are ranked, in ``RANGES`` ranges of equal width that are summed each for itself first.
    """
    v = F.col(value)
    keyed = df.select(*keys, value).filter(v.isNotNull())
    asked = [_BELOW / 1000, *[i / 1000 for i in range(_ABOVE, 1001)]]
    bounds = keyed.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.max(v).alias("_max"), F.percentile_approx(v, asked, 10_000).alias("_near"),
    )
    n, j = F.col("_n"), p95_place(F.col("_n"))
    above = F.ceil((j + 1) * 1000 / n).cast("int") + 1
    bounds = bounds.select(
        *keys, "_n", "_max", F.col("_near")[0].alias("_lo"),
        F.when(above >= 1000, F.col("_max")).otherwise(F.get("_near", F.greatest(above - _ABOVE, F.lit(0)) + 1)).alias("_hi"),
    )
    if keys:
        joined = keyed.alias("r").join(bounds.alias("b"), same_keys("r", "b", keys)).select(
            *[F.col(f"r.{k}").alias(k) for k in keys], "_n", "_max", "_lo", "_hi", F.col(f"r.{value}").alias(value)
        )
    else:
        joined = with_overall(keyed, bounds)
    near = joined.filter(v <= F.col("_hi"))
    share = (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    inside = v >= F.col("_lo")
    counted = near.groupBy(
        *keys, "_n", "_max", F.when(inside, v).alias("_val"),
        F.when(inside, F.coalesce(F.floor(share * RANGES), F.lit(0))).otherwise(-1).alias("_range"),
    ).agg(F.count("*").alias("_c"))
    summed = running_sum(counted, keys, F.col("_range"), [F.col("_val").asc_nulls_first()], {"_cum": F.col("_c")})
    picked = summed.filter(F.col("_val").isNotNull()).groupBy(*keys, "_n", "_max").agg(
        F.min(F.when(F.col("_cum") >= j, F.col("_val"))).alias("_a"),
        F.min(F.when(F.col("_cum") >= j + 1, F.col("_val"))).alias("_b"),
    )
    return picked.select(*keys, p95_value(n, F.col("_a"), F.col("_b"), F.col("_max")).alias(name))


def perf_report(metrics: DataFrame) -> DataFrame:
    """Success rate, latency, throughput and embedding figures, with one row per file type.

    ``metrics``: file_type, file_size_bytes, duration_seconds, success (boolean),
    chunks_generated, embedding_duration.
    """
    d = F.when(F.col("success"), F.col("duration_seconds"))
    speed = F.when(F.col("success"), F.col("file_size_bytes")) / F.greatest(d, F.lit(0.001))
    embed_time = F.when(F.col("success") & (F.col("embedding_duration") > 0), F.col("embedding_duration"))
    rows = grouped_with_overall(metrics, "file_type", {
        "avg_latency": half_up(exact_avg(d), 3), "cnt": F.count_if("success"),
    }, {
        "avg_seconds": half_up(exact_avg(d), 3),
        "min_seconds": half_up(F.min(d), 3),
        "max_seconds": half_up(F.max(d), 3),
        "avg_mb_per_sec": half_up(exact_avg(speed) / (1024 * 1024), 2),
        "total_chunks": F.sum(F.when(F.col("success"), F.col("chunks_generated"))),
        "avg_embedding_time": half_up(F.coalesce(exact_avg(embed_time), F.lit(0.0)), 3),
        "total_processed": F.count("*"),
        "success_rate": half_up(F.count_if("success").cast("double") / F.count("*") * 100, 1),
    }).filter("cnt > 0")
    p95 = p95_exclusive(metrics.filter("success"), [], "duration_seconds", "p95_seconds")
    return with_overall(rows, p95.select(half_up(F.col("p95_seconds"), 3).alias("p95_seconds")))


def model_perf_report(metrics: DataFrame) -> DataFrame:
    """Count, latency, tokens and throughput of each operation.

    ``metrics``: operation, duration_seconds, tokens_processed.
    """
    d, t = F.col("duration_seconds"), F.col("tokens_processed")
    seconds = F.sum(d.cast("decimal(28,6)")).cast("double")
    base = metrics.groupBy("operation").agg(
        F.count("*").alias("cnt"),
        half_up(exact_avg(d), 4).alias("avg_latency"),
        F.sum(t).alias("total_tokens"),
        half_up(exact_avg(t, 0), 1).alias("avg_tokens_per_req"),
        F.when(seconds > 0, half_up(F.sum(t) / seconds, 1)).otherwise(F.lit(0.0)).alias("throughput_tokens_sec"),
    )
    p95 = p95_exclusive(metrics, ["operation"], "duration_seconds", "p95_latency")
    joined = base.alias("b").join(p95.alias("p"), same_keys("b", "p", ["operation"]), "left")
    return joined.select("b.*", half_up(F.col("p95_latency"), 4).alias("p95_latency"))


def metric_counters(requests: DataFrame, labels: list[str]) -> DataFrame:
    return requests.groupBy(*labels).agg(F.count("*").alias("total"))


def metric_histogram(df: DataFrame, label: str, value: str, bounds: tuple[float, ...] = fixed.LATENCY_BUCKETS) -> DataFrame:
    """Cumulative buckets, sum and count per label in one aggregation pass."""
    v = F.col(value)
    names = [f"_b{i}" for i in range(len(bounds))]
    wide = df.groupBy(label).agg(
        F.count(v).alias("series_count"),
        F.sum(v.cast("decimal(28,6)")).cast("double").alias("series_sum"),
        *[F.count_if(v <= b).alias(n) for b, n in zip(bounds, names)],
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(n).alias("bucket_count")) for b, n in zip(bounds, names)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("series_count").alias("bucket_count")))
    return wide.select(label, "series_count", "series_sum", F.inline(F.array(*rows)))


def metric_gauge(df: DataFrame, label: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(label).agg(F.max_by(value, F.struct(*order)).alias("value"))


def concurrency_profile(requests: DataFrame) -> DataFrame:
    """Requests active at each arrival, and whether a limit is passed.

    ``requests``: id, started, ended, heavy (boolean). Every request is a +1 at its
    start and a -1 at its end; ends come before starts at the same instant. The buckets of the running
    sum hold about equal numbers of rows, so a busy hour is many tasks.
    """
    starts = requests.select("id", F.col("started").alias("at"), F.lit(1).alias("step"), "heavy")
    ends = requests.select("id", F.col("ended").alias("at"), F.lit(-1).alias("step"), "heavy")
    order = [F.col("at"), F.col("step"), F.col("id")]
    line = balanced(starts.unionByName(ends), [], order, "concurrency")
    summed = running_sum(
        line, [], F.col(PART), order,
        {"active": F.col("step"), "heavy_active": F.when(F.col("heavy"), F.col("step")).otherwise(0)},
    )
    return summed.filter(F.col("step") == 1).select(
        "id", "active", "heavy_active",
        (F.col("active") > fixed.MAX_CONCURRENT).alias("over_total"),
        (F.col("heavy") & (F.col("heavy_active") > fixed.MAX_CONCURRENT_HEAVY)).alias("over_heavy"),
    )


def health_status(hosts: DataFrame) -> DataFrame:
    """Disk, memory and overall status of host readings (database, disk and memory columns)."""
    def graded(name: str, critical: int, warning: int) -> Column:
        return F.when(F.col(name) >= critical, "critical").when(F.col(name) >= warning, "warning").otherwise("healthy")

    disk, memory = graded("disk_percent", 95, 85), graded("memory_percent", 90, 75)
    staged = hosts.withColumns({"disk_status": disk, "memory_status": memory})
    found = F.array("database_status", "disk_status", "memory_status")

    def seen(*names: str) -> Column:
        return F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))

    overall = F.when(seen("unhealthy", "critical"), "unhealthy").when(seen("degraded", "warning"), "degraded")
    return staged.withColumn("status", overall.otherwise("healthy"))


def threshold_alerts(readings: DataFrame, key: list[str]) -> DataFrame:
    """One row per reading above its limit, with title and level; missing metrics count as zero."""
    def alert(metric: str, title: str, limit: float, level: str) -> Column:
        value = F.coalesce(F.col(metric), F.lit(0.0)).cast("double")
        return F.when(value > limit, F.struct(
            F.lit(metric).alias("metric"), F.lit(title).alias("title"), F.lit(level).alias("level"), value.alias("value")
        ))

    raised = F.array_compact(F.array(*[alert(*row) for row in fixed.ALERT_LIMITS]))
    return readings.select(*key, F.inline(raised))


def step_latency(runs: DataFrame, latencies: str) -> DataFrame:
    """Latency per agent step from a map column."""
    return runs.select(F.explode(latencies).alias("step", "latency_ms")).groupBy("step").agg(
        F.count("*").alias("runs"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms")
    )


def trace_defaults(traces: DataFrame) -> DataFrame:
    """Complete request traces and their JSON form without null fields.

    Time to first token is the gateway latency when known, else the total latency; an
    empty vector search is flagged.
    """
    ttft = F.when(F.col("gateway_latency_ms") > 0, F.col("gateway_latency_ms")).otherwise(F.col("total_latency_ms"))
    done = traces.withColumns({
        "ttft_ms": ttft,
        "vector_search_empty": F.coalesce(F.col("vector_results_count"), F.lit(0)) == 0,
        "tokens_total": F.coalesce("tokens_input", F.lit(0)) + F.coalesce("tokens_output", F.lit(0)),
    })
    return done.withColumn("trace", F.to_json(F.struct(*done.columns)))
