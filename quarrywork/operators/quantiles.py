"""Exact 95th percentiles of any span of days from sketches stored per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .monitoring import RANGES, p95_exclusive, p95_place, p95_value, same_keys
from .ordered import running_sum

#: Size of a sketch: the larger, the closer its ranks. Any size gives exact answers; a small one sends more keys the long way.
SKETCH = 1600
#: Ranks at which a merged sketch is asked, and by how many of them a bracket is widened.
STEPS, MARGIN = 200, 2


def daily_sketches(rows: DataFrame, day: str, keys: list[str], value: str, size: int = SKETCH) -> DataFrame:
    """One row per day and key: count, least and largest value, and a mergeable sketch of ``value`` (a double).

    Null and NaN are no values; a day and key without a value has no row. A null day or key is one like any other.
    """
    v = F.col(value)
    return rows.filter(v.isNotNull() & ~F.isnan(v)).groupBy(day, *keys).agg(
        F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("largest"),
        F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"),
    )


def brackets(sketches: DataFrame, day: str, keys: list[str], first: Column, last: Column, margin: int = MARGIN) -> DataFrame:
    """Per key: rows of the days from ``first`` to ``last``, and two values between which the 95th percentile should lie.

    Only the stored sketches are read. The ranks are taken from the count, so small keys get a wide bracket by the same rule.
    """
    span = sketches.filter(F.col(day).between(first, last))
    merged = span.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.min("least").alias("_least"), F.max("largest").alias("_largest"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    grid = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
    place = p95_place(F.col("_n"))
    low = F.floor(place * STEPS / F.col("_n")).cast("int") - margin
    high = F.ceil((place + 1) * STEPS / F.col("_n")).cast("int") + margin
    asked = merged.withColumn("_grid", grid)
    return asked.select(
        *keys, "_n", "_largest",
        F.when(low <= 0, F.col("_least")).otherwise(F.get("_grid", low)).alias("_lo"),
        F.when(high >= STEPS, F.col("_largest")).otherwise(F.get("_grid", high)).alias("_hi"),
    )


def p95_of_span(
    rows: DataFrame, sketches: DataFrame, day: str, keys: list[str], value: str, first: Column, last: Column,
    margin: int = MARGIN,
) -> DataFrame:
    """Exact 95th percentile (exclusive rule) of each key over the days from ``first`` to ``last``: keys (one or more), ``n``, ``p95``.

    ``rows`` is the stored table, best partitioned by ``day``; ``sketches`` is ``daily_sketches`` of the same rows.
    The merged sketches bracket the answer and give each key's count. Ranks are counted from the top, so values
    below the least bracket are not read: that bound goes to the scan as a filter. Of the rest, values above a key's bracket are
    counted and those inside ranked. A sketch errs now and then; a key whose ranks turn out to lie outside its bracket
    is computed from all its values, so the answer is exact in every case.
    """
    v = F.col(value)
    inside = rows.filter(F.col(day).between(first, last)).select(*keys, value).filter(v.isNotNull() & ~F.isnan(v))
    found = brackets(sketches, day, keys, first, last, margin)
    floor = found.agg(F.min("_lo")).first()[0]
    near = inside if floor is None else inside.filter(v >= F.lit(floor))
    joined = near.alias("r").join(found.alias("b"), same_keys("r", "b", keys)).filter(v >= F.col("_lo")).select(
        *[F.col(f"b.{k}").alias(k) for k in keys], "_n", "_largest", "_lo", "_hi", value
    )
    share = (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    below = v <= F.col("_hi")
    counted = joined.groupBy(
        *keys, "_n", "_largest", F.when(below, v).alias("_val"),
        F.when(below, -F.coalesce(F.floor(share * RANGES), F.lit(0))).otherwise(-RANGES - 1).alias("_range"),
    ).agg(F.count("*").alias("_c"))
    summed = running_sum(counted, keys, F.col("_range"), [F.col("_val").desc_nulls_first()], {"_down": F.col("_c")})
    # _down rows are at or above the value: the value holds the ranks from n - _down + 1 to n - _down + _c
    j, start = p95_place(F.col("_n")), F.col("_n") - F.col("_down")
    held = F.col("_val").isNotNull()

    def at(rank: Column) -> Column:
        return F.max(F.when(held & (start < rank) & (rank <= start + F.col("_c")), F.col("_val")))

    picked = summed.groupBy(*keys, "_n", "_largest").agg(at(j).alias("_a"), at(j + 1).alias("_b"))
    p95 = p95_value(F.col("_n"), F.col("_a"), F.col("_b"), F.col("_largest"))
    answers = materialize(picked.select(*keys, F.col("_n").alias("n"), p95.alias("p95")), "span-p95")
    missed = answers.filter(F.col("p95").isNull()).drop("p95")
    whole = inside.alias("r").join(missed.alias("m"), same_keys("r", "m", keys), "left_semi")
    again = p95_exclusive(whole, keys, value)
    rest = missed.alias("m").join(again.alias("a"), same_keys("m", "a", keys)).select(
        *[F.col(f"m.{k}").alias(k) for k in keys], "n", "p95"
    )
    return answers.filter(F.col("p95").isNotNull()).unionByName(rest)
