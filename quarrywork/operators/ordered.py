"""Running values over long ordered groups, split by buckets of the order column.

A plain window over a key puts all of the key's rows into one task. Here each group
is cut into fixed buckets (of time, say): rows are processed inside ``(key, bucket)``,
a small summary per bucket carries the effect of earlier buckets, and the two are
joined on ``(key, bucket)``. Only the summaries of a key meet in one task, and there
is one per bucket, however many rows the key has. Choose the bucket width so that one
bucket of the busiest key fits a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

BUCKET = "_bucket"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the fixed-width bucket, in microseconds (whole-number arithmetic)."""
    at = micros(ts)
    return at - F.pmod(at, F.lit(seconds * 1_000_000))


def number_bucket(position: Column, width: int) -> Column:
    return position - F.pmod(position, F.lit(width))


PART = "_part"


def balanced(df: DataFrame, keys: list[str], order: list[Column], label: str) -> DataFrame:
    """``df`` with buckets in ``PART`` that follow the counts: ranges of (key, order) of about equal size.

    For keys or times of which one holds a large share of all rows. Written, because both passes of a
    two-level sum must see the same ranges.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn(PART, F.spark_partition_id()), label)


def with_bucket_values(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Bring a summary's values to the rows of its ``(key, bucket)``; a NULL key is a key like any other."""
    on = [*keys, BUCKET]
    renamed = summary.withColumnsRenamed({k: f"_k_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on])
    return rows.join(renamed, same, "left").drop(*[f"_k_{k}" for k in on])


def running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums ``values`` of each key in ``order``.

    ``order`` must be total inside a bucket and agree with the bucket order.
    """
    staged = df.withColumn(BUCKET, bucket).withColumns({f"_v_{n}": v for n, v in values.items()})
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy(*keys, BUCKET).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    carried = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in values]
    )
    inside = staged.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(local) for n in values})
    joined = with_bucket_values(inside, carried, keys)
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in values])


def position(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "position") -> DataFrame:
    """Row number of each row inside its key, from one."""
    return running_sum(df, keys, bucket, order, {name: F.lit(1).cast("bigint")})


def previous_value(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Last non-null ``value`` strictly before each row of its key."""
    staged = df.withColumn(BUCKET, bucket).withColumn("_v", value)
    before = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    ends = staged.filter(F.col("_v").isNotNull()).groupBy(*keys, BUCKET).agg(
        F.max_by("_v", F.struct(*order)).alias("_end")
    )
    # every bucket needs a carried value, also those without a value of their own
    frames = with_bucket_values(staged.select(*keys, BUCKET).distinct(), ends, keys)
    carried = frames.select(*keys, BUCKET, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    inside = staged.withColumn("_local", F.last("_v", ignorenulls=True).over(before))
    return with_bucket_values(inside, carried, keys).select(*df.columns, F.coalesce("_local", "_carry").alias(name))


def moving_average(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str, rows: int, name: str,
    block: int = 100_000,
) -> DataFrame:
    """Mean of the last ``rows`` values of each key, at every row.

    Rows get their position in the key; blocks of positions are then windows of their
    own, each with the last ``rows - 1`` rows of the block before as run-up.
    """
    placed = position(df, keys, bucket, order, "_pos")
    own = number_bucket(F.col("_pos") - 1, block)
    run_up = F.pmod(F.col("_pos") - 1, F.lit(block)) >= block - (rows - 1)
    blocks = F.when(run_up, F.array(own, own + block)).otherwise(F.array(own))
    copies = placed.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    frame = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-(rows - 1), 0)
    total = F.sum(F.col(value).cast("decimal(28,6)")).over(frame).cast("double")
    averaged = copies.withColumn(name, total / F.count(value).over(frame))
    return averaged.filter(F.col("_block") == F.col("_own")).drop("_pos", "_own", "_block")


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], on: str, seconds: int, tie: str, payload: list[str],
    prefix: str = "prev_",
) -> DataFrame:
    """For each left row the latest right row of the same key at or before it (NULL if none).

    Both sides are laid on one time line and the right payload is carried forward, so
    no left row is paired with more than one right row. Several right rows at the same
    instant resolve to the greatest ``tie``.
    """
    hidden = [f"_r_{c}" for c in payload]
    rights = right.select(
        *keys, on, F.lit(0).alias("_side"), F.col(tie).alias("_tie"),
        F.struct(*[F.col(c).alias(h) for c, h in zip(payload, hidden)]).alias("_payload"),
    )
    lefts = left.withColumns({"_side": F.lit(1), "_tie": F.col(tie)})
    line = lefts.unionByName(rights, allowMissingColumns=True)
    order = [F.col(on), F.col("_side"), F.col("_tie")]
    carried = previous_value(line, keys, time_bucket(F.col(on), seconds), order, F.col("_payload"), "_hit")
    return carried.filter(F.col("_side") == 1).select(
        *left.columns, *[F.col(f"_hit.{h}").alias(prefix + c) for c, h in zip(payload, hidden)]
    )


def sessions(df: DataFrame, keys: list[str], ts: str, idle_seconds: int) -> DataFrame:
    """Sessions of each key: a new one starts after more than ``idle_seconds`` without a row."""
    return merge_session_parts(session_parts(df, keys, ts, idle_seconds), keys, idle_seconds)


def session_parts(df: DataFrame, keys: list[str], ts: str, idle_seconds: int) -> DataFrame:
    """First, last and count of each ``(key, idle-wide bucket)``.

    No gap inside such a bucket can end a session, so that is all a session needs of it, in
    whatever order the rows come. A key has at most one row per bucket of time.
    """
    return df.groupBy(*keys, time_bucket(F.col(ts), idle_seconds).alias(BUCKET)).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count("*").alias("_n")
    )


def merge_session_parts(reduced: DataFrame, keys: list[str], idle_seconds: int) -> DataFrame:
    """Sessions from :func:`session_parts`."""
    order = Window.partitionBy(*keys).orderBy(BUCKET)
    gap = micros(F.col("_first")) - micros(F.lag("_last").over(order))
    fresh = F.when(gap.isNull() | (gap > idle_seconds * 1_000_000), 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = reduced.withColumn("_fresh", fresh).withColumn("session_no", F.sum("_fresh").over(running))
    return numbered.groupBy(*keys, "session_no").agg(
        F.min("_first").alias("started"), F.max("_last").alias("last_access"), F.sum("_n").alias("events")
    )


#: Levels of cells: whole numbers of 62 bits.
LEVELS = 62


def covering_cells(low: Column, high: Column) -> Column:
    """The cells of doubling width that make up ``[low, high)``: at most two of each level, disjoint.

    On every level the part that is left begins at ``ceil(low / 2^k)`` and ends at ``floor(high / 2^k)``; an odd cell at
    either end has no whole parent inside the interval, so it is listed there.
    """
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    ends = F.transform(levels, lambda k: F.struct(k.alias("level"), _shifted_up(low, k).alias("first"), _shifted(high, k).alias("end")))
    alive = F.filter(ends, lambda x: x["first"] < x["end"])
    odd = lambda c: F.pmod(c, F.lit(2)) == 1
    cell = lambda x, c: F.struct(x["level"].alias("level"), c.alias("cell"))
    left = F.transform(F.filter(alive, lambda x: odd(x["first"])), lambda x: cell(x, x["first"]))
    right = F.transform(F.filter(alive, lambda x: odd(x["end"])), lambda x: cell(x, x["end"] - 1))
    return F.concat(left, right)


def _shifted(value: Column, level: Column) -> Column:
    """floor(value / 2^level)."""
    return F.call_function("shiftright", value, level)


def _shifted_up(value: Column, level: Column) -> Column:
    """ceil(value / 2^level)."""
    return -_shifted(-value, level)


#: Listed cells that are broadcast; levels with more meet their points in an exchange.
FEW_CELLS = 20_000


def interval_lookup(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, payload: list[str]) -> DataFrame:
    """Range join of points with half-open intervals ``[low, high)`` of whole numbers; intervals may overlap.

    An interval is listed under the cells of doubling width that make it up, at most two of each level however long it
    is; a point lies in one cell of each level. Every pair meets in exactly one cell. Points are looked up on the levels that
    occur: those of few cells are broadcast, so that points do not move for them; on the others both sides are dealt out
    by cell. The planner is not asked, as it takes a side for as small as it was before its rows were repeated by level.
    Empty intervals and nulls meet nothing.
    """
    bounds = intervals.select(F.col(low).cast("bigint").alias("_low"), F.col(high).cast("bigint").alias("_high"), *payload)
    listed = bounds.filter("_low < _high").withColumn("_listed", F.explode(covering_cells(F.col("_low"), F.col("_high"))))
    listed = materialize(listed.select(F.col("_listed.level").alias("_level"), F.col("_listed.cell").alias("_cell"), *payload), "cells")
    few, many, total = [], [], 0
    for r in sorted(listed.groupBy("_level").count().collect(), key=lambda r: (r["count"], r["_level"])):  # at most LEVELS
        total += r["count"]
        (few if total <= FEW_CELLS else many).append(r["_level"])
    value = F.col(at).cast("bigint")

    def met(levels: list[int], strategy: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(k).alias("level"), _shifted(value, F.lit(k)).alias("cell")) for k in sorted(levels)])
        placed = points.filter(value.isNotNull()).withColumn("_at", F.explode(cells) if levels else F.lit(None).cast("struct<level:int,cell:bigint>"))
        own = listed.filter(F.col("_level").isin(levels)).hint(strategy)
        found = placed.withColumns({"_level": F.col("_at.level"), "_cell": F.col("_at.cell")}).join(own, ["_level", "_cell"])
        return found.select(*points.columns, *payload)

    if few and many:
        return met(few, "broadcast").unionByName(met(many, "merge"))
    return met(many, "merge") if many else met(few, "broadcast")
