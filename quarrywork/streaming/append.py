"""A table by day that a stream appends to: each row once over restarts, small files compacted."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DAY, BATCH, RUN = "day", "_batch", "_run"
_LOG = f"{DAY} date, upto bigint, {RUN} string"


def append_stream(stream: DataFrame, path: str, checkpoint: str, compact_every: int = 0, least: int = 8) -> None:
    """Append all available input to the table at ``path``; ``stream`` has a date column ``day``.

    A micro-batch owns one folder, partitioned by day, and overwrites it when it runs again, so a restart from the checkpoint
    neither loses nor repeats a row. (Who reads between a failure and the restart may see a part of that batch.)
    Every ``compact_every`` batches, days with ``least`` pieces or more are rewritten; batches before the
    running one are complete by then. One stream at a time writes to a table. Rows without a day are kept and stay as written.
    """
    spark, schema = stream.sparkSession, stream.schema
    if DAY not in schema.names or {BATCH, RUN} & set(schema.names):
        raise ValueError(f"the stream needs a column {DAY} and none named {BATCH} or {RUN}")
    for part in ("raw", "days"):
        spark.createDataFrame([], schema).write.mode("append").partitionBy(DAY).parquet(f"{path}/{part}")
    spark.createDataFrame([], _LOG).write.mode("append").parquet(f"{path}/log")

    def save(batch: DataFrame, batch_id: int) -> None:
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact(batch.sparkSession, path, schema, batch_id - 1, least)
        batch.write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/raw/{BATCH}={batch_id}")

    run = (
        stream.writeStream.outputMode("append").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()


def _parts(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The rows that count: batches after their day's last compaction, and the last compaction of each day.

    The log has one row per day and compaction; what is read of it, a row per compacted day, becomes a filter on folder names.
    """
    log = spark.read.schema(_LOG).parquet(f"{path}/log")
    days_of: dict[tuple[int, str], list] = {}
    for day, newest in log.groupBy(DAY).agg(F.max(F.struct("upto", RUN))).orderBy(DAY).collect():
        days_of.setdefault(tuple(newest), []).append(day)
    known = [day for days in days_of.values() for day in days]
    raw = spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).parquet(f"{path}/raw")
    days = spark.read.schema(StructType([*schema.fields, StructField(RUN, StringType())])).parquet(f"{path}/days")

    def any_of(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    if known:
        later = any_of([F.col(DAY).isin(ds) & (F.col(BATCH) > upto) for (upto, _), ds in days_of.items()])
        raw = raw.filter(F.col(DAY).isNull() | ~F.col(DAY).isin(known) | later)
    return raw, days.filter(any_of([F.col(DAY).isin(ds) & (F.col(RUN) == run) for (_, run), ds in days_of.items()]))


def read_appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as rows of ``schema``; a filter on ``day`` prunes folders."""
    raw, days = _parts(spark, path, schema)
    return raw.select(schema.names).unionByName(days.select(schema.names))


def compact(spark: SparkSession, path: str, schema: StructType, upto: int | None = None, least: int = 2) -> int:
    """Rewrite each day that lies in ``least`` pieces or more (batches, and its last compaction) into files of the
    planner's target size; return how many days.

    ``upto``: the last complete batch (None: all, when no stream runs). The new files count from the moment
    the log names them, in one file written last; until then, and after a failure, the old pieces count. A large day is split
    over tasks, small ones share a task. Replaced files stay for readers that opened them, until the cluster's clean-up.
    """
    raw, days = _parts(spark, path, schema)
    raw = raw.filter(F.col(DAY).isNotNull() & (F.lit(True) if upto is None else F.col(BATCH) <= upto))
    pieces = raw.select(DAY, BATCH).distinct().unionByName(days.select(DAY, F.lit(-1).cast("bigint").alias(BATCH)).distinct())
    counted = pieces.groupBy(DAY).agg(F.count("*").alias("pieces"), F.max(BATCH).alias("newest"))
    chosen = counted.filter((F.col("pieces") >= least) & (F.col("newest") >= 0)).collect()
    if not chosen:
        return 0
    last, run = max(r["newest"] for r in chosen), uuid.uuid4().hex
    picked = F.col(DAY).isin([r[DAY] for r in chosen])
    rows = raw.filter(picked).select(schema.names).unionByName(days.filter(picked).select(schema.names))
    rows.hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{path}/days/{RUN}={run}")
    spark.createDataFrame([(r[DAY], last, run) for r in chosen], _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return len(chosen)
