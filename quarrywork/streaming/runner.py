"""Running streams to their end and reading what they wrote."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_path, table

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH = "batch_id"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of one stream."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


#: Bytes of input files in a micro-batch (at least one file).
MAX_BYTES = 1 << 30


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream; ``MAX_BYTES`` bounds a micro-batch.

    Times without zone become timestamps, the only type a watermark accepts.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern that matches the table's file or folder: the source takes no single file
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", MAX_BYTES).parquet(f"{sf_dir}/{name}.parque[t]")
    return _zoned(stream)


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of ``table_stream`` as a table."""
    return _zoned(table(spark, sf_dir, name))


def _zoned(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def run_append(stream: DataFrame, label: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Run an append-mode stream over all available input into parquet, exactly once."""
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, label), shared_path(spark, f"{label}-checkpoint")
    with settings(spark, conf or {}):
        run = (
            stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_update(stream: DataFrame, label: str, keys: list[str], conf: dict[str, str] | None = None) -> DataFrame:
    """Run an update-mode aggregation; the result is each key's latest version.

    Every micro-batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, label), shared_path(spark, f"{label}-checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    with settings(spark, conf or {}):
        run = (
            stream.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    written = spark.read.parquet(path)
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_v")).select(*keys, "_v.*")
