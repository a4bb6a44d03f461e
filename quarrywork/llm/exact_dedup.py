"""Exact deduplication by a stateful stream, with DataFrame and SQL functions only.

Documents arrive as a stream of small rows: SHA-256 of the text, its length, the stable
identifier and a content locator (file and row in it). The keyed state lives in RocksDB on
the executors' disks, with its changes in the shared checkpoint folder, and has no
expiry: per digest it retains the locator and identifier of the row that stays and the
number of rows seen, never a text. State crosses micro-batches, and a failed task repeats
from the last committed version.

A digest is not a proof. After the stream, the full bytes of all texts of a hit, a digest with several
rows, are compared: they are equal if their smallest and their largest are. Texts that share a digest
but not their bytes are grouped by their bytes instead. Both aggregations combine on the map side, so
a text that a third of all rows share is one row per task before the exchange. A Bloom filter of the
hits, which Spark builds at run time, keeps the texts of other digests out of the exchange.

Of equal texts the row with the largest identifier stays; null identifiers come last, and
rows that repeat the identifier too are told apart by their locator, so exactly one stays.
Null text counts as empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, shared_path
from ..streaming.runner import ROCKS, run_update, settings
from .common import FILE, ROW, carried, join_hot, placed, whole_text, without

#: Input files of one micro-batch.
FILES_PER_BATCH = 256
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    # many small stores: no space is set aside before it is used
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: A Bloom filter of the hits (bounded by Spark's own limits) is put on the scan of the texts, whatever their size.
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "16g",
}


def arrivals(rows: DataFrame, digest: Column) -> DataFrame:
    return rows.select("key", "file", "row", digest.alias("digest"))


def stream_state(arrived: DataFrame, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """digest, keep (identifier and locator of the row that stays) and group_size, from the stream over ``path``."""
    stream = arrived.sparkSession.readStream.schema(arrived.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    # a struct compares field by field, nulls first
    state = stream.groupBy("digest").agg(F.max(F.struct("key", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
    return run_update(state, "dedup-state", ["digest"], _STATE)


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Column | None = None, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256, file, row.

    ``digest`` replaces the SHA-256 as the state's key, for tests of what happens when digests collide.
    """
    return _dedup(docs, placed(docs), key, text, digest, files_per_batch)


def _dedup(docs: DataFrame, there: DataFrame, key: str, text: str, digest: Column | None, files_per_batch: int) -> DataFrame:
    rows = there.select(carried(docs, key).alias("key"), whole_text(carried(docs, text)).alias("text"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    spark = rows.sparkSession
    sha = F.sha2(F.col("text").cast("binary"), 256)
    digest = sha if digest is None else digest
    path = shared_path(spark, "dedup-arrivals")
    arrivals(rows, digest).write.parquet(path)
    arrived = spark.read.parquet(path)
    state = materialize(stream_state(arrived, path, files_per_batch), "dedup-groups")

    # the full bytes, on every hit: equal if the smallest is the largest
    contents = rows.withColumn("digest", digest)
    hits = state.filter("group_size > 1").select("digest")
    with settings(spark, _BLOOM):
        on_hits = contents.join(hits, "digest", "left_semi").groupBy("digest").agg((F.min("text") != F.max("text")).alias("differs"))
        unequal = materialize(on_hits.filter("differs").select("digest"), "dedup-collisions")
    by_digest = join_hot(arrived.join(unequal, "digest", "left_anti"), state, "digest", "group_size").withColumn("sha", F.col("digest") if digest is sha else F.lit(None))
    collided = contents.join(unequal, "digest", "left_semi")
    by_bytes = collided.groupBy("text").agg(F.max(F.struct("key", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
    apart = collided.select("key", "file", "row", "digest", "text").join(by_bytes, "text").select(
        "digest", "key", "file", "row", "keep", "group_size", sha.alias("sha")
    )
    if digest is not sha:
        by_digest = by_digest.drop("sha").join(rows.select("file", "row", sha.alias("sha")), ["file", "row"])
    found = by_digest.select("digest", "key", "file", "row", "keep", "group_size", "sha").unionByName(apart)
    return found.select(
        F.col("key").alias(key), F.col("keep.key").alias("keep_id"), "group_size",
        ((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"), "file", "row",
    )


def keep_one_copy(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    there = placed(docs)
    dropped = _dedup(docs, there, key, text, None, FILES_PER_BATCH).filter(~F.col("kept"))
    return without(there, dropped, docs.columns)
