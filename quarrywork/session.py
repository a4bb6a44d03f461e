"""Session construction and the shared working folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "quarrywork", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs are written for; a cluster passes no master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_if_narrow(df: DataFrame, key: str) -> DataFrame:
    """Share the rows of a scan with fewer tasks than cores; leave a wide scan as it is.

    A small file is one task, which starves CPU-heavy text work. A large input is
    already split by its row groups, and gets no exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


#: Bytes of text in a share of :func:`lay_out`.
SHARE_BYTES = 4_000_000


def shares(docs: DataFrame, text: str) -> int:
    """Into how many shares of some megabytes a table of texts is dealt; one pass over the texts' lengths."""
    size = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE_BYTES))


def lay_out(docs: DataFrame, key: str, text: str, spread_null: bool = False) -> DataFrame:
    """Rows of a key together, in shares of some megabytes of text: their number grows with the text, not their size.

    A fixed number of shares, or one put together by the size of the texts, holds more rows of exploded words the longer the input.
    With ``spread_null``, rows without a key do not belong together.
    """
    by = [F.col(key), F.when(F.col(key).isNull(), F.xxhash64(text))] if spread_null else [F.col(key)]
    return docs.repartition(shares(docs, text), *by)


def wide_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return spread_if_narrow(table(spark, sf_dir, name), key)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python hold some megabytes, whatever the length of the rows; a smaller bound is left as it is.

    Rows alone (10,000 of them) bound nothing where each is a whole text.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not re.fullmatch(r"\d+b?", now) or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; unset, it is a folder below the session's warehouse, which they
    share as well.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work").rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{shared_root(spark)}/quarrywork/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably: the written files survive the loss of executors.
    """
    path = shared_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
