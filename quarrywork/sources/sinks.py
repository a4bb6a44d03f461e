"""Writers. Each returns what was written, read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import hash_prefix
from ..session import shared_path


def write_lines(lines: DataFrame, label: str) -> DataFrame:
    """Write a one-column text dataset (one record per line)."""
    path = shared_path(lines.sparkSession, label)
    lines.write.text(path)
    return lines.sparkSession.read.text(path)


def clipped(message: Column, limit: int = 500) -> Column:
    """Cut a long message, marking the cut with dots inside the limit."""
    return F.when(
        F.length(message) > limit, F.concat(F.left(message, F.lit(limit - 3)), F.lit("..."))
    ).otherwise(message)


def event_rows(df: DataFrame, ip: str = "ip", security: bool = False) -> DataFrame:
    """Telemetry rows as stored: address hashed, long texts cut, partition day added."""
    out = df.withColumn("ip_hash", hash_prefix(F.col(ip), 8 if security else 16)).drop(ip)
    if "error_message" in df.columns:
        out = out.withColumn("error_message", clipped(F.col("error_message")))
    if "mission" in df.columns:
        out = out.withColumn("mission", F.left(F.coalesce("mission", F.lit("")), F.lit(200)))
    return out.withColumn("day", F.to_date("created_at"))


def append_events(rows: DataFrame, path: str) -> None:
    """Append to a table partitioned by day, so date filters prune folders."""
    rows.write.mode("append").partitionBy("day").parquet(path)
