"""Session memory: the newest items of each session and the context built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import SESSION_MAX_CHARS, SESSION_MAX_ITEMS
from .topn import top_n_per_group


def session_items(items: DataFrame, limit: int = SESSION_MAX_ITEMS) -> DataFrame:
    """Newest ``limit`` items per session, each content cut to the stored maximum.

    ``items``: session_id, arrival (unique in a session), filename, type, content.
    """
    cut = items.withColumn("content", F.left("content", F.lit(SESSION_MAX_CHARS)))
    kept = top_n_per_group(cut, ["session_id"], [F.col("arrival").desc()], limit, spread_on=["session_id", "arrival"])
    return kept.drop("rank_in_group")


def _context(entries: Column) -> Column:
    blocks = F.transform(
        entries,
        lambda i: F.concat(F.lit("--- "), i["filename"], F.lit(" ("), i["type"], F.lit(") ---\n"), i["content"]),
    )
    return F.array_join(blocks, "\n\n")


def _gathered(kept: DataFrame) -> DataFrame:
    # at most ten items of bounded size per session
    entry = F.struct("arrival", "filename", "type", "content")
    return kept.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def combine_context(kept: DataFrame) -> DataFrame:
    """Items of a session under their headers, in arrival order."""
    return _gathered(kept).select("session_id", F.size("entries").alias("items"), _context(F.col("entries")).alias("context"))


def _preview(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def session_listing(kept: DataFrame) -> DataFrame:
    """Items with lengths and previews, and the combined context's length and preview."""
    rows = _gathered(kept).withColumn("context", _context(F.col("entries")))
    listed = F.transform("entries", lambda i: F.struct(
        i["filename"].alias("filename"), i["type"].alias("type"), F.length(i["content"]).alias("content_length"),
        _preview(i["content"], 500).alias("content_preview"),
    ))
    return rows.select(
        "session_id", F.size("entries").alias("item_count"), listed.alias("items"),
        F.length("context").alias("combined_length"), _preview(F.col("context"), 1000).alias("combined_preview"),
    )
