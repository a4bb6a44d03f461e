"""Connected components of a table of links, by alternating star operations.

Large star: every node's larger neighbours are linked to the smallest of its neighbours and
itself. Small star: every node's smaller neighbours are, and the node too. Both keep what is
connected connected, and repeated they end in stars around the smallest node of each component
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). A hub with many links is a
partial aggregation and one side of a skew join, never one group in memory. Each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _smallest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the smallest of u's neighbours and u itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _smallest(down)
    own = found.select("u", F.col("m").alias("v"))
    others = found.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(others).filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: equal marks mean that nothing changed."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """``node`` and the smallest node of its component as ``root``, for every node that has a link.

    ``links`` has columns u and v of one orderable type; loops, repeats and both directions are fine.
    """
    links = materialize(links.select("u", "v").filter("u <> v").distinct(), "links")
    before, now = None, _mark(links)
    while now != before and now[0]:
        links = materialize(_small_star(_large_star(links)), "links")
        before, now = now, _mark(links)
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
