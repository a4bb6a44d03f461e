"""Top-n per group that survives a group holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_SALTS = 64


def top_n_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    rank_name: str = "rank_in_group",
    salts: int = DEFAULT_SALTS,
    spread_on: list[str] | None = None,
) -> DataFrame:
    """First ``n`` rows of each key by ``order`` (make it total for a stable answer).

    Two stages: the group is first cut to ``n`` rows inside each of ``salts`` shares,
    then across shares, so one task sees at most ``n * salts`` rows of a key. The
    result is exact, because a row of the final top n is also in the top n of its share.
    ``spread_on`` names the columns that tell rows of a group apart (default: all).
    """
    salt = "_share"
    spread = df.withColumn(salt, F.pmod(F.xxhash64(*(spread_on or df.columns)), F.lit(salts)))
    local = Window.partitionBy(*keys, salt).orderBy(*order)
    kept = spread.withColumn(rank_name, F.row_number().over(local)).filter(F.col(rank_name) <= n)
    total = Window.partitionBy(*keys).orderBy(*order)
    return (
        kept.drop(rank_name, salt)
        .withColumn(rank_name, F.row_number().over(total))
        .filter(F.col(rank_name) <= n)
    )
