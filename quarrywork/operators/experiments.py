"""Deterministic A/B assignment and experiment results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import half_up, let

BUCKETS = 100
CONTROL = "control"
# 65536 mod 100: the weight of one four-digit hexadecimal step
_STEP = 36


@dataclass(frozen=True)
class Experiment:
    id: str
    variants: tuple[str, ...] = (CONTROL, "treatment")
    weights: tuple[float, ...] = (0.5, 0.5)
    is_active: bool = True


def bucket(experiment_id: str, user: Column) -> Column:
    """``sha256("experiment:user") mod 100`` by folding four hexadecimal digits at a time."""
    hashed = F.sha2(F.concat(F.lit(f"{experiment_id}:"), user.cast("string")), 256)

    def folded(digest: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.lit(15)),
            lambda i: F.conv(F.substr(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int"),
        )
        return F.aggregate(pieces, F.lit(0), lambda a, p: (a * _STEP + p) % BUCKETS)

    return let(hashed, folded)


def assign(experiment: Experiment | None, user: Column) -> Column:
    """Variant of a user: cumulative weights over the bucket, past the end the first variant."""
    if experiment is None or not experiment.is_active:
        return F.lit(CONTROL)
    share = bucket(experiment.id, user) / F.lit(float(BUCKETS))
    bounds, total = [], 0.0
    for variant, weight in zip(experiment.variants, experiment.weights):
        total += weight
        bounds.append((variant, total))
    branches = reduce(
        lambda acc, b: acc.when(share < b[1], b[0]), bounds[1:], F.when(share < bounds[0][1], bounds[0][0])
    )
    return branches.otherwise(experiment.variants[0])


def results(experiment: Experiment, users: DataFrame, user: str, converted: str) -> DataFrame:
    """Users assigned, users converted and the rate, per variant.

    ``users`` holds one row per user with a boolean ``converted``: a user's many
    events are reduced before the variant is computed.
    """
    assigned = users.select(assign(experiment, F.col(user)).alias("variant"), F.col(converted).alias("converted"))
    counted = assigned.groupBy("variant").agg(
        F.count("*").alias("assignments"), F.count_if(F.col("converted")).alias("conversions")
    )
    return counted.select(
        "*",
        half_up(F.col("conversions").cast("double") / F.col("assignments") * 100, 2).alias("conversion_rate"),
    )
