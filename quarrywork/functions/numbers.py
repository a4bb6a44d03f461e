"""Numeric helpers whose result does not depend on evaluation order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

KB = 1024
MB = 1024 * 1024
GB = 1024 * 1024 * 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(col: Column, scale: int) -> Column:
    """Round in decimal, halves away from zero, and return a double."""
    return F.round(col.cast("decimal(38,9)"), scale).cast("double")


def exact_sum(col: Column, scale: int = 6) -> Column:
    """Sum in decimal: the same total whatever order the rows arrive in."""
    return F.coalesce(F.sum(col.cast(f"decimal(28,{scale})")), F.lit(0)).cast("double")


def exact_avg(col: Column, scale: int = 6) -> Column:
    """Mean of the non-null values from a decimal sum; NULL when there are none."""
    total = F.sum(col.cast(f"decimal(28,{scale})")).cast("double")
    return F.when(F.count(col) > 0, total / F.count(col))


def percent(part: Column, whole: Column, scale: int, empty: float | None = None) -> Column:
    """``part / whole * 100``; ``empty`` when there is nothing to divide by."""
    return F.when(whole > 0, half_up(part.cast("double") / whole * 100, scale)).otherwise(F.lit(empty))


def human_bytes(size: Column) -> Column:
    """KB / MB / GB text with two decimals."""
    def text(unit: int, label: str) -> Column:
        return F.concat(
            F.round(size.cast("decimal(38,9)") / F.lit(unit), 2).cast("decimal(28,2)").cast("string"),
            F.lit(f" {label}"),
        )

    return F.when(size >= GB, text(GB, "GB")).when(size >= MB, text(MB, "MB")).otherwise(text(KB, "KB"))


def hash_prefix(col: Column, length: int = 16) -> Column:
    """First characters of the SHA-256 hex digest."""
    return F.substring(F.sha2(col.cast("string"), 256), 1, length)
