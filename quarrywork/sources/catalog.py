"""The user's database: temporary views, their columns and row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TEST_TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def row_counts(spark: SparkSession, names: tuple[str, ...] = TEST_TABLES) -> DataFrame:
    """``COUNT(*)`` of every table in one job; each table is counted before the union."""
    counts = [spark.table(n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n in names]
    return reduce(DataFrame.unionByName, counts)


def columns(spark: SparkSession, names: tuple[str, ...] = TEST_TABLES, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Name and type of every column, from the catalog; ``keys`` declares each table's key, which files do not know."""
    rows = [(n, i, c.name, c.dataType, bool(c.nullable), c.name in (keys or {}).get(n, ()))
            for n in names for i, c in enumerate(spark.catalog.listColumns(n))]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, data_type string, nullable boolean, is_key boolean"
    )


def schema_text(spark: SparkSession, names: tuple[str, ...] = TEST_TABLES) -> str:
    """Readable schema: a ``TABLE name:`` line, then one indented line per column."""
    parts = []
    for name in names:
        lines = [f"  {c.name} {c.dataType.upper()}" for c in spark.catalog.listColumns(name)]
        parts.append("\n".join([f"TABLE {name}:", *lines]))
    return "\n\n".join(parts)


def describe(spark: SparkSession, names: tuple[str, ...] = TEST_TABLES, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Columns of every table together with the table's row count."""
    return columns(spark, names, keys).join(row_counts(spark, names), "table_name")
