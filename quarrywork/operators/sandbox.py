"""Read-only SQL over a user's tables: guard, row cap and history."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.requests import clean_sql, clean_text, guard_sql, guard_text


class RefusedQuery(ValueError):
    """The statement is not a single read-only query."""


@dataclass(frozen=True)
class QueryResult:
    sql: str
    rows: DataFrame
    truncated: DataFrame

    def with_flag(self) -> DataFrame:
        """The rows with a ``truncated`` column telling whether more existed."""
        return self.rows.withColumn("truncated", self.truncated.scalar())


def relations(spark: SparkSession, sql: str) -> tuple[set[str], str]:
    """Relations that a statement names (without its own named subqueries), and its plan as parsed. Nothing runs."""
    plan = spark.sql(f"EXPLAIN EXTENDED {sql}").first()[0]
    parsed = plan.split("== Analyzed Logical Plan ==")[0]
    own = {n.strip().lower() for names in re.findall(r"CTE \[([^\]]*)\]", parsed) for n in names.split(",")}
    named = {n.replace(", ", ".").lower() for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", parsed)}
    return named - own, parsed


def checked(spark: SparkSession, sql: str, args: dict | None = None) -> str:
    """The cleaned statement; raises :class:`RefusedQuery` with the reason.

    First the text, then the plan: it may read only tables and views of the session, by name, and
    run neither programs nor reflection.
    """
    text = clean_text(sql)
    verdict = guard_text(text)
    if verdict is None:
        bound = re.sub(r"(?<![:\w]):(\w+)", "NULL", text) if args else text
        named, plan = relations(spark, bound)
        if re.search(r"ScriptTransformation|\b(java_method|try_reflect|reflect)\(", plan):
            verdict = "Script transformations and reflection calls not allowed"
        strangers = sorted(n for n in named if not re.fullmatch(r"\w+(\.\w+)*", n) or not spark.catalog.tableExists(n))
        if strangers:
            verdict = f"Unknown table: {strangers[0]}"
    if verdict is not None:
        raise RefusedQuery(verdict)
    return text


def run(spark: SparkSession, sql: str, max_rows: int | None = None) -> QueryResult:
    """Guard and run a query; with ``max_rows`` at most so many rows come back, and a flag tells if there were more."""
    text = checked(spark, sql)
    result = spark.sql(text)
    if max_rows is None:
        return QueryResult(text, result, spark.range(1).select(F.lit(False).alias("truncated")))
    capped = result.limit(max_rows + 1)
    return QueryResult(text, result.limit(max_rows), capped.agg((F.count("*") > max_rows).alias("truncated")))


def unlimited(spark: SparkSession, sql: str) -> DataFrame:
    """Guard and run a query whose whole result feeds another job."""
    return spark.sql(checked(spark, sql))


def history_rows(statements: DataFrame, question: str, sql: str, at: str) -> DataFrame:
    """Log rows of a batch of statements: question, cleaned text, success, time."""
    text = clean_sql(F.col(sql))
    return statements.select(
        F.col(question).alias("question"), text.alias("sql"), guard_sql(text).isNull().alias("success"),
        F.col(at).alias("timestamp"),
    )
