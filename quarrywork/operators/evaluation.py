"""Scores from judged responses: parsing, weighting, fallbacks, gates and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import DIMENSION_WEIGHTS, MAX_RETRIES, QUALITY_THRESHOLD
from ..functions.numbers import half_up

MISSING_SCORE = 5.0
MISSING_WEIGHT = 1.0


def json_block(text: Column) -> Column:
    """The JSON of a free text: a fenced block when there is one, else the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    inside = F.regexp_extract(fenced, r"(?s)\{.*\}", 0)
    return F.nullif(F.when(fenced != "", inside).otherwise(braces), F.lit(""))


def parse_or(text: Column, schema: str, default: Column) -> Column:
    """Parse the JSON block of a text; a broken or missing block gives ``default``."""
    return F.coalesce(F.from_json(json_block(text), schema), default)


def _expected(response_type: Column) -> Column:
    """Weights of the response type's dimensions; an unknown type is judged as chat."""
    def weights(kind: str) -> Column:
        return F.create_map(*[F.lit(x) for pair in DIMENSION_WEIGHTS[kind].items() for x in pair])

    return (
        F.when(response_type == "investigation", weights("investigation"))
        .when(response_type == "sql", weights("sql"))
        .otherwise(weights("chat"))
    )


def eval_parse(df: DataFrame, raw: str, response_type: str) -> DataFrame:
    """Add ``parsed`` (map dimension -> score) and ``reasons``; ``parsed`` is NULL for broken JSON.

    A dimension may be an object with a score or a bare number. Only the dimensions
    expected of the response type are read.
    """
    fields = F.from_json(json_block(F.col(raw)), "map<string,string>")
    staged = df.withColumns({"_fields": fields, "weights": _expected(F.col(response_type))})
    names = F.filter(F.map_keys("weights"), lambda d: F.map_contains_key("_fields", d))

    def value(d: Column) -> Column:
        return F.element_at("_fields", d)

    def score(d: Column) -> Column:
        bare = value(d).try_cast("double")
        inner = F.get_json_object(value(d), "$.score").try_cast("double")
        is_object = F.startswith(value(d), F.lit("{"))
        return F.when(is_object, F.coalesce(inner, F.lit(MISSING_SCORE))).otherwise(bare)

    known = F.filter(
        F.transform(names, lambda d: F.struct(
            d.alias("dimension"), score(d).alias("score"),
            F.coalesce(F.get_json_object(value(d), "$.reasoning"), F.lit("")).alias("reasoning"))),
        lambda e: e["score"].isNotNull(),
    )
    return staged.withColumn("parsed", F.when(F.col("_fields").isNotNull(), known)).drop("_fields")


def fallback_score(raw: Column) -> Column:
    """Mean of all ``n/10`` marks in a text, 5 when there are none."""
    marks = F.transform(
        F.regexp_extract_all(raw, F.lit(r"(\d+(?:\.\d+)?)\s*/\s*10"), F.lit(1)), lambda m: m.cast("double")
    )
    total = F.aggregate(marks, F.lit(0.0), lambda a, m: a + m)
    return F.when(F.size(marks) > 0, total / F.size(marks)).otherwise(F.lit(MISSING_SCORE))


def weighted_score(parsed: Column, weights: Column) -> Column:
    """Weighted mean of the parsed dimensions; 5 when none is known."""
    def weight(e: Column) -> Column:
        return F.coalesce(F.element_at(weights, e["dimension"]), F.lit(MISSING_WEIGHT))

    total = F.aggregate(parsed, F.lit(0.0), lambda a, e: a + e["score"] * weight(e))
    mass = F.aggregate(parsed, F.lit(0.0), lambda a, e: a + weight(e))
    return F.when(mass > 0, total / mass).otherwise(F.lit(MISSING_SCORE))


def evaluate(df: DataFrame, raw: str, response_type: str, failed: str | None = None) -> DataFrame:
    """Overall score of each judged response.

    Parsed JSON gives the weighted mean; unreadable text the mean of its marks; a
    failed judge call scores zero.
    """
    parsed = eval_parse(df, raw, response_type)
    broken = F.col("parsed").isNull()
    score = F.when(broken, fallback_score(F.col(raw))).otherwise(weighted_score(F.col("parsed"), F.col("weights")))
    error = F.when(broken, F.lit("Fallback evaluation - JSON parsing failed"))
    if failed is not None:
        score = F.when(F.col(failed), F.lit(0.0)).otherwise(score)
        error = F.when(F.col(failed), F.lit("Evaluation failed")).otherwise(error)
    return parsed.withColumns({"overall_score": half_up(score, 4), "error": error})


def passes_gate(score: Column, error: Column, threshold: float = QUALITY_THRESHOLD) -> Column:
    return error.isNull() & (score >= threshold)


def weighted_rows(scores: DataFrame, key: str, response_type: str) -> DataFrame:
    """Weighted mean from exploded rows ``(key, response_type, dimension, score)``."""
    weight = F.coalesce(F.element_at(_expected(F.col(response_type)), F.col("dimension")), F.lit(MISSING_WEIGHT))
    score = F.coalesce(F.col("score"), F.lit(MISSING_SCORE))
    weighted = scores.withColumns({"_w": weight, "_sw": score * weight})
    return weighted.groupBy(key).agg(
        half_up(
            F.coalesce(
                F.sum(F.col("_sw").cast("decimal(20,6)")).cast("double")
                / F.nullif(F.sum(F.col("_w").cast("decimal(20,6)")).cast("double"), F.lit(0.0)),
                F.lit(MISSING_SCORE),
            ), 4,
        ).alias("overall_score")
    )


def retry_select(runs: DataFrame, key: str, iteration: str, score: str,
                 threshold: float = QUALITY_THRESHOLD, max_retries: int = MAX_RETRIES) -> DataFrame:
    """First iteration that passes, else the last one allowed; partial aggregation per key.

    Iterations past ``max_retries`` cannot be chosen but are counted; a key with no other has a null choice.
    """
    allowed = F.col(iteration) <= max_retries
    passed = allowed & (F.col(score) >= threshold)
    best = F.struct(F.col(iteration).alias("iteration"), F.col(score).alias("score"))
    return runs.groupBy(key).agg(
        F.coalesce(F.min(F.when(passed, best)), F.max(F.when(allowed, best))).alias("chosen"),
        F.count("*").alias("iterations"),
    ).select(
        key, "iterations", "chosen.iteration", "chosen.score",
        (F.col("chosen.score") >= threshold).alias("passed"), (F.col("chosen.iteration") > 1).alias("retried"),
    )


def findings_by_severity(reports: DataFrame, report: str) -> DataFrame:
    """Findings of report texts counted by severity and source."""
    schema = "struct<findings:array<struct<finding:string,source:string,severity:string>>>"
    found = F.from_json(json_block(F.col(report)), schema)["findings"]
    return (
        reports.select(F.inline(found))
        .groupBy("severity", "source").agg(F.count("*").alias("findings"))
    )
