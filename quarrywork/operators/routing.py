"""Prompt routing: signals, score, level and model, all row-wise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.numbers import half_up
from ..functions.textstats import word_count


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit("(?U)" + p)) for p in patterns])


def signals(df: DataFrame, prompt: str, context_length: str) -> DataFrame:
    """Add the counts a prompt is judged by."""
    lower = F.lower(F.col(prompt))
    hits = [F.rlike(lower, F.lit("(?U)" + p)).cast("int") for p in fixed.COMPLEX_PATTERNS]
    return df.withColumns({
        "words": word_count(F.col(prompt)),
        "is_simple": _any(lower, fixed.SIMPLE_PATTERNS),
        "complex_hits": reduce(lambda a, b: a + b, hits),
        "technical_hits": F.regexp_count(F.col(prompt), F.lit("(?iU)" + fixed.TECHNICAL_PATTERN)),
        "questions": F.length(F.col(prompt)) - F.length(F.replace(F.col(prompt), F.lit("?"), F.lit(""))),
        "large_context": F.col(context_length) > 15000,
    })


def route(df: DataFrame, prompt: str = "prompt", context_length: str = "context_length") -> DataFrame:
    """Score, complexity level, confidence and the signals that decided."""
    short, long = F.col("words") <= fixed.SIMPLE_MAX_WORDS, F.col("words") >= fixed.COMPLEX_MIN_WORDS
    technical = F.col("technical_hits") >= fixed.TECHNICAL_TERM_THRESHOLD
    several = F.col("questions") >= 3

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    score = (
        F.when(short, F.lit(-1.0)).when(long, F.lit(1.5)).otherwise(F.lit(0.0))
        + points(F.col("is_simple"), -0.6)
        + F.col("complex_hits") * 0.5
        + points(technical, 0.8)
        + points(several, 0.5)
        + points(F.col("large_context"), 0.5)
    )

    def named(condition: Column, name: str, value: str | None = None, suffix: str = ")") -> Column:
        text = F.lit(name) if value is None else F.concat(F.lit(name + "("), F.col(value).cast("string"), F.lit(suffix))
        return F.when(condition, text)

    listed = F.array_compact(F.array(
        named(short, "short_prompt", "words", "w)"),
        named(long, "long_prompt", "words", "w)"),
        named(F.col("is_simple"), "simple_pattern"),
        named(F.col("complex_hits") > 0, "complex_patterns", "complex_hits"),
        named(technical, "technical_terms", "technical_hits"),
        named(several, "multi_question", "questions"),
        named(F.col("large_context"), "large_context"),
    ))
    scored = signals(df, prompt, context_length).withColumns({"score": half_up(score, 4), "signals": listed})
    s = F.col("score")
    return scored.withColumns({
        "complexity": F.when(s <= -0.5, "simple").when(s < 1.5, "moderate").otherwise("complex"),
        "confidence": half_up(
            F.when(s <= -0.5, F.least(F.lit(0.9), 0.6 + F.abs(s) * 0.1))
            .when(s < 1.5, F.lit(0.7))
            .otherwise(F.least(F.lit(0.95), 0.6 + s * 0.08)), 2),
    })


def _rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in fixed.LEVELS]), level)


def domain_floor(routed: DataFrame, domain: str = "domain") -> DataFrame:
    """Raise the level to the domain's minimum."""
    floors = F.create_map(*[F.lit(x) for pair in fixed.DOMAIN_FLOORS.items() for x in pair])
    floor = F.coalesce(F.element_at(floors, F.lower(F.col(domain))), F.lit(fixed.LEVELS[0]))
    rank = F.greatest(_rank(F.col("complexity")), _rank(floor))
    return routed.withColumn("complexity", F.element_at(F.array(*[F.lit(x) for x in fixed.LEVELS]), rank.cast("int")))


def choose_model(routed: DataFrame, force_model: str | None = None) -> DataFrame:
    """Primary and fallback model of the level; a forced model bypasses routing."""
    if force_model is not None:
        return routed.withColumns({
            "model": F.lit(force_model), "fallback_model": F.lit(None).cast("string"),
            "complexity": F.lit("moderate"), "confidence": F.lit(1.0),
            "signals": F.array(F.lit("user_override")),
        })
    pairs = [x for level, (first, second) in fixed.LEVEL_MODELS.items()
             for x in (F.lit(level), F.struct(F.lit(first).alias("primary"), F.lit(second).alias("fallback")))]
    choice = F.element_at(F.create_map(*pairs), F.col("complexity"))
    return routed.withColumns({"model": choice["primary"], "fallback_model": choice["fallback"]})


def reason(routed: DataFrame) -> DataFrame:
    """Explain the level with the first three signals."""
    first = F.when(F.size("signals") > 0, F.array_join(F.slice("signals", 1, 3), ", ")).otherwise("default")
    return routed.withColumn(
        "reasoning",
        F.when(F.col("complexity") == "simple", F.concat(F.lit("Simple query detected ("), first, F.lit("); using fast model")))
        .when(F.col("complexity") == "moderate", F.concat(F.lit("Standard query ("), first, F.lit("); balanced model selected")))
        .otherwise(F.concat(F.lit("Complex analysis required ("), first, F.lit("); using high-capability model"))),
    )


def models_per_level(routed: DataFrame) -> DataFrame:
    """Models open to each level, with the requests routed to the level."""
    counts = routed.groupBy("complexity").agg(F.count("*").alias("requests"))
    listed = choose_model(counts)
    return listed.select(
        "complexity", "requests", F.explode(F.array_compact(F.array("model", "fallback_model"))).alias("model")
    )
