"""Request cost against a price list, model names, and the model chosen after failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import (
    BASELINE_COMPLETION_PRICE, BASELINE_PROMPT_PRICE, DEFAULT_MODEL, FALLBACK_ORDER, MAX_FALLBACKS, MODEL_IDS,
)
from ..functions.numbers import half_up

PER_MILLION = 1_000_000


def model_id(name: Column) -> Column:
    """Identifier of a display name; unknown names get the default model's."""
    ids = F.create_map(*[F.lit(x) for pair in MODEL_IDS.items() for x in pair])
    return F.coalesce(F.element_at(ids, name), F.lit(MODEL_IDS[DEFAULT_MODEL]))


def request_cost(requests: DataFrame, pricing: DataFrame) -> DataFrame:
    """Add actual cost, baseline cost, savings and savings percent to each request.

    ``pricing`` is ``(model_id, prompt, completion)`` in dollars per million tokens; a
    model without a price costs nothing. The left join is left to the planner, which
    broadcasts the list only while it is measured to be small.
    """
    prompt = F.coalesce(F.col("prompt"), F.lit(0.0))
    completion = F.coalesce(F.col("completion"), F.lit(0.0))

    def cost(in_price: Column, out_price: Column) -> Column:
        return (F.col("input_tokens") * in_price + F.col("output_tokens") * out_price) / PER_MILLION

    priced = requests.join(pricing, "model_id", "left").select(
        *requests.columns,
        cost(prompt, completion).alias("_actual"),
        cost(F.lit(BASELINE_PROMPT_PRICE), F.lit(BASELINE_COMPLETION_PRICE)).alias("_base"),
    )
    saved = F.col("_base") - F.col("_actual")
    return priced.select(
        *requests.columns,
        half_up(F.col("_actual"), 6).alias("actual_cost"),
        half_up(F.col("_base"), 6).alias("gpt4_cost"),
        half_up(saved, 6).alias("savings"),
        F.when(F.col("_base") > 0, half_up(saved / F.col("_base") * 100, 2)).otherwise(F.lit(0.0)).alias("savings_percent"),
    )


def fallback_choice(attempts: DataFrame, limit: int | None = MAX_FALLBACKS) -> DataFrame:
    """The model that finally answered each request.

    ``attempts`` is ``(request_id, primary, model, ok, retryable)``. The primary is
    tried first, then the fixed order without it, at most five. The first success
    wins unless an attempt before it failed for good. Attempts beyond ``limit`` (None: no
    limit) decide nothing, but their request keeps its row and ``within_limit`` tells. Plain
    aggregation with partial results, so a request id with very many rows is combined
    before the shuffle.
    """
    places = F.create_map(*[x for i, m in enumerate(FALLBACK_ORDER) for x in (F.lit(m), F.lit(i + 1))])
    own = F.element_at(places, F.col("primary"))
    place = F.element_at(places, F.col("model"))
    # leaving the primary out moves the models behind it one place up
    rank = F.when(F.col("model") == F.col("primary"), F.lit(0)).otherwise(
        place - F.when(own < place, 1).otherwise(0)
    )
    ranked = attempts.withColumn("rank", rank)
    counts = F.lit(True) if limit is None else F.coalesce(F.col("rank") <= limit, F.lit(False))
    ok = counts & F.col("ok")
    won = F.when(ok, F.col("rank"))
    stop = F.when(counts & ~F.col("ok") & ~F.col("retryable"), F.col("rank"))
    summary = ranked.groupBy("request_id", "primary").agg(
        F.min(won).alias("won_at"), F.min(stop).alias("stopped_at"),
        F.min(F.when(ok, F.struct("rank", "model"))).alias("winner"),
        F.max(F.when(counts, F.col("rank"))).alias("last_rank"), F.every(counts).alias("within_limit"),
    )
    alive = F.col("won_at").isNotNull() & (F.col("stopped_at").isNull() | (F.col("won_at") < F.col("stopped_at")))
    return summary.select(
        "request_id", "primary",
        F.when(alive, F.col("winner.model")).alias("model_used"),
        F.coalesce(alive & (F.col("won_at") > 0), F.lit(False)).alias("fallback_used"),
        (F.least(F.when(alive, F.col("won_at")), F.col("stopped_at"), F.col("last_rank")) + 1).alias("models_tried"),
        "within_limit",
    )


# An example price list in dollars per million tokens, for trial runs.
EXAMPLE_PRICES = (
    ("google/gemini-2.0-flash-001", 0.10, 0.40),
    ("deepseek/deepseek-chat", 0.14, 0.28),
    ("deepseek/deepseek-r1", 0.55, 2.19),
    ("meta-llama/llama-3.3-70b-instruct", 0.10, 0.25),
    ("google/gemini-2.0-flash-exp:free", 0.0, 0.0),
)


def example_pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLE_PRICES), "model_id string, prompt double, completion double")
