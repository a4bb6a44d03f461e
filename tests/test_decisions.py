import hashlib

import pytest
from pyspark.sql import functions as F

from quarrywork.operators import costs, evaluation, experiments, routing, sandbox
from quarrywork.operators.experiments import Experiment
from quarrywork.sources import catalog


def test_cost(spark):
    requests = spark.createDataFrame(
        [(1, "deepseek/deepseek-chat", 1_000_000, 500_000), (2, "unknown", 1000, 1000), (3, "deepseek/deepseek-r1", 0, 0)],
        "id int, model_id string, input_tokens bigint, output_tokens bigint",
    )
    rows = {r.id: r for r in costs.request_cost(requests, costs.example_pricing(spark)).collect()}
    assert (rows[1].actual_cost, rows[1].gpt4_cost, rows[1].savings, rows[1].savings_percent) == (0.28, 25.0, 24.72, 98.88)
    assert (rows[2].actual_cost, rows[2].savings_percent) == (0.0, 100.0)
    assert rows[3].savings_percent == 0.0


def test_fallback(spark):
    rows = [
        ("a", "DeepSeek R1", "DeepSeek R1", False, True), ("a", "DeepSeek R1", "DeepSeek V3", False, True),
        ("a", "DeepSeek R1", "Google Gemini 2.0 Flash", True, False),
        ("b", "DeepSeek V3", "DeepSeek V3", True, False),
        ("c", "DeepSeek V3", "DeepSeek V3", False, False), ("c", "DeepSeek V3", "Mistral Small", True, False),
        # the sixth fallback is beyond the limit of five
        ("d", "DeepSeek V3", "DeepSeek V3", False, True), ("d", "DeepSeek V3", "DeepSeek (Free)", True, False),
    ]
    df = spark.createDataFrame(rows, "request_id string, primary string, model string, ok boolean, retryable boolean")
    got = {r.request_id: (r.model_used, r.fallback_used, r.models_tried) for r in costs.fallback_choice(df).collect()}
    assert got == {"a": ("Google Gemini 2.0 Flash", True, 3), "b": ("DeepSeek V3", False, 1), "c": (None, False, 1), "d": (None, False, 1)}


@pytest.mark.parametrize("prompt, domain, context, level, model", [
    ("hello there", "general", 0, "simple", "Google Gemini 2.0 Flash"),
    ("hello there", "legal", 0, "moderate", "DeepSeek V3"),
    ("word " * 160 + "analyze", "legal", 0, "complex", "Meta Llama 4 Maverick"),
    ("analyze and compare the strategy", "general", 20000, "moderate", "DeepSeek V3"),
])
def test_routing(spark, prompt, domain, context, level, model):
    df = spark.createDataFrame([(prompt, domain, context)], "prompt string, domain string, context_length int")
    row = routing.reason(routing.choose_model(routing.domain_floor(routing.route(df)))).first()
    assert (row.complexity, row.model) == (level, model)
    assert row.reasoning


def test_forced_model(spark):
    df = spark.createDataFrame([("x", 0)], "prompt string, context_length int")
    row = routing.choose_model(routing.route(df), "Mine").first()
    assert (row.model, row.confidence, row.signals) == ("Mine", 1.0, ["user_override"])


@pytest.mark.parametrize("raw, score, failed", [
    ('{"relevance": {"score": 10}, "accuracy": 4}', 7.0, False),
    ('```json\n{"safety": {"score": 8, "reasoning": "r"}}\n```', 8.0, False),
    ('{"unknown": 3}', 5.0, False),
    ("rated 6/10 and 9 / 10", 7.5, False),
    ("no score {", 5.0, False),
    ('{"relevance": {"score": 10}}', 0.0, True),
])
def test_evaluation(spark, raw, score, failed):
    df = spark.createDataFrame([(raw, "chat", failed)], "raw string, kind string, failed boolean")
    row = evaluation.evaluate(df, "raw", "kind", "failed").first()
    assert row.overall_score == score


def test_retry(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 8.0), ("b", 1, 3.0), ("b", 2, 4.0), ("c", 1, 7.0)], "m string, i int, s double")
    got = {r.m: (r.iteration, r.passed, r.retried) for r in evaluation.retry_select(df, "m", "i", "s").collect()}
    assert got == {"a": (2, True, True), "b": (2, False, True), "c": (1, True, False)}


def test_assignment_matches_big_integers(spark):
    users = spark.range(300)
    got = {r.id: r.b for r in users.select("id", experiments.bucket("exp", F.col("id")).alias("b")).collect()}
    assert got == {u: int(hashlib.sha256(f"exp:{u}".encode()).hexdigest(), 16) % 100 for u in range(300)}


@pytest.mark.parametrize("experiment, expected", [
    (None, {"control"}), (Experiment("e", is_active=False), {"control"}),
    (Experiment("e", ("a", "b"), (0.0, 1.0)), {"b"}), (Experiment("e", ("a", "b"), (0.2, 0.2)), {"a", "b"}),
])
def test_assignment_edges(spark, experiment, expected):
    got = {r.v for r in spark.range(200).select(experiments.assign(experiment, F.col("id")).alias("v")).collect()}
    assert got == expected


def test_sandbox(spark, sf):
    catalog.register_views(spark, sf, ("orders", "nation"))
    result = sandbox.run(spark, "```sql\nSELECT o_orderkey FROM orders;\n```", max_rows=5)
    rows = result.with_flag().collect()
    assert len(rows) == 5 and rows[0].truncated is True
    assert sandbox.run(spark, "SELECT * FROM nation LIMIT 3").with_flag().first().truncated is False
    for bad in ("DROP TABLE orders", "SELECT 1; SELECT 2", ""):
        with pytest.raises(sandbox.RefusedQuery):
            sandbox.run(spark, bad)
    assert "TABLE nation:\n  n_nationkey INT" in catalog.schema_text(spark, ("nation",))
