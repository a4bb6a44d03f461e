"""Cost, routing, evaluation, experiment and request-check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, requests as rq
from ..functions.numbers import half_up, hash_prefix, human_bytes
from ..operators import costs, evaluation, experiments, lookup, reports, routing
from ..session import table
from . import sqltext as sx
from .mapping import AS_OF_SQL, K_SQL, MODEL_REQUESTS, as_of, davg, dsum, model_requests, prop_k, rounded
from .registry import query

NAMES = (*fixed.MODEL_IDS, "Mistral Small 3.1", "Unlisted model")


def case_of(expr: str, pairs: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {sx.q(k)} THEN {sx.q(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


def sql_list(values) -> str:
    return "[" + ", ".join(sx.q(v) for v in values) + "]"


MODEL_ID_SQL = case_of("model", fixed.MODEL_IDS, sx.q(fixed.MODEL_IDS[fixed.DEFAULT_MODEL]))
PRICES = "prices(model_id, prompt, completion) AS (VALUES " + ", ".join(
    f"({sx.q(m)}, {p}::DOUBLE, {c}::DOUBLE)" for m, p, c in costs.EXAMPLE_PRICES
) + ")"
PRICED = f"""{MODEL_REQUESTS}, {PRICES},
named AS (SELECT *, list_extract({sql_list(NAMES)}, CAST(model_no + 1 AS INTEGER)) AS model FROM model_requests),
ided AS (SELECT *, {MODEL_ID_SQL} AS model_id FROM named),
raw_cost AS (SELECT i.id, i.model, i.model_id, i.input_tokens, i.output_tokens, i.created_at,
  (input_tokens * COALESCE(prompt, 0) + output_tokens * COALESCE(completion, 0)) / 1000000 AS a,
  (input_tokens * 10.0::DOUBLE + output_tokens * 30.0::DOUBLE) / 1000000 AS b FROM ided i LEFT JOIN prices USING (model_id)),
llm AS (SELECT id, model, model_id, input_tokens, output_tokens, created_at, {rounded("a", 6)} AS actual_cost, {rounded("b", 6)} AS gpt4_cost,
  {rounded("b - a", 6)} AS savings, CASE WHEN b > 0 THEN {rounded("(b - a) / b * 100", 2)} ELSE 0.0 END AS savings_percent FROM raw_cost)"""


def named_requests(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in NAMES])
    named = model_requests(spark, sf).withColumn("model", F.get(names, F.col("model_no")))
    return named.withColumn("model_id", costs.model_id(F.col("model"))).drop("model_no")


def priced(spark: SparkSession, sf: str) -> DataFrame:
    return costs.request_cost(named_requests(spark, sf), costs.example_pricing(spark))


@query("request_cost", f"WITH {PRICED} SELECT id, model_id, input_tokens, output_tokens, actual_cost, gpt4_cost, savings, savings_percent FROM llm")
def request_cost(spark, sf):
    return priced(spark, sf).drop("model", "created_at")


@query("model_name_map", f"WITH {PRICED} SELECT model, model_id, COUNT(*) AS requests FROM ided GROUP BY ALL")
def model_name_map(spark, sf):
    return named_requests(spark, sf).groupBy("model", "model_id").agg(F.count("*").alias("requests"))


@query("cost_totals", f"""WITH {PRICED} SELECT COUNT(*) AS total_requests, {rounded(dsum("actual_cost", 9), 6)} AS total_cost,
  {rounded(dsum("gpt4_cost", 9), 6)} AS total_baseline_cost, {rounded(dsum("savings", 9), 6)} AS total_savings,
  {rounded(davg("savings_percent", 2), 2)} AS avg_savings_percent, CAST(SUM(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(SUM(output_tokens) AS BIGINT) AS total_output_tokens,
  {rounded(dsum(f"CASE WHEN CAST(created_at AS DATE) = CAST({AS_OF_SQL} AS DATE) THEN savings END", 9), 6)} AS today_savings FROM llm""")
def cost_totals(spark, sf):
    return reports.cost_totals(priced(spark, sf), as_of())


@query("cost_by_model", f"""WITH {PRICED} SELECT model, COUNT(*) AS requests, {rounded(dsum("actual_cost", 9), 6)} AS cost,
  {rounded(dsum("savings", 9), 6)} AS savings, {rounded(davg("savings_percent", 2), 2)} AS avg_savings_percent FROM llm GROUP BY model""")
def cost_by_model(spark, sf):
    return reports.cost_by_model(priced(spark, sf)).orderBy(F.col("requests").desc())


@query("cost_by_day", f"""WITH {PRICED} SELECT strftime(created_at, '%Y-%m-%d') AS day, {rounded(dsum("actual_cost", 9), 6)} AS cost,
  {rounded(dsum("savings", 9), 6)} AS savings FROM llm WHERE CAST(created_at AS DATE) >= CAST({AS_OF_SQL} AS DATE) - 7 GROUP BY 1""")
def cost_by_day(spark, sf):
    return reports.cost_by_day(priced(spark, sf), as_of())


ORDER_LIST = sql_list(fixed.FALLBACK_ORDER)


@query("fallback_choice", f"""
WITH a AS (SELECT l_orderkey AS request_id, list_extract({ORDER_LIST}, CAST(l_orderkey % 7 + 1 AS INTEGER)) AS primary_model,
  list_extract({ORDER_LIST}, CAST((l_orderkey + l_linenumber) % 7 + 1 AS INTEGER)) AS model, l_returnflag = 'N' AS ok, l_linestatus = 'O' AS retryable FROM lineitem),
r AS (SELECT *, CASE WHEN model = primary_model THEN 0 ELSE list_position({ORDER_LIST}, model) -
   CASE WHEN list_position({ORDER_LIST}, primary_model) < list_position({ORDER_LIST}, model) THEN 1 ELSE 0 END END AS rk FROM a),
s AS (SELECT request_id, primary_model, MIN(rk) FILTER (ok AND rk <= 5) AS won_at, MIN(rk) FILTER (NOT ok AND NOT retryable AND rk <= 5) AS stopped_at,
  MAX(rk) FILTER (rk <= 5) AS last_rank, MAX(rk) <= 5 AS within_limit FROM r GROUP BY ALL),
t AS (SELECT *, won_at IS NOT NULL AND (stopped_at IS NULL OR won_at < stopped_at) AS alive FROM s)
SELECT t.request_id, primary_model AS "primary", CASE WHEN alive THEN (SELECT MIN(model) FROM r WHERE r.request_id = t.request_id AND r.rk = t.won_at) END AS model_used,
  alive AND won_at > 0 AS fallback_used, least(CASE WHEN alive THEN won_at END, stopped_at, last_rank) + 1 AS models_tried, within_limit FROM t""")
def fallback_choice(spark, sf):
    order = F.array(*[F.lit(m) for m in fixed.FALLBACK_ORDER])
    n = len(fixed.FALLBACK_ORDER)
    attempts = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.get(order, F.pmod("l_orderkey", F.lit(n)).cast("int")).alias("primary"),
        F.get(order, F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(n)).cast("int")).alias("model"),
        (F.col("l_returnflag") == "N").alias("ok"),
        (F.col("l_linestatus") == "O").alias("retryable"),
    )
    return costs.fallback_choice(attempts)


# -- routing ------------------------------------------------------------------------------

PREFIXES = (
    "What is meant here? ",
    "Analyze and compare the legal implications, why and how: ",
    "Summarize: ",
    "Explain the API latency, throughput and encryption architecture??? ",
    "",
    "Recommend a detailed strategy with trade-offs and rationale for compliance: ",
)
DOMAINS = ("general", "legal", "medical", "technical")

PROMPTS = f"""prompts AS (SELECT conv_id, turn, list_extract({sql_list(PREFIXES)}, CAST((conv_id + turn) % 6 + 1 AS INTEGER)) || text AS prompt,
  list_extract({sql_list(DOMAINS)}, CAST(conv_id % 4 + 1 AS INTEGER)) AS domain, (conv_id * 977) % 40000 AS context_length FROM conversations)"""


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    prefixes, domains = (F.array(*[F.lit(x) for x in xs]) for xs in (PREFIXES, DOMAINS))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat(F.get(prefixes, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)).cast("int")), F.col("text")).alias("prompt"),
        F.get(domains, F.pmod("conv_id", F.lit(4)).cast("int")).alias("domain"),
        F.pmod(F.col("conv_id") * 977, F.lit(40000)).alias("context_length"),
    )


def hit(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {sx.q(pattern)})"


ROUTED = f"""{PROMPTS},
sig AS (SELECT *, {sx.count('prompt', chr(92) + 'S+')} AS words, {" OR ".join(hit('lower(prompt)', p) for p in fixed.SIMPLE_PATTERNS)} AS is_simple,
  {" + ".join(f"CAST({hit('lower(prompt)', p)} AS INTEGER)" for p in fixed.COMPLEX_PATTERNS)} AS complex_hits,
  len(regexp_extract_all(prompt, {sx.q('(?i)' + fixed.TECHNICAL_PATTERN)})) AS technical_hits,
  length(prompt) - length(replace(prompt, '?', '')) AS questions, context_length > 15000 AS large_context FROM prompts),
sc AS (SELECT *, {rounded('''CASE WHEN words <= 50 THEN -1.0 WHEN words >= 150 THEN 1.5 ELSE 0 END + CASE WHEN is_simple THEN -0.6 ELSE 0 END
  + complex_hits * 0.5 + CASE WHEN technical_hits >= 4 THEN 0.8 ELSE 0 END + CASE WHEN questions >= 3 THEN 0.5 ELSE 0 END
  + CASE WHEN large_context THEN 0.5 ELSE 0 END''', 4)} AS score,
  list_filter([CASE WHEN words <= 50 THEN 'short_prompt(' || words || 'w)' END, CASE WHEN words >= 150 THEN 'long_prompt(' || words || 'w)' END,
   CASE WHEN is_simple THEN 'simple_pattern' END, CASE WHEN complex_hits > 0 THEN 'complex_patterns(' || complex_hits || ')' END,
   CASE WHEN technical_hits >= 4 THEN 'technical_terms(' || technical_hits || ')' END,
   CASE WHEN questions >= 3 THEN 'multi_question(' || questions || ')' END, CASE WHEN large_context THEN 'large_context' END],
   lambda x: x IS NOT NULL) AS signals FROM sig),
routed AS (SELECT *, CASE WHEN score <= -0.5 THEN 'simple' WHEN score < 1.5 THEN 'moderate' ELSE 'complex' END AS complexity,
  {rounded('CASE WHEN score <= -0.5 THEN least(0.9, 0.6 + abs(score) * 0.1) WHEN score < 1.5 THEN 0.7 ELSE least(0.95, 0.6 + score * 0.08) END', 2)} AS confidence FROM sc)"""


def routed(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route(prompts(spark, sf))


PRIMARY = case_of("complexity", {k: v[0] for k, v in fixed.LEVEL_MODELS.items()})
SECOND = case_of("complexity", {k: v[1] for k, v in fixed.LEVEL_MODELS.items()})


@query("route_prompt", f"""WITH {ROUTED} SELECT conv_id, turn, words, complex_hits, technical_hits, questions, score, complexity, confidence,
  array_to_string(signals, ',') AS signals, {PRIMARY} AS model, {SECOND} AS fallback_model FROM routed""")
def route_prompt(spark, sf):
    return routing.choose_model(routed(spark, sf)).select(
        "conv_id", "turn", "words", "complex_hits", "technical_hits", "questions", "score", "complexity", "confidence",
        F.array_join("signals", ",").alias("signals"), "model", "fallback_model",
    )


FLOORED = "CASE WHEN domain IN ('legal', 'medical') AND complexity = 'simple' THEN 'moderate' ELSE complexity END"


@query("route_domain_floor", f"WITH {ROUTED} SELECT domain, complexity AS before, {FLOORED} AS complexity, COUNT(*) AS prompts FROM routed GROUP BY ALL")
def route_domain_floor(spark, sf):
    raised = routing.domain_floor(routed(spark, sf).withColumn("before", F.col("complexity")))
    return raised.groupBy("domain", "before", "complexity").agg(F.count("*").alias("prompts"))


@query("route_models", f"""WITH {ROUTED}, c AS (SELECT complexity, COUNT(*) AS requests FROM routed GROUP BY 1)
SELECT complexity, requests, {PRIMARY} AS model FROM c UNION ALL SELECT complexity, requests, {SECOND} FROM c""")
def route_models(spark, sf):
    return routing.models_per_level(routed(spark, sf))


@query("route_reason", f"""WITH {ROUTED}, r AS (SELECT conv_id, turn, complexity, CASE WHEN len(signals) > 0 THEN array_to_string(signals[1:3], ', ') ELSE 'default' END AS f FROM routed)
SELECT conv_id, turn, CASE complexity WHEN 'simple' THEN 'Simple query detected (' || f || '); using fast model'
  WHEN 'moderate' THEN 'Standard query (' || f || '); balanced model selected'
  ELSE 'Complex analysis required (' || f || '); using high-capability model' END AS reasoning FROM r""")
def route_reason(spark, sf):
    return routing.reason(routed(spark, sf)).select("conv_id", "turn", "reasoning")


# -- evaluation ---------------------------------------------------------------------------

JUDGED_PARTS = (
    ('{"relevance": {"score": ', "{a}", ', "reasoning": "ok, fine"}, "accuracy": ', "{b}", ', "safety": {"score": 9}, "overall_feedback": "x"}'),
    ('Here it is:\n```json\n{"relevance": {"score": ', "{b}", '}, "helpfulness": {"reasoning": "none"}}\n```\nDone.'),
    ("I would give this ", "{a}", "/10 for tone and ", "{b}", ".5 / 10 for depth"),
    ("nothing to see {broken ", "{a}"),
    ('{"other": 3, "completeness": {"score": ', "{a}", "}}"),
)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    a = (F.pmod(F.col("n_chars"), F.lit(10)) + 1).cast("string")
    b = (F.pmod(F.col("doc_id"), F.lit(10)) + 1).cast("string")
    kind = F.pmod(F.col("doc_id"), F.lit(5))

    def text(parts):
        return F.concat(*[a if p == "{a}" else b if p == "{b}" else F.lit(p) for p in parts])

    raw = F.when(kind == 0, text(JUDGED_PARTS[0]))
    for i, parts in enumerate(JUDGED_PARTS[1:], 1):
        raw = raw.when(kind == i, text(parts))
    return table(spark, sf, "documents").select(
        "doc_id", "lang", raw.alias("raw"), F.lit("chat").alias("response_type"),
        (F.pmod(F.col("doc_id"), F.lit(17)) == 0).alias("failed"),
    )


def _judged_sql() -> str:
    def text(parts):
        return " || ".join({"{a}": "CAST(n_chars % 10 + 1 AS VARCHAR)", "{b}": "CAST(doc_id % 10 + 1 AS VARCHAR)"}.get(p) or sx.q(p) for p in parts)

    return "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {text(p)}" for i, p in enumerate(JUDGED_PARTS)) + " END"


CHAT = fixed.DIMENSION_WEIGHTS["chat"]
JUDGED = f"""judged AS (SELECT doc_id, lang, {_judged_sql()} AS raw, doc_id % 17 = 0 AS failed FROM documents),
blk AS (SELECT *, CASE WHEN regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)```', 1) <> '' THEN regexp_extract(regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)```', 1), '(?s)\\{{.*\\}}')
  ELSE regexp_extract(raw, '(?s)\\{{.*\\}}') END AS block FROM judged),
jsn AS (SELECT *, CASE WHEN block <> '' AND json_valid(block) THEN block END AS j FROM blk),
dims AS (SELECT doc_id, lang, raw, failed, j, {", ".join(f"CASE WHEN json_type(json_extract(j, '$.{d}')) = 'OBJECT' THEN COALESCE(CAST(json_extract_string(j, '$.{d}.score') AS DOUBLE), 5.0) ELSE TRY_CAST(json_extract_string(j, '$.{d}') AS DOUBLE) END AS {d}" for d in CHAT)} FROM jsn)"""
MASS = " + ".join(f"CASE WHEN {d} IS NULL THEN 0 ELSE {w}::DOUBLE END" for d, w in CHAT.items())
TOTAL = " + ".join(f"COALESCE({d} * {w}::DOUBLE, 0)" for d, w in CHAT.items())
MARKS = "list_transform(regexp_extract_all(raw, '(\\d+(?:\\.\\d+)?)\\s*/\\s*10', 1), lambda x: CAST(x AS DOUBLE))"
SCORED = f"""{JUDGED},
scored AS (SELECT *, {rounded(f'''CASE WHEN failed THEN 0.0 WHEN j IS NULL THEN CASE WHEN len({MARKS}) > 0 THEN list_sum({MARKS}) / len({MARKS}) ELSE 5.0 END
  WHEN {MASS} > 0 THEN ({TOTAL}) / ({MASS}) ELSE 5.0 END''', 4)} AS overall_score,
  CASE WHEN failed THEN 'Evaluation failed' WHEN j IS NULL THEN 'Fallback evaluation - JSON parsing failed' END AS error FROM dims)"""


@query("eval_parse", f"""WITH {JUDGED} SELECT doc_id, dimension, score FROM (
  UNPIVOT (SELECT doc_id, {", ".join(CHAT)} FROM dims) ON {", ".join(CHAT)} INTO NAME dimension VALUE score)""")
def eval_parse(spark, sf):
    parsed = evaluation.eval_parse(judged(spark, sf), "raw", "response_type")
    return parsed.select("doc_id", F.inline("parsed")).select("doc_id", "dimension", "score")


@query("eval_weighted_score", f"WITH {SCORED} SELECT doc_id, overall_score FROM scored WHERE NOT failed AND j IS NOT NULL AND ({MASS}) > 0")
def eval_weighted_score(spark, sf):
    parsed = evaluation.eval_parse(judged(spark, sf).filter(~F.col("failed")), "raw", "response_type")
    rows = parsed.select("doc_id", "response_type", F.inline("parsed"))
    return evaluation.weighted_rows(rows, "doc_id", "response_type")


@query("eval_fallback", f"WITH {SCORED} SELECT doc_id, overall_score, error FROM scored")
def eval_fallback(spark, sf):
    return evaluation.evaluate(judged(spark, sf), "raw", "response_type", "failed").select("doc_id", "overall_score", "error")


@query("quality_gate", f"WITH {SCORED} SELECT lang, COUNT(*) AS judged, COUNT(*) FILTER (error IS NULL AND overall_score >= 7) AS passed FROM scored GROUP BY lang")
def quality_gate(spark, sf):
    scored = evaluation.evaluate(judged(spark, sf), "raw", "response_type", "failed")
    passed = evaluation.passes_gate(F.col("overall_score"), F.col("error"))
    return scored.groupBy("lang").agg(F.count("*").alias("judged"), F.count_if(passed).alias("passed"))


@query("retry_select", """
WITH r AS (SELECT l_orderkey AS mission, l_linenumber AS iteration, l_quantity / 5 AS score FROM lineitem),
c AS (SELECT mission, COALESCE(MIN({'i': iteration, 's': score}) FILTER (score >= 7 AND iteration <= 4), MAX({'i': iteration, 's': score}) FILTER (iteration <= 4)) AS chosen, COUNT(*) AS iterations FROM r GROUP BY mission)
SELECT mission, iterations, chosen.i AS iteration, chosen.s AS score, chosen.s >= 7 AS passed, chosen.i > 1 AS retried FROM c""")
def retry_select(spark, sf):
    runs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("mission"), F.col("l_linenumber").alias("iteration"), (F.col("l_quantity") / 5).alias("score")
    )
    return evaluation.retry_select(runs, "mission", "iteration", "score", max_retries=4)


@query("findings_by_severity", """
SELECT CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, source, COUNT(*) AS findings FROM documents GROUP BY ALL
UNION ALL SELECT 'low', lang, COUNT(*) FROM documents GROUP BY lang""")
def findings_by_severity(spark, sf):
    level = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.pmod("doc_id", F.lit(3)).cast("int"))
    finding = F.struct(F.lit("found {it}, said \"so\"").alias("finding"), F.col("source"), level.alias("severity"))
    other = F.struct(F.lit("language").alias("finding"), F.col("lang").alias("source"), F.lit("low").alias("severity"))
    report = F.concat(F.lit("Report follows.\n"), F.to_json(F.struct(F.array(finding, other).alias("findings"))), F.lit("\nEnd."))
    texts = table(spark, sf, "documents").select("doc_id", report.alias("report"))
    return evaluation.findings_by_severity(texts, "report")


@query("extract_json_block", f"""
WITH t AS (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'noise ' || props || ' more' WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE 'no json here' END AS raw,
  {K_SQL} AS k FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN -1 ELSE k END AS k FROM t""")
def extract_json_block(spark, sf):
    kind = F.pmod("event_id", F.lit(3))
    raw = (
        F.when(kind == 0, F.concat(F.lit("noise "), F.col("props"), F.lit(" more")))
        .when(kind == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .otherwise("no json here")
    )
    parsed = evaluation.parse_or(raw, "struct<k:bigint>", F.struct(F.lit(-1).cast("bigint").alias("k")))
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


# -- experiments --------------------------------------------------------------------------

PRICE_TEST = experiments.Experiment("price_test", ("control", "blue", "green"), (0.4, 0.35, 0.2))
CLOSED_TEST = experiments.Experiment("closed", is_active=False)
BUCKET_SQL = """list_reduce(list_prepend(0, list_transform(range(16), lambda i:
  CAST(('0x' || substr(sha256('price_test:' || CAST(user_id AS VARCHAR)), i * 4 + 1, 4)) AS INTEGER))), lambda a, x: (a * 36 + x) % 100)"""
VARIANT_SQL = "CASE WHEN b / 100.0::DOUBLE < 0.4 THEN 'control' WHEN b / 100.0::DOUBLE < 0.75 THEN 'blue' WHEN b / 100.0::DOUBLE < 0.95 THEN 'green' ELSE 'control' END"
USERS_SQL = f"u AS (SELECT user_id, bool_or(event_type = 'purchase') AS converted FROM events GROUP BY user_id), a AS (SELECT user_id, converted, {BUCKET_SQL} AS b FROM u)"


def ab_users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("converted"))


@query("ab_assign", f"WITH {USERS_SQL} SELECT user_id, b AS bucket, {VARIANT_SQL} AS variant, 'control' AS closed_variant FROM a")
def ab_assign(spark, sf):
    user = F.col("user_id")
    return ab_users(spark, sf).select(
        user, experiments.bucket("price_test", user).alias("bucket"), experiments.assign(PRICE_TEST, user).alias("variant"),
        experiments.assign(CLOSED_TEST, user).alias("closed_variant"),
    )


@query("ab_results", f"""WITH {USERS_SQL} SELECT {VARIANT_SQL} AS variant, COUNT(*) AS assignments, COUNT(*) FILTER (converted) AS conversions,
  {rounded("CAST(COUNT(*) FILTER (converted) AS DOUBLE) / COUNT(*) * 100", 2)} AS conversion_rate FROM a GROUP BY 1""")
def ab_results(spark, sf):
    return experiments.results(PRICE_TEST, ab_users(spark, sf), "user_id", "converted")


# -- request checks -----------------------------------------------------------------------

SQL_TEXTS = (
    ("SELECT * FROM events WHERE event_type = '", "'"),
    ("DROP TABLE ", ""),
    ("  select count(*) from ", ""),
    ("SELECT 1; SELECT '", "'"),
    ("SELECT '", "' -- note"),
    ("WITH a AS (SELECT '", "' AS x) SELECT * FROM a"),
    ("EXPLAIN SELECT '", "'"),
    ("SELECT load_extension('", "')"),
    ("```sql\nSELECT '", "';\n```"),
    ("Here's the query:\n\nSELECT replace('", "', 'a', 'b');;"),
    ("SELECT updated_at, '", "' FROM created"),
    ("SELECT /* c */ '", "'"),
    ("SELECT TRANSFORM(event_id) USING 'cat' AS (x string) FROM ", ""),
    ("SELECT java_method('java.lang.System', 'getProperty', '", "')"),
    ("SELECT * FROM text.`/etc/", "`"),
    ("SELECT * FROM `org.example.Format` . `", ":9`"),
    ("SELECT a.`b` FROM a JOIN c USING (", ")"),
    ("SELECT * FROM IDENTIFIER('", "')"),
)
STATEMENTS = f"statements AS (SELECT event_id, CASE event_id % {len(SQL_TEXTS) + 1} " + " ".join(
    f"WHEN {i} THEN {sx.q(a)} || event_type || {sx.q(b)}" for i, (a, b) in enumerate(SQL_TEXTS)
) + " ELSE '' END AS statement FROM events)"


def statements(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.pmod("event_id", F.lit(len(SQL_TEXTS) + 1))
    text = F.when(kind == 0, F.concat(F.lit(SQL_TEXTS[0][0]), F.col("event_type"), F.lit(SQL_TEXTS[0][1])))
    for i, (a, b) in enumerate(SQL_TEXTS[1:], 1):
        text = text.when(kind == i, F.concat(F.lit(a), F.col("event_type"), F.lit(b)))
    return table(spark, sf, "events").select("event_id", text.otherwise("").alias("statement"))


CLEAN = r"""cleaned AS (SELECT event_id, regexp_replace(CASE WHEN regexp_matches(bare, '(?is)\b(WITH\s+\w+\s*(?:\([^)]*\)\s*)?AS\s*\(.*|SELECT\b.*)')
  THEN regexp_extract(bare, '(?is)\b(WITH\s+\w+\s*(?:\([^)]*\)\s*)?AS\s*\(.*|SELECT\b.*)', 1) ELSE bare END, ';+$', '') AS statement FROM (
  SELECT event_id, regexp_replace(regexp_replace(regexp_replace(statement, '```sql\s*', '', 'g'), '```\s*', '', 'g'), '^\s+|\s+$', '', 'g') AS bare FROM statements))"""
GUARD = "CASE WHEN statement = '' THEN 'Empty SQL query' " + " ".join(
    f"WHEN regexp_matches(upper(statement), '\\b{k}\\b') THEN 'Blocked operation: {k} is not allowed'" for k in fixed.BLOCKED_KEYWORDS
) + r" WHEN NOT regexp_matches(upper(statement), '^\s*(SELECT|WITH)\b') THEN 'Only SELECT queries are allowed' " + " ".join(
    f"WHEN regexp_matches(upper(statement), {sx.q(p)}) THEN {sx.q(m)}" for p, m in (*rq.SUSPICIOUS, *rq.UNSAFE)
) + " END"


@query("guard_sql", f"WITH {STATEMENTS} SELECT event_id, {GUARD} AS verdict FROM statements")
def guard_sql(spark, sf):
    return statements(spark, sf).select("event_id", rq.guard_sql(F.col("statement")).alias("verdict"))


@query("clean_sql_text", f"WITH {STATEMENTS}, {CLEAN} SELECT event_id, statement, {GUARD} AS verdict FROM cleaned")
def clean_sql_text(spark, sf):
    cleaned = statements(spark, sf).select("event_id", rq.clean_sql(F.col("statement")).alias("statement"))
    return cleaned.withColumn("verdict", rq.guard_sql(F.col("statement")))


@query("hash_identity", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS ip_hash, substr(sha256(c_name), 1, 8) AS short_hash FROM customer")
def hash_identity(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", hash_prefix(F.col("c_name"), 16).alias("ip_hash"), hash_prefix(F.col("c_name"), 8).alias("short_hash")
    )


@query("client_ip", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '10.0.0.' || (user_id % 256) WHEN 1 THEN '10.1.0.' || (user_id % 256)
  WHEN 2 THEN 'fe80::' || (user_id % 10) WHEN 3 THEN '192.168.1.' || (user_id % 256) WHEN 4 THEN 'invalid' ELSE 'invalid' END AS ip FROM events""")
def client_ip(spark, sf):
    kind, n = F.pmod("event_id", F.lit(6)), F.pmod("user_id", F.lit(256)).cast("string")
    log = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == 0, F.concat(F.lit(" 10.0.0."), n, F.lit(" , 172.16.0.1"))).when(kind == 4, "bad address").alias("xff"),
        F.when(kind == 1, F.concat(F.lit("10.1.0."), n)).alias("real"),
        F.when(kind == 2, F.concat(F.lit("fe80::"), F.pmod("user_id", F.lit(10)).cast("string"))).alias("edge"),
        F.when(kind == 3, F.concat(F.lit("192.168.1."), n)).alias("remote"),
    )
    return log.select("event_id", rq.client_ip(F.col("xff"), F.col("real"), F.col("edge"), F.col("remote")).alias("ip"))


@query("request_fingerprint", """SELECT substr(md5(event_type || '|' || CASE WHEN user_id % 3 = 0 THEN '' ELSE 'en' END || '|' || props), 1, 16) AS fingerprint,
  COUNT(*) AS requests FROM events GROUP BY 1""")
def request_fingerprint(spark, sf):
    language = F.when(F.pmod("user_id", F.lit(3)) != 0, "en")
    prints = table(spark, sf, "events").select(
        rq.request_fingerprint(F.col("event_type"), language, F.col("props")).alias("fingerprint")
    )
    return prints.groupBy("fingerprint").agg(F.count("*").alias("requests"))


@query("honeypot_filter", f"SELECT event_id, user_id FROM events WHERE {K_SQL} % 5 = 0")
def honeypot_filter(spark, sf):
    forms = table(spark, sf, "events").withColumn("website", F.when(F.pmod(prop_k(), F.lit(5)) == 0, "http://spam.example"))
    return forms.filter(rq.is_bot(F.col("website"))).select("event_id", "user_id")


def bytes_sql(size: str) -> str:
    def text(unit: int, label: str) -> str:
        return f"CAST(CAST(ROUND(CAST({size} AS DECIMAL(38,9)) / {unit}, 2) AS DECIMAL(28,2)) AS VARCHAR) || ' {label}'"

    return f"CASE WHEN {size} >= 1073741824 THEN {text(1073741824, 'GB')} WHEN {size} >= 1048576 THEN {text(1048576, 'MB')} ELSE {text(1024, 'KB')} END"


@query("human_bytes", f"SELECT o_orderkey, {bytes_sql('(CAST(floor(o_totalprice) AS BIGINT) * (1 + o_custkey % 9000))')} AS size FROM orders")
def human_bytes_query(spark, sf):
    size = F.floor("o_totalprice").cast("bigint") * (1 + F.pmod("o_custkey", F.lit(9000)))
    return table(spark, sf, "orders").select("o_orderkey", human_bytes(size).alias("size"))


def any_sql(expr: str, needles) -> str:
    return " OR ".join(f"contains(lower({expr}), {sx.q(n)})" for n in needles)


@query("keyword_intent", f"WITH {PROMPTS} SELECT conv_id, turn, {any_sql('prompt', fixed.STATS_KEYWORDS)} AS about_stats FROM prompts")
def keyword_intent(spark, sf):
    return prompts(spark, sf).select("conv_id", "turn", rq.is_stats_question(F.col("prompt")).alias("about_stats"))


@query("search_trigger", f"WITH {PROMPTS} SELECT conv_id, turn, {any_sql('prompt', fixed.SEARCH_TRIGGERS)} AS wants_search FROM prompts")
def search_trigger(spark, sf):
    return prompts(spark, sf).select("conv_id", "turn", rq.wants_search(F.col("prompt")).alias("wants_search"))


ANSWERS = (("what is", "product"), ("api", "interface"), ("summar", "summary"), ("th", "english"), ("é", "french"))


@query("first_match_lookup", f"WITH {PROMPTS} SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN contains(lower(prompt), {sx.q(k)}) THEN {sx.q(v)}" for k, v in ANSWERS) + " END AS answer FROM prompts")
def first_match_lookup(spark, sf):
    return prompts(spark, sf).select("conv_id", "turn", rq.first_match(F.col("prompt"), ANSWERS).alias("answer"))


@query("first_match_table", """WITH k AS (SELECT word, MIN(item_id) AS item_id FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS word FROM benchmark) GROUP BY word),
h AS (SELECT conv_id, turn, MIN(printf('%019d', item_id) || ' ' || word) AS hit FROM conversations JOIN k ON contains(lower(text), word) GROUP BY conv_id, turn)
SELECT conv_id, turn, split_part(hit, ' ', 2) || '@' || CAST(CAST(split_part(hit, ' ', 1) AS BIGINT) AS VARCHAR) AS answer FROM conversations LEFT JOIN h USING (conv_id, turn)""")
def first_match_table(spark, sf):
    items = table(spark, sf, "benchmark")
    words = items.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("needle"))
    keys = words.withColumn("answer", F.concat_ws("@", "needle", F.col("item_id").cast("string")))
    found = lookup.first_match(table(spark, sf, "conversations"), F.col("text"), keys, ["item_id"])
    return found.select("conv_id", "turn", "answer")
