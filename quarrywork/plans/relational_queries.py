"""The relational surface: joins, aggregates, windows, set operations and scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from ..functions import fixed
from ..functions.numbers import half_up
from ..operators import ordered, sandbox
from ..operators.topn import top_n_per_group
from ..session import materialize, shared_path, table
from ..sources import catalog
from .decision_queries import CLEAN, GUARD, STATEMENTS
from .mapping import rounded
from .registry import query


def sql_query(name: str, text: str, twin: str | None = None) -> None:
    """Register a statement that goes through the guard; DuckDB gets ``twin`` or the same text."""

    used = tuple(n for n in catalog.TEST_TABLES if re.search(rf"\b{n}\b", text))

    def build(spark, sf):
        catalog.register_views(spark, sf, used)
        return sandbox.unlimited(spark, text)

    build.__name__ = name
    query(name, twin or text)(build)


# -- joins --------------------------------------------------------------------------------

sql_query("join_inner", f"""
SELECT n_name, COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")

sql_query("join_left", """
SELECT c_custkey, COUNT(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")

sql_query("join_right", """
SELECT s_suppkey, s_name, COUNT(l_orderkey) AS lines FROM lineitem RIGHT JOIN supplier ON l_suppkey = s_suppkey AND l_quantity > 49 GROUP BY s_suppkey, s_name""")

sql_query("join_full", """
SELECT COALESCE(c.nationkey, s.nationkey) AS nationkey, c.customers, s.suppliers
FROM (SELECT c_nationkey AS nationkey, COUNT(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c
FULL JOIN (SELECT s_nationkey AS nationkey, COUNT(*) AS suppliers FROM supplier WHERE s_acctbal < 4000 GROUP BY s_nationkey) s ON c.nationkey = s.nationkey""")

sql_query("join_semi", """
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")

sql_query("join_anti", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")


@query("join_range", """
WITH tiers AS (SELECT DISTINCT p_size AS tier, p_size * 10000 AS low, p_size * 10000 + 7500 AS high FROM part)
SELECT o_orderkey, tier FROM orders JOIN tiers ON CAST(floor(o_totalprice) AS BIGINT) >= low AND CAST(floor(o_totalprice) AS BIGINT) < high""")
def join_range(spark, sf):
    tiers = table(spark, sf, "part").select(F.col("p_size").cast("bigint").alias("tier")).distinct().select(
        "tier", (F.col("tier") * 10000).alias("low"), (F.col("tier") * 10000 + 7500).alias("high")
    )
    points = table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("at"))
    return ordered.interval_lookup(points, "at", tiers, "low", "high", ["tier"]).select("o_orderkey", "tier")


@query("join_range_overlapping", """
WITH spans AS (SELECT o_orderkey AS span, CAST(floor(o_totalprice) AS BIGINT) - 5 AS low, CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 7 AS high FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT -1, -1000000000000, 1000000000000)
SELECT c_custkey, COUNT(*) AS spans, SUM(span)::BIGINT AS total FROM customer JOIN spans ON CAST(floor(c_acctbal * 20) AS BIGINT) >= low AND CAST(floor(c_acctbal * 20) AS BIGINT) < high GROUP BY c_custkey""")
def join_range_overlapping(spark, sf):
    """One interval over the whole axis and many narrow ones that overlap."""
    price = F.floor("o_totalprice")
    narrow = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").cast("bigint").alias("span"), (price - 5).alias("low"), (price + F.col("o_orderkey") % 7).alias("high")
    )
    spans = narrow.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("span"), F.lit(-10**12).alias("low"), F.lit(10**12).alias("high")))
    points = table(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_acctbal") * 20).alias("at"))
    met = ordered.interval_lookup(points, "at", spans, "low", "high", ["span"])
    return met.groupBy("c_custkey").agg(F.count("*").alias("spans"), F.sum("span").alias("total"))


@query("join_asof", """
WITH b AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts, max_by(event_id, event_id) AS click_id, max_by(value, event_id) AS click_value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT b.event_id, b.value, c.click_id AS prev_event_id, c.click_value AS prev_value FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts >= c.ts""")
def join_asof(spark, sf):
    events = table(spark, sf, "events")
    cols = ["event_id", "user_id", "ts", "value"]
    bought = events.filter(F.col("event_type") == "purchase").select(cols)
    clicked = events.filter(F.col("event_type") == "click").select(cols)
    joined = ordered.asof_join(bought, clicked, ["user_id"], "ts", 86_400, "event_id", ["event_id", "value"])
    return joined.select("event_id", "value", "prev_event_id", "prev_value")


# -- aggregates ---------------------------------------------------------------------------

sql_query("agg_basic", f"""
SELECT l_returnflag, l_linestatus, COUNT(*) AS lines, COUNT(DISTINCT l_suppkey) AS suppliers, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  {rounded("CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)", 4)} AS avg_price, MIN(l_discount) AS min_discount, MAX(l_discount) AS max_discount
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10""")

sql_query(
    "agg_string",
    """SELECT c_mktsegment, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM (
  SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) d GROUP BY c_mktsegment""",
    """SELECT c_mktsegment, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM (
  SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) d GROUP BY c_mktsegment""",
)

sql_query("agg_rollup_cube", """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS orders, grouping(o_orderstatus) AS all_statuses, grouping(o_orderpriority) AS all_priorities
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")


@query("agg_approx_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, true AS within_bound FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(spark, sf):
    """The estimate lies within three standard errors of the exact count."""
    near, exact = F.approx_count_distinct("l_partkey", 0.02), F.count_distinct("l_partkey")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        exact.alias("parts"), (F.abs(near - exact) <= 3 * 0.02 * exact).alias("within_bound")
    )


@query("agg_stored_sketches", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id FROM events),
s AS (SELECT user_id, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM d GROUP BY user_id)
SELECT 'hll' AS sketch, 'union' AS part, COUNT(*) FILTER (c OR p) AS users, true AS within_bound FROM s
UNION ALL SELECT 'theta', 'union', COUNT(*) FILTER (c OR p), true FROM s
UNION ALL SELECT 'theta', 'intersection', COUNT(*) FILTER (c AND p), true FROM s""")
def agg_stored_sketches(spark, sf):
    """Sketches of each day and event type are stored; unions and intersections over all days read sketches alone."""
    events = table(spark, sf, "events").filter(F.col("event_type").isin("click", "purchase")).select(
        F.to_date("ts").alias("day"), "event_type", F.col("user_id").cast("bigint").alias("user_id")
    )
    daily = events.groupBy("day", "event_type").agg(
        F.hll_sketch_agg("user_id", 14).alias("hll"), F.theta_sketch_agg("user_id", 14).alias("theta")
    )
    stored = materialize(daily, "daily-sketches")
    of = lambda kind: F.theta_union_agg(F.when(F.col("event_type") == kind, F.col("theta")), 14)
    total = stored.agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", 14).alias("theta"), of("click").alias("c"), of("purchase").alias("p"))
    near = total.select(F.inline(F.array(
        F.struct(F.lit("hll").alias("sketch"), F.lit("union").alias("part"), F.hll_sketch_estimate("hll").alias("near")),
        F.struct(F.lit("theta").alias("sketch"), F.lit("union").alias("part"), F.theta_sketch_estimate("theta").alias("near")),
        F.struct(F.lit("theta").alias("sketch"), F.lit("intersection").alias("part"), F.theta_sketch_estimate(F.theta_intersection("c", "p")).alias("near")),
    )))
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    users = events.groupBy("user_id").agg((has("click") & has("purchase")).alias("both"))
    exact = users.agg(F.count("*").alias("either"), F.count_if("both").alias("both"))
    exact = exact.select(F.inline(F.array(F.struct(F.lit("union").alias("part"), F.col("either").alias("users")), F.struct(F.lit("intersection").alias("part"), F.col("both").alias("users")))))
    # three standard errors of 2^14 entries; an intersection's error is relative to the union
    bound = 3 / 2**7 * F.max("users").over(Window.partitionBy(F.lit(0)))
    exact = exact.withColumn("bound", bound)
    return near.join(exact, "part").select("sketch", "part", "users", (F.abs(F.col("near") - F.col("users")) <= F.col("bound")).alias("within_bound"))


# -- windows ------------------------------------------------------------------------------


@query("win_rank", """
SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank_in_group FROM orders) WHERE rank_in_group <= 3""")
def win_rank(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = top_n_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, spread_on=["o_orderkey"])
    return best.select("o_custkey", "o_orderkey", "rank_in_group")


@query("win_dense_rank", """
SELECT p_brand, p_partkey, dr FROM (SELECT p_brand, p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS dr FROM part) WHERE dr <= 2""")
def win_dense_rank(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    # rank the distinct sizes, then look the rank up: a brand with very many parts is not gathered
    sizes = part.select("p_brand", "p_size").distinct()
    ranked = sizes.withColumn("dr", F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.col("p_size").desc())))
    return part.join(ranked.filter(F.col("dr") <= 2), ["p_brand", "p_size"]).select("p_brand", "p_partkey", "dr")


@query("win_lag", """
SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_order FROM orders""")
def win_lag(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lagged = ordered.previous_value(
        orders, ["o_custkey"], ordered.time_bucket(F.col("o_orderdate"), 365 * 86_400),
        [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderkey"), "previous_order",
    )
    return lagged.select("o_orderkey", "previous_order")


@query("win_frame", """
SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM orders""")
def win_frame(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    summed = ordered.running_sum(
        orders, ["o_custkey"], ordered.time_bucket(F.col("o_orderdate"), 365 * 86_400),
        [F.col("o_orderdate"), F.col("o_orderkey")], {"running_total": F.col("o_totalprice").cast("decimal(18,2)")},
    )
    return summed.select("o_orderkey", F.col("running_total").cast("double").alias("running_total"))


# -- sorting, sampling, counting ----------------------------------------------------------

sql_query("sort_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("sample_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10")
sql_query("count_rows", "SELECT COUNT(*) AS row_count FROM lineitem")


@query("catalog_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in catalog.TEST_TABLES))
def catalog_row_counts(spark, sf):
    catalog.register_views(spark, sf)
    return catalog.row_counts(spark)


KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",),
    "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}
SCHEMA_SQL = f"""WITH k(table_name, column_name) AS (VALUES {", ".join(f"('{t}', '{c}')" for t, cs in KEYS.items() for c in cs)}),
n AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in catalog.TEST_TABLES)})
SELECT c.table_name, CAST(c.ordinal_position - 1 AS INTEGER) AS position, c.column_name,
  CASE c.data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(c.data_type) END AS data_type,
  c.is_nullable = 'YES' AS nullable, k.column_name IS NOT NULL AS is_key, n.row_count
FROM information_schema.columns c JOIN n USING (table_name) LEFT JOIN k ON k.table_name = c.table_name AND k.column_name = c.column_name"""


@query("catalog_schema", SCHEMA_SQL)
def catalog_schema(spark, sf):
    catalog.register_views(spark, sf)
    return catalog.describe(spark, keys=KEYS)


# -- set operations -----------------------------------------------------------------------

sql_query("set_union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("set_union_all", "SELECT c_custkey AS k, c_nationkey AS nationkey FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
sql_query("set_intersect", "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
sql_query("set_except", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")

# -- subqueries and expressions -----------------------------------------------------------

sql_query("subquery", """
SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT MAX(o_totalprice) * 0.9 FROM orders)
  OR o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")

sql_query("cte", """
WITH spend AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey),
big AS (SELECT * FROM spend WHERE total > 2000000)
SELECT c_name, total FROM big JOIN customer ON c_custkey = o_custkey""")

sql_query("case_predicates", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'known' WHEN o_orderstatus IS NOT NULL THEN 'open' ELSE 'none' END AS kind,
  COALESCE(NULLIF(o_orderpriority, '5-LOW'), 'low') AS priority FROM orders
WHERE o_totalprice BETWEEN 1000 AND 250000 AND o_orderpriority LIKE '%-%' AND o_orderstatus IS NOT NULL""")


@query("view_filter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def view_filter(spark, sf):
    catalog.register_views(spark, sf, ("customer",))
    sandbox.unlimited(spark, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'").createOrReplaceTempView("vip_customers")
    return spark.table("vip_customers")


@query("ltv_sum", "SELECT c_custkey AS customer_id, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS lifetime_value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY c_custkey")
def ltv_sum(spark, sf):
    catalog.register_views(spark, sf, ("customer", "orders"))
    text = sandbox.checked(spark, """SELECT c_custkey AS customer_id, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS lifetime_value
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > :floor GROUP BY c_custkey""", args={"floor": 5000})
    return spark.sql(text, args={"floor": 5000})


# -- the sandbox itself -------------------------------------------------------------------


@query("sandbox_query", """
SELECT l_orderkey, l_linenumber, l_partkey, true AS truncated FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""")
def sandbox_query(spark, sf):
    catalog.register_views(spark, sf, ("lineitem",))
    asked = "Here you go:\n```sql\nSELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey;\n```"
    return sandbox.run(spark, asked, fixed.MAX_RESULT_ROWS).with_flag()


@query("sandbox_history", f"""WITH {STATEMENTS}, {CLEAN} SELECT event_type || ' question' AS question, c.statement AS sql, {GUARD.replace('statement', 'c.statement')} IS NULL AS success,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS asked_at FROM cleaned c JOIN events USING (event_id)""")
def sandbox_history(spark, sf):
    from .decision_queries import statements

    asked = statements(spark, sf).join(table(spark, sf, "events").select("event_id", "event_type", "ts"), "event_id")
    rows = sandbox.history_rows(asked.withColumn("question", F.concat("event_type", F.lit(" question"))), "question", "statement", "ts")
    path = shared_path(spark, "history")
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(
        "question", "sql", "success", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("asked_at")
    )


# -- scalar functions ---------------------------------------------------------------------

sql_query(
    "fn_string",
    """SELECT c_custkey, concat(c_name, '/', c_mktsegment) AS joined, c_name || '-' || CAST(c_nationkey AS STRING) AS piped, substr(c_name, 10, 4) AS part, instr(c_name, '#') AS place,
  upper(c_name) AS up, lower(c_mktsegment) AS low, trim(concat('  ', c_name, ' ')) AS trimmed, length(c_name) AS n, translate(c_name, '#', '_') AS swapped, printf('%05d', c_custkey) AS padded FROM customer""",
    """SELECT c_custkey, concat(c_name, '/', c_mktsegment) AS joined, c_name || '-' || CAST(c_nationkey AS VARCHAR) AS piped, substr(c_name, 10, 4) AS part, instr(c_name, '#') AS place,
  upper(c_name) AS up, lower(c_mktsegment) AS low, trim(concat('  ', c_name, ' ')) AS trimmed, length(c_name) AS n, translate(c_name, '#', '_') AS swapped, printf('%05d', c_custkey) AS padded FROM customer""",
)
sql_query("fn_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' AND p_type LIKE 'S%' AND p_name NOT ILIKE '%bolt'")
sql_query(
    "fn_date",
    """SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS day, date_format(o_orderdate, 'HH') AS hour, date_format(date_sub(to_date(o_orderdate), 7), 'yyyy-MM-dd') AS week_before,
  datediff(date '1999-12-31', to_date(o_orderdate)) AS days_left, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders""",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%H') AS hour, strftime(CAST(o_orderdate AS DATE) - 7, '%Y-%m-%d') AS week_before,
  date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-12-31') AS days_left, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders""",
)
sql_query(
    "fn_math",
    f"""SELECT l_orderkey, l_linenumber, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DOUBLE) AS net, abs(l_quantity - 25) AS gap, least(l_quantity, 10.0) AS low,
  greatest(l_quantity, 40.0) AS high, l_partkey % 7 AS rest, l_partkey div 7 AS whole, sqrt(l_quantity * l_quantity) AS root FROM lineitem""",
    f"""SELECT l_orderkey, l_linenumber, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DOUBLE) AS net, abs(l_quantity - 25) AS gap, least(l_quantity, 10.0) AS low,
  greatest(l_quantity, 40.0) AS high, l_partkey % 7 AS rest, l_partkey // 7 AS whole, sqrt(l_quantity * l_quantity) AS root FROM lineitem""",
)
sql_query(
    "fn_null",
    """SELECT c_custkey, COALESCE(nullif(c_mktsegment, 'MACHINERY'), 'none') AS segment, ifnull(nullif(c_nationkey, 3), -1) AS nation, if(c_acctbal < 0, 'debt', 'ok') AS state,
  CASE WHEN c_acctbal IS NULL THEN 0 ELSE 1 END AS known FROM customer""",
)
sql_query(
    "fn_json",
    """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.missing') AS missing, to_json(named_struct('id', event_id, 'kind', event_type)) AS packed,
  size(json_object_keys(props)) AS keys FROM events""",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, CAST(to_json({'id': event_id, 'kind': event_type}) AS VARCHAR) AS packed,
  len(json_keys(props)) AS keys FROM events""",
)


@query("fn_variant", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS wrong_type, event_type AS kind, event_id % 3 AS second, CAST(NULL AS VARCHAR) AS missing,
  'OBJECT<items: ARRAY<BIGINT>, kind: STRING, props: OBJECT<k: BIGINT>>' AS shape FROM events""")
def fn_variant(spark, sf):
    """Nested values stored as VARIANT in Parquet: paths, wrong types, missing fields and the schema of all rows."""
    nested = F.concat(
        F.lit('{"kind":"'), "event_type", F.lit('","props":'), "props", F.lit(',"items":['), F.col("event_id").cast("string"), F.lit(","),
        (F.col("event_id") % 3).cast("string"), F.lit("]}"),
    )
    stored = materialize(table(spark, sf, "events").select("event_id", F.parse_json(nested).alias("v")), "variants")
    shape = stored.select(F.schema_of_variant_agg("v").alias("shape")).scalar()
    return stored.select(
        "event_id", F.variant_get("v", "$.props.k", "bigint").alias("k"), F.try_variant_get("v", "$.kind", "bigint").alias("wrong_type"),
        F.variant_get("v", "$.kind", "string").alias("kind"), F.variant_get("v", "$.items[1]", "bigint").alias("second"),
        F.try_variant_get("v", "$.none", "string").alias("missing"), shape.alias("shape"),
    )


@query("fn_array_map", """
SELECT doc_id, list_sum(list_transform(ws, lambda w: length(w))) AS letters, len(list_filter(ws, lambda w: length(w) > 6)) AS long_words, list_contains(ws, 'the') AS has_the,
  ws[1] AS first_word, len(list_distinct(ws)) AS vocabulary FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents)""")
def fn_array_map(spark, sf):
    ws = F.col("ws")
    rows = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws"))
    letters = F.aggregate(F.transform(ws, F.length), F.lit(0), lambda a, n: a + n)
    return rows.select(
        "doc_id", F.when(F.size(ws) > 0, letters).alias("letters"), F.size(F.filter(ws, lambda w: F.length(w) > 6)).alias("long_words"),
        F.array_contains(ws, "the").alias("has_the"), F.get(ws, F.lit(0)).alias("first_word"), F.size(F.array_distinct(ws)).alias("vocabulary"),
    )


sql_query(
    "fn_hash",
    "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, substr(sha2(c_name, 256), 1, 16) AS short FROM customer",
    "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, substr(sha256(c_name), 1, 16) AS short FROM customer",
)
