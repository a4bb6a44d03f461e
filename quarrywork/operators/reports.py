"""Usage, cost, agent, sandbox and quality reports over telemetry tables.

The separate counters of a dashboard become conditional aggregates over a single scan of each
table; totals and groups of one table come from grouping sets. ``as_of`` stands for "now".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import exact_avg, exact_sum, half_up, human_bytes, percent
from .topn import top_n_per_group


def _day(as_of: Column) -> Column:
    return F.to_date(as_of)


def _since_week(created_at: Column, as_of: Column) -> Column:
    return F.to_date(created_at) >= F.date_sub(_day(as_of), 7)


# -- usage --------------------------------------------------------------------------------


def usage_totals(conversions: DataFrame, as_of: Column) -> DataFrame:
    day = F.to_date("created_at")
    return conversions.agg(
        F.count("*").alias("total_conversions"),
        F.count_if(day == _day(as_of)).alias("today_conversions"),
        F.count_if(_since_week(F.col("created_at"), as_of)).alias("week_conversions"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        F.count_distinct("ip_hash").alias("unique_users"),
    )


def usage_summary(conversions: DataFrame, errors: DataFrame, security: DataFrame, capacity: DataFrame, as_of: Column) -> DataFrame:
    """One row: totals, today, this week, bytes, users, errors, security and capacity counters."""
    failures = errors.agg(F.count("*").alias("errors"))
    guards = security.agg(
        F.count_if(F.col("event_type") == "rate_limit").alias("rate_limit_hits"),
        F.count_if(F.col("event_type").startswith("blocked:")).alias("blocked_requests"),
    )
    full = capacity.agg(F.count("*").alias("capacity_exceeded"))
    row = one_row(usage_totals(conversions, as_of), failures, guards, full)
    return row.select(
        "*",
        human_bytes(F.col("total_bytes")).alias("total_data_processed"),
        half_up(
            F.col("errors").cast("double") / F.greatest(F.col("total_conversions"), F.lit(1)) * 100, 1
        ).alias("error_rate_percent"),
    )


def one_row(*reports: DataFrame) -> DataFrame:
    """Put one-row reports side by side: union the rows, then keep each column's only value."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    return stacked.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in stacked.columns])


def with_overall(rows: DataFrame, overall: DataFrame) -> DataFrame:
    """Repeat the columns of a one-row report on every row, through a scalar subquery."""
    packed = overall.select(F.struct(*overall.columns).alias("_all")).scalar()
    return rows.withColumn("_all", packed).select(*rows.columns, "_all.*")


def grouped_with_overall(df: DataFrame, key: str, by_key: dict[str, Column], overall: dict[str, Column]) -> DataFrame:
    """Aggregates per key with those of all rows on each of them, from one scan (grouping sets).

    The window that brings the overall row to the others sees one row per key.
    """
    both = df.groupingSets([[key], []], key).agg(
        F.grouping(key).alias("_all"), *[c.alias(n) for n, c in by_key.items()],
        F.struct(*[c.alias(n) for n, c in overall.items()]).alias("_overall"),
    )
    total = F.any_value(F.when(F.col("_all") == 1, F.col("_overall")), F.lit(True)).over(Window.partitionBy())
    rows = both.withColumn("_overall", total).filter(F.col("_all") == 0)
    return rows.select(key, *by_key, *[F.col(f"_overall.{n}").alias(n) for n in overall])


def count_by(df: DataFrame, key: Column | str, name: str) -> DataFrame:
    col = F.col(key) if isinstance(key, str) else key
    return df.groupBy(col.alias(name)).agg(F.count("*").alias("cnt"))


def by_day(df: DataFrame, as_of: Column) -> DataFrame:
    recent = df.filter(_since_week(F.col("created_at"), as_of))
    return count_by(recent, F.date_format("created_at", "yyyy-MM-dd"), "day")


def by_hour(df: DataFrame) -> DataFrame:
    return count_by(df, F.date_format("created_at", "HH"), "hour")


def last_event(df: DataFrame) -> DataFrame:
    return df.agg(
        F.date_format(F.max_by("created_at", "id"), "yyyy-MM-dd HH:mm:ss").alias("last_conversion"),
        F.max("id").alias("last_id"),
    )


def recent_rows(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.col("id").desc()).limit(n)


def errors_by_type(errors: DataFrame) -> DataFrame:
    return count_by(errors, F.coalesce("error_type", F.lit("unknown")), "error_type")


def feature_usage(features: dict[str, DataFrame], chunk_feature: str = "chunk") -> DataFrame:
    """Requests per feature table plus the chunks generated.

    Each table is counted before the union, so only one row per feature moves.
    """
    parts = []
    for name, df in features.items():
        chunks = F.coalesce(F.sum("chunks_generated"), F.lit(0)) if name == chunk_feature else F.lit(0)
        parts.append(
            df.agg(F.count("*").alias("requests"), chunks.cast("bigint").alias("total_chunks"))
            .select(F.lit(name).alias("feature"), "requests", "total_chunks")
        )
    return reduce(DataFrame.unionByName, parts)


def top_types_brief(conversions: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    """The most used types with the overall size and success figures on each row."""
    size = F.coalesce(F.sum("file_size"), F.lit(0))
    mean = half_up(exact_avg(F.when(F.col("file_size") > 0, F.col("file_size")), 0) / 1024, 2)
    rows = grouped_with_overall(conversions, "file_type", {"cnt": F.count("*")}, {
        "total_conversions": F.count("*"),
        "today_conversions": F.count_if(F.to_date("created_at") == _day(as_of)),
        "total_bytes_processed": size,
        "total_mb_processed": half_up(size / F.lit(1024 * 1024), 2),
        "avg_file_size_kb": F.coalesce(mean, F.lit(0.0)),
        "success_rate": F.when(F.count("*") > 0, F.lit(100.0)).otherwise(F.lit(0.0)),
    })
    return rows.orderBy(F.col("cnt").desc(), "file_type").limit(n)


# -- cost ---------------------------------------------------------------------------------


def cost_totals(llm: DataFrame, as_of: Column) -> DataFrame:
    today = F.to_date("created_at") == _day(as_of)
    return llm.agg(
        F.count("*").alias("total_requests"),
        half_up(exact_sum(F.col("actual_cost"), 9), 6).alias("total_cost"),
        half_up(exact_sum(F.col("gpt4_cost"), 9), 6).alias("total_baseline_cost"),
        half_up(exact_sum(F.col("savings"), 9), 6).alias("total_savings"),
        half_up(F.coalesce(exact_avg(F.col("savings_percent"), 2), F.lit(0.0)), 2).alias("avg_savings_percent"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
        half_up(exact_sum(F.when(today, F.col("savings")), 9), 6).alias("today_savings"),
    )


def cost_by_model(llm: DataFrame) -> DataFrame:
    return llm.groupBy("model").agg(
        F.count("*").alias("requests"),
        half_up(exact_sum(F.col("actual_cost"), 9), 6).alias("cost"),
        half_up(exact_sum(F.col("savings"), 9), 6).alias("savings"),
        half_up(exact_avg(F.col("savings_percent"), 2), 2).alias("avg_savings_percent"),
    )


def cost_by_day(llm: DataFrame, as_of: Column) -> DataFrame:
    return (
        llm.filter(_since_week(F.col("created_at"), as_of))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"))
        .agg(
            half_up(exact_sum(F.col("actual_cost"), 9), 6).alias("cost"),
            half_up(exact_sum(F.col("savings"), 9), 6).alias("savings"),
        )
    )


# -- agents -------------------------------------------------------------------------------


def _agent_totals(as_of: Column) -> dict[str, Column]:
    won = F.col("success") == 1
    return {
        "total_executions": F.count("*"),
        "successful_executions": F.count_if(won),
        "success_rate": percent(F.count_if(won), F.count("*"), 1, 100.0),
        "total_cost": half_up(exact_sum(F.col("actual_cost"), 9), 6),
        "total_savings": half_up(exact_sum(F.col("savings"), 9), 6),
        "avg_savings_percent": half_up(F.coalesce(exact_avg(F.col("savings_percent"), 2), F.lit(0.0)), 2),
        "avg_latency_ms": F.floor(F.coalesce(exact_avg(F.col("total_latency_ms"), 0), F.lit(0.0))),
        "avg_quality_score": half_up(F.coalesce(exact_avg(F.col("quality_score"), 2), F.lit(0.0)), 1),
        "avg_findings": half_up(F.coalesce(exact_avg(F.when(won, F.col("findings_count")), 0), F.lit(0.0)), 1),
        "today_executions": F.count_if(F.to_date("created_at") == _day(as_of)),
    }


def agent_totals(agents: DataFrame, as_of: Column) -> DataFrame:
    return agents.agg(*[c.alias(n) for n, c in _agent_totals(as_of).items()])


def agent_stats(agents: DataFrame, as_of: Column) -> DataFrame:
    """Per agent type, with the overall figures repeated on each row."""
    overall = _agent_totals(as_of)
    overall["avg_latency_ms_overall"] = overall.pop("avg_latency_ms")
    return grouped_with_overall(agents, "agent_type", {
        "executions": F.count("*"),
        "savings": half_up(exact_sum(F.col("savings"), 9), 6),
        "avg_latency_ms": F.floor(exact_avg(F.col("total_latency_ms"), 0)),
    }, overall)


# -- sandbox ------------------------------------------------------------------------------

SQLITE_TYPES = (".sqlite", ".db", ".sqlite3")
SHEET_TYPES = (".csv", ".xlsx")


def sandbox_stats(requests: DataFrame, as_of: Column) -> DataFrame:
    upload = F.col("request_type") == "upload"
    query = F.col("request_type") == "query"
    queries = F.count_if(query)
    return requests.agg(
        F.count_distinct("ip_hash").alias("sessions"),
        F.count_if(upload).alias("files_ingested"),
        queries.alias("queries_executed"),
        F.count_if(query & (F.col("success") == 0)).alias("failed_queries"),
        F.count_if(upload & F.col("file_type").isin(*SQLITE_TYPES)).alias("sqlite_files"),
        F.count_if(upload & (F.col("file_type") == ".sql")).alias("dump_files"),
        F.count_if(upload & F.col("file_type").isin(*SHEET_TYPES)).alias("spreadsheet_files"),
        percent(F.count_if(query & (F.col("success") == 1)), queries, 1).alias("success_rate"),
        half_up(
            F.coalesce(exact_avg(F.when(query, F.col("query_latency_ms")), 0), F.lit(0.0)), 1
        ).alias("avg_latency_ms"),
        F.count_if(F.to_date("created_at") == _day(as_of)).alias("today_requests"),
    )


# -- quality ------------------------------------------------------------------------------

QUALITY_DIMENSIONS = ("relevance", "accuracy", "helpfulness", "safety", "completeness")


def _quality_totals(as_of: Column) -> dict[str, Column]:
    def mean(name: str) -> Column:
        return half_up(F.coalesce(exact_avg(F.col(name)), F.lit(0.0)), 2)

    today = F.to_date("created_at") == _day(as_of)
    return {
        "total_evaluations": F.count("*"),
        "avg_overall_score": mean("overall_score"),
        "passed_count": F.coalesce(F.sum("passed_threshold"), F.lit(0)),
        "pass_rate": percent(F.sum("passed_threshold"), F.count("*"), 1, 0.0),
        **{f"avg_{d}": mean(f"{d}_score") for d in QUALITY_DIMENSIONS},
        "total_eval_cost": half_up(exact_sum(F.col("eval_cost")), 6),
        "today_evaluations": F.count_if(today),
        "today_avg_score": half_up(F.coalesce(exact_avg(F.when(today, F.col("overall_score"))), F.lit(0.0)), 2),
    }


def quality_totals(evaluations: DataFrame, as_of: Column) -> DataFrame:
    return evaluations.agg(*[c.alias(n) for n, c in _quality_totals(as_of).items()])


def quality_stats(evaluations: DataFrame, as_of: Column) -> DataFrame:
    """Per response type, with the overall figures repeated on each row."""
    return grouped_with_overall(evaluations, "response_type", {
        "evaluations": F.count("*"),
        "avg_score": half_up(exact_avg(F.col("overall_score")), 2),
        "pass_rate_percent": percent(F.sum("passed_threshold"), F.count("*"), 1, 0.0),
    }, _quality_totals(as_of))


# -- everything at once -------------------------------------------------------------------


def api_rollup(
    conversions: DataFrame,
    errors: DataFrame,
    security: DataFrame,
    capacity: DataFrame,
    requests: DataFrame,
    llm: DataFrame,
    agents: DataFrame,
    evaluations: DataFrame,
    as_of: Column,
    started_at: Column,
) -> DataFrame:
    """All reports nested in one record; every part is aggregated before it is combined."""

    def nested(report: DataFrame, name: str) -> DataFrame:
        return report.select(F.struct(*report.columns).alias(name))

    def listed(counts: DataFrame, name: str) -> DataFrame:
        # one entry per type, day or hour: as many as there are kinds, not rows
        key = counts.columns[0]
        return counts.agg(F.map_from_entries(F.collect_list(F.struct(key, "cnt"))).alias(name))

    recent = recent_rows(security.select("id", "event_type", "ip_hash", "created_at"))
    parts = one_row(
        nested(usage_summary(conversions, errors, security, capacity, as_of), "usage"),
        listed(count_by(conversions, "file_type", "file_type"), "popular_formats"),
        listed(by_day(conversions, as_of), "conversions_by_day"),
        listed(by_hour(conversions), "conversions_by_hour"),
        listed(errors_by_type(errors), "errors_by_type"),
        last_event(conversions).select("last_conversion"),
        recent.agg(F.sort_array(F.collect_list(F.struct("id", "event_type", "ip_hash")), asc=False).alias("recent_security_events")),
        nested(sandbox_stats(requests, as_of), "sql_sandbox"),
        nested(cost_totals(llm, as_of), "cost_tracking"),
        nested(agent_totals(agents, as_of), "agent_workflows"),
        nested(quality_totals(evaluations, as_of), "response_quality"),
    )
    uptime = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(started_at.cast("timestamp"))
    return parts.select(F.lit("operational").alias("status"), uptime.alias("uptime_seconds"), "*")


def contact_list(contacts: DataFrame, n: int | None = None) -> DataFrame:
    ordered = contacts.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered if n is None else ordered.limit(n)


def memory_status(items: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum(F.length("content")), F.lit(0))
    return items.agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count("*").alias("total_items"),
        size.alias("total_size_chars"),
        half_up(size.cast("double") / (1024 * 1024), 2).alias("total_size_mb"),
    )


def retain_last(metrics: DataFrame, keys: list[str], order: list[Column], n: int = 1000) -> DataFrame:
    """The newest ``n`` metric rows of each key."""
    return top_n_per_group(metrics, keys, order, n)
