"""Request-level expressions: client address, fingerprints, bots, intents, SQL safety."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed

ADDRESS_PATTERN = r"^[\d.:a-fA-F]+$"


def client_ip(forwarded: Column, real_ip: Column, edge_ip: Column, remote: Column) -> Column:
    """First forwarded address, else the proxy headers, else the peer; ``invalid`` unless it looks like one."""
    def filled(col: Column) -> Column:
        return F.nullif(col, F.lit(""))

    first = F.trim(F.split_part(filled(forwarded), F.lit(","), F.lit(1)))
    ip = F.coalesce(first, filled(real_ip), filled(edge_ip), filled(remote), F.lit("unknown"))
    return F.when(F.rlike(ip, F.lit(ADDRESS_PATTERN)), ip).otherwise("invalid")


def request_fingerprint(agent: Column, language: Column, encoding: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (agent, language, encoding)]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def is_bot(honeypot: Column) -> Column:
    return F.coalesce(honeypot, F.lit("")) != ""


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(n)) for n in needles])


def is_stats_question(text: Column) -> Column:
    return contains_any(text, fixed.STATS_KEYWORDS)


def wants_search(mission: Column) -> Column:
    return contains_any(mission, fixed.SEARCH_TRIGGERS)


def first_match(text: Column, answers: tuple[tuple[str, str], ...]) -> Column:
    """Answer of the first key, in declared order, that the text contains."""
    lower = F.lower(text)
    return reduce(
        lambda acc, kv: acc.when(F.contains(lower, F.lit(kv[0])), kv[1]), answers[1:],
        F.when(F.contains(lower, F.lit(answers[0][0])), answers[0][1]),
    )


# -- SQL text -----------------------------------------------------------------------------


# a WITH opens the query only when a named subquery follows it
QUERY_START = r"(?is)\b(WITH\s+\w+\s*(?:\([^)]*\)\s*)?AS\s*\(.*|SELECT\b.*)"


def clean_sql(sql: Column) -> Column:
    """Drop code fences and any text before the first SELECT or WITH, and closing semicolons."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"```sql\s*", ""), r"```\s*", "")
    trimmed = F.regexp_replace(bare, r"(?U)^\s+|\s+\z", "")
    start = F.regexp_extract(trimmed, QUERY_START, 1)
    return F.regexp_replace(F.when(start != "", start).otherwise(trimmed), r";+\z", "")


OPENS_QUERY = r"^\s*(SELECT|WITH)\b"

# Suspicious text and the verdict on it, in checking order.
SUSPICIOUS = (
    (r"--", "SQL comments not allowed"),
    (r"/\*", "Block comments not allowed"),
    (r";\s*\w", "Multiple statements not allowed"),
    (r"LOAD_EXTENSION", "Extension loading not allowed"),
)


# What would let a SELECT of Spark's dialect leave the tables: static Java methods, programs, files by path, names made at run time.
UNSAFE = (
    (r"\b(JAVA_METHOD|REFLECT|TRY_REFLECT)\b", "Reflection calls not allowed"),
    (r"\bUSING\s*['\"]", "Script transformations not allowed"),
    (r"\bIDENTIFIER\s*\(", "Names made at run time not allowed"),
    (r"`?\s*\.\s*`[^`]*[/\\:*]", "Files by path not allowed"),
    (r"\b(AVRO|BINARYFILE|CSV|DELTA|IMAGE|JDBC|JSON|LIBSVM|ORC|PARQUET|TEXT|XML)`?\s*\.\s*`", "Files by path not allowed"),
)


def guard_text(sql: str) -> str | None:
    """:func:`guard_sql` for one statement, without a job."""
    upper = sql.upper()
    if not sql:
        return "Empty SQL query"
    for keyword in fixed.BLOCKED_KEYWORDS:
        if re.search(rf"\b{keyword}\b", upper):
            return f"Blocked operation: {keyword} is not allowed"
    if not re.search(OPENS_QUERY, upper):
        return "Only SELECT queries are allowed"
    return next((message for pattern, message in (*SUSPICIOUS, *UNSAFE) if re.search(pattern, upper)), None)


def clean_text(sql: str) -> str:
    """:func:`clean_sql` for one statement, without a job."""
    bare = re.sub(r"```\s*", "", re.sub(r"```sql\s*", "", sql)).strip()
    start = re.search(QUERY_START, bare)
    return re.sub(r";+\Z", "", start[1] if start else bare)


def guard_sql(sql: Column) -> Column:
    """Why a statement is refused, or NULL when it may run.

    Read-only queries start with SELECT or WITH; the keyword check also fires inside
    literals, on purpose.
    """
    def judged(upper: Column) -> Column:
        verdict = F.when(upper == "", "Empty SQL query")
        for keyword in fixed.BLOCKED_KEYWORDS:
            # the search for the bare word is cheap and mostly enough
            named = F.contains(upper, F.lit(keyword)) & F.rlike(upper, F.lit(rf"(?U)\b{keyword}\b"))
            verdict = verdict.when(named, f"Blocked operation: {keyword} is not allowed")
        verdict = verdict.when(~F.rlike(upper, F.lit("(?U)" + OPENS_QUERY)), "Only SELECT queries are allowed")
        for pattern, message in (*SUSPICIOUS, *UNSAFE):
            verdict = verdict.when(F.rlike(upper, F.lit("(?U)" + pattern)), message)
        return verdict

    return judged(F.upper(F.coalesce(sql, F.lit(""))))
