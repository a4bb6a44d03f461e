"""Functions a user can call from SQL.

The text functions are SQL functions: Spark inlines their body, so they cost no
Python and stay inside the optimised plan. ``chunk_document`` is a table function for one text,
``chunk_table`` one for a whole table, batch by batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..session import small_batches
from . import packers
from .markdown import EMAIL_MASK, EMAIL_PATTERN, TEXT_RULES, java_pattern, java_replacement


STRATEGIES = {**packers.STRATEGIES, "fixed_size": packers.cut_fixed, "token": packers.cut_tokens}
WORD = re.compile(r"\S+\s*|\s+")


#: Characters of chunks in a table that goes back to Spark.
MOST_HELD = 2_000_000


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _replaced(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {_quoted(java_pattern(pattern))}, {_quoted(java_replacement(replacement))})"


def _stripped(expr: str) -> str:
    return _replaced(_replaced(expr, r"^\s+", ""), r"\s+\z", "")


def function_bodies() -> dict[str, tuple[str, str]]:
    """Name -> (return type, body over the argument ``t``)."""
    text = "t"
    for pattern, replacement in TEXT_RULES:
        text = _replaced(text, pattern, replacement)
    lines = f"array_join(transform(split({text}, '\\n'), x -> {_stripped('x')}), '\\n')"
    return {
        "token_count": ("INT", "CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(t) / 4) AS INT)) END"),
        "redact_emails": ("STRING", _replaced("t", EMAIL_PATTERN, EMAIL_MASK)),
        "md_to_text": ("STRING", _stripped(lines)),
        "text_hash": ("STRING", "substr(md5(t), 1, 12)"),
    }


def chunks_of(text: str | None, size: int, overlap: int, strategy: str) -> Iterator[tuple]:
    """idx, text, token_count, char_count, start_char, end_char of each chunk; sizes are kept within their limits."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
    if text is None or not text.strip():
        return
    size = max(64, min(size, 8192))
    overlap = max(0, min(overlap, size // 2))
    for i, (body, low, high) in enumerate(STRATEGIES[strategy](text, size, overlap)):
        tokens = len(WORD.findall(body)) if strategy == "token" else packers.estimate(body)
        yield i, body, tokens, len(body), low, high


@udtf(returnType="idx int, text string, token_count int, char_count int, start_char int, end_char int")
class ChunkDocument:
    """``chunk_document(text, size, overlap, strategy)`` for LATERAL joins."""

    def eval(self, text: str, size: int, overlap: int, strategy: str) -> Iterator[tuple]:
        yield from chunks_of(text, size, overlap, strategy)


@arrow_udtf(returnType="key string, idx int, text string, token_count int, char_count int, start_char int, end_char int")
class ChunkTable:
    """``chunk_table(TABLE(...), size, overlap, strategy)``: a table of key and text, batches in and batches out.

    Sizes and strategies are those of ``chunk_document``; ``key`` comes back as text. Null and blank texts give no chunk.
    """

    def eval(self, rows: pa.RecordBatch, size: pa.Array, overlap: pa.Array, strategy: pa.Array) -> Iterator[pa.Table]:
        given = {"size": size[0].as_py(), "overlap": overlap[0].as_py(), "strategy": strategy[0].as_py()}
        kinds = (pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4)
        names = ("key", "idx", "text", "token_count", "char_count", "start_char", "end_char")

        def tabled(found: list[tuple]) -> pa.Table:
            return pa.table([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names=names)

        found, held = [], 0
        for key, text in zip(rows.column(0).cast(pa.string()), rows.column(1)):
            for chunk in chunks_of(text.as_py(), **given):
                found.append((key.as_py(), *chunk))
                held += len(chunk[1])
                if held > MOST_HELD:
                    yield tabled(found)
                    found, held = [], 0
        yield tabled(found)


def register_functions(spark: SparkSession) -> None:
    """The functions by name; ``chunk_table`` gets its rows in small batches from then on."""
    small_batches(spark)
    for name, (returns, body) in function_bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {returns} RETURN {body}")
    spark.udtf.register("chunk_document", ChunkDocument)
    spark.udtf.register("chunk_table", ChunkTable)
