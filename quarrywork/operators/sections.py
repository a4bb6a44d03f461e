"""Markdown split into typed sections, and the JSON and XML forms built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.markdown import strip


def _lines(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per trimmed line, numbered inside its document.

    Rows of one document are laid out together once, before the lines are exploded;
    the windows and groupings that follow reuse that partitioning.
    """
    spread = docs.repartition(*[F.col(k) for k in key])
    lines = spread.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    line = strip(F.col("raw"))
    return lines.select(*key, "pos", line.alias("line"))


def _header_level(line: Column) -> Column:
    marks = F.length(line) - F.length(F.ltrim(line, F.lit("#")))
    return F.least(marks, F.lit(6))


def _sectioned(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """Sections in order: a blank line or a header starts a new one."""
    is_header = F.col("line").startswith("#")
    breaks = is_header | (F.col("line") == "")
    order = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = _lines(docs, key, text).withColumn("section", F.sum(breaks.cast("int")).over(order))
    body = F.when(~breaks, F.struct("pos", "line"))
    return numbered.groupBy(*key, "section").agg(
        F.max(F.when(is_header, _header_level(F.col("line")))).alias("level"),
        F.max(F.when(is_header, F.trim(F.ltrim(F.col("line"), F.lit("#"))))).alias("title"),
        F.array_sort(F.collect_list(body)).alias("body"),
    ).select(
        *key, "section", "level", "title",
        F.array_join(F.transform("body", lambda b: b["line"]), "\n").alias("content"),
    )


def md_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections with content as ``(key, section, type, title, content)``."""
    kind = F.when(F.col("level").isNull(), F.lit("paragraph")).otherwise(
        F.concat(F.lit("h"), F.col("level").cast("string"))
    )
    return (
        _sectioned(docs, [key], text)
        .filter(F.col("content") != "")
        .select(key, "section", kind.alias("type"), "title", "content")
    )


def md_to_json(docs: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """One JSON document per input row: file name, sections in order, section count."""
    kind = F.when(F.col("level").isNull(), F.lit("paragraph")).otherwise(
        F.concat(F.lit("h"), F.col("level").cast("string"))
    )
    parts = _sectioned(docs, [key, name], text).filter(F.col("content") != "")
    per_doc = parts.groupBy(key, name).agg(
        F.array_sort(
            F.collect_list(F.struct("section", kind.alias("type"), "title", "content"))
        ).alias("all_sections")
    )
    listed = F.transform("all_sections", lambda s: F.struct(s["type"].alias("type"), s["title"].alias("title"),
                                                            s["content"].alias("content")))
    body = F.struct(F.col(name).alias("filename"), listed.alias("sections"),
                    F.size("all_sections").alias("total_sections"))
    return per_doc.select(key, F.size("all_sections").alias("total_sections"),
                          F.to_json(F.struct(body.alias("document"))).alias("json"))


def _escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def md_to_xml(docs: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """One XML document per input row: headers as ``h1``..``h6``, paragraphs as ``p``."""
    level = F.concat(F.lit("h"), F.col("level").cast("string"))
    header = F.when(
        F.col("level").isNotNull(),
        F.concat(F.lit("    <"), level, F.lit(">"), _escape(F.col("title")), F.lit("</"), level, F.lit(">")),
    )
    paragraph = F.when(
        F.col("content") != "", F.concat(F.lit("    <p>"), _escape(F.col("content")), F.lit("</p>"))
    )
    element = F.concat_ws("\n", header, paragraph)
    parts = _sectioned(docs, [key, name], text).withColumn("element", element).filter(F.col("element") != "")
    per_doc = parts.groupBy(key, name).agg(
        F.array_sort(F.collect_list(F.struct("section", "element"))).alias("elements")
    )
    body = F.array_join(F.transform("elements", lambda e: e["element"]), "\n")
    quoted = F.replace(_escape(F.col(name)), F.lit('"'), F.lit("&quot;"))
    xml = F.concat(F.lit('<document filename="'), quoted, F.lit('">\n  <body>\n'), body, F.lit("\n  </body>\n</document>"))
    return per_doc.select(key, xml.alias("xml"))
