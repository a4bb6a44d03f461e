"""Whole-document jobs: cleaning with an output form, and preparation for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.markdown import clean_text
from . import analysis, chunking, embedding, sections

PREVIEW = 5000


def clean_documents(
    docs: DataFrame, key: str, name: str, text: str, macros: bool = False, metadata: bool = False,
    emails: bool = False, output: str = "markdown",
) -> DataFrame:
    """The chosen cleaners in their fixed order, then markdown, text, json or xml in ``content``.

    An unknown output form gives markdown.
    """
    row_wise = "text" if output == "text" else "markdown"
    cleaned = docs.select(key, name, clean_text(F.col(text), macros, metadata, emails, row_wise).alias("content"))
    if output == "json":
        return sections.md_to_json(cleaned, key, name, "content").select(key, F.col("json").alias("content"))
    if output == "xml":
        return sections.md_to_xml(cleaned, key, name, "content").select(key, F.col("xml").alias("content"))
    return cleaned.select(key, "content")


def prepare(
    docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50, strategy: str = "recursive_character",
    export: str = "jsonl", collection: str = "documents", include_analysis: bool = False,
) -> DataFrame:
    """Chunk, embed and export every document, one row each: text preview, chunk count, export rows.

    ``export`` is ``jsonl`` (lines), ``arrays`` (parallel arrays per collection) or
    ``records`` (one record with a vector per chunk). Everything of one document is
    gathered in its row, which is bounded by the document; nothing is gathered beyond it.
    """
    pieces = embedding.embed_rows(chunking.chunk_documents(docs.select(key, text), text, [key], size, overlap, strategy))
    if export == "arrays":
        batches = embedding.vector_batches(pieces.withColumn("collection", F.lit(collection)), "collection", key)
        exported = batches.select(key, F.size("ids").alias("chunks_count"),
                                  F.struct("collection", "ids", "embeddings", "documents", "metadatas").alias("export"))
    else:
        fields = embedding.vector_record() if export == "records" else [embedding.jsonl_value(True).alias("value")]
        exported = pieces.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("idx", *fields))).alias("export")
        ).withColumn("chunks_count", F.size("export"))
    body = F.col(text)
    preview = F.when(F.length(body) > PREVIEW, F.concat(F.left(body, F.lit(PREVIEW)), F.lit("..."))).otherwise(body)
    heads = docs.select(key, F.length(body).alias("markdown_length"), preview.alias("markdown"))
    result = heads.join(exported, key)
    if include_analysis:
        result = result.join(analysis.analyze_documents(docs, key, text).drop("error"), key)
    return result
