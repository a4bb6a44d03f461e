"""Knowledge base build: scan a folder, chunk, embed, write JSON lines, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import DIMENSIONS, MODEL_NAME
from ..operators import chunking, embedding
from .files import read_corpus

SIZE, OVERLAP = 500, 50


@dataclass(frozen=True)
class KnowledgeBase:
    path: str
    entries: DataFrame

    def summary(self) -> DataFrame:
        return self.entries.agg(
            F.count_distinct("source").alias("total_docs"),
            F.count("*").alias("total_chunks"),
            F.lit(DIMENSIONS).alias("embedding_dim"),
            F.lit(MODEL_NAME).alias("embedding_model"),
        )


ENTRY_SCHEMA = (
    "source string, chunk_id int, content string, char_count int, embedding array<double>, embedding_model string"
)


def build(spark: SparkSession, base: str, out: str, strategy: str = "token", size: int = SIZE,
          overlap: int = OVERLAP, pattern: str = "*.md") -> KnowledgeBase:
    """Embed every Markdown file below ``base`` into JSON lines at ``out``."""
    pieces = chunking.chunk_documents(read_corpus(spark, base, pattern), "text", ["source"], size, overlap, strategy)
    rows = embedding.embed_rows(pieces).select(
        "source", F.col("idx").alias("chunk_id"), F.col("text").alias("content"), "char_count", "embedding",
        F.col("model").alias("embedding_model"),
    )
    rows.write.mode("errorifexists").json(out)
    return KnowledgeBase(out, spark.read.schema(ENTRY_SCHEMA).json(out))
