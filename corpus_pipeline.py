"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrywork.llm import byte_cnn, toxic_passages
from quarrywork.llm.common import fold
from quarrywork.llm.exact_dedup import keep_one_copy
from quarrywork.llm.packing import pack
from quarrywork.llm.simhash import keep_one_of_near_copies
from quarrywork.session import materialize, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language cannot be told."""
    return byte_cnn.keep_known(docs, byte_cnn.learn(docs, fold("doc_id", 3) != 1))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic."""
    return toxic_passages.keep_harmless(docs, toxic_passages.learn(docs, table(spark, sf_dir, "labels"), fold("key", 5) != 0))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return keep_one_copy(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that 64-bit fingerprints of four-word shingles link at 4 bits or fewer, the smallest doc_id stays."""
    return keep_one_of_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack(docs, TOKENIZER, END_ID)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("packing", packing),
]

#: Tokenizer, network and fingerprints have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
