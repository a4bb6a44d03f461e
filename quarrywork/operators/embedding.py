"""Feature vectors for chunks, export forms, and similarity retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.textstats import words
from ..functions.vectors import MODEL_NAME, common_word_codes, cosine, length_codes, norm, text_features, unit
from .topn import top_n_per_group


def embed(df: DataFrame, text: str, name: str = "embedding") -> DataFrame:
    """Add the unit feature vector of a text column; row-wise, built-in expressions only."""
    staged = df.withColumn("_low", F.lower(F.col(text))).withColumn("_words", words(F.col("_low")))
    coded = staged.withColumns({
        "_n": F.size("_words"), "_lengths": length_codes(F.col("_words")),
        "_common": common_word_codes(F.col("_words")), "_digest": F.md5("_low"),
    }).drop("_words")
    parts = ["_low", "_n", "_lengths", "_common", "_digest"]
    raw = coded.withColumn("_raw", text_features(*[F.col(c) for c in parts])).drop(*parts)
    return raw.withColumn(name, unit(F.col("_raw"))).drop("_raw")


def text_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def embed_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with vector, dimensions, model and text hash."""
    return embed(chunks, "text").select(
        "*", F.size("embedding").alias("dimensions"), F.lit(MODEL_NAME).alias("model"),
        text_hash(F.col("text")).alias("text_hash"),
    )


def query_vectors(spark: SparkSession, texts: list[str]) -> Column:
    """Vectors of questions and their norms, in order, as one scalar subquery: computed once, shipped with the plan."""
    asked = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("pos", "text")
    )
    listed = embed(asked, "text").agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("rows"))
    vectors = F.transform("rows", lambda r: F.struct(r["embedding"].alias("embedding"), norm(r["embedding"]).alias("norm")))
    return listed.select(vectors.alias("vectors")).scalar()


def query_vector(spark: SparkSession, text: str) -> Column:
    return query_vectors(spark, [text])[0]["embedding"]


def retrieve_topk(rows: DataFrame, vector: Column, k: int = 3, tie_break: list[str] | None = None) -> DataFrame:
    """The ``k`` rows whose embedding is most similar to ``vector``.

    One scan: each task keeps its own best ``k`` and only those meet at the end.
    """
    scored = rows.withColumn("_query", vector).withColumn(
        "score", cosine(F.col("embedding"), F.col("_query"))
    ).drop("_query")
    return scored.orderBy(F.col("score").desc(), *(tie_break or [])).limit(k)


def same_chunk(text: str, opening: int | None) -> Column:
    """What makes two chunks one: the digest of the whole text, or of its first ``opening`` characters."""
    return F.sha2(F.col(text) if opening is None else F.substring(text, 1, opening), 256)


def retrieve_multi(rows: DataFrame, tasks: list[str], key: list[str], per_task: int = 3, total: int = 10,
                   opening: int | None = None) -> DataFrame:
    """Best chunks of several sub-tasks, without repeating a chunk.

    Each task takes its top ``per_task``; of equal chunks (or, with ``opening``, of chunks that
    begin alike) the earliest task's stays; the best ``total`` remain. Chunks are scored
    against the fixed list of tasks in place, so nothing is cross-joined; only keys, scores and
    digests are ranked, and the texts of the few winners are joined at the end.
    """
    spark = rows.sparkSession
    scored = rows.withColumns({"_asked": query_vectors(spark, tasks), "_norm": norm(F.col("embedding"))}).select(
        *key, same_chunk("text", opening).alias("_same"),
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("task_no"), F.lit(task).alias("matched_task"),
                     cosine(F.col("embedding"), F.col("_asked")[i]["embedding"], F.col("_norm"), F.col("_asked")[i]["norm"]).alias("relevance_score"))
            for i, task in enumerate(tasks)
        ])),
    )
    order = [F.col("relevance_score").desc(), *[F.col(c) for c in key]]
    best = top_n_per_group(scored, ["task_no"], order, per_task, rank_name="_place", spread_on=key)
    # at most len(tasks) * per_task rows remain
    first = best.groupBy("_same").agg(
        F.min_by(F.struct(*best.columns), F.struct("task_no", "_place")).alias("r")
    ).select("r.*").drop("_place", "_same").orderBy(*order).limit(total)
    return first.join(rows.drop("embedding"), key)


def retrieve_fallback(rows: DataFrame, order: list[str], n: int = 15, opening: int | None = None) -> DataFrame:
    """First distinct chunks in order, all with score 1, for when no vectors exist."""
    kept = rows.groupBy(same_chunk("text", opening).alias("_same")).agg(F.min(F.struct(*order)).alias("_first"))
    first = kept.select(*[F.col(f"_first.{c}").alias(c) for c in order]).orderBy(*order).limit(n)
    return first.join(rows, order).withColumn("relevance_score", F.lit(1.0)).withColumn(
        "matched_task", F.lit("full_content")
    )


def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One document per text: the smallest key among exact copies.

    Only fingerprints are grouped, with partial aggregation, so a text copied a
    million times reaches the final task as a few partial minima. The kept rows are
    then found by key, which has no repeats.
    """
    fingerprint = F.md5(F.col(text))
    groups = docs.groupBy(fingerprint.alias("_fp")).agg(
        F.min(key).alias(key), F.count("*").alias("copies")
    )
    return docs.join(groups.select(key, "copies"), key).withColumn("text_hash", text_hash(F.col(text)))


def jsonl_value(include_embeddings: bool = False) -> Column:
    """JSON object of a chunk row."""
    fields = [F.col("idx").alias("id"), F.col("text")]
    if include_embeddings:
        fields.append(F.col("embedding"))
    fields += [
        F.col("token_count").alias("tokens"),
        F.struct(F.col("start_char"), F.col("end_char")).alias("metadata"),
    ]
    return F.to_json(F.struct(*fields))


def jsonl_lines(chunks: DataFrame, include_embeddings: bool = False) -> DataFrame:
    """One JSON object per chunk in a single string column, ready for ``write.text``."""
    return chunks.select(jsonl_value(include_embeddings).alias("value"))


def embedding_records(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """Chunks in the form embedding services take: id, text, token count, position."""
    return chunks.select(
        *keep, F.concat(F.lit("chunk_"), F.col("idx").cast("string")).alias("id"), "text", "token_count",
        F.struct(F.col("idx").alias("index"), F.col("start_char").alias("char_start"),
                 F.col("end_char").alias("char_end")).alias("metadata"),
    )


def vector_record() -> list[Column]:
    """Fields of one record with a ``vector``, from an embedded chunk."""
    return [
        F.concat(F.lit("chunk_"), F.col("idx").cast("string")).alias("id"), F.col("text"),
        F.col("embedding").alias("vector"), F.col("token_count").alias("tokens"), F.col("text_hash"),
    ]


def vector_records(embedded: DataFrame, keep: list[str]) -> DataFrame:
    """One record per chunk with a ``vector`` field."""
    return embedded.select(*keep, *vector_record())


def vector_batches(embedded: DataFrame, collection: str, batch: str) -> DataFrame:
    """Parallel arrays per collection, in batches of one document each.

    A collection has no size bound, so it is never gathered whole: each output row
    holds the arrays of one document of the collection.
    """
    item = F.struct("idx", "text", "embedding", "token_count", "text_hash")
    rows = embedded.groupBy(collection, batch).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select(
        collection, batch,
        F.transform("items", lambda c: F.concat(F.lit("chunk_"), c["idx"].cast("string"))).alias("ids"),
        F.transform("items", lambda c: c["embedding"]).alias("embeddings"),
        F.transform("items", lambda c: c["text"]).alias("documents"),
        F.transform("items", lambda c: F.struct(c["token_count"].alias("tokens"),
                                                  c["text_hash"].alias("text_hash"))).alias("metadatas"),
    )
