"""Keywords of each document by frequency and by TF-IDF over its sentences.

A document's rows are laid out together once, by its key and in shares of some megabytes of text
(:func:`..session.lay_out`), before the text is cut into words. Every later grouping and window includes that
key, so Spark adds no further exchange. TF-IDF counts the documents of a batch together, without a row per term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed import KEYWORD_STOP_WORDS
from ..functions.numbers import half_up
from ..functions.scan import classes, portions, unpacked
from ..functions.terms import best_terms, has_words, most_used
from ..session import lay_out, small_batches

WORD = r"(?U)\w+"
#: Texts of fewer words have no keywords.
FEW_WORDS = 5
FOUND = "array<struct<rank_in_doc: int, keyword: string, score: double>>"

Found = dict[int, list[tuple[str, float]]]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list]]:
    """Batches, sorted by their first column, that end with the last row of a key; and their keys."""
    held: list[pa.RecordBatch] = []
    keys: list = []
    for batch in batches:
        own = batch.column(0).to_pylist()
        last = len(own)
        while last and own[last - 1] == own[-1]:
            last -= 1
        if last or (keys and own and own[0] != keys[-1]):
            yield [*held, batch.slice(0, last)], [*keys, *own[:last]]
            held, keys = [], []
        held.append(batch.slice(last))
        keys += own[last:]
    if keys:
        yield held, keys


def _found_by_key(docs: DataFrame, key: str, text: str, into: str | None, every: bool, find: Callable[[list[str], np.ndarray], tuple[Found, list[bool]]]) -> DataFrame:
    """``docs`` with the keywords of each key's texts in ``into``, NULL where there are none.

    Rows of a key have to be in one partition. ``find`` takes texts and the numbers of their keys; it returns the keywords by
    number, and for each text whether it is done: others stay in ``text``, which is blanked else. With ``every`` each row of a
    key has its keywords and rows without a key have none, else the first row of a key has them. Without ``into`` a row per keyword.
    """
    others = [c for c in docs.columns if c not in (key, text)] if into else []
    rows = docs.select(key, text, *others)
    schema = rows.withColumn(into, F.lit(None).cast(FOUND)).schema if into else rows.select(key, F.inline(F.lit(None).cast(FOUND))).schema
    kind = pa.list_(pa.struct([("rank_in_doc", pa.int32()), ("keyword", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, keys in _whole(batches):
            number = np.cumsum([i > 0 and k != keys[i - 1] for i, k in enumerate(keys)])
            texts = [t for part in parts for t in part.column(1).to_pylist()]
            given = [i for i, t in enumerate(texts) if t is not None and not (every and keys[i] is None)]
            found, done = find([texts[i] for i in given], number[given])
            if into is None:
                firsts = {int(g): i for i, g in reversed(list(enumerate(number)))}
                column = pa.chunked_array([part.column(0) for part in parts])
                ranked = [(firsts[g], i, w, s) for g, best in sorted(found.items()) for i, (w, s) in enumerate(best, 1)]
                at, ranks, words, scores = zip(*ranked) if ranked else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [column.take(pa.array(at, pa.int64())).combine_chunks(), pa.array(ranks, pa.int32()), pa.array(words, pa.string()), pa.array(scores, pa.float64())],
                    names=[key, "rank_in_doc", "keyword", "score"],
                )
                continue
            for i, over in zip(given, done):
                texts[i] = None if over else texts[i]
            lists = {g: [{"rank_in_doc": i, "keyword": w, "score": s} for i, (w, s) in enumerate(best, 1)] for g, best in found.items()}
            row = 0
            for part in parts:
                at = range(row, row := row + part.num_rows)
                held = [lists.get(int(number[i])) if every or i == 0 or keys[i] != keys[i - 1] else None for i in at]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([texts[i] for i in at], pa.string()), *part.columns[2:], pa.array(held, kind)],
                    names=[key, text, *others, into],
                )

    small_batches(docs.sparkSession)
    return rows.sortWithinPartitions(key).mapInArrow(run, schema)


def _rounded(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "keyword", half_up(F.col("score"), 4).alias("score"), "rank_in_doc")


def keywords_by_frequency(
    docs: DataFrame, key: str, text: str, top_n: int = 10, laid_out: bool = False, into: str | None = None, every: bool = True,
) -> DataFrame:
    """Most used words of three or more ASCII letters, with their share of all such words.

    With ``into`` no row per word: ``docs`` with a column of the keywords, not rounded yet, for texts few of which are long.
    """
    docs = docs if laid_out else lay_out(docs, key, text)
    if into is not None:
        packed, stop = classes(), frozenset(KEYWORD_STOP_WORDS)

        def find(texts: list[str], groups: np.ndarray) -> tuple[Found, list[bool]]:
            table, own = unpacked(packed), {}
            for g, t in zip(groups.tolist(), texts):
                own.setdefault(g, []).append(t)
            best = {g: most_used(some, stop, top_n, table) for g, some in own.items()}
            return {g: b for g, b in best.items() if b}, [True] * len(texts)

        return _found_by_key(docs, key, text, into, every, find)
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    kept = F.filter(tokens, lambda w: F.rlike(w, F.lit("^[a-z]{3,}$")) & ~w.isin(*KEYWORD_STOP_WORDS))
    words = docs.select(key, F.explode_outer(kept).alias("word")).filter(F.col("word").isNotNull())
    counts = words.groupBy(key, "word").agg(F.count("*").alias("uses"))
    doc = Window.partitionBy(key)
    best = doc.orderBy(F.col("uses").desc(), "word")
    return (
        counts.withColumn("total", F.sum("uses").over(doc))
        .withColumn("rank_in_doc", F.row_number().over(best))
        .filter(F.col("rank_in_doc") <= top_n)
        .select(
            key, F.col("word").alias("keyword"), "uses",
            half_up(F.col("uses").cast("double") / F.col("total"), 4).alias("score"), "rank_in_doc",
        )
    )


def extract_keywords(
    docs: DataFrame, key: str, text: str, top_n: int = 10, laid_out: bool = False, into: str | None = None,
) -> DataFrame:
    """TF-IDF keywords, by frequency where a text has fewer than two sentences.

    Texts of fewer than five words have none. With ``into`` all rows of ``docs`` with a column of their key's keywords in
    order, NULL where there are none or no key.
    """
    shared = docs if laid_out else lay_out(docs, key, text)
    if into is None:
        shared = shared.select(key, text)
    kept = [c for c in shared.columns if c != into]
    every = into is not None
    # a text that TF-IDF is not for stays in its column, the others are blanked there
    first = keywords_by_tfidf(shared.withColumn("_text", F.col(text)), key, "_text", top_n, laid_out=True, into="_by_tfidf", every=every, least=FEW_WORDS)
    both = keywords_by_frequency(first, key, "_text", top_n, laid_out=True, into="_by_frequency", every=every)
    if into is None:
        rows = both.select(key, F.explode(F.array("_by_tfidf", "_by_frequency")).alias("_found"))
        return _rounded(rows.select(key, F.inline("_found")), key)
    none = F.array().cast(FOUND)
    listed = F.concat(F.coalesce("_by_tfidf", none), F.coalesce("_by_frequency", none))
    rounded = F.transform(listed, lambda k: F.struct(k["rank_in_doc"].alias("rank_in_doc"), k["keyword"].alias("keyword"), half_up(k["score"], 4).alias("score")))
    return both.select(*kept, F.when(F.coalesce("_by_tfidf", "_by_frequency").isNotNull(), F.array_sort(rounded)).alias(into))


def keywords_by_tfidf(
    docs: DataFrame, key: str, text: str, top_n: int = 10, max_features: int = 100, max_df: float = 0.9,
    laid_out: bool = False, into: str | None = None, every: bool = True, least: int = 0,
) -> DataFrame:
    """Mean TF-IDF of one- and two-word terms, each sentence taken as a document.

    Sentences of ten or fewer characters are dropped; documents with fewer than two
    sentences give no rows. Terms in more than ``max_df`` of the sentences are dropped,
    the ``max_features`` most used remain, idf is ``ln((1+n)/(1+df)) + 1`` and each
    sentence vector has unit length. Texts of fewer than ``least`` words are left out.

    With ``into`` no row per term: ``docs`` with a column of the keywords, not rounded yet, and in ``text`` only the texts of
    ``least`` words or more with fewer than two sentences.
    """
    docs = docs if laid_out else lay_out(docs, key, text)
    packed, stop = classes(), frozenset(KEYWORD_STOP_WORDS)

    def find(texts: list[str], groups: np.ndarray) -> tuple[Found, list[bool]]:
        table = unpacked(packed)
        enough = [i for i, t in enumerate(texts) if not least or has_words(t, least)]
        done, found = [True] * len(texts), {}
        for at in portions([texts[i] for i in enough], groups[enough]):
            some = enough[at]
            best, n_sentences = best_terms([texts[i] for i in some], groups[some], stop, top_n, max_features, max_df, table)
            found |= best
            for i, n in zip(some, n_sentences):
                done[i] = bool(n >= 2)
        return found, done

    if into is not None:
        return _found_by_key(docs, key, text, into, every, find)
    return _rounded(_found_by_key(docs, key, text, None, False, find), key)
