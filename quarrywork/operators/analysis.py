"""Full analysis of a document: statistics, reading time, structure, readability, language, keywords.

The counts of a text are taken a batch at a time by RE2 and NumPy: chains of Java expressions took several hundred
seconds of a core for 100 MB. What is made of the counts stays in expressions, shared with the queries that need a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import markdown as md, textstats as ts
from ..functions.fixed import LANGUAGE_PROFILES
from ..functions.markdown import plain_texts, structure_counts
from ..functions.scan import SPACES, classes, counts, portions, profile_hits, unpacked
from ..session import lay_out, small_batches
from .keywords import extract_keywords

MEASURES = ("words", "characters", "characters_no_spaces", "black", "sentences", "paragraphs", "letters", "vowel_runs", "complex")
PARTS = (*md.STRUCTURE_PATTERNS, "named_images")


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_plain``, ``_blank`` and a column ``_name`` for each count; the counts of a text that is NULL are NULL."""
    packed = classes()
    profiles = LANGUAGE_PROFILES
    names = [*MEASURES, *[f"hits_{code}" for code in profiles]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpacked(packed)
        for batch in batches:
            texts = batch.column(1)
            plain = plain_texts(texts)
            given = [t for t in plain if t is not None]
            found: dict[str, list[np.ndarray]] = {n: [] for n in names}
            for at in portions(given):
                some = given[at]
                hits = profile_hits(some, profiles, table)
                for name, values in (counts(some, table) | {f"hits_{code}": n for code, n in hits.items()}).items():
                    found[name].append(values)
            row = np.cumsum([t is not None for t in plain]) - 1
            missing = np.array([t is None for t in plain], bool)
            counted = [pa.array(np.concatenate([*found[n], [0]])[row], pa.int32(), mask=missing) for n in names]
            blank = pa.array([not (t or "").strip(SPACES) for t in texts.to_pylist()], pa.bool_())
            parts = [c.cast(pa.int32()) for c in structure_counts(texts).values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(plain, pa.string()), blank, *counted, *parts],
                names=[key, "_plain", "_blank", *[f"_{n}" for n in (*names, *PARTS)]],
            )

    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    columns = ", ".join(f"_{n} int" for n in (*names, *PARTS))
    return docs.select(key, F.make_valid_utf8(F.col(text)).alias(text)).mapInArrow(run, f"`{key}` {kind}, _plain string, _blank boolean, {columns}")


def analyze_documents(docs: DataFrame, key: str, text: str, plain: str | None = None) -> DataFrame:
    """Row-wise analysis; a blank text gives an error row. No exchange is needed.

    ``plain`` names a column for the plain text that was analysed.
    """
    measures = {n: F.col(f"_{n}") for n in MEASURES}
    inputs = ts.readability_inputs_of(measures)
    n_words = measures["words"]
    language = ts.best_language({code: F.col(f"_hits_{code}") for code in LANGUAGE_PROFILES}, n_words)
    return _measured(docs, key, text).select(
        key,
        F.when(F.col("_blank"), F.lit("No content to analyze")).alias("error"),
        _struct(ts.stats_of(measures)).alias("basic_stats"),
        _struct(ts.reading_time(n_words)).alias("reading_time"),
        _struct(md.structure_of({n: F.col(f"_{n}") for n in PARTS})).alias("structure"),
        _struct(ts.readability(*inputs.values())).alias("readability"),
        _struct({"code": language, "name": ts.language_name(language)}).alias("language"),
        *([F.col("_plain").alias(plain)] if plain else []),
    )


def analyze_with_keywords(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The row-wise analysis with each document's keywords (at most ten), found where its rows were laid out.

    The plain text is made once for both. A row without a key has no keywords.
    """
    laid = lay_out(docs.select(key, text), key, text, spread_null=True)
    analyzed = analyze_documents(laid, key, text, plain="_plain")
    found = extract_keywords(analyzed, key, "_plain", laid_out=True, into="keywords")
    return found.drop("_plain")
