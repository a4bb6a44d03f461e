"""Text feature vectors and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import EMBEDDING_WORDS
from .numbers import let

DIMENSIONS = 100
MODEL_NAME = "tfidf-fallback"
LETTERS = "abcdefghijklmnopqrst"
MAX_WORD = 20


def _occurrences(text: Column, char: str) -> Column:
    """Of an ASCII character, so each is one byte: bytes are known, characters would be counted."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def _code(n: Column) -> Column:
    """One letter per small number, so that counting numbers is counting letters."""
    return F.char(n + 96)


def length_codes(words: Column) -> Column:
    """The words' lengths (longer ones as 20), one letter each."""
    return F.array_join(F.transform(words, lambda w: _code(F.least(F.length(w), F.lit(MAX_WORD)))), "")


def common_word_codes(words: Column) -> Column:
    """The common words among the words, one letter each."""
    known = F.array(*[F.lit(w) for w in EMBEDDING_WORDS])
    found = F.filter(words, lambda w: w.isin(*EMBEDDING_WORDS))
    return F.array_join(F.transform(found, lambda w: _code(F.array_position(known, w))), "")


def text_features(text: Column, n_words: Column, lengths: Column, common: Column, digest: Column) -> Column:
    """The 100 raw features of a lower-cased text.

    Letter counts a-t, word lengths 1-20, rates of twenty common words, punctuation
    and size rates, sixteen digest bytes; the rest is zero. The arguments are columns
    of their own (word count, :func:`length_codes`, :func:`common_word_codes`, MD5), so
    each is computed once and the features stay plain string arithmetic.
    """
    n_chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    total = F.greatest(n_words, F.lit(1)).cast("double")
    letters = [chr(97 + i) for i in range(MAX_WORD)]
    zero = F.lit(0.0)
    values = [_occurrences(text, c).cast("double") for c in LETTERS]
    values += [_occurrences(lengths, c).cast("double") for c in letters]
    values += [_occurrences(common, c) / total for c in letters]
    values += [_occurrences(text, c) / n_chars * 100 for c in ".,?!:"]
    values += [
        n_words / F.lit(100.0),
        F.length(text) / F.lit(1000.0),
        zero,  # share of capitals: the text is already lower case
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Nd}+", ""))) / n_chars,
        _occurrences(text, "\n") / n_chars * 100,
    ]
    values += [zero] * 10
    values += [
        F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255.0 for i in range(16)
    ]
    values += [zero] * (DIMENSIONS - len(values))
    return F.array(*values)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a: Column) -> Column:
    """Scale to length one; a zero vector stays zero."""
    return let(norm(a), lambda size: F.when(size > 0, F.transform(a, lambda v: v / size)).otherwise(a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; zero when either vector is zero. Norms that are known are not computed again."""
    return let((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b), lambda size: F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0)))
