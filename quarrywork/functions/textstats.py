"""Counts and scores of one text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .fixed import LANGUAGE_NAMES, LANGUAGE_PROFILES
from .numbers import half_up

WORDS_PER_MINUTE = 200


def estimate_tokens(text: Column) -> Column:
    """About four characters per token, at least one for a non-empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
    )


def _count(text: Column, gap: str, unit: str) -> Column:
    """How often ``unit`` follows ``gap``: each becomes one letter, and what is left at the end holds none.

    ``regexp_count`` puts every match into an array first.
    """
    marked = F.regexp_replace(text, f"(?U){gap}{unit}", "a")
    return F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit("a"), F.lit("")))


def word_count(text: Column) -> Column:
    return _count(text, r"\s*+", r"\S++")


def sentence_count(text: Column) -> Column:
    """Pieces between runs of ``.!?`` that hold more than white space."""
    return _count(text, r"[.!?\s]*+", "[^.!?]++")


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: F.rlike(p, F.lit(r"(?U)\S"))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def text_stats(text: Column) -> dict[str, Column]:
    """Word, character, sentence and paragraph counts with the two averages."""
    return stats_of({
        "words": word_count(text),
        "characters": F.length(text),
        "characters_no_spaces": F.length(F.translate(text, " \n\t", "")),
        "black": F.length(F.regexp_replace(text, r"(?U)\s+", "")),
        "sentences": sentence_count(text),
        "paragraphs": paragraph_count(text),
    })


def stats_of(counts: dict[str, Column]) -> dict[str, Column]:
    """The statistics from counts by :func:`text_stats` or :func:`.scan.counts`."""
    n_words, n_sentences, letters = counts["words"], counts["sentences"], counts["black"]
    return {
        "word_count": n_words,
        "character_count": counts["characters"],
        "character_count_no_spaces": counts["characters_no_spaces"],
        "sentence_count": n_sentences,
        "paragraph_count": counts["paragraphs"],
        "average_word_length": half_up(letters.cast("double") / F.greatest(n_words, F.lit(1)), 1),
        "average_sentence_length": half_up(n_words.cast("double") / F.greatest(n_sentences, F.lit(1)), 1),
    }


def reading_time(n_words: Column) -> dict[str, Column]:
    minutes = n_words.cast("double") / WORDS_PER_MINUTE
    whole = F.bround(minutes.cast("decimal(20,6)"), 0).cast("bigint").cast("string")
    return {
        "minutes": half_up(minutes, 1),
        "display": F.when(minutes < 1, "Less than 1 minute")
        .when(minutes < 2, "About 1 minute")
        .otherwise(F.concat(F.lit("About "), whole, F.lit(" minutes"))),
    }


# Lower bound of the Flesch score and its reading level.
READING_LEVELS = (
    (90, "Very Easy (5th grade)"),
    (80, "Easy (6th grade)"),
    (70, "Fairly Easy (7th grade)"),
    (60, "Standard (8th-9th grade)"),
    (50, "Fairly Difficult (10th-12th grade)"),
    (30, "Difficult (College)"),
)
HARDEST_LEVEL = "Very Difficult (Graduate)"
MIN_READABLE_WORDS = 10

VOWELS = "aeiouy"
COMPLEX_WORD = rf"[{VOWELS}]+[^{VOWELS}\s]+[{VOWELS}]+[^{VOWELS}\s]+[{VOWELS}]\S*"


def readability_inputs(text: Column) -> dict[str, Column]:
    """The counts the readability formulas share; a syllable is a run of vowels."""
    lower = F.lower(text)
    return readability_inputs_of({
        "words": word_count(text),
        "sentences": sentence_count(text),
        "letters": F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")),
        "vowel_runs": _count(lower, f"[^{VOWELS}]*+", f"[{VOWELS}]++"),
        "complex": F.regexp_count(lower, F.lit("(?U)" + COMPLEX_WORD)),
    })


def readability_inputs_of(counts: dict[str, Column]) -> dict[str, Column]:
    """The inputs from counts by :func:`readability_inputs` or :func:`.scan.counts`."""
    return {
        "n_words": counts["words"],
        "n_sentences": F.greatest(counts["sentences"], F.lit(1)),
        "n_letters": counts["letters"],
        "n_syllables": F.greatest(counts["vowel_runs"], counts["words"]),
        "n_complex": counts["complex"],
    }


def readability(n_words: Column, n_sentences: Column, n_letters: Column, n_syllables: Column,
                n_complex: Column) -> dict[str, Column]:
    """Published readability formulas over :func:`readability_inputs`; NULL for short texts."""
    w, s = n_words.cast("double"), n_sentences.cast("double")
    wps, spw = w / s, n_syllables / w
    flesch = 206.835 - 1.015 * wps - 84.6 * spw
    enough = n_words >= MIN_READABLE_WORDS
    level = reduce(
        lambda acc, item: acc.when(flesch >= item[0], item[1]), READING_LEVELS[1:],
        F.when(flesch >= READING_LEVELS[0][0], READING_LEVELS[0][1]),
    ).otherwise(HARDEST_LEVEL)
    scores = {
        "flesch_reading_ease": flesch,
        "flesch_kincaid_grade": 0.39 * wps + 11.8 * spw - 15.59,
        "gunning_fog": 0.4 * (wps + 100 * n_complex / w),
        "smog_index": 1.043 * F.sqrt(n_complex * (30 / s)) + 3.1291,
        "automated_readability_index": 4.71 * n_letters / w + 0.5 * wps - 21.43,
        "coleman_liau_index": 5.88 * n_letters / w - 29.6 * s / w - 15.8,
    }
    result = {name: F.when(enough, half_up(score, 1)) for name, score in scores.items()}
    result["reading_level"] = F.when(enough, level)
    result["available"] = enough
    return result


MIN_LANGUAGE_WORDS = 5


def telling_words(text: Column) -> Column:
    """The words of a text that are in any language's profile."""
    known = sorted({w for profile in LANGUAGE_PROFILES.values() for w in profile})
    return F.filter(letter_words(text), lambda w: w.isin(*known))


def language_hits(telling: Column) -> dict[str, Column]:
    """How many of the words belong to each language's profile; :func:`telling_words`, a column of their own, are enough."""

    def hits(profile: tuple[str, ...]) -> Column:
        return F.size(F.filter(telling, lambda w: w.isin(*profile)))

    return {code: hits(profile) for code, profile in LANGUAGE_PROFILES.items()}


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))


def best_language(hits: dict[str, Column], n_words: Column) -> Column:
    """Code with the most hits (first in profile order on a tie); NULL when nothing speaks for any."""
    top = F.greatest(*hits.values())
    choice = reduce(
        lambda acc, code: acc.when(hits[code] == top, code), list(hits)[1:],
        F.when(hits[next(iter(hits))] == top, next(iter(hits))),
    )
    return F.when((n_words >= MIN_LANGUAGE_WORDS) & (top > 0), choice)


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, code), F.upper(code))
