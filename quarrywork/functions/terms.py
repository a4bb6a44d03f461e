"""TF-IDF of the terms of documents, and their most used words.

All documents of a batch are counted at once: words and pairs of words become numbers in the order of their strings, and
sorted numbers are counted.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .scan import END, SPACE, SPACES, WORD, Scan, points, runs, string

#: Sums of fractions are taken in whole units, so they do not depend on the order of the terms.
UNIT = 10**12
#: A sentence has so many characters without the white space at its ends.
SENTENCE_LENGTH = 11


def has_words(text: str, n: int) -> bool:
    """Whether a text has ``n`` words or more, as :func:`.textstats.word_count` counts them."""
    return re.match(f"[{SPACES}]*+(?:[^{SPACES}]++[{SPACES}]++){{{n - 1}}}[^{SPACES}]", text) is not None


def _first(*columns: np.ndarray) -> np.ndarray:
    """The rows that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums from each start to the next, exact in whole units; each is the double next to its sum."""
    whole = np.floor(x * UNIT + 0.5)
    if float(whole.max()) * len(whole) < 2**62:
        sums = np.add.reduceat(whole.astype(np.int64), starts)
        if sums.max() < 2**53:
            return sums / UNIT
    else:
        sums = np.add.reduceat(np.array([int(w) for w in whole.tolist()], object), starts)
    return np.array([total / UNIT for total in sums.tolist()])


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group; rows of a group follow each other."""
    starts = _first(groups)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(starts, append=len(groups)))


def sentences(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, str]:
    """How many sentences each text has, and the sentences of all, a line each, with other characters blanked."""
    scan = Scan(texts, table)
    split = scan.has(END) | (scan.points == 10)
    black = np.flatnonzero(~scan.has(SPACE) & ~split)
    if not len(black):
        return np.zeros(len(texts), np.int64), ""
    starts = _first(np.cumsum(split, dtype=np.int32)[black])
    start, end = black[starts], black[np.append(starts[1:], len(black)) - 1] + 1
    long = end - start >= SENTENCE_LENGTH
    start, end = start[long], end[long]
    step = np.zeros(len(split), np.int8)
    step[start], step[end] = 1, -1
    lines = np.where(np.cumsum(step, dtype=np.int8) > 0, scan.points, scan.points.dtype.type(32))
    lines[end] = 10
    return scan.texts_of(start), string(lines)


def best_terms(
    texts: list[str], groups: np.ndarray, stop: frozenset[str], top_n: int, max_features: int, max_df: float, table: np.ndarray,
) -> tuple[dict[int, list[tuple[str, float]]], np.ndarray]:
    """The ``top_n`` terms of each group with their scores, and how many sentences each text has.

    The texts of a group, whose number is in ``groups``, follow each other. Sentences at the same place of texts with as many
    sentences are one.
    """
    n_sentences, lines = sentences(texts, table)
    # a sentence is made small by itself: what a letter becomes may depend on its neighbours
    low = points(lines.lower())
    words, at, coding = runs(low, (table[low] & WORD) != 0)
    if not len(words):
        return {}, n_sentences
    line = np.cumsum(low == 10, dtype=np.int32)[at]
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary
    kept = pc.greater(pc.binary_length(vocabulary), len("a".encode(coding))).to_numpy(zero_copy_only=False)
    kept &= ~pc.is_in(vocabulary, pa.array([w.encode(coding, "replace") for w in stop], vocabulary.type)).to_numpy(zero_copy_only=False)
    order = pc.sort_indices(vocabulary).to_numpy()
    vocabulary, kept = vocabulary.take(pa.array(order)), kept[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    ids = number[coded.indices.to_numpy()]
    ids, line = ids[kept[ids]], line[kept[ids]]
    if not len(ids):
        return {}, n_sentences

    # a line is a sentence by its group, the number of its text's sentences and its place
    at = np.repeat(np.arange(len(texts)), n_sentences)
    group, n, place = groups[at], n_sentences[at], _places(at)
    order = np.lexsort((place, n, group))
    group, n, place = group[order], n[order], place[order]
    starts = _first(group, n, place)
    sentence = np.empty(len(order), np.int64)
    sentence[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
    sentence, group, n, place = sentence[line], group[starts], n[starts], place[starts]
    shift = len(starts).bit_length()

    # a pair comes behind its first word alone and before all longer words, as " " does before all letters
    base = len(vocabulary).bit_length()
    pair = np.flatnonzero(line[1:] == line[:-1])
    first = ids << base
    terms, term = np.unique(np.concatenate([first, first[pair] + ids[pair + 1] + 1]), return_inverse=True)
    used = np.sort((term << shift) + np.concatenate([sentence, sentence[pair]]))
    starts = _first(used)
    tf = np.diff(starts, append=len(used))
    term, sentence = used[starts] >> shift, used[starts] & ((1 << shift) - 1)

    # of each group's term
    starts = _first(term, group[sentence])
    df = np.diff(starts, append=len(term))
    own, uses, most = group[sentence[starts]], np.add.reduceat(tf, starts), np.maximum.reduceat(n[sentence], starts)
    usable = np.flatnonzero(df <= max_df * most)
    order = usable[np.lexsort((term[starts][usable], -uses[usable], own[usable]))]
    feature = np.zeros(len(starts), bool)
    feature[order[_places(own[order]) < max_features]] = True

    df = np.repeat(df, df)
    valued = np.flatnonzero(np.repeat(feature, np.diff(starts, append=len(term))) & (df <= max_df * n[sentence]))
    if not len(valued):
        return {}, n_sentences
    term, sentence, tf, df = term[valued], sentence[valued], tf[valued], df[valued]
    seen, weight = np.unique(n[sentence] * (len(n) + 1) + df, return_inverse=True)
    weights = [math.log((1.0 + m) / (1.0 + d)) + 1 for m, d in zip(*(x.tolist() for x in np.divmod(seen, len(n) + 1)))]
    value = tf * np.array(weights)[weight]

    # of each place: vectors of one place have one length, also where their texts differ in sentences
    order = np.lexsort((place[sentence], group[sentence]))
    starts = _first(group[sentence[order]], place[sentence[order]])
    norms = np.sqrt(_sums((value * value)[order], starts))
    norm = np.empty(len(value))
    norm[order] = np.repeat(norms, np.diff(starts, append=len(value)))

    starts = _first(term, group[sentence], n[sentence])
    term, own, n = term[starts], group[sentence[starts]], n[sentence[starts]]
    score = _sums(value / norm, starts) / n
    order = np.lexsort((term, -np.floor(score * 10**8 + 0.5), own))
    order = order[_places(own[order]) < top_n]
    best: dict[int, list[tuple[str, float]]] = {}
    for g, code, s in zip(own[order].tolist(), terms[term[order]].tolist(), score[order].tolist()):
        own_words = [vocabulary[i].as_py().decode(coding) for i in (code >> base, (code & ((1 << base) - 1)) - 1) if i >= 0]
        best.setdefault(g, []).append((" ".join(own_words), s))
    return best, n_sentences


def most_used(texts: list[str], stop: frozenset[str], top_n: int, table: np.ndarray) -> list[tuple[str, float]]:
    """The ``top_n`` words of three or more ASCII letters with their share of all such words."""
    low = points("\n".join(t.lower() for t in texts))
    words = string(np.where((table[low] & WORD) != 0, low, low.dtype.type(32))).split()
    uses = Counter(w for w in words if re.fullmatch("[a-z]{3,}", w) and w not in stop)
    total = uses.total()
    return [(w, n / total) for w, n in heapq.nsmallest(top_n, uses.items(), key=lambda u: (-u[1], u[0]))]
