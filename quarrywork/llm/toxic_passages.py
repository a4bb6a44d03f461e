"""Toxic passages by maximum-scoring segment search.

Model. A word is its letters, lowered; its units are the word and its first four, five and six
letters, so that inflected forms share a stem. A unit's score is the log-odds ratio of its
document frequency in toxic and other labelled documents under an informative Dirichlet prior: the
unit's frequency over all documents of the table, labelled or not (Monroe, Colaresi and Quinn,
"Fightin' Words", 2008). Units whose log-odds lie ``SURE`` standard errors above 0 keep
it; every other word has one common negative score, the log-odds of not being such a word.

Search. One pass over the words of a text finds all maximal-scoring segments (Ruzzo and Tompa,
1999). A segment of score S in a text of n words is expected K n exp(-lambda S) times by
chance (Karlin and Altschul, 1990): lambda solves sum p exp(lambda s) = 1 over the word scores of other
documents, K is its maximum-likelihood value on them. Segments expected at most ``EXPECTED`` times are
significant. The r best of a text are judged together by Karlin and Altschul's sum statistic; the
least probability over r is the text's, and a logistic curve over its logarithm, fitted on the
labelled documents weighted to the real ratio of the labels, is the score.

Bounds. At most about ``LABELLED`` documents of each label, chosen by a hash of the key, are
learned from, one of each group of near copies (copies are put aside first: documents whose ``SKETCH`` smallest hashes of
five-word shingles all agree, which a pair of Jaccard similarity 0.3 does in about one case of a hundred); the counts of the prior cover all documents.
The driver holds the units of at least ``TIMES`` toxic documents of the sample, two numbers a labelled document, and a
bitmap of ``PLACES`` bits; the sample's size decides all of them, not the tables'. Scoring is one scan without an exchange.

Word scores are whole multiples of 2^-20, so sums are exact. Of equally good segments the shortest is maximal: a
segment is not prolonged by words that add nothing. Segments of one text do not overlap; equal ones are all kept.

Null and empty texts, and texts without letters, have no segment. A key with several labels is
toxic if one says so; labels other than 0 and 1 are not read. Without two labels to learn from every
score is 0. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import WORK_BYTES, in_batches, passed, pieces_of_work, restored

LABELLED = 10_000
#: Toxic documents of the sample that a unit of the model is in.
TIMES = 3
#: Smallest shingle hashes that copies share.
SKETCH = 4
#: Word scores are multiples of one part of this.
PARTS = 1 << 20
STEMS = (4, 5, 6)
SURE, EXPECTED = 3.0, 0.05
#: Weight of the prior, as a share of the labelled counts.
PRIOR = 0.1
_SHINGLE = 5
#: Bits of the bitmap of labelled keys, a multiple of 32,768.
PLACES = 1 << 25


def units(word: str) -> list[str]:
    """The word itself, marked by a closing space, and its stems."""
    return [word + " ", *[word[:n] for n in STEMS if len(word) >= n]]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def cut_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Number of words of each text, and all words."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\pL]+", " "), " ")
    lists = pc.split_pattern(plain, " ")
    return np.where(np.asarray(pc.binary_length(plain)) > 0, np.asarray(pc.list_value_length(lists)), 0), lists


@dataclass
class Model:
    scores: dict[str, float]
    other: float  # score of every other word
    rate: float  # lambda
    k: float = 1.0
    slope: float = 1.0
    offset: float = 0.0

    def word_score(self, word: str) -> float:
        return max((self.scores[u] for u in units(word) if u in self.scores), default=self.other)

    def expected(self, score: float, n: int) -> float:
        return self.k * max(n, 1) * math.exp(-self.rate * score)

    def evidence(self, segments: list[float], n: int) -> float:
        """-ln of the least sum-statistic probability over the significant segments; 0 without any."""
        best, total = 0.0, 0.0
        for r, score in enumerate(sorted(segments, reverse=True), 1):
            log_expected = math.log(self.k * max(n, 1)) - self.rate * score
            if log_expected > math.log(EXPECTED):
                break
            total -= log_expected
            if r == 1:
                found = -math.log(-math.expm1(-math.exp(log_expected))) if log_expected > -20 else total
            else:
                found = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r)
            best = max(best, found)
        return best

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.offset))))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, past the last) in linear time; only positive scores are visited."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    for at, left, right in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist()):
        first = at
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j -= 1
            if j < 0 or held[j][1] >= right:
                break
            left, first = held[j][0], held[j][2]
            del held[j:]
        held.append((left, right, first, at + 1))
    return [(right - left, first, end) for left, right, first, end in held]


def segments_of_batch(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """Number of words and the segments of each text."""
    counts, lists = cut_words(texts)
    words = pc.dictionary_encode(pc.list_flatten(lists))
    by_word = np.array([model.word_score(w) if w else 0.0 for w in strings(words.dictionary)])
    scores = by_word[np.asarray(words.indices)]
    ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
    starts = np.concatenate([[0], ends[:-1]])
    hot = np.add.reduceat(np.append(scores > 0, False).astype(np.int64), starts) if len(starts) else starts
    for k in range(len(texts)):
        yield int(counts[k]), segments(scores[starts[k] : ends[k]]) if hot[k] else []


# learning


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, key: str, text: str, label: str) -> tuple[DataFrame, dict[int, float]]:
    """toxic and text of about ``LABELLED`` documents of each label, written, and how many each of a label stands for.

    Copies go first: of each group of near copies one document is thinned or kept, so that the weights count groups.
    """
    marks = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
        .filter(usable)
    )
    marks = materialize(marks, "usable-labels")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # texts are not exchanged: a bitmap of the labelled keys spares most other texts the sketch, the join after it is exact
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(PLACES)) + 1
    bits = np.zeros(PLACES // 8, dtype=np.uint8)
    parts = marks.select(place("key").alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for r in parts.collect():  # at most PLACES bits
        bits.reshape(-1, len(r["bits"]))[r["part"] - 1] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            at = np.asarray(batch.column("at")) - 1
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            least = []
            for body in batch.column("text").to_pylist():
                words = (body or "").lower().split()
                own = {xxh64_intdigest(" ".join(words[i : i + _SHINGLE])) for i in range(max(1, len(words) - _SHINGLE + 1))}
                least.append(xxh64_intdigest(np.array(heapq.nsmallest(SKETCH, own), dtype="<u8").tobytes()) >> 1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("key", "body")], pa.array(least, pa.int64())], names=["key", "body", "sketch"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    seen = in_batches(rows.select("key", "text", F.xxhash64("text").alias("body"), place("key").alias("at")).filter("key is not null"), sketch, f"key {kind}, body long, sketch long")
    first = seen.join(marks, "key").groupBy("sketch", "toxic").agg(F.min(F.struct("key", "body")).alias("first")).select("first.*", "toxic")
    first = materialize(first.withColumn("h", F.xxhash64("key", F.lit("labelled")) / F.lit(2.0**64) + 0.5), "labelled-groups")
    n = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, LABELLED / max(1, n.get(1, 0)))).otherwise(min(1.0, LABELLED / max(1, n.get(0, 0))))
    chosen = first.filter(F.col("h") < share).drop("h")
    kept = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # about twice LABELLED small rows, whatever the size of the tables
    found = rows.withColumn("body", F.xxhash64("text")).join(F.broadcast(chosen), ["key", "body"]).dropDuplicates(["key", "body", "toxic"])
    return materialize(found.select("toxic", "text"), "labelled"), {toxic: n[toxic] / k for toxic, k in kept.items()}


def unit_counts(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, tuple[int, int]]:
    """Units of at least ``TIMES`` toxic documents, in how many toxic and other documents, and the sums over all units."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_work(batches, "text", WORK_BYTES // 4):  # the counters outweigh the text
            found: tuple[Counter, Counter] = (Counter(), Counter())
            lists = cut_words(batch.column("text"))[1]
            for toxic, words in zip(batch.column("toxic").to_pylist(), lists.to_pylist()):
                found[toxic].update({u for w in set(words) if w for u in units(w)})
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([c[u] for u in names], pa.int64()) for c in (found[1], found[0])]], names=["unit", "toxic", "other"]
            )

    totals = in_batches(sample, count, "unit string, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    totals = materialize(totals, "unit-counts")
    sums = totals.agg(F.sum("toxic"), F.sum("other")).first()
    rows = sorted(totals.filter(F.col("toxic") >= TIMES).collect(), key=lambda r: r["unit"])
    return [r["unit"] for r in rows], np.array([r["toxic"] for r in rows]), np.array([r["other"] for r in rows]), (sums[0] or 0, sums[1] or 0)


def background(docs: DataFrame, text: str, names: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each named unit is, and that sum over all units."""
    wanted = {u: k for k, u in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, every = np.zeros(len(wanted), dtype=np.int64), 0
        for batch in pieces_of_work(batches, "text"):
            lists = cut_words(batch.column("text"))[1]
            owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            words = pc.dictionary_encode(pc.list_flatten(lists))
            # (document, word) once, then (document, unit) once
            size = max(1, len(words.dictionary))
            document, word = np.divmod(np.unique(owner * size + np.asarray(words.indices)), size)
            letters = np.asarray(pc.utf8_length(words.dictionary))
            every += int(((letters > 0) + sum((letters >= n).astype(np.int64) for n in STEMS))[word].sum())
            own = strings(words.dictionary)
            for n in (0, *STEMS):
                units_of = (w[:n] if len(w) >= n else "" for w in own) if n else (w + " " for w in own)
                place = np.fromiter((wanted.get(u, -1) for u in units_of), dtype=np.int64, count=len(own))[word]
                hit = place >= 0
                both = np.unique(document[hit] * len(wanted) + place[hit])
                totals += np.bincount(both % max(1, len(wanted)), minlength=len(wanted))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(totals[used], every))], names=["unit", "n"])

    rows = in_batches(docs.select(F.col(text).alias("text")), count, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect()
    found = {r["unit"]: r["n"] for r in rows}  # a row per name, and one
    return np.array([found.get(k, 0) for k in range(len(names))], dtype=np.float64), found.get(-1, 0)


def log_odds(names: list[str], toxic: np.ndarray, other: np.ndarray, sums: tuple[int, int], everywhere: np.ndarray, every: int) -> Model:
    prior = PRIOR * sum(sums)
    own = prior * (everywhere + 1) / (every + 1)
    in_toxic, in_other = (toxic + own) / (sums[0] + prior), (other + own) / (sums[1] + prior)
    delta = np.log(in_toxic / (1 - in_toxic)) - np.log(in_other / (1 - in_other))
    sure = delta / np.sqrt(1 / (toxic + own) + 1 / (other + own)) >= SURE
    # of a stem and its longer forms the surest covers the words; count that one alone
    delta = np.round(delta * PARTS) / PARTS
    scores = {names[k]: float(delta[k]) for k in np.flatnonzero(sure)}
    cover = [k for k in np.flatnonzero(sure) if not any(names[k][:n] in scores for n in STEMS if n < len(names[k].rstrip()))]
    p_toxic, p_other = min(0.5, in_toxic[cover].sum()), min(0.5, in_other[cover].sum())
    ground = min(-1, round(math.log((1 - p_toxic) / (1 - p_other)) * PARTS) if p_toxic > p_other else -1) / PARTS
    low, high = 1e-3, 20.0  # sum p exp(rate s) - 1 is below 0 just above 0, and grows without end
    for _ in range(60):
        mid = (low + high) / 2
        total = float((in_other[cover] * np.exp(np.minimum(700, mid * delta[cover]))).sum() + (1 - p_other) * math.exp(mid * ground))
        low, high = (mid, high) if total < 1 else (low, mid)
    return Model(scores, ground, low)


def calibrate(sample: DataFrame, model: Model, weights: dict[int, float]) -> Model:
    """K from the other documents, then the logistic curve; two numbers per labelled document come to the driver.

    A document counts as many times in the curve as ``weights`` says of its label, so that the labels have their real ratio.
    """

    def measured(value: Callable[[int, list[float]], float]) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces_of_work(batches, "text"):
                found = [value(n, [s for s, _, _ in own]) for n, own in segments_of_batch(batch.column("text"), model)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], names=["toxic", "x"])

        return in_batches(sample, run, "toxic int, x double").collect()

    # rows arrive in any order; sums of doubles shall not
    chance = sorted(r["x"] for r in measured(lambda n, own: n * math.exp(-model.rate * max(own, default=0.0))) if not r["toxic"])
    model.k = len(chance) / sum(chance) if chance and sum(chance) else 1.0
    rows = measured(lambda n, own: model.evidence(own, n))
    x = np.array([r["x"] for r in rows])
    y = np.array([r["toxic"] for r in rows], dtype=float)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    times = np.where(y > 0, weights.get(1, 1.0), weights.get(0, 1.0))
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -60, 60)))
        slope = design.T @ (times * (y - p)) - 1e-2 * w
        curve = (design * (times * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(curve, slope)
    model.slope, model.offset = float(w[0]), float(w[1])
    return model


def learn(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """``usable`` says which labels may be learned from, by the column ``key``."""
    sample, weights = labelled_sample(docs, labels, usable, key, text, label)
    names, toxic, other, sums = unit_counts(sample)
    if not names or not sums[1]:
        return None
    model = log_odds(names, toxic, other, sums, *background(docs, text, names))
    return calibrate(sample, model, weights)


def score(docs: DataFrame, model: Model | None, columns: dict[str, Column], text: str = "text") -> DataFrame:
    """The given columns, score, predicted, and passages: score, expected number and word positions of each significant segment."""
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], F.col(text).alias("__text"))
    names = list(columns)
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    passage = pa.struct([("score", pa.float64()), ("expected", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_work(batches, "__text"):
            scores, passages = [], []
            if model is None:
                scores, passages = [0.0] * batch.num_rows, [[]] * batch.num_rows
            else:
                for n, own in segments_of_batch(batch.column("__text"), model):
                    scores.append(model.probability(model.evidence([s for s, _, _ in own], n)))
                    told = [(s, model.expected(s, n), a, b) for s, a, b in own]
                    passages.append([dict(zip(("score", "expected", "first_word", "end_word"), t)) for t in told if t[1] <= EXPECTED])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(passages, pa.list_(passage)),
                ],
                names=[*names, "score", "predicted", "passages"],
            )

    spans = "array<struct<score: double, expected: double, first_word: bigint, end_word: bigint>>"
    return in_batches(rows, run, f"{schema}, score double, predicted int, passages {spans}")


def keep_harmless(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return restored(score(docs, model, passed(docs), text).filter("predicted = 0"), docs.columns)
