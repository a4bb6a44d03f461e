"""The best documents for stated items by summed term weights, pruned by norm buckets.

A term's impact in a document depends on its count and the document's length, its weight on the number of documents
that hold it; a score is the inner product of the item's vector (weights, times repeats) with the document's impact vector,
in integers. Only terms of the items matter, so vectors are restricted to them.

1. A scan writes each document's vector: its number of terms, and (term, count) of the items' terms.
2. Number of documents, their terms, and the documents of each term are counted over all vectors.
3. The vectors of a batch are put in the order of their length (norm) and cut into buckets (Teflioudi, Gemulla and Mykytiuk,
   "LEMP", 2015). By Cauchy-Schwarz no score of a bucket exceeds the item's norm times the bucket's largest; a
   bucket below the item's bar is passed over whole. Inside, the item's heaviest coordinates are
   summed, the rest is bounded by the rest of both norms; the documents that may still reach the bar are scored
   exactly in 64-bit integers. Bounds are doubles with room for their rounding.

An item's bar is the score of its k-th best document so far in the task, and from the start that of its k-th best among one
document in ``FIRST`` (chosen by a hash): a bar from some documents is never above the right one, so nothing is lost. A
task sends at most k documents an item on. Vectors are not exchanged.

Items are taken in blocks of about ``BLOCK_BYTES`` of text; every block scans the documents once, so the work grows with the
product of both, as it must. A block's terms and weights travel in closures.

Null texts have no term. Documents without a term take no part in the counts. Repeated documents are ranked each; those with
equal scores go by ascending key, null keys last. Repeated items get their answer each; items without a known term none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.topn import top_n_per_group
from ..session import materialize
from .common import in_batches, pieces_of_work, ragged_take, term_table, terms_of

#: Text of a block of items, in bytes.
BLOCK_BYTES = 8 << 20
#: Documents of a bucket, and coordinates of an item that are summed before the rest is bounded.
BUCKET, FOCUS = 2048, 6
#: One document in so many gives the first bar.
FIRST = 64
_TABLE = term_table(digits=True)


class Asked:
    """The items of a block as vectors over the block's terms."""

    def __init__(self, places: list[int], texts: list[str | None]):
        counts, words = terms_of(pa.array(texts, pa.string()), _TABLE)
        self.places = places
        self.names = words.dictionary.cast(pa.string())
        owner = np.repeat(np.arange(len(texts)), counts)
        size = max(1, len(self.names))
        pairs, self.repeats = np.unique(owner * size + np.asarray(words.indices), return_counts=True)
        self.owner, self.term = np.divmod(pairs, size)

    def weigh(self, held: np.ndarray, documents: int) -> None:
        """Weights from the number of documents that hold each term."""
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in held.tolist()], dtype=np.int64)
        self.vectors = []
        for k in range(len(self.places)):
            own = slice(*np.searchsorted(self.owner, [k, k + 1]).tolist())
            term, value = self.term[own], self.repeats[own] * weight[self.term[own]]
            term, value = term[value > 0], value[value > 0]
            order = np.argsort(-value, kind="stable")
            self.vectors.append((term[order], value[order]))


def vectors(docs: DataFrame, names: pa.Array, key: str, text: str) -> DataFrame:
    """``key``, n (terms of the document), and term and count of the named ones among them."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = max(1, len(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_work(batches, "text"):
            counts, words = terms_of(batch.column("text"), _TABLE)
            place = np.asarray(pc.fill_null(pc.index_in(words.dictionary, value_set=names.cast(words.dictionary.type)), -1), dtype=np.int64)
            named = place[np.asarray(words.indices)]
            pairs, times = np.unique((np.repeat(np.arange(len(counts)), counts) * size + named)[named >= 0], return_counts=True)
            owner, term = np.divmod(pairs, size)
            ends = pa.array(np.searchsorted(owner, np.arange(len(counts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts), *lists], names=["key", "n", "term", "times"])

    return in_batches(rows, count, f"key {rows.schema['key'].dataType.simpleString()}, n long, term array<int>, times array<int>")


def holders(found: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term is; one row per term of the block reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(pc.list_flatten(batch.column("term"))), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in in_batches(found.select("term"), count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def flat(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_flatten(lists), dtype=np.int64)


class Bucket:
    """Documents of similar length, by document and by term."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, lengths: np.ndarray, square: np.ndarray, size: int):
        self.term, self.impact, self.lengths, self.square = term, impact, lengths, square
        self.starts = np.cumsum(lengths) - lengths
        self.longest = math.sqrt(float(square.max()))
        order = np.argsort(term, kind="stable")
        self.by_term = owner[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(size + 1))

    def may_reach(self, term: np.ndarray, value: np.ndarray, rest: float, bar: int) -> np.ndarray:
        """Documents whose bound is at least the bar; ``term`` and ``value`` are the heaviest coordinates."""
        summed, square = np.zeros(len(self.square)), self.square.copy()
        for t, v in zip(term.tolist(), value.tolist()):
            own = slice(self.bounds[t], self.bounds[t + 1])
            who, impact = self.by_term[0][own], self.by_term[1][own].astype(np.float64)
            summed[who] += v * impact
            square[who] -= impact * impact
        bound = summed + rest * np.sqrt(np.maximum(square, 0))
        return np.flatnonzero(bound * (1 + 1e-9) + 1 >= bar)

    def scores(self, who: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores; ``dense`` has the item's value of every term."""
        lengths = self.lengths[who]
        at = ragged_take(self.starts[who], lengths, np.arange(len(self.term)))
        sums = np.concatenate([[0], np.cumsum(dense[self.term[at]] * self.impact[at])])
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]


def buckets(batch: pa.RecordBatch, documents: int, terms: int, size: int) -> Iterator[tuple[np.ndarray, Bucket]]:
    """The documents of a batch, longest vectors first: their rows in the batch, and the bucket."""
    lengths = np.asarray(pc.list_value_length(batch.column("term")), dtype=np.int64)
    middle = 75 + np.array([25 * n * documents // terms for n in batch.column("n").to_pylist()], dtype=np.int64)
    term, times = flat(batch.column("term")), flat(batch.column("times"))
    impact = 1_000_000_000 * times // (1000 * times + 12 * np.repeat(middle, lengths))
    ends = np.cumsum(lengths)
    square = np.where(lengths > 0, np.add.reduceat(np.append(impact.astype(np.float64) ** 2, 0.0), ends - lengths), 0.0)
    order = np.argsort(-square, kind="stable")
    order = order[lengths[order] > 0]
    for lo in range(0, len(order), BUCKET):
        rows = order[lo : lo + BUCKET]
        at = ragged_take(ends[rows] - lengths[rows], lengths[rows], np.arange(len(term)))
        owner = np.repeat(np.arange(len(rows)), lengths[rows])
        yield rows, Bucket(owner, term[at], impact[at], lengths[rows], square[rows], size)


def search(found: DataFrame, asked: Asked, bars: list[int], documents: int, terms: int, k: int) -> DataFrame:
    """place (of the item), key, score: at most ``k`` documents per item and task, those at or above the item's bar."""
    size, places, weighed = max(1, len(asked.names)), asked.places, asked.vectors
    kind = found.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in places]  # (-score, key is null, key), best first
        now = list(bars)
        heavy = [(t[:FOCUS], v[:FOCUS], math.sqrt(float((v[FOCUS:].astype(np.float64) ** 2).sum()))) for t, v in weighed]
        norms = [math.sqrt(float((v.astype(np.float64) ** 2).sum())) for _, v in weighed]
        dense = np.zeros(size, dtype=np.int64)
        key_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, key_type = batch.column("key"), batch.column("key").type
            for rows, bucket in buckets(batch, documents, terms, size):
                for q, (term, value) in enumerate(weighed):
                    if norms[q] * bucket.longest * (1 + 1e-9) + 1 < now[q] or not len(term):
                        continue
                    who = bucket.may_reach(*heavy[q], now[q])
                    dense[term] = value
                    scores = bucket.scores(who, dense)
                    dense[term] = 0
                    least = now[q]
                    if len(scores) > k:
                        least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    chosen = np.flatnonzero(scores >= max(least, 1))
                    if not len(chosen):
                        continue
                    of = keys.take(pa.array(rows[who[chosen]])).to_pylist()
                    best[q] = sorted(best[q] + [(-s, x is None, 0 if x is None else x) for s, x in zip(scores[chosen].tolist(), of)])[:k]
                    if len(best[q]) == k:
                        now[q] = max(now[q], -best[q][-1][0])
        out = [(places[q], None if none else x, -s) for q, rows in enumerate(best) for s, none, x in rows]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], key_type), pa.array([r[2] for r in out], pa.int64())],
                names=["place", "key", "score"],
            )

    return in_batches(found, run, f"place long, key {kind}, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    return top_n_per_group(found, ["place"], [F.desc("score"), F.asc_nulls_last("key")], k, "rank", salts=16)


def lexical_top(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item``, rank, ``key``, score: for each item its ``k`` best documents (all with a score above 0, if fewer)."""
    stated = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text"))
    stated = materialize(stated.withColumn("place", F.monotonically_increasing_id()), "items")
    n_blocks = max(1, -(-(stated.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    answer = None
    for block in range(n_blocks):
        rows = stated.filter(F.pmod(F.xxhash64("place"), F.lit(n_blocks)) == block).select("place", "text").collect()  # about BLOCK_BYTES
        asked = Asked([r["place"] for r in rows], [r["text"] for r in rows])
        found = materialize(vectors(docs, asked.names, key, text), "impact-vectors")
        documents, terms = found.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        asked.weigh(holders(found, max(1, len(asked.names))), documents)
        none = [1] * len(rows)
        first = ranked(search(found.filter(F.pmod(F.xxhash64("key", "n"), F.lit(FIRST)) == 0), asked, none, documents, terms, k), k)
        bar = {r["place"]: r["score"] for r in first.filter(F.col("rank") == k).select("place", "score").collect()}  # one row per item
        best = ranked(search(found, asked, [bar.get(r["place"], 1) for r in rows], documents, terms, k), k)
        answer = best if answer is None else answer.unionByName(best)
    return answer.join(stated.select("place", "item"), "place").select(
        F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"
    )
