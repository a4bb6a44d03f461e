"""Benchmark passages in documents by winnowing, with DataFrame and SQL functions only.

A window of an item is ``window`` consecutive words; an item of fewer words is one window of all of them. For
windows of n words, k-grams of k = (n + 1) // 2 words are hashed, and of every n - k + 1 consecutive k-grams the smallest
hash is a fingerprint (Schleimer, Wilkerson and Aiken, "Winnowing", 2003). Equal windows have equal
smallest hashes; so a document with a window of an item shares a fingerprint with it, without exception.
All places of the smallest hash are fingerprints, so ties lose nothing.

1. The distinct fingerprints of each document meet those of the items. What remains are candidate documents.
2. In the candidates, every hit is extended: the windows of the document that hold the hit's k-gram are compared
   with the items' windows, word by word.
3. A document's hit words are the union of its windows.

Texts are not exchanged in the first step: a fingerprint and the row's locator are. The items' fingerprints and
windows are broadcast while there are at most ``common.BROADCAST`` of them. Beyond that both sides are dealt by a salt of
``common.SALTS`` shares, so that a fingerprint in a third of all rows is spread over many tasks.

Words are maximal runs of ``WORD`` in the text with A-Z lowered. Null and empty texts, and texts without a word, have no
word and no hit. Repeated rows and null identifiers get a row each. Items without a word have no window. Items with a null
id are compared, count among the hit words, but have no id to be listed. Several items of one id count as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import FILE, ROW, carried, meet, placed, whole_text

#: Letters, digits and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lowered.
_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Winnow:
    """Fingerprints that every window of ``size`` words shares with an equal one."""

    size: int

    @property
    def gram(self) -> int:
        return (self.size + 1) // 2

    @property
    def span(self) -> int:
        """k-grams in a window."""
        return self.size - self.gram + 1

    def grams(self, hashes: str) -> Column:
        """Hash of every k-gram, from the column with the hash of every word."""
        word = [lambda i, d=d: F.get(F.col(hashes), i + d) for d in range(self.gram)]
        return _places(F.size(hashes) - self.gram + 1, lambda i: F.xxhash64(F.lit(self.size), *[w(i) for w in word]))

    def least(self, grams: str) -> Column:
        """The smallest hash of every ``span`` consecutive k-grams."""
        if self.span == 1:
            return F.col(grams)
        return _places(F.size(grams) - self.span + 1, lambda i: F.least(*[F.get(F.col(grams), i + d) for d in range(self.span)]))

    def chosen(self, grams: str, least: str) -> Column:
        """(place, hash) of the k-grams that are the smallest of some window."""
        among = [lambda i, d=d: F.get(F.col(least), i - d) for d in range(self.span)]
        top = (lambda i: among[0](i)) if self.span == 1 else (lambda i: F.greatest(*[a(i) for a in among]))
        at = _places(F.size(grams), lambda i: F.when(F.get(F.col(grams), i) == top(i), F.struct(i.alias("at"), F.get(F.col(grams), i).alias("print"))))
        return F.filter(at, lambda x: x.isNotNull())


def _places(n: Column, make) -> Column:
    """``make(i)`` for i from 0 to n - 1."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), make)).otherwise(F.expr("array()"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(whole_text(text), _UPPER, _LOWER), F.lit(WORD), 0)


def hashed(rows: DataFrame, words: str = "words") -> DataFrame:
    return rows.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))


def window_text(words: str, at: Column, size: int) -> Column:
    """The words of a window, joined; no word holds a space."""
    return F.array_join(F.slice(F.col(words), at + 1, size), " ")


def item_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """item, size and window: the distinct windows of all items."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))
    return rows.withColumn("at", starts).select("item", "size", window_text("words", F.col("at"), F.col("size")).alias("window")).distinct()


def prints_of(rows: DataFrame, kinds: list[Winnow]) -> DataFrame:
    """``rows`` with words, and the columns grams_n and least_n for every kind of window."""
    rows = hashed(rows)
    rows = rows.withColumns({f"grams_{k.size}": k.grams("hashes") for k in kinds})
    return rows.withColumns({f"least_{k.size}": k.least(f"grams_{k.size}") for k in kinds})


def all_least(kinds: list[Winnow]) -> Column:
    parts = [F.col(f"least_{k.size}") for k in kinds]
    return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])


def hit_windows(there: DataFrame, windows: DataFrame, text: Column) -> DataFrame:
    """file, row, at, size, window: every window of a document that is an item's. ``there`` has a locator."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``window`` rows
    kinds = [Winnow(s) for s in sizes]
    known = windows.select("size", "window").distinct()
    of_items = prints_of(known.withColumn("words", F.split("window", " ")), kinds)
    by_size = F.coalesce(*[F.when(F.col("size") == k.size, F.col(f"least_{k.size}")) for k in kinds]) if kinds else F.expr("array(0L)")
    prints = materialize(of_items.select(F.explode(by_size).alias("print")).distinct(), "item-prints")
    known = materialize(known, "item-windows")
    n_prints, n_windows = prints.count(), known.count()

    place = [F.col(FILE).alias("file"), F.col(ROW).alias("row")]
    if not kinds:
        return there.select(*place, F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("window")).filter("false")
    docs = there.select(*place, text.alias("text"))
    seen = prints_of(docs.select("file", "row", words_of(F.col("text")).alias("words")), kinds).select("file", "row", F.explode(all_least(kinds)).alias("print"))
    candidates = meet(seen, prints, ["print"], "left_semi", n_prints, ["file", "row"]).select("file", "row").distinct()
    candidates = materialize(candidates, "candidates")

    # the candidates once more: hits with their places, each extended to the windows around it
    again = docs.join(candidates, ["file", "row"], "left_semi")
    rows = prints_of(again.select("file", "row", words_of(F.col("text")).alias("words")), kinds)
    found = None
    for k in kinds:
        reach = k.size - k.gram  # words that a window may have before or after the k-gram
        # the k-gram with the words around it: all that its windows need
        around = F.transform(
            k.chosen(f"grams_{k.size}", f"least_{k.size}"),
            lambda x: F.struct(
                x["print"].alias("print"), F.greatest(x["at"] - reach, F.lit(0)).alias("first"),
                F.slice(F.col("words"), F.greatest(x["at"] - reach, F.lit(0)) + 1, F.least(x["at"], F.lit(reach)) + k.size).alias("near"),
            ),
        )
        hits = rows.select("file", "row", F.inline(around))
        hits = meet(hits, prints, ["print"], "left_semi", n_prints, ["file", "row", "first"])
        starts = F.explode(F.sequence(F.lit(0), F.size("near") - k.size))
        extended = hits.filter(F.size("near") >= k.size).withColumn("from", starts).select(
            "file", "row", (F.col("first") + F.col("from")).alias("at"), F.lit(k.size).alias("size"),
            window_text("near", F.col("from"), k.size).alias("window"),
        )
        found = extended if found is None else found.unionByName(extended)
    same = meet(found, known, ["size", "window"], "left_semi", n_windows, ["file", "row", "at"])
    return materialize(same.distinct(), "hit-windows")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """One row per document: ``key``, n_words, n_hit, n_items, items (sorted ids), spans, contaminated.

    ``spans`` are the maximal runs of hit words, (first word, past the last), in order.
    """
    there = placed(docs)
    windows = materialize(item_windows(benchmark, item, item_text, window), "windows")
    hits = hit_windows(there, windows, carried(docs, text))
    # windows that touch or overlap are one span; a document has no more windows than words
    along = Window.partitionBy("file", "row").orderBy("at", "size")
    ended = F.max(F.col("at") + F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("new", F.coalesce(F.col("at") > ended, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(along))
    runs = runs.groupBy("file", "row", "run").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("size")).alias("end"))
    spans = runs.groupBy("file", "row").agg(
        F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans")
    )
    by_window = hits.select("file", "row", "size", "window").distinct()
    listed = windows.filter("item is not null")
    of_items = meet(by_window, listed, ["size", "window"], "inner", listed.count(), ["file", "row"])
    of_items = of_items.groupBy("file", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(of_items, ["file", "row"], "left")
    n_words = F.regexp_count(whole_text(carried(docs, text)), F.lit(_RAW)).cast("long")
    every = there.select(carried(docs, key).alias("key"), F.col(FILE).alias("file"), F.col(ROW).alias("row"), n_words.alias("n_words"))
    none = F.expr("CAST(array() AS array<struct<first: int, end: int>>)")
    done = every.join(found, ["file", "row"], "left").withColumns({
        "spans": F.coalesce("spans", none), "items": F.coalesce("items", F.expr("CAST(array() AS array<string>)")),
    })
    return done.select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )
