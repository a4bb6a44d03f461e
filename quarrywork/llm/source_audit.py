"""How the words of the sources of a language differ from the language and from each other.

Terms are runs of letters (ASCII letters, A-Z lowered, and all characters beyond ASCII). A language keeps its V terms
that are in at least ``MIN_DOCUMENTS`` of its documents. A group (language and source) or a language gives a kept term of
count c the weight p = 1 + floor(10^9 (c + 2) / (N + 2 V)), N its count of all kept terms; two weights differ by
f = floor((p - q)^2 / (p + q)). All of it is exact: whole numbers, products in decimals.

Counts. A task adds up (language, source, term) in Arrow and passes on at most ``HELD`` rows at a time; one exchange by (language, term)
gives counts, counts over the language, and the number of documents. No group meets in one task.

Terms of a group: a dominance skyband. f grows with the group's count and falls with the language's while p > q. So a
term is surpassed by any with no smaller group count, no larger language count and an earlier name (UTF-8), and
one that ``best`` others surpass cannot be among the first ``best``. Each partition keeps what fewer than ``best`` others
of it surpass; what is left of a group meets once more, is reduced again, then ranked by exact f. Within a partition terms come
in order of their names; a term is compared with those kept before, which suffices: whoever surpasses a dropped term's
victim surpasses the victim.

Pairs of sources. All are asked for. A table of sources by terms is cut into blocks of ``SOURCES`` sources and about
``TERMS`` terms; a pair of blocks is a task's table, where terms that occur in neither source are left to one product at the
end, because their f is the same.

Null language, source and text count as empty strings. Texts without a term, and groups of such texts, count as groups:
all their counts are 0. A language without a kept term has pairs of value 0 and no terms. Repeated rows count each. No
other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import in_batches, pieces_of_work, term_table, terms_of

MIN_DOCUMENTS = 10
#: Rows of counts that a task holds before it passes them on.
HELD = 500_000
#: Sources and (about) terms of one table of weights.
SOURCES, TERMS = 128, 2048
#: Terms that the sweep compares at once.
CHUNK = 512
_TABLE = term_table(digits=False)
_NAMES = ["lang", "source", "term", "n", "docs"]


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n and docs of the texts of a batch."""
    counts, words = terms_of(batch.column("text"), _TABLE)
    lang, source = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "source"))
    n_sources, n_words = max(1, len(source.dictionary)), max(1, len(words.dictionary))
    group = np.asarray(lang.indices, dtype=np.int64) * n_sources + np.asarray(source.indices)
    owner, word = np.repeat(np.arange(len(counts)), counts), np.asarray(words.indices, dtype=np.int64)
    in_document, times = np.unique(owner * n_words + word, return_counts=True)
    cell = group[in_document // n_words] * n_words + in_document % n_words
    cells, where = np.unique(cell, return_inverse=True)
    group_of = cells // n_words
    return pa.table([
        lang.dictionary.take(pa.array(group_of // n_sources)).cast(pa.string()), source.dictionary.take(pa.array(group_of % n_sources)).cast(pa.string()),
        words.dictionary.take(pa.array(cells % n_words)).cast(pa.string()),
        pa.array(np.bincount(where, weights=times, minlength=len(cells)).astype(np.int64)), pa.array(np.bincount(where, minlength=len(cells)).astype(np.int64)),
    ], names=_NAMES)


def added(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return total.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_NAMES)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = 0
        for batch in pieces_of_work(batches, "text"):
            parts.append(batch_counts(batch))
            rows += parts[-1].num_rows
            if rows > 2 * HELD:
                parts = [added(parts)]
                rows = parts[0].num_rows
                if rows > HELD:
                    yield from parts[0].to_batches(max_chunksize=1 << 16)
                    parts, rows = [], 0
        if parts:
            yield from added(parts).to_batches(max_chunksize=1 << 16)

    return in_batches(docs, count, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_documents: int) -> DataFrame:
    """lang, source, term, n, lang_n, and ``one``, which is 1 in one row of each term of a language."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    every = counts.withColumns({
        "lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term),
        "one": (F.col("source") == F.min("source").over(of_term)).cast("int"),
    })
    return materialize(every.filter(F.col("lang_docs") >= min_documents).drop("lang_docs", "docs"), "kept-terms")


def weight(count: str, total: str) -> Column:
    return F.expr(f"1 + (CAST({count} + 2 AS DECIMAL(20, 0)) * 1000000000) div (CAST({total} AS DECIMAL(20, 0)) + 2 * v)")


DIFFERENCE = "((p - q) * (p - q)) div (p + q)"


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, lang_total and v of every group, and idx, its place among its language's."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("one").alias("v"))
    every = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    every = every.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "lang_total", "v")})
    in_lang = Window.partitionBy("lang")
    placed = every.withColumns({"idx": F.row_number().over(in_lang.orderBy("source")) - 1, "sources": F.count("*").over(in_lang)})
    return materialize(placed, "groups")


class Sweep:
    """What fewer than ``best`` earlier terms surpass, of terms that come in order of their names."""

    def __init__(self, best: int):
        self.best = best
        self.n = self.lang_n = np.zeros(0, dtype=np.int64)

    def add(self, n: np.ndarray, lang_n: np.ndarray) -> np.ndarray:
        """Which of the next terms stay."""
        stays = np.zeros(len(n), dtype=bool)
        for lo in range(0, len(n), CHUNK):
            own_n, own_lang = n[lo : lo + CHUNK], lang_n[lo : lo + CHUNK]
            before = ((self.n[:, None] >= own_n) & (self.lang_n[:, None] <= own_lang)).sum(axis=0)
            beside = np.triu((own_n[:, None] >= own_n) & (own_lang[:, None] <= own_lang), 1).sum(axis=0)
            stay = before + beside < self.best
            stays[lo : lo + CHUNK] = stay
            self.n, self.lang_n = np.concatenate([self.n, own_n[stay]]), np.concatenate([self.lang_n, own_lang[stay]])
        return stays


def skyband(rows: DataFrame, best: int) -> DataFrame:
    """Of lang, source, term, n, lang_n the rows that fewer than ``best`` others of their group in their partition surpass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sweep = None, Sweep(best)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c) for c in ("lang", "source")]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in names:
                new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)))
            starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            n, lang_n = np.asarray(batch.column("n")), np.asarray(batch.column("lang_n"))
            stays = []
            for lo, hi in zip(starts, starts[1:]):
                own = tuple(c[lo].as_py() for c in names)
                if own != group:
                    group, sweep = own, Sweep(best)
                stays.append(sweep.add(n[lo:hi], lang_n[lo:hi]))
            yield batch.filter(pa.array(np.concatenate(stays)))

    columns = ["lang", "source", "term", "n", "lang_n"]
    return in_batches(rows.select(*columns).sortWithinPartitions("lang", "source", "term"), run, "lang string, source string, term string, n long, lang_n long")


def term_part(kept: DataFrame, groups: DataFrame, best: int) -> DataFrame:
    band = materialize(skyband(kept, best), "skybands")
    merged = skyband(band.repartition("lang", "source"), best)
    weighed = merged.join(groups, ["lang", "source"]).withColumns({"p": weight("n", "total"), "q": weight("lang_n", "lang_total")}).filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    valued = weighed.select("lang", "source", F.col("term").alias("item"), F.expr(DIFFERENCE).alias("value"))
    return valued.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_pairs(table: pa.Table) -> pa.Table:
    """x, y (names of sources), part: the sum over the terms of this table of f less the f of a term in neither source; flat: v times that f."""
    term = table.column("term")
    is_base = np.asarray(pc.is_null(term))
    block, idx, p = (np.asarray(table.column(c)) for c in ("block", "idx", "p"))
    a, b = int(table.column("a")[0].as_py()), int(table.column("b")[0].as_py())
    sides, bases, names = [], [], []
    cells = table.filter(pa.array(~is_base))
    words = pc.dictionary_encode(cells.column("term").combine_chunks())
    code = np.asarray(words.indices)
    for side in dict.fromkeys((a, b)):
        at = np.flatnonzero(is_base & (block == side))
        at = at[np.argsort(idx[at])]
        base = p[at]
        weights = np.repeat(base[:, None], len(words.dictionary), axis=1)
        own = block[~is_base] == side
        weights[np.searchsorted(idx[at], idx[~is_base][own]), code[own]] = p[~is_base][own]
        sides.append(weights)
        bases.append(base)
        names.append(table.column("source").take(pa.array(at)).to_pylist())
    v = int(table.column("v")[0].as_py())
    out: list[list] = [[], [], [], []]
    for i in range(len(bases[0])):
        rest = slice(i + 1, None) if a == b else slice(None)
        alike = difference(bases[0][i], bases[-1][rest])
        sums = difference(sides[0][i], sides[-1][rest]).sum(axis=1) - alike * len(words.dictionary)
        out[0] += [names[0][i]] * len(sums)
        out[1] += names[-1][rest]
        out[2] += sums.tolist()
        out[3] += (alike * v).tolist()
    lang = [table.column("lang")[0].as_py()] * len(out[0])
    return pa.table([pa.array(lang, pa.string()), *[pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()))]], names=["lang", "x", "y", "part", "flat"])


def pair_part(kept: DataFrame, groups: DataFrame) -> DataFrame:
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int")
    block = F.floor(F.col("idx") / SOURCES).cast("int")
    every = groups.filter("sources > 1").withColumns({"buckets": buckets, "block": block, "blocks": F.ceil(F.col("sources") / SOURCES).cast("int")})
    shape = ["lang", "source", "term", "bucket", "block", "blocks", "idx", "p", "v"]
    cells = kept.select("lang", "source", "term", "n").join(every, ["lang", "source"])
    cells = cells.withColumns({"p": weight("n", "total"), "bucket": F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")}).select(*shape)
    base = F.when(F.col("v") > 0, F.expr("1 + (2 * 1000000000BD) div (CAST(total AS DECIMAL(20, 0)) + 2 * v)")).otherwise(F.lit(1))
    bases = every.withColumns({
        "term": F.lit(None).cast("string"), "p": base.cast("long"), "bucket": F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)),
    }).select(*shape)
    rows = cells.unionByName(bases).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other", "blocks")
    parts = rows.groupBy("lang", "bucket", "a", "b").applyInArrow(block_pairs, "lang string, x string, y string, part long, flat long")
    sums = parts.groupBy("lang", "x", "y").agg((F.sum("part") + F.max("flat")).alias("value"))
    sums = materialize(sums, "pairs")
    both = sums.select("lang", F.col("x").alias("source"), F.col("y").alias("item"), "value").unionByName(
        sums.select("lang", F.col("y").alias("source"), F.col("x").alias("item"), "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order))


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_documents: int = MIN_DOCUMENTS, best: int = 10
) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (part ``pair``) and the ``best`` terms (part ``term``)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])
    kept = kept_terms(rows, min_documents)
    groups = groups_of(rows, kept)
    pairs = pair_part(kept, groups).withColumn("part", F.lit("pair"))
    terms = term_part(kept, groups, best).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
