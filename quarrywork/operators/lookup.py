"""First matching key of a large table of keys, by a multi-pattern automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .ordered import PART, balanced, running_sum

#: Characters of the keys, and 16 for each key, that one automaton holds (21 bytes each, measured on random keys of 24
#: characters); a longer table becomes several automata.
CHARACTERS = 4_000_000
_PER_KEY = 16


def matcher(keys: list[tuple[str, str | None]]) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    """Scan over batches of texts for the first of ``keys`` (needle, answer) that each text contains."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton, always = ahocorasick.Automaton(), None
        for place, (needle, _) in enumerate(keys):
            if needle:
                automaton.add_word(needle, place)
            else:
                always = place
        automaton.make_automaton()
        built = automaton.kind == ahocorasick.AHOCORASICK

        def first(text: str | None) -> int | None:
            if text is None:
                return None
            best = always
            for _, place in automaton.iter(text) if built else ():
                if best is None or place < best:
                    best = place
                    if not best:
                        break
            return best

        for texts in batches:
            found = [first(t) for t in texts]
            yield pd.DataFrame({
                "found": [p is not None for p in found],
                "answer": pd.Series([None if p is None else keys[p][1] for p in found], dtype=object),
            })

    return scan


def in_blocks(table: DataFrame, order: list[str], characters: int) -> tuple[DataFrame, int]:
    """The distinct keys, written with the number of their block, and how many blocks there are."""
    usable = table.filter(F.col("needle").isNotNull())
    once = usable.groupBy("needle").agg(F.min(F.struct(*order, "answer")).alias("_first")).select("needle", "_first.*")
    by = [F.col(c) for c in (*order, "needle")]
    summed = running_sum(
        balanced(once, [], by, "lookup-order"), [], F.col(PART), by, {"_upto": F.length("needle").cast("bigint") + _PER_KEY}
    )
    before = F.col("_upto") - F.length("needle") - _PER_KEY
    block = F.floor(before / characters).cast("int")
    written = materialize(summed.select(*order, "needle", "answer", block.alias("_block")), "lookup-keys")
    last = written.agg(F.max("_block")).first()[0]
    return written, 0 if last is None else last + 1


def first_match(
    rows: DataFrame, text: Column, table: DataFrame, order: list[str], name: str = "answer", characters: int = CHARACTERS
) -> DataFrame:
    """``rows`` with the answer of the first key, in ``order``, that the lower-cased text contains.

    ``table``: needle (as it stands in lower-cased text), answer, and the columns of ``order``. Each text is
    read once for all keys of an automaton. The table is cut, in order, into blocks of about ``characters``
    (one key may pass that); only one block is on the driver and in a task at a time, and a text that a
    block has answered is not read again, so a table of any length gives the same answers.

    A null text gets null, and so does a text without a match. A null needle never matches, an empty one
    matches every text. Of equal needles the first in ``order`` counts, then the smallest answer; keys at
    the same place rank by their needle. Columns of ``rows`` keep their values; ``name`` must be free.
    """
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name} already")
    keys, blocks = in_blocks(table, order, characters)
    hit = name
    while hit in rows.columns or hit == name:
        hit = f"_{hit}"
    out = rows.withColumn(hit, F.struct(F.lit(False).alias("found"), F.lit(None).cast("string").alias("answer")))
    for block in range(blocks):
        ranked = keys.filter(F.col("_block") == block).orderBy(*order, "needle").select("needle", "answer").collect()
        scan = F.pandas_udf(matcher([tuple(r) for r in ranked]), "found boolean, answer string")
        answered = F.col(f"`{hit}`.found")
        open_text = F.when(~answered, F.lower(text))
        out = out.withColumn(hit, F.when(answered, F.col(f"`{hit}`")).otherwise(scan(open_text)))
        if block + 1 < blocks:
            out = materialize(out, "lookup-block")
    return out.withColumn(name, F.col(f"`{hit}`.answer")).drop(hit)
