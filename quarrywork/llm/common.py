"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

_HOLDER = "_quarrywork_process"
#: Texts of one piece of work in a task, in bytes.
WORK_BYTES = 6 << 20


def in_batches(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow`` with batches of some megabytes, whatever the length of the rows.

    The bound is a setting of the session; a smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = rows.sparkSession.conf
    if not re.fullmatch(r"\d+b?", conf.get(key)) or int(conf.get(key).rstrip("b")) > WORK_BYTES:
        conf.set(key, str(WORK_BYTES))
    return rows.mapInArrow(function, schema)


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """One object per Python worker process and key.

    Spark keeps worker processes from task to task, while functions that travel by value
    start with fresh globals; a loaded model or a cache of encoded words is kept here.
    """
    holder = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER))
    kept = vars(holder).setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def whole_text(column: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: the fold a row belongs to."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def pieces_of_work(batches: Iterator[pa.RecordBatch], column: str, most: int = WORK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``most`` bytes of ``column``.

    Small batches are put together, large ones cut; a text longer than that is a batch alone.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.to_batches()[0] if table.num_rows else held[0]

    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
        at = done = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(ends, done + most - size, side="right")))
            part = batch.slice(at, until - at)
            held.append(part)
            size += int(ends[until - 1]) - done
            at, done = until, int(ends[until - 1])
            if size >= most or at < batch.num_rows:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()
    held = []
    pa.default_memory_pool().release_unused()


def term_table(digits: bool) -> bytes:
    """For ``terms_of``: ASCII letters lowered, digits kept if wanted, all other ASCII characters a space."""
    kept = set(range(97, 123)) | (set(range(48, 58)) if digits else set())
    return bytes(b + 32 if 65 <= b <= 90 else b if b in kept or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array, table: bytes) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Number of terms of each text (null: none), and all terms one after another, as a dictionary array.

    A term is a run of what ``table`` keeps; one pass over the bytes of the batch, which keeps UTF-8 valid.
    """
    texts = pa.array(texts.fill_null(""), pa.large_string()) if not pa.types.is_large_string(texts.type) else texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    plain = (body.slice(lo, hi - lo).to_pybytes() if body is not None else b"").translate(table)
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - lo).tobytes()), pa.py_buffer(plain))
    lists = pc.ascii_split_whitespace(clean)
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    words = pc.list_flatten(lists)
    filled = np.asarray(pc.binary_length(words)) > 0
    if not filled.all():  # a text that starts or ends with a space has an empty first or last word
        owner = np.repeat(np.arange(len(counts)), counts)[~filled]
        counts = counts - np.bincount(owner, minlength=len(counts))
        words = words.filter(pa.array(filled))
    words = pc.dictionary_encode(words)
    return counts, words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words


def ragged_take(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """``flat[start:start + length]`` for every pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(total)]


def table_of(schema: pa.Schema, **columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def passed(docs: DataFrame) -> dict[str, Column]:
    """All columns of ``docs`` under names of our own, to be carried through a function."""
    return {f"__c{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns)}


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The carried columns under their own names again."""
    return rows.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(columns)])


#: The content locator of a row: its file and its place in that file.
FILE, ROW = "__place_file", "__place_row"


def carried(docs: DataFrame, column: str) -> Column:
    """The column of ``docs`` in ``placed(docs)`` or ``passed``."""
    return F.col(f"__c{docs.columns.index(column)}")


def placed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` under names of our own, and each row's locator in ``FILE`` and ``ROW``.

    No column name clashes, ``_metadata`` neither. A frame that is not read from files as it stands is written to
    the shared folder first.
    """

    def located(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
        place = rows.metadataColumn("_metadata")
        return rows.select(*[c.alias(n) for n, c in columns.items()], place["file_path"].alias(FILE), place["row_index"].alias(ROW))

    try:
        return located(docs, passed(docs))
    except AnalysisException:
        rows = materialize(docs.select(*[c.alias(n) for n, c in passed(docs).items()]), "placed")
        return located(rows, {c: F.col(c) for c in rows.columns})


def without(rows: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``placed`` documents that are not among ``dropped`` (file, row), under their own names."""
    gone = dropped.select(F.col("file").alias(FILE), F.col("row").alias(ROW))
    return restored(rows.join(gone, [FILE, ROW], "left_anti"), columns)


#: Keys that may count as hot: the broadcast side of ``join_hot`` has no more rows.
HOT_KEYS = 100_000
#: Rows of a key that are never hot.
FEW_ROWS = 1_000


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``by_key``, which has one row per ``key`` and says in ``size`` how many ``rows`` have it.

    A key is hot above a ``HOT_KEYS``-th of all rows; so there are at most ``HOT_KEYS`` hot ones, which are
    broadcast, and a task of the shuffled rest meets few rows of any one key. Both frames should be written tables.
    """
    total = by_key.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > max(FEW_ROWS, total // HOT_KEYS)
    hot = F.broadcast(by_key.filter(is_hot))
    rest = rows.join(hot.select(key), key, "left_anti").join(by_key.filter(~is_hot), key)
    return rows.join(hot, key).unionByName(rest)


#: Rows of a small side that may be broadcast, about 100 bytes each.
BROADCAST = 1_000_000
#: Shares of a key beyond that.
SALTS = 16


def meet(rows: DataFrame, few: DataFrame, keys: list[str], how: str, n: int, spread: list[str]) -> DataFrame:
    """``rows`` joined with the ``n`` rows of ``few``: broadcast while they are few, salted by ``spread`` beyond."""
    if n <= BROADCAST:
        return rows.join(F.broadcast(few), keys, how)
    dealt = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, [*keys, "salt"], how).drop("salt")
