"""Documents to chunks. Chunking is row-wise: no strategy needs an exchange.

Sizes are tokens of about four characters. Every strategy returns rows
``(*keep, idx, text, token_count, char_count, start_char, end_char)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import packers
from ..functions.numbers import half_up
from ..functions.textstats import estimate_tokens
from ..session import small_batches

CHUNK_SCHEMA = (
    "array<struct<idx:int,text:string,token_count:int,char_count:int,start_char:int,end_char:int>>"
)
MIN_SIZE, MAX_SIZE = 64, 8192


def clamp(size: int, overlap: int) -> tuple[int, int]:
    size = max(MIN_SIZE, min(size, MAX_SIZE))
    return size, max(0, min(overlap, size // 2))


def _not_blank(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?U)\S"))


def chunk_fixed(docs: DataFrame, text: str, keep: list[str], size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of exactly ``4 * size`` characters every ``4 * (size - overlap)``.

    With overlap the last ``4 * overlap`` characters also form a closing chunk. The
    window starts are a closed form, and one regular expression with a look-ahead
    yields every window in a single pass over the text.
    """
    size, overlap = clamp(size, overlap)
    width, back = 4 * size, 4 * overlap
    step = width - back
    n = F.col("_n")
    last = F.greatest(F.lit(0), F.ceil((n - width) / F.lit(step)).cast("int"))
    windows = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{1,{width}}})).{{1,{step}}}"), F.lit(1))
    body = F.transform(
        F.slice(windows, 1, last + 1),
        lambda w, i: F.struct(i.alias("idx"), w.alias("text"), (i * step).alias("start_char")),
    )
    tail_start = n - back
    tail = F.when(
        (F.lit(back) > 0) & (tail_start > last * step),
        F.array(F.struct((last + 1).alias("idx"), F.right(F.col(text), F.lit(back)).alias("text"),
                         tail_start.alias("start_char"))),
    ).otherwise(F.array().cast("array<struct<idx:int,text:string,start_char:int>>"))
    rows = (
        docs.select(*keep, text, F.length(text).alias("_n"))
        .filter(_not_blank(F.col(text)))
        .select(*keep, F.inline(F.concat(body, tail)))
    )
    return rows.select(
        *keep, "idx", "text", estimate_tokens(F.col("text")).alias("token_count"),
        F.length("text").alias("char_count"), "start_char",
        (F.col("start_char") + F.length("text")).alias("end_char"),
    )


def running_starts(lengths: Column) -> Column:
    """Where each part begins, and where the last one ends: the running sums of the lengths, in one pass."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n))


def chunk_token(docs: DataFrame, text: str, keep: list[str], size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` word tokens with character offsets.

    A token is a word with the white space after it (leading white space is its own
    token), so joining tokens gives the text back. The run stops at the text's end.
    """
    size, overlap = clamp(size, overlap)
    step = size - overlap
    toks = F.col("_toks")
    count = F.size(toks)
    last = F.greatest(F.lit(0), F.ceil((count - size) / F.lit(step)).cast("int"))
    cell_lengths = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.length(F.array_join(F.slice(toks, i * step + 1, F.lit(step)), "")),
    )
    tokenized = docs.filter(_not_blank(F.col(text))).select(
        *keep, F.regexp_extract_all(F.col(text), F.lit(r"(?U)\S+\s*|\s+"), F.lit(0)).alias("_toks")
    )
    cells = tokenized.select(*keep, "_toks", running_starts(cell_lengths).alias("_starts"), last.alias("_last"))
    chunk = F.transform(
        F.sequence(F.lit(0), F.col("_last")),
        lambda i: F.struct(
            i.alias("idx"),
            F.array_join(F.slice(toks, i * step + 1, F.lit(size)), "").alias("text"),
            F.least(F.lit(size), count - i * step).alias("token_count"),
            F.get("_starts", i).alias("start_char"),
        ),
    )
    rows = cells.select(*keep, F.inline(chunk))
    return rows.select(
        *keep, "idx", "text", "token_count", F.length("text").alias("char_count"), "start_char",
        (F.col("start_char") + F.length("text")).alias("end_char"),
    )


def _packer(strategy: str, size: int, overlap: int):
    cut = packers.STRATEGIES[strategy]

    def chunks_of(text: str | None) -> list[tuple]:
        if text is None or not text.strip():
            return []
        return [(i, t, packers.estimate(t), len(t), low, high) for i, (t, low, high) in enumerate(cut(text, size, overlap))]

    @F.arrow_udf(CHUNK_SCHEMA)
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"idx": pa.int32(), "text": pa.string(), "token_count": pa.int32(), "char_count": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32()}
        for batch in batches:
            ends, found = [0], []
            for text in batch:
                found.extend(chunks_of(text.as_py()))
                ends.append(len(found))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=list(kinds)))

    return split


def chunk_packed(
    docs: DataFrame, text: str, keep: list[str], strategy: str, size: int = 512, overlap: int = 50
) -> DataFrame:
    """The strategies whose next cut depends on the last one, as an Arrow UDF over small batches of documents."""
    size, overlap = clamp(size, overlap)
    small_batches(docs.sparkSession)
    split = _packer(strategy, size, overlap)
    return docs.select(*keep, split(F.col(text)).alias("_chunks")).select(*keep, F.inline("_chunks"))


def chunk_documents(
    docs: DataFrame, text: str, keep: list[str], size: int = 512, overlap: int = 50, strategy: str = "token"
) -> DataFrame:
    """Chunk by strategy name; an unknown name falls back to ``character``."""
    if strategy == "fixed_size":
        return chunk_fixed(docs, text, keep, size, overlap)
    if strategy == "token":
        return chunk_token(docs, text, keep, size, overlap)
    return chunk_packed(docs, text, keep, strategy if strategy in packers.STRATEGIES else "character", size, overlap)


def mark_oversize(chunks: DataFrame, size: int = 512) -> DataFrame:
    """Flag chunks a packer had to emit whole although they exceed the size."""
    return chunks.withColumn("is_oversize", F.col("char_count") > 4 * clamp(size, 0)[0])


def chunk_stats(chunks: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks, tokens and the averages of each document."""
    per_doc = chunks.groupBy(key).agg(
        F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens")
    )
    sized = docs.select(key, F.length(text).alias("total_characters"))
    joined = per_doc.join(sized, key)
    return joined.select(
        key, "total_chunks", "total_tokens", "total_characters",
        half_up(F.col("total_tokens").cast("double") / F.col("total_chunks"), 1).alias("average_chunk_tokens"),
        half_up(F.col("total_characters").cast("double") / F.col("total_chunks"), 1).alias("average_chunk_chars"),
    )


ROOT_SECTION = "Document Root"
HEADER_LINE = r"(?dUm)^#{1,6}\s+.+$"


def headers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown headers with their character position: ``(key, pos, level, title)``."""
    found = F.regexp_extract_all(F.col(text), F.lit(HEADER_LINE), F.lit(0))
    between = F.split(F.col(text), HEADER_LINE)
    # a header begins where the gap before it ends; gaps and headers take turns
    passed = running_starts(F.zip_with(F.slice("_gaps", F.lit(1), F.size("_found")), "_found", lambda g, h: F.length(g) + F.length(h)))
    place = F.transform("_found", lambda h, i: F.get("_passed", i) + F.length(F.get("_gaps", i)))
    rows = (
        docs.select(key, found.alias("_found"), between.alias("_gaps"))
        .filter(F.size("_found") > 0)
        .withColumn("_passed", passed)
        .select(key, F.inline(F.arrays_zip(place.alias("pos"), F.col("_found").alias("line"))))
    )
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})", 1))
    return rows.select(
        key, "pos", marks.alias("level"),
        F.regexp_replace("line", r"(?U)^#{1,6}\s+|\s+\z", "").alias("title"),
    )


def chunk_headers(docs: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Give every chunk the path of headers in force where it starts.

    Headers and chunk starts are laid out in document order; for each level the last
    header of that level or above is carried forward, and it counts when it is of
    exactly that level. One ordered pass, no pairing of headers with chunks.
    """
    marks = headers(docs, key, text).select(
        key, "pos", F.lit(0).alias("kind"), "level", "title", F.lit(None).cast("int").alias("idx")
    )
    starts = chunks.select(
        key, F.col("start_char").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("title"), "idx",
    )
    order = Window.partitionBy(key).orderBy("pos", "kind", "idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.unionByName(starts)
    for level in range(1, 7):
        seen = F.when(F.col("level") <= level, F.struct("level", "title"))
        rows = rows.withColumn(f"_h{level}", F.last(seen, ignorenulls=True).over(order))
    path = F.array_compact(
        F.array(*[F.when(F.col(f"_h{n}.level") == n, F.col(f"_h{n}.title")) for n in range(1, 7)])
    )
    section = F.when(F.size("header_context") > 0, F.array_join("header_context", " > ")).otherwise(ROOT_SECTION)
    return (
        rows.filter(F.col("kind") == 1)
        .select(key, "idx", F.col("pos").alias("start_char"), path.alias("header_context"))
        .withColumn("section", section)
    )
