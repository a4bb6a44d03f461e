"""Large text files as chunks of whole lines that know in which state they begin.

Every split of a file is read once, by its own task, from all states of a lexer at once: the result is a table "state at the
start of the split -> state here" for each of its chunks. Runs that reach the same state go on as one, so few are
left after the first lines. One row per split is composed from split to split; then every chunk knows its state,
wherever it lies. Units that lie whole in a chunk are cut there; what reaches over chunks is put together by its
number, counted with the states. Chunks are written once, to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, small_batches

#: Characters of a chunk, and of a split's first one, after which few runs are left.
CHUNK, FIRST_CHUNK = 2_000_000, 50_000
#: Characters of a unit that reaches over chunks; a longer one (a quote that is never closed) is not put together.
LONGEST = 200_000_000
_TABLE = "array<struct<state: int, header: string, closed: bigint, first: int, last: int, mid: int>>"


@dataclass
class Pieces:
    """``whole``: text that begins between units, with file, split, chunk, state, header, and the place ``begins`` in its chunk; ``long``: where a unit is too long."""

    whole: DataFrame
    long: DataFrame


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are but for the line feed, bytes that are no UTF-8 replaced; order is that of the scan."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.make_valid_utf8("value").alias("line")
    )


def tables_of(lines: DataFrame, lexer) -> DataFrame:
    """file, split, chunk, text and its table; the last row of a split has no text and the states at the end."""
    size, first_size = CHUNK, FIRST_CHUNK
    small_batches(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[str] = []
        length = chunk = 0
        now: list[tuple] = []  # state, header, units closed so far; by the state at the start of the split

        def rows(found: list[tuple]) -> pa.RecordBatch:
            names = ("state", "header", "closed", "first", "last", "mid")
            tables = [[dict(zip(names, t)) for t in table] for _, _, table in found]
            kind = pa.list_(pa.struct([("state", pa.int32()), ("header", pa.string()), ("closed", pa.int64()), *[(n, pa.int32()) for n in names[3:]]]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]] * len(found), pa.string()), pa.array([key[1]] * len(found), pa.int64()), pa.array([c for c, _, _ in found], pa.int64()),
                    pa.array([t for _, t, _ in found], pa.string()), pa.array(tables, kind),
                ],
                names=["file", "split", "chunk", "text", "table"],
            )

        def flush() -> tuple:
            nonlocal held, length, chunk, now
            text = "\n".join(held) + "\n"
            scans = {s: lexer.scan(text, s) for s in {t[0] for t in now}}
            table = [(s, h, c, scans[s].first, scans[s].last, scans[s].mid) for s, h, c in now]
            # a block that goes on keeps the header it began with
            now = [(scans[s].state, h if scans[s].header is None and scans[s].state == s else scans[s].header, c + (scans[s].first >= 0)) for s, h, c in now]
            held, length, chunk = [], 0, chunk + 1
            return chunk - 1, text, table

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                yield rows([flush()])
            yield rows([(chunk, None, [(s, h, c, 0, 0, 0) for s, h, c in now])])

        for batch in batches:
            for file, split, line in zip(*[batch.column(c).to_pylist() for c in ("file", "split", "line")]):
                if (file, split) != key:
                    if key is not None:
                        yield from end()
                    key, chunk, held, length = (file, split), 0, [], 0
                    now = [(s, None, 0) for s in (range(len(lexer.states)) if split else [lexer.start])]
                held.append(line)
                length += len(line) + 1
                if length >= (first_size if split and not chunk else size):
                    yield rows([flush()])
        if key is not None:
            yield from end()

    return lines.mapInArrow(run, f"file string, split bigint, chunk bigint, text string, table {_TABLE}")


def _composed(lexer):
    start = lexer.start

    def run(table: pa.Table) -> pa.Table:
        """Of one file, a row per split: the states at the starts of its splits, one after another."""
        rows = sorted(table.select(["file", "split", "table"]).to_pylist(), key=lambda r: r["split"])
        state, header, base, out = start, None, 0, []
        for r in rows:
            out.append((r["file"], r["split"], state, header, base))
            found = r["table"][state if r["split"] else 0]
            state, base = found["state"], base + found["closed"]
            header = header if found["header"] is None else found["header"]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()))]
        return pa.table(columns, names=["file", "split", "entry", "entry_header", "base"])

    return run


def pieces(spark: SparkSession, path: str, lexer, lines: DataFrame | None = None) -> Pieces:
    """The text of files in pieces that begin between two units of ``lexer``."""
    tables = materialize(tables_of(read_lines(spark, path) if lines is None else lines, lexer), "chunks")
    ends = tables.filter("text is null").select("file", "split", "table")
    entries = materialize(
        ends.groupBy("file").applyInArrow(_composed(lexer), "file string, split bigint, entry int, entry_header string, base bigint"), "chunk-states"
    )
    known = tables.filter("text is not null").join(entries, ["file", "split"])
    known = known.withColumn("t", F.get("table", F.when(F.col("split") > 0, F.col("entry")).otherwise(0)))
    known = known.select(
        "file", "split", "chunk", "text", "t.first", "t.last", F.col("t.mid").alias("state"), F.coalesce("t.header", "entry_header").alias("header"),
        (F.col("base") + F.col("t.closed")).alias("unit"),
    )
    inside = known.filter("last > first").select(
        "file", "split", "chunk", F.expr("substring(text, first + 1, last - first)").alias("text"), "state", F.when(F.col("first") == 0, F.col("header")).otherwise("").alias("header"), F.col("first").alias("begins")
    )
    def part(rows: DataFrame, text: str, unit: str, begins: str) -> DataFrame:
        return rows.select("file", "split", "chunk", F.expr(text).alias("text"), F.expr(unit).alias("unit"), F.expr(begins).alias("begins"))

    parts = part(known.filter("first < 0"), "text", "unit", "0").unionByName(part(known.filter("first > 0"), "substring(text, 1, first)", "unit", "0"))
    parts = parts.unionByName(part(known.filter("first >= 0"), "substring(text, last + 1)", "unit + 1", "last")).filter("text <> ''")
    sizes = parts.groupBy("file", "unit").agg(F.sum(F.length("text").cast("bigint")).alias("size"))
    short = parts.join(sizes.filter(F.col("size") <= LONGEST).select("file", "unit"), ["file", "unit"], "left_semi")
    joined = short.groupBy("file", "unit").agg(F.array_sort(F.collect_list(F.struct("split", "chunk", "text", "begins"))).alias("parts"))
    across = joined.select(
        "file", F.get("parts", F.lit(0))["split"].alias("split"), F.get("parts", F.lit(0))["chunk"].alias("chunk"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.lit(lexer.start).alias("state"), F.lit(None).cast("string").alias("header"), F.get("parts", F.lit(0))["begins"].alias("begins"),
    )
    long = parts.join(sizes.filter(F.col("size") > LONGEST), ["file", "unit"]).groupBy("file", "unit").agg(
        F.max("size").alias("size"), F.min_by(F.substring("text", 1, 1000), F.struct("split", "chunk")).alias("begins")
    )
    return Pieces(inside.unionByName(across), long)
