"""Exact top-k by integer inner product through a bit-sliced index.

Every component is floor(scale * x), stored relative to the block's smallest value as bit
slices: bitmap b of a dimension has a row's bit if that row's value has bit b. For a
query, the slices of a dimension are added once for every set bit of the query's
component, negative components with the complement (whose constant is the same for all
rows). Slices of equal weight meet in carry-save adders, three in, a sum and a carry out,
until each weight has one slice: the scores of all rows of the block, bit by bit. The top
rows are then picked from the most significant slice downward. Rows that tie at the end
are the boundary; they are taken in the order of their id, and the scores of the picked
rows are computed exactly as integers.

Blocks come from the scan's own partitions. Queries are dealt into blocks of about
``QUERIES`` by a hash of their id; a block of queries meets a block of rows in one task,
and a task's answer is at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import in_batches

#: Rows of a block of the index, and queries of a block of queries (about).
ROWS, QUERIES = 16384, 1024
SCALE = 64
_WORD = np.dtype("<u8")


def usable(vector: Column) -> Column:
    """Neither null nor empty nor holding null, NaN or an infinity."""
    d = vector.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return d.isNotNull() & (F.size(d) > 0) & ~F.exists(d, bad)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; an error where a score of such vectors might leave 64 bits."""
    d = vector.cast("array<double>")
    most = F.sqrt(F.lit(2.0**62) / F.size(d))
    message = F.lit(f"a component times {scale} is too large: its square times the number of components must stay below 2^62")
    return F.transform(d, lambda x: F.when(F.abs(x * scale) < most, F.floor(x * scale).cast("long")).otherwise(F.raise_error(message).cast("long")))


def bit_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low value of each dimension, its number of slices, all slices) of a rows x dimensions block."""
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    depth = np.array([int(m).bit_length() for m in above.max(axis=0)], dtype=np.int64)
    pad = -len(values) % 64
    rows = [
        np.packbits(np.pad((above[:, d] >> np.uint64(b) & np.uint64(1)).astype(np.uint8), (0, pad)), bitorder="little")
        for d in range(values.shape[1]) for b in range(depth[d])
    ]
    return low, depth, np.array(rows, dtype=np.uint8).reshape(len(rows), (len(values) + pad) // 8).view(_WORD)


def score_slices(query: np.ndarray, depth: np.ndarray, slices: np.ndarray, flipped: np.ndarray) -> list[np.ndarray]:
    """Slices of the inner products, least significant first, up to a constant."""
    first = np.cumsum(depth) - depth
    columns: list[list[np.ndarray]] = []

    def put(weight: int, bitmap: np.ndarray) -> None:
        while len(columns) <= weight:
            columns.append([])
        columns[weight].append(bitmap)

    for d in np.flatnonzero(query):
        source, size = (slices, int(query[d])) if query[d] > 0 else (flipped, -int(query[d]))
        for shift in range(size.bit_length()):
            if size >> shift & 1:
                for b in range(depth[d]):
                    put(shift + b, source[first[d] + b])
    out, weight = [], 0
    while weight < len(columns):
        waiting = columns[weight]
        while len(waiting) > 2:
            a, b, c = waiting.pop(), waiting.pop(), waiting.pop()
            half = a ^ b
            waiting.insert(0, half ^ c)
            put(weight + 1, (a & b) | (half & c))
        if len(waiting) == 2:
            a, b = waiting
            waiting = [a ^ b]
            put(weight + 1, a & b)
        out.append(waiting[0] if waiting else np.zeros(slices.shape[1], dtype=_WORD))
        weight += 1
    return out


def top_rows(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest values among ``allowed``; ties at the boundary in row order."""
    sure, tied = np.zeros_like(allowed), allowed
    for bitmap in reversed(slices):
        high = tied & bitmap
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            tied = high
        else:
            sure, tied = sure | high, tied & ~bitmap
            if n == k:
                break
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    best = rows(sure)
    return np.concatenate([best, rows(tied)[: max(0, k - len(best))]])


def build_index(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """One row per block of at most ``ROWS`` usable vectors of one partition, rows in key order.

    Vectors of different length go to different blocks.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        number = iter(range(1 << 62))

        def block(dims: int) -> pa.RecordBatch:
            rows = sorted(held.pop(dims), key=lambda r: r[0])
            values = np.array([r[1] for r in rows], dtype=np.int64)
            low, depth, slices = bit_slices(values)
            payload = [np.array([r[0] for r in rows], "<i8"), values.astype("<i8"), depth.astype("<i8"), slices]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{TaskContext.get().partitionId()}-{next(number)}"]), pa.array([dims], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in payload]],
                names=["block", "dims", "keys", "items", "depth", "slices"],
            )

        for batch in batches:
            for name, values in zip(batch.column("key").to_pylist(), batch.column("v").to_pylist()):
                held.setdefault(len(values), []).append((name, values))
                if len(held[len(values)]) >= ROWS:
                    yield block(len(values))
        for dims in list(held):
            yield block(dims)

    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("key"), quantised(F.col(vector), scale).alias("v"))
    return in_batches(rows, build, "block string, dims int, keys binary, items binary, depth binary, slices binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, ``key``, score: for each query row its ``k`` best other rows (all, if fewer).

    Ties go to the smaller key. Rows with a null key, and vectors that are null, empty or hold a
    null or non-finite component, take no part. Rows that repeat key and vector count once as a
    query and each as a candidate; rows of the query's own key are never its candidates.
    Vectors of another length than the query's are not compared with it. A vector of d components of which
    one times ``scale`` reaches the square root of 2^62 / d ends the query with an error, because scores are 64-bit integers.
    """
    index = materialize(build_index(vectors, key, vector, scale), "bit-slices")
    asked = materialize(
        vectors.filter(is_query & F.col(key).isNotNull() & usable(F.col(vector)))
        .select(F.col(key).cast("long").alias("query_id"), quantised(F.col(vector), scale).alias("v")).distinct(),
        "queries",
    )
    n_parts = -(-asked.count() // QUERIES) or 1
    parts = (
        asked.withColumn("part", F.pmod(F.xxhash64("query_id", "v"), F.lit(n_parts)).cast("int"))
        .groupBy("part", F.size("v").alias("dims")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    )
    # a stated set of queries against all rows, block by block: every pair of blocks is one row
    blocks = index.select("block", "dims").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    meet = blocks.join(parts, ["part", "dims"]).join(index.drop("dims"), "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                dims = row["dims"].as_py()
                keys = np.frombuffer(row["keys"].as_buffer(), "<i8")
                items = np.frombuffer(row["items"].as_buffer(), "<i8").reshape(-1, dims)
                depth = np.frombuffer(row["depth"].as_buffer(), "<i8")
                slices = np.frombuffer(row["slices"].as_buffer(), _WORD).reshape(int(depth.sum()), -(-len(keys) // 64))
                flipped = ~slices
                full = np.packbits(np.ones(len(keys), np.uint8), bitorder="little")
                everyone = np.pad(full, (0, -len(full) % 8)).view(_WORD)
                out: list[list[np.ndarray]] = [[], [], []]
                for query in row["asked"].as_py():
                    own = query["query_id"]
                    allowed = everyone
                    lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                    if lo < hi:
                        allowed = everyone.copy()
                        for at in range(lo, hi):
                            allowed[at >> 6] &= ~np.uint64(1 << (at & 63))
                    q = np.array(query["v"], dtype=np.int64)
                    best = top_rows(score_slices(q, depth, slices, flipped), allowed, k)
                    out[0].append(np.full(len(best), own))
                    out[1].append(keys[best])
                    out[2].append(items[best] @ q)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["query_id", "key", "score"])

    found = in_batches(meet, search, "query_id long, key long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
