"""A compressed file format for token ids: canonical Huffman code words in independent blocks.

Layout below one folder, all Parquet, so that any store Spark writes to will do:

* ``blocks``: one row per block of at most ``BLOCK`` ids: shard, first (ids of the shard
  before it), n_ids, payload, checkpoints (bit offset of every 256th id, 32-bit little
  endian) and the pieces of documents in it (key, start of the document in the shard,
  its length, where the piece begins in it, length). Any block can be decoded alone.
* ``codebook``: id and code length; canonical order defines the code words.
* ``shards``: shard and the number of ids in all shards before it.

Shards are ranges of the key, ascending; ids run in ascending key order through them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize, shared_path
from .common import in_batches, pieces_of_work
from .huffman import Code, canonical, code_lengths, pack_bits, unpack_bits
from .packing import with_end
from .words import words_of

BLOCK = 1 << 16
#: Payload bytes decoded side by side.
DECODE_BYTES = 4 << 20
_POLY = 0xEDB88320
_PIECES = "starts array<long>, doc_tokens array<long>, froms array<long>, sizes array<long>"


def crc_shift(crc: int, n_bytes: int) -> int:
    """The crc's share in that of a longer string: ``crc`` advanced over ``n_bytes`` that follow.

    crc32(a + b) == crc_shift(crc32(a), len(b)) ^ crc32(b): polynomials modulo the CRC's own,
    bit-reflected; the factor x**(8 n) comes from repeated squaring.
    """

    def times(a: int, b: int) -> int:
        product = 0
        while b:
            if b & 0x80000000:
                product ^= a
            a = (a >> 1) ^ (_POLY if a & 1 else 0)
            b = b << 1 & 0xFFFFFFFF
        return product

    power, square, n = 0x80000000, 0x00800000, n_bytes  # 1, x**8
    while n:
        if n & 1:
            power = times(power, square)
        square = times(square, square)
        n >>= 1
    return times(crc, power)


def _narrow(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, vocabulary: int) -> DataFrame:
    """Blocks of plain ids, in ascending key order within and across shards (null keys first).

    Rows of equal key are ordered by their text's hash, so a repeated task makes the same blocks.
    """
    kind = docs.schema[key].dataType.simpleString()
    width = _narrow(vocabulary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0  # ids of the shard so far
        for batch in pieces_of_work(batches, "text"):
            counts, ids = words_of(tokenizer).encode(batch.column("text"))
            ids, ends = with_end(counts, ids, end_id)
            begins = np.concatenate([[0], ends[:-1]])
            rows = []
            for lo in range(0, len(ids), BLOCK):
                hi = min(lo + BLOCK, len(ids))
                a, b = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(begins, hi))
                starts, stops = begins[a:b], ends[a:b]
                froms = np.maximum(lo - starts, 0)
                rows.append({
                    "shard": batch.column("shard")[0], "first": done + lo, "n_ids": hi - lo, "ids": ids[lo:hi].astype(width).tobytes(),
                    "keys": batch.column("key").slice(a, b - a).to_pylist(), "starts": done + starts,
                    "doc_tokens": stops - starts, "froms": froms, "sizes": np.minimum(stops, hi) - starts - froms,
                })
            done += len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["shard"].as_py() for r in rows], pa.int32()),
                    *[pa.array([r[n] for r in rows], pa.int64()) for n in ("first", "n_ids")],
                    pa.array([r["ids"] for r in rows], pa.binary()),
                    pa.array([r["keys"] for r in rows], pa.list_(batch.schema.field("key").type)),
                    *[pa.array([r[n] for r in rows], pa.list_(pa.int64())) for n in ("starts", "doc_tokens", "froms", "sizes")],
                ],
                names=["shard", "first", "n_ids", "ids", "keys", "starts", "doc_tokens", "froms", "sizes"],
            )

    rows = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", F.xxhash64("text"))
        .withColumn("shard", F.spark_partition_id())
    )
    return in_batches(rows, blocks, f"shard int, first long, n_ids long, ids binary, keys array<{kind}>, {_PIECES}")


def id_counts(blocks: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all blocks: a row per id and task, then a sum per id."""
    width = _narrow(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for payload in batch.column("ids"):
                total += np.bincount(np.frombuffer(payload.as_buffer(), dtype=width), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(vocabulary, dtype=np.int64)
    # at most one row per id of the vocabulary
    for row in in_batches(blocks.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    return counts


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text, ``end_id`` after each, and write the folder ``path``.

    Null text is the end id alone; an empty input writes files without rows.
    """
    spark = docs.sparkSession
    vocabulary = max(words_of(tokenizer).size, end_id + 1)
    plain = materialize(tokenise(docs, tokenizer, end_id, key, text, vocabulary), "token-ids")
    lengths = code_lengths(id_counts(plain, vocabulary))
    code = canonical(lengths)
    width = _narrow(vocabulary)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [pack_bits(np.frombuffer(b.as_buffer(), dtype=width), code) for b in batch.column("ids")]
            arrays = {n: batch.column(n) for n in batch.schema.names if n != "ids"}
            arrays["payload"] = pa.array([p for p, _ in both], pa.binary())
            arrays["checkpoints"] = pa.array([c.astype("<u4").tobytes() for _, c in both], pa.binary())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    kind = plain.schema["keys"].dataType.simpleString()
    schema = f"shard int, first long, n_ids long, keys {kind}, {_PIECES}, payload binary, checkpoints binary"
    # compressed already
    in_batches(plain, packed, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    totals = plain.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before")).write.parquet(f"{path}/shards")


def read_code(spark: SparkSession, path: str) -> Code:
    """The codebook has at most one row per id of the vocabulary."""
    rows = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    return canonical(lengths)


def decoded(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[tuple[dict, np.ndarray]]:
    """Each block's row without its payload, and its ids; some megabytes of payload at a time."""
    held: list[dict] = []
    size = 0

    def run() -> Iterator[tuple[dict, np.ndarray]]:
        ids = unpack_bits(
            [r["payload"] for r in held], [np.frombuffer(r["checkpoints"], "<u4") for r in held], [r["n_ids"] for r in held], code
        )
        return zip(held, ids)

    for batch in batches:
        for row in range(batch.num_rows):
            held.append({n: batch.column(n)[row].as_py() for n in batch.schema.names})
            size += len(held[-1]["payload"])
            if size >= DECODE_BYTES:
                yield from run()
                held, size = [], 0
    yield from run()


def read_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: key, start, n_tokens, ids_crc32.

    A document in several blocks gets its crc as the exclusive or of its pieces' shares,
    so the order of the blocks does not matter.
    """
    code = read_code(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in decoded(batches, code):
            ids = ids.astype("<u4")
            shares, at = [], 0
            for n, begin, size in zip(row["doc_tokens"], row["froms"], row["sizes"]):
                crc, after = zlib.crc32(ids[at : at + size]), n - begin - size
                shares.append(crc_shift(crc, 4 * after) if after else crc)
                at += size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(shares), pa.int32()), pa.array(row["keys"], key_type), pa.array(row["starts"], pa.int64()),
                    pa.array(row["doc_tokens"], pa.int64()), pa.array(shares, pa.int64()),
                ],
                names=["shard", "key", "start", "n_tokens", "share"],
            )

    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    found = in_batches(blocks, pieces, f"shard int, key {kind}, start long, n_tokens long, share long")
    whole = found.groupBy("shard", "start").agg(F.first("key").alias("key"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("share").alias("crc"))
    return whole.join(spark.read.parquet(f"{path}/shards"), "shard").select(
        F.col("key").alias(key), (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files below the shared folder and report what reading them back gives."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, key, text)
    return read_digests(docs.sparkSession, path, key)
