"""SimHash fingerprints, links between near ones by bit-sliced comparison, and their groups.

A text's words (split at ASCII white space, A-Z lowered) give shingles of a few words; every
shingle its XXH64; a fingerprint bit is 1 if it is set in more than half of them. More than 64 bits
come from mixing the same hashes.

Candidates share a key, a selection of fingerprint bits. ``exact_keys`` cuts the bits into so
many blocks that two fingerprints within the radius agree in some pair of blocks whole; no
link can be lost. For radii too wide for that, ``sampled_keys`` draws bit positions; the chance to
lose a link at distance d is (1 - (1 - d/bits) ** size) ** tables.

Fingerprints of a key stand in blocks of 64 lanes, bit planes vertically. A fingerprint is
compared with a whole block at once: each plane is added to carry-save counters that start so high
that a lane overflows when it is past the radius, two planes to a full adder. A block whose
lanes all did is abandoned. In a key with many members, those near a few pivots are joined first
and not compared among themselves again, which loses no link between groups. Only a forest of
links leaves the task. Keys with more than ``CHUNK`` members are dealt into chunks, and every
pair of chunks meets in a task of its own.

Equal fingerprints are one node from the start. Null and empty texts have the fingerprint zero
and are linked like any other. Repeated rows and null identifiers are kept; a group of null
identifiers alone has a null component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import FILE, ROW, carried, in_batches, join_hot, pieces_of_work, placed, without
from .components import roots

#: Members of a key that one task compares at most twice over.
CHUNK = 8192
#: Rows (a fingerprint against a block) that are compared side by side.
SIDE_BY_SIDE = 1 << 15
PIVOTS = 16
_ONE = np.uint64(1)


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, big-endian bytes, one row each."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros((0, 8), dtype=np.uint8)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - width)
    spans = zip(starts[: last + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.frombuffer(b"".join([xxh64_digest(line[a:b], seed) for a, b in spans]), dtype=np.uint8).reshape(-1, 8)


def fingerprint(text: str, width: int = 4, bits: int = 64, seed: int = 42) -> bytes:
    hashes = shingle_hashes(text.encode(), width, seed)
    counts = np.zeros(bits, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)]
        for word in range(bits // 64):
            mixed = part if not word else mix(part.view(">u8")[:, 0].astype(np.uint64) + np.uint64(word)).astype(">u8")[:, None].view(np.uint8)
            counts[64 * word : 64 * word + 64] += np.unpackbits(mixed, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, columns: dict, text: str | Column, width: int, bits: int, seed: int) -> DataFrame:
    """The given columns and the fingerprint of the whole text as ``fp``."""
    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], text.alias("__text"))
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_work(batches, "__text"):
            found = [fingerprint(t or "", width, bits, seed) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, pa.binary())], names=[*names, "fp"])

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return in_batches(rows, run, f"{schema}, fp binary")


# candidate keys


def exact_keys(bits: int, radius: int, agree: int = 2) -> np.ndarray:
    """Masks that no pair within the radius can all miss: of radius + agree blocks, at least ``agree`` are equal."""
    blocks = np.array_split(np.arange(bits), radius + agree)
    return masks(bits, [np.concatenate(c) for c in itertools.combinations(blocks, agree)])


def sampled_keys(bits: int, size: int, tables: int, seed: int = 7) -> np.ndarray:
    draw = np.random.default_rng(seed)
    return masks(bits, [draw.choice(bits, size, replace=False) for _ in range(tables)])


def masks(bits: int, chosen: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(chosen), bits), dtype=np.uint8)
    for row, positions in zip(out, chosen):
        row[positions] = 1
    return np.packbits(out, axis=1).view(">u8").astype(np.uint64)


def words_of_prints(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").reshape(-1, bits // 64).astype(np.uint64)


def bytes_of_prints(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in prints.astype(">u8")], pa.binary())


def keyed(nodes: DataFrame, keys: np.ndarray, bits: int) -> DataFrame:
    """A row per fingerprint and key: bucket (a hash of the key) and fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = words_of_prints(batch.column("fp"), bits)
            for number, mask in enumerate(keys):
                key = np.full(len(prints), mix(np.array([number], dtype=np.uint64))[0])
                for word in range(prints.shape[1]):
                    key = mix(key ^ (prints[:, word] & mask[word]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("fp")], names=["bucket", "fp"])

    return in_batches(nodes.select("fp"), run, "bucket long, fp binary")


# comparison


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """bits x blocks: lane l of block b is fingerprint 64 b + l."""
    n, words = prints.shape
    raw = np.unpackbits(np.ascontiguousarray(prints.astype(">u8")).view(np.uint8).reshape(n, -1), axis=1)
    raw = np.pad(raw, ((0, -n % 64), (0, 0))).reshape(-1, 64, words * 64)
    return np.ascontiguousarray(np.packbits(raw, axis=1, bitorder="little").transpose(2, 0, 1)).view("<u8")[:, :, 0]


def lane_mask(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits lo..hi-1 of a word, 0 <= lo <= hi <= 64."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    upto = lambda n: np.where(n >= 64, full, (_ONE << np.minimum(n, 63).astype(np.uint64)) - _ONE)
    return upto(hi) & ~upto(lo)


def near(prints: np.ndarray, planes: np.ndarray, who: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple:
    """Pairs (fingerprint, lane) of the given rows that are within the radius."""
    width = max(1, int(radius + 1).bit_length())
    start = (1 << width) - 1 - radius
    counters = [np.full(len(who), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> b & 1 else np.uint64(0)) for b in range(width)]
    own = prints[who]
    for p in range(0, len(planes), 2):
        x, y = (
            planes[q][block] ^ (np.uint64(0) - (own[:, q // 64] >> np.uint64(63 - q % 64) & _ONE))
            for q in (p, p + 1)
        )
        half = x ^ y
        carry = (x & y) | (half & counters[0])
        counters[0] ^= half
        for b in range(1, width):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        lanes = lanes & ~carry
        if p % 8 == 6:
            left = np.flatnonzero(lanes)
            if len(left) < len(lanes):
                if not len(left):
                    return left, left
                who, block, lanes, own = who[left], block[left], lanes[left], own[left]
                counters = [c[left] for c in counters]
    row, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return who[row], block[row] * 64 + lane


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def pivot_ranges(prints: np.ndarray, lo: int, hi: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of members lo..hi-1 in which those near one pivot stand together, and each one's end of that run."""
    label = np.full(hi - lo, -1, dtype=np.int64)
    for number in range(PIVOTS):
        free = np.flatnonzero(label < 0)
        if not len(free):
            break
        apart = np.bitwise_count(prints[lo + free] ^ prints[lo + free[0]]).sum(axis=1)
        label[free[apart <= radius]] = number
    alone = np.flatnonzero(label < 0)
    label[alone] = PIVOTS + np.arange(len(alone))
    order = np.argsort(label, kind="stable")
    return lo + order, lo + np.searchsorted(label[order], label[order], side="right")


def links_in_groups(prints: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links inside consecutive groups (their starts are given): child and parent rows."""
    n = len(prints)
    ends = np.append(starts[1:], n)
    order, run_end = np.arange(n), np.arange(1, n + 1)
    for lo, hi in zip(starts[ends - starts > 64].tolist(), ends[ends - starts > 64].tolist()):
        order[lo:hi], run_end[lo:hi] = pivot_ranges(prints, lo, hi, radius)
    prints = prints[order]
    planes = bit_planes(prints)
    group_end = np.repeat(ends, ends - starts)
    # a member meets the blocks from the end of its own run to the end of its group
    first, last = run_end // 64, (group_end - 1) // 64
    n_rows = np.where(run_end < group_end, last - first + 1, 0)
    forest = Forest(n)
    runs = np.flatnonzero(run_end - np.arange(n) > 1)
    for i in runs.tolist():
        forest.join(i, i + 1)
    bounds = np.concatenate([[0], np.cumsum(n_rows)])
    member = 0
    while member < n:
        until = max(member + 1, int(np.searchsorted(bounds, bounds[member] + SIDE_BY_SIDE, side="right")) - 1)
        counts = n_rows[member:until]
        if counts.any():
            who = np.repeat(np.arange(member, until), counts)
            block = np.repeat(first[member:until] - bounds[member:until] + bounds[member], counts) + np.arange(len(who))
            lanes = lane_mask(np.clip(run_end[who] - 64 * block, 0, 64), np.clip(group_end[who] - 64 * block, 0, 64))
            a, b = near(prints, planes, who, block, lanes, radius)
            for i, j in zip(a.tolist(), b.tolist()):
                forest.join(i, j)
        member = until
    top = np.array([forest.root(i) for i in range(n)], dtype=np.int64)
    # the smallest fingerprint is the parent, so that the stars of different keys share theirs
    by_value = np.lexsort(prints.T[::-1])
    rank = np.empty(n, dtype=np.int64)
    rank[by_value] = np.arange(n)
    least = np.full(n, n, dtype=np.int64)
    np.minimum.at(least, top, rank)
    parent = by_value[least[top]]
    child = np.flatnonzero(parent != np.arange(n))
    return order[child], order[parent[child]]


def link_prints(nodes: DataFrame, keys: np.ndarray, bits: int, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between fingerprints within the radius: a forest of each key's."""
    rows = keyed(nodes, keys, bits)
    many = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    many = materialize(many.select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "large-buckets")
    dealt = rows.join(many, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    met = met.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None

        def linked(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            sizes = np.diff(np.append(starts, batch.num_rows))
            keep = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # a single fingerprint has no link
            prints = words_of_prints(batch.column("fp"), bits)[keep]
            sizes = sizes[sizes > 1]
            child, parent = links_in_groups(prints, np.cumsum(sizes) - sizes, radius) if len(sizes) else (keep, keep)
            return pa.RecordBatch.from_arrays([bytes_of_prints(prints[child]), bytes_of_prints(prints[parent])], names=["u", "v"])

        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            named = [np.asarray(batch.column(c)) for c in ("bucket", "a", "b")]
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in named], axis=0)
            starts = np.flatnonzero(new)
            if len(starts) < 2:
                rest = batch
                continue
            rest = batch.slice(int(starts[-1]))
            yield linked(batch.slice(0, int(starts[-1])), starts[:-1])
        if rest is not None and rest.num_rows:
            yield linked(rest, np.zeros(1, dtype=np.int64))

    return in_batches(met, run, "u binary, v binary").distinct()


def _components(found: DataFrame, keys: np.ndarray, bits: int, radius: int) -> DataFrame:
    """fp, the number ``n`` of its rows, and ``least``, the smallest ``id`` (one column, possibly a struct) of its component."""
    nodes = materialize(found.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "fingerprint-nodes")
    group = materialize(roots(link_prints(nodes.select("fp"), keys, bits, radius)), "fingerprint-groups")
    linked = nodes.join(group, nodes.fp == group.node)
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("size")), "fingerprint-least")
    members = join_hot(group, least, "root", "size").select(F.col("node").alias("fp"), "least")
    return materialize(nodes.join(members, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("least")), "fingerprint-components")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, bits: int = 64, radius: int = 4, seed: int = 42,
    keys: np.ndarray | None = None,
) -> DataFrame:
    """``key``, fingerprint (hexadecimal) and component_id, the smallest ``key`` reachable over links, for every row."""
    keys = exact_keys(bits, radius) if keys is None else keys
    found = materialize(fingerprints(docs, {"id": F.col(key)}, text, width, bits, seed), "fingerprints")
    groups = _components(found, keys, bits, radius)
    named = join_hot(found, groups, "fp", "n")
    return named.select(F.col("id").alias(key), F.lower(F.hex("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one_of_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, bits: int = 64, radius: int = 4, seed: int = 42,
    keys: np.ndarray | None = None,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component of ``near_copies`` the row with the smallest key.

    May remove any row whose fingerprint is within ``radius`` bits of another's, or reachable over such links; no
    other similarity is asked for. Rows that repeat the key are told apart by their place; null keys come first.
    Texts without a word have fingerprint zero and are linked like any other.
    """
    keys = exact_keys(bits, radius) if keys is None else keys
    there = placed(docs)
    columns = {"id": F.struct(carried(docs, key).alias("key"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))}
    found = materialize(fingerprints(there, columns, carried(docs, text), width, bits, seed), "fingerprints")
    groups = _components(found, keys, bits, radius)
    dropped = join_hot(found, groups, "fp", "n").filter(~F.col("id").eqNullSafe(F.col("least")))
    return without(there, dropped.select("id.file", "id.row"), docs.columns)
