"""Sum-of-squares packing of token sequences into windows.

Each scan partition packs its own documents online, in the order it reads them: no
exchange, and a lost task is repeated alone. A document longer than a window fills
whole windows first; what is left goes to the fill level that minimises the sum of
squared counts of partially filled windows, which the level array ``counts`` tracks.
At most ``max_open`` windows stay open; beyond that, and at the end of the partition,
the emptiest are cut up to fill the fullest, so one partial window remains. That one
is cut into powers of two, which need no padding.

Null text is a document of its end id alone. Repeated rows are packed each; the row's
key may be null. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, pieces_of_work
from .words import words_of

WIDTH = 2048
#: Open windows of a partition; bounds its memory at this number times the width.
MAX_OPEN = 1024
_ROW = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc: int
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:n], self.doc_tokens),
            Piece(self.doc, self.start + n, self.ids[n:], self.doc_tokens),
        )


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class Packer:
    """Packs one partition; ``rows`` holds the pieces of closed sequences until they are taken."""

    def __init__(self, width: int, max_open: int, first_sequence: int):
        self.width, self.max_open, self.sequence = width, max_open, first_sequence
        self.counts = np.zeros(width + 1, dtype=np.int64)  # open windows at each level; the last stays 0
        self.open: list[list[Window]] = [[] for _ in range(width)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def close(self, window: Window) -> None:
        offset = 0
        for p in window.pieces:
            self.rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, self.sequence, offset))
            offset += len(p.ids)
        self.sequence += 1

    def level_for(self, size: int) -> int:
        """Level whose window takes the piece at the least growth of the sum of squares; 0 is a new window."""
        levels = np.flatnonzero(self.counts[: self.width - size + 1])
        if not len(levels):
            return 0
        after = levels + size
        growth = 2 * (self.counts[after] - self.counts[levels] + 1) - (after == self.width)
        best = len(levels) - 1 - int(np.argmin(growth[::-1]))  # of equals, the fullest
        return int(levels[best]) if growth[best] <= 2 * self.counts[size] + 1 else 0

    def hold(self, window: Window) -> None:
        if window.fill == self.width:
            self.close(window)
        elif window.fill:
            self.open[window.fill].append(window)
            self.counts[window.fill] += 1
            self.n_open += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        """``ids`` as little-endian unsigned 32-bit integers."""
        whole = len(ids) - len(ids) % self.width
        for at in range(0, whole, self.width):
            window = Window()
            window.add(Piece(doc, at, ids[at : at + self.width], len(ids)))
            self.close(window)
        if whole == len(ids):
            return
        piece = Piece(doc, whole, ids[whole:].copy(), len(ids))
        level = self.level_for(len(piece.ids))
        window = Window()
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        window.add(piece)
        self.hold(window)
        if self.n_open > self.max_open:
            self.drain()

    def drain(self) -> None:
        """Fill the fullest open windows with the contents of the emptiest; one partial window remains."""
        queue = [w for level in reversed(self.open) for w in level]
        self.open = [[] for _ in range(self.width)]
        self.counts[:] = 0
        self.n_open = 0
        head, tail = 0, len(queue) - 1
        while head < tail:
            gap = self.width - queue[head].fill
            if gap == 0:
                self.close(queue[head])
                head += 1
                continue
            donor = queue[tail]
            piece = donor.pieces.pop()
            donor.fill -= len(piece.ids)
            if len(piece.ids) > gap:
                piece, rest = piece.cut(gap)
                donor.add(rest)
            queue[head].add(piece)
            if not donor.fill:
                tail -= 1
        for window in queue[head : tail + 1]:
            self.hold(window)

    def finish(self) -> None:
        self.drain()
        for window in [w for level in self.open for w in level]:
            for size in (1 << b for b in reversed(range(self.width.bit_length())) if window.fill >> b & 1):
                part = Window()
                while part.fill < size:
                    piece = window.pieces.pop(0)
                    if len(piece.ids) > size - part.fill:
                        piece, rest = piece.cut(size - part.fill)
                        window.pieces.insert(0, rest)
                    part.add(piece)
                self.close(part)


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents with ``end_id`` after each, and where each document ends."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id).astype("<u4", copy=False), ends + np.arange(1, len(ends) + 1)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
    width: int = WIDTH, max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence holds at most ``width`` ids. Sequence ids are unique, and dense within
    each partition of the input.
    """
    kind = docs.schema[key].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        packer = Packer(width, max_open, TaskContext.get().partitionId() << 33)

        def take() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        key_type = None
        for batch in pieces_of_work(batches, "text"):
            key_type = batch.schema.field("key").type
            keys = batch.column("key").to_pylist()
            ids, ends = with_end(*words_of(tokenizer).encode(batch.column("text")), end_id)
            at = 0
            for name, end in zip(keys, ends.tolist()):
                packer.add(name, ids[at:end])
                at = end
            yield take()
        if key_type is not None:
            packer.finish()
            yield take()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return in_batches(rows, packed, f"key {kind}, {_ROW}").withColumnRenamed("key", key)
