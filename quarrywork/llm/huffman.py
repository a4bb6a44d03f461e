"""Canonical length-limited Huffman codes over integer ids, packed and unpacked with NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Ids between two bit-offset checkpoints.
STEP = 256
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of each id under ``limit`` bits (package-merge); 0 where the count is 0.

    The limit grows to what the number of used ids needs.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages, leaf_at = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        leaf_at.append(by < n)
        both = both[by]
        pairs = len(both) // 2
        packages = both[0 : 2 * pairs : 2] + both[1 : 2 * pairs : 2]
    take = 2 * n - 2
    for level in reversed(leaf_at):
        picked = int(level[:take].sum())
        lengths[order[:picked]] += 1
        take = 2 * (take - picked)
    return lengths


@dataclass
class Code:
    """Code words by id, and the table that decodes ``bits`` bits at a time."""

    lengths: np.ndarray
    words: np.ndarray
    bits: int
    ids_at: np.ndarray
    lengths_at: np.ndarray


def canonical(lengths: np.ndarray) -> Code:
    """Codes in order of (length, id): the lengths alone define them."""
    used = np.flatnonzero(lengths)
    bits = int(lengths.max()) if len(used) else 1
    order = used[np.argsort(lengths[used], kind="stable")]
    span = (1 << (bits - lengths[order].astype(np.int64))).astype(np.int64)
    first = np.cumsum(span) - span
    words = np.zeros(len(lengths), dtype=np.uint64)
    words[order] = (first >> (bits - lengths[order].astype(np.int64))).astype(np.uint64)
    ids_at = np.zeros(1 << bits, dtype=np.int32)
    lengths_at = np.zeros(1 << bits, dtype=np.int64)
    ids_at[: int(span.sum())] = np.repeat(order, span)
    lengths_at[: int(span.sum())] = np.repeat(lengths[order], span)
    return Code(lengths, words, bits, ids_at, lengths_at)


def pack_bits(ids: np.ndarray, code: Code) -> tuple[bytes, np.ndarray]:
    """Code words one after another, most significant bit first, and the bit offset of every STEP-th id.

    A code word has fewer than 64 bits, so at least one starts in every 64-bit word and at
    most one reaches over its end.
    """
    if not len(ids):
        return b"", np.zeros(0, dtype=np.uint32)
    lengths = code.lengths[ids].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word, room = starts >> 6, 64 - (starts & 63)
    values = code.words[ids]
    over = lengths - room  # bits that belong to the next word
    spill = np.flatnonzero(over > 0)
    shifted = values << np.maximum(-over, 0).astype(np.uint64)
    shifted[spill] = values[spill] >> over[spill].astype(np.uint64)
    out = np.zeros(int(ends[-1] + 63 >> 6) + 1, dtype=np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[heads]] = np.bitwise_or.reduceat(shifted, heads)
    out[word[spill] + 1] |= values[spill] << (64 - over[spill]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], starts[::STEP].astype(np.uint32)


def unpack_bits(payloads: list[bytes], offsets: list[np.ndarray], counts: list[int], code: Code) -> list[np.ndarray]:
    """Ids of each block. All stretches between checkpoints advance side by side, one id a step."""
    base = np.cumsum([0, *[len(p) for p in payloads]]) * 8
    raw = np.frombuffer(b"".join([*payloads, bytes(8)]), dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from every byte on
    at = np.concatenate([o.astype(np.int64) + b for o, b in zip(offsets, base)] or [np.zeros(0, np.int64)])
    out = np.empty((STEP, len(at)), dtype=np.int32)
    shift, last = np.uint32(32 - code.bits), len(window) - 1
    for step in range(STEP):
        seen = window[np.minimum(at >> 3, last)]  # a stretch that is over may point past the end
        entry = (seen << (at & 7).astype(np.uint32)) >> shift
        out[step] = code.ids_at[entry]
        at += code.lengths_at[entry]
    lanes = np.cumsum([0, *[len(o) for o in offsets]])
    return [out[:, lo:hi].T.reshape(-1)[:n] for lo, hi, n in zip(lanes, lanes[1:], counts)]
