"""Ids of distinct words, kept by a worker process from batch to batch."""

from __future__ import annotations

import numpy as np

from .common import ragged_take

#: Distinct words a worker process keeps, about 200 bytes each, in two generations.
KEPT_WORDS = 300_000


class Generation:
    """Word -> place; the ids of the word at a place are ``flat[start:start + length]``."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def add(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        starts = np.cumsum(lengths) - lengths + len(self.flat)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.flat = np.concatenate([self.flat, ids])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])


class Known:
    """Encoded words. When the younger generation is full it becomes the older; words that are met again move on."""

    def __init__(self) -> None:
        self.young, self.old = Generation(), Generation()

    @property
    def known(self) -> dict[str, int]:
        return self.young.known

    @property
    def starts(self) -> np.ndarray:
        return self.young.starts

    @property
    def lengths(self) -> np.ndarray:
        return self.young.lengths

    @property
    def flat(self) -> np.ndarray:
        return self.young.flat

    def encode_new(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in the order worked on, how many ids each has, and all ids."""
        raise NotImplementedError

    def places(self, words: list[str]) -> np.ndarray:
        """Place of each word; those not met before are encoded first."""
        if len(self.young.known) > KEPT_WORDS // 2:
            self.young, self.old = Generation(), self.young
        young, old = self.young, self.old
        new = [w for w in words if w not in young.known]
        again = [w for w in new if w in old.known]
        if again:
            at = np.fromiter(map(old.known.__getitem__, again), dtype=np.int64, count=len(again))
            young.add(again, old.lengths[at], ragged_take(old.starts[at], old.lengths[at], old.flat))
            new = [w for w in new if w not in old.known]
        if new:
            young.add(*self.encode_new(new))
        return np.fromiter(map(young.known.__getitem__, words), dtype=np.int64, count=len(words))
