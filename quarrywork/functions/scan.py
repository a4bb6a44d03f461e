"""Counts over the characters of many texts at once, with NumPy: what :mod:`.textstats` counts by expressions, text by text.

A character is looked up once in a table of classes; runs of a class are counted where they begin.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, END, LETTER, NUMBER, WORD, VOWEL = (1 << i for i in range(6))
#: What ``(?U)\\s`` matches.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Alphabetic by Unicode though neither letters, marks nor letter numbers, and the two joiners: they are in ``(?U)\\w``.
WORDLIKE = (*range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A), 0x200C, 0x200D)


@cache
def classes() -> bytes:
    """A byte of classes for each code point, packed: made once on the driver, some kilobytes on their way to the workers."""
    table = np.zeros(0x110000, np.uint8)
    kinds = {c: LETTER | WORD for c in ("Lu", "Ll", "Lt", "Lm", "Lo")} | {c: NUMBER | WORD for c in ("Nd", "Nl")}
    kinds |= {"No": NUMBER} | {c: WORD for c in ("Mn", "Mc", "Me", "Pc")}
    table[:] = np.fromiter((kinds.get(unicodedata.category(chr(i)), 0) for i in range(0x110000)), np.uint8, 0x110000)
    for points, kind in ((map(ord, SPACES), SPACE), (map(ord, ".!?"), END), (WORDLIKE, WORD), (map(ord, "aeiouy"), VOWEL)):
        table[list(points)] |= kind
    return zlib.compress(table.tobytes())


def unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def points(text: str) -> np.ndarray:
    """The code points, in one byte each where that is enough."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def string(code_points: np.ndarray) -> str:
    if code_points.dtype == np.uint8:
        return code_points.tobytes().decode("latin-1")
    return code_points.astype(np.uint32, copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def portions(texts: list[str], groups: np.ndarray | None = None, most: int = 300_000) -> Iterator[slice]:
    """Slices of some hundred thousand characters each, whose arrays stay in the cache; the texts of a group stay together."""
    start = held = 0
    for i, text in enumerate(texts):
        if held >= most and (groups is None or groups[i] != groups[i - 1]):
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if texts:
        yield slice(start, len(texts))


def begins(flags: np.ndarray) -> np.ndarray:
    """Where runs of true begin."""
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    return first


def runs(code_points: np.ndarray, flags: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray, str]:
    """The runs of true as an Arrow column, in order of their strings when sorted, where they begin, and their encoding."""
    coding, data = "latin-1", code_points[flags]
    if code_points.dtype != np.uint8:
        coding = "utf-16-be" if len(data) and data.max() < 0x10000 else "utf-32-be"
        data = data.astype(">u2" if coding == "utf-16-be" else ">u4")
    first = begins(flags)
    offsets = np.append(np.flatnonzero(first[flags]), len(data)) * data.itemsize
    kind = pa.binary() if data.nbytes < 2**31 else pa.large_binary()
    offsets = offsets.astype(np.int32 if kind == pa.binary() else np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.flatnonzero(first), coding


class Scan:
    """Some texts behind each other, a line end after each; ``kinds`` has the classes, and ends are spaces that end a sentence."""

    def __init__(self, texts: list[str], table: np.ndarray):
        self.points = points("\n".join(texts) + "\n")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.kinds = table[self.points]
        self.kinds[self.ends] = SPACE | END

    def has(self, kind: int) -> np.ndarray:
        return (self.kinds & kind) != 0

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist())], np.int64)

    def texts_of(self, at: np.ndarray) -> np.ndarray:
        """How many of the places ``at`` are in each text."""
        return np.bincount(np.searchsorted(self.starts, at, "right") - 1, minlength=len(self.starts))


def counts(texts: list[str], table: np.ndarray) -> dict[str, np.ndarray]:
    """Words, characters, sentences, paragraphs, letters, runs of vowels and words with three of them."""
    scan = Scan(texts, table)
    black = ~scan.has(SPACE)
    said = np.flatnonzero(black & ~scan.has(END))
    piece = np.cumsum(scan.has(END), dtype=np.int32)[said]
    white = (scan.points == 32) | (scan.points == 10) | (scan.points == 9)
    white[scan.ends] = False
    low = Scan([t.lower() for t in texts], table)
    vowels = np.flatnonzero(begins(low.has(VOWEL)))
    token = np.cumsum(begins(~low.has(SPACE)), dtype=np.int32)[vowels]
    third = token[2:] == token[:-2]
    third[1:] &= token[:-3] != token[1:-2]
    return {
        "words": scan.per_text(begins(black)),
        "characters": scan.ends - scan.starts,
        "characters_no_spaces": scan.ends - scan.starts - scan.per_text(white),
        "black": scan.per_text(black),
        "sentences": scan.texts_of(said[np.diff(piece, prepend=-1) != 0]),
        "paragraphs": np.array([sum(1 for p in t.split("\n\n") if p.strip(SPACES)) for t in texts], np.int64),
        "letters": scan.per_text(scan.has(LETTER | NUMBER)),
        "vowel_runs": low.texts_of(vowels),
        "complex": low.texts_of(vowels[:-2][third]),
    }


def profile_hits(texts: list[str], profiles: dict[str, tuple[str, ...]], table: np.ndarray) -> dict[str, np.ndarray]:
    """How many words of letters belong to each language's profile."""
    low = Scan([t.lower() for t in texts], table)
    known = sorted({w for profile in profiles.values() for w in profile})
    words, at, coding = runs(low.points, low.has(LETTER))
    place = pc.index_in(words, pa.array([w.encode(coding, "replace") for w in known], words.type)).fill_null(-1).to_numpy()
    told = np.flatnonzero(place >= 0)
    text = np.searchsorted(low.starts, at[told], "right") - 1
    uses = np.bincount(text * len(known) + place[told], minlength=len(texts) * len(known)).reshape(len(texts), len(known))
    return {code: uses[:, [known.index(w) for w in set(profile)]].sum(axis=1) for code, profile in profiles.items()}
