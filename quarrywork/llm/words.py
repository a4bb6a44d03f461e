"""Token ids of whole texts through the tokenizers library, each distinct word encoded once.

A tokenizer whose pre-tokenizer throws white space away gives every run of other
characters the same ids wherever it stands, so white space is a safe boundary: texts
are cut there, the distinct runs of a batch are encoded by the library, and the ids of
a text are put together from them. Two more boundaries keep the number of distinct
runs low: ASCII capitals may be lowered first, because the tokenizer lowers letters
anyway, and a Latin letter before ``. , ; : ! ?`` ends a run of letters. Whether a
tokenizer has these rules is read from its own file; one that has not is given whole
texts. Texts that spell an added token go to the library as they are.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import per_process, ragged_take
from .known import Known

#: Bytes of text given to the library in one string.
PIECE_BYTES = 4096
#: Texts above this size are cut, where the tokenizer has a safe boundary.
LONG_BYTES = 1 << 16
_LETTERS = "a-zà-öø-ÿ"


def drops_white_space(spec: dict) -> bool:
    """The tokenizer splits by a pattern, keeps the matches only, and none can hold white space."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split = [s for s in steps if s.get("type") == "Split"]
    lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
    known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    return (
        lowers and added and len(split) == 1 and split[0].get("invert") and split[0].get("behavior") == "Removed"
        and split[0]["pattern"].get("Regex") == known
    )


def splits_before_space(spec: dict) -> bool:
    """Byte-level with the usual pattern: one space between two other characters starts a new piece."""
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


class Words(Known):
    """Encodes Arrow string arrays; one object per worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.by_word = drops_white_space(self.spec)
        self.before_space = splits_before_space(self.spec)
        self.added = [t["content"] for t in self.spec.get("added_tokens", [])]
        suffix = self.spec["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.ends = np.zeros(self.size, dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Plain words many to a string, others one by one."""
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        arrays: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def one_by_one(part: list[str]) -> None:
            rows = self.library(part)
            arrays.append(np.fromiter((x for row in rows for x in row), dtype=np.int32))
            counts.append(np.array([len(row) for row in rows], dtype=np.int64))

        for lo in range(0, len(plain), 4 * PIECE_BYTES):
            part = plain[lo : lo + 4 * PIECE_BYTES]
            per = max(1, PIECE_BYTES * len(part) // (sum(map(len, part)) + len(part)))
            rows = self.library([" ".join(part[i : i + per]) for i in range(0, len(part), per)])
            ids = np.fromiter((x for row in rows for x in row), dtype=np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part):
                arrays.append(ids)
                counts.append(np.diff(last, prepend=-1))
            else:  # a word of several pieces
                one_by_one(part)
        one_by_one(odd)
        return plain + odd, np.concatenate(counts), np.concatenate(arrays)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and for all words together their place among the known ones."""
        lowered = pc.replace_substring_regex(pc.ascii_lower(texts), rf"([{_LETTERS}])([.,;:!?])", r"\1 \2")
        lists = pc.ascii_split_whitespace(lowered)
        # a text that starts or ends with white space has an empty first or last word: no ids
        words = pc.dictionary_encode(pc.list_flatten(lists))
        n = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        at = self.places(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        return n, at[np.asarray(words.indices)]

    def encode(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text (null: none), and all ids one after another (or none of them)."""
        texts = texts.fill_null("")
        if not self.by_word:
            return self.encode_whole(texts, ids)
        odd = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            odd |= np.asarray(pc.match_substring(texts, token, ignore_case=True))
        if odd.any():
            return self.mixed(texts, odd, ids)
        n, at = self.cut(texts)
        lengths = self.lengths[at]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(n)
        counts = sums[ends] - sums[ends - n]
        return counts, ragged_take(self.starts[at], lengths, self.flat) if ids else self.flat[:0]

    def mixed(self, texts: pa.Array, odd: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Texts with added tokens through the library as a whole, the others by words."""
        parts = [self.encode(texts.filter(pa.array(~odd)), ids), self.encode_whole(texts.filter(pa.array(odd)), ids)]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd], counts[odd] = parts[0][0], parts[1][0]
        if not ids:
            return counts, parts[0][1]
        flat = np.concatenate([parts[0][1], parts[1][1]])
        starts = np.zeros(len(texts), dtype=np.int64)
        for mask, (n, _), base in ((~odd, parts[0], 0), (odd, parts[1], len(parts[0][1]))):
            starts[mask] = np.cumsum(n) - n + base
        return counts, ragged_take(starts, counts, flat)

    def encode_whole(self, texts: pa.Array, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Batches balanced by bytes; long texts in pieces that end at a safe boundary."""
        pieces, owner = [], []
        for k, text in enumerate(texts.to_pylist()):
            for piece in self.safe_pieces(text):
                pieces.append(piece)
                owner.append(k)
        counts, out = np.zeros(len(texts), dtype=np.int64), []
        for lo, hi in balanced([len(p) for p in pieces], LONG_BYTES * 16):
            rows = self.library(pieces[lo:hi])
            np.add.at(counts, owner[lo:hi], [len(r) for r in rows])
            if ids:
                out.append(np.fromiter((x for r in rows for x in r), dtype=np.int32))
        return counts, np.concatenate(out) if out else np.zeros(0, dtype=np.int32)

    def safe_pieces(self, text: str) -> list[str]:
        if len(text) <= LONG_BYTES or not (self.by_word or self.before_space):
            return [text]
        out, at = [], 0
        while len(text) - at > LONG_BYTES:
            cut = self.boundary(text, at + LONG_BYTES)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def boundary(self, text: str, since: int) -> int:
        """First place from ``since`` where a space stands between two ordinary ASCII letters."""
        at = text.find(" ", since)
        while at > 0:
            before, after = text[at - 1 : at], text[at + 1 : at + 2]
            if before.isascii() and before.isalnum() and after.isascii() and after.isalnum():
                return at
            at = text.find(" ", at + 1)
        return -1


def balanced(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of about ``most`` in sum each."""
    out, lo, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            out.append((lo, i))
            lo, total = i, 0
        total += size
    return [*out, (lo, len(sizes))] if len(sizes) > lo else out


def words_of(path: str) -> Words:
    return per_process(("words", path), lambda: Words(path))
