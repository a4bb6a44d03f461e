"""Exact encoding with a merge-type sentencepiece model by backtracking, and decoding.

A sequence of pieces is the model's encoding if every two neighbours are: re-merging the
text of the two gives the two again. So a text is walked with the longest piece that an
Aho-Corasick automaton found at each place; a piece that does not go with the one before
it gives way to the next shorter one, and when none is left, the place is marked as
failed in a bit field and the walk steps back. No place fails twice.

No piece of the model reaches from another character over a space, which is checked when
it is loaded; so the pieces of a space-started word do not depend on what stands around
it, and each distinct word of a worker is worked on once. Where no piece joins an ASCII letter to a sign or digit,
words end there too. One pass of the automaton takes the longest pieces of all new words; those whose
neighbours all go together are done, the others are walked. Characters without a piece of
their own become bytes.

Null and empty texts give the end id alone. The space sign of the model, when it stands in
a text, is a space, as in the library.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, per_process, pieces_of_work, ragged_take
from .known import Known

SPACE = "▁"
#: Stands between words while a batch is cut.
MARK = "\x00"
#: Neighbours whose check a process keeps; about 100 bytes each. When full it starts anew.
KEPT_PAIRS = 1_000_000

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


class Pieces(Known):
    """Encoder and decoder of one model; one object per worker process."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.scores = [model.get_score(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        byte = {int(self.names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_ids = [byte.get(b, -1) for b in range(256)]
        self.ids = {n: i for i, n in enumerate(self.names) if not (special[i] or model.is_byte(i))}
        plain = model.normalize("  Aﬁ  b ") == f"{SPACE * 3}Aﬁ{SPACE * 2}b{SPACE}"
        across = any(SPACE in n.lstrip(SPACE) for n in self.ids)
        if not plain or across or min(self.byte_ids) < 0 or any(model.is_unused(i) for i in range(size)):
            raise ValueError("a model with plain text, a prefix space, byte pieces and no piece across a space is needed")
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.letters = [len(n) for n in self.names]
        self.spans = np.array(self.letters)
        #: the longest piece that is a shorter start of a piece; -1: none
        self.shorter = [next((self.ids[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in self.ids), -1) for n in self.names]
        self.pairs: dict[int, bool] = {}
        self.size = size
        inside = {c for n in self.ids for c in zip(n, n[1:])}
        #: no piece goes from an ASCII letter to an ASCII sign or digit, so a word may be cut there
        self.cut_at_signs = not any(a.isascii() and a.isalpha() and "!" <= b <= "~" and not b.isalpha() for a, b in inside)
        self.alone: dict[int, bool] = {}
        self.shown = [n.replace(SPACE, " ") for n in self.names]
        for i in range(size):
            if special[i]:
                self.shown[i] = " ⁇ " if model.is_unknown(i) else ""
        for b in range(128):  # an ASCII byte is a character by itself
            self.shown[self.byte_ids[b]] = chr(b)
        self.high = np.zeros(size, dtype=bool)
        self.high[self.byte_ids[128:]] = True
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.control = {i for i in range(size) if model.is_control(i)}
        self.digits = [str(i) for i in range(size)]

    # encoding

    def merge(self, text: str) -> list[int]:
        """The model's own rule on a short text: again and again the best-scored merge, leftmost first."""
        parts = list(text)
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, where = self.scores[i], k
            if where < 0:
                return [self.ids[p] for p in parts]
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def compatible(self, last: int | None, piece: int) -> bool:
        if last is None:
            if piece not in self.alone:
                self.alone[piece] = self.merge(self.names[piece]) == [piece]
            return self.alone[piece]
        key = last * self.size + piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.names[last] + self.names[piece]) == [last, piece]
        return found

    def walk(self, text: str) -> list[int]:
        """Pieces of a text whose characters all have a piece."""
        letters, shorter, pairs, size, n = self.letters, self.shorter, self.pairs, self.size, len(text)
        longest = [-1] * n
        for end, i in self.automaton.iter(text):
            longest[end + 1 - letters[i]] = i  # of one start, the longer come later
        out: list[int] = []
        failed = bytearray(n + 1)  # a mark per position
        start, i = 0, longest[0]
        while start < n:
            last = out[-1] if out else None
            while i >= 0:
                end = start + letters[i]
                if not failed[end]:
                    goes = pairs.get(last * size + i) if last is not None else None
                    if self.compatible(last, i) if goes is None else goes:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                start = end
                i = longest[start] if start < n else -1
            else:
                failed[start] = 1
                i = out.pop()
                start -= letters[i]
                i = shorter[i]
        return out

    def word(self, word: str) -> list[int]:
        """Pieces of a word, its characters without a piece as bytes."""
        if all(c in self.ids for c in word):
            return self.walk(word) if word else []
        out, run = [], 0
        for k, c in enumerate(word):
            if c not in self.ids:
                out += self.walk(word[run:k]) if k > run else []
                out += [self.byte_ids[b] for b in c.encode()]
                run = k + 1
        return out + (self.walk(word[run:]) if run < len(word) else [])

    def longest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are cut right by taking the longest piece at every place, how many pieces each has, and all pieces.

        One pass of the automaton over all words; the neighbours of all words are checked together. Where every
        two go with each other, the walk would have made no step back.
        """
        ends = np.cumsum([len(w) + 1 for w in words])
        met = itertools.chain.from_iterable(self.automaton.iter_long(MARK.join(words)))
        end, ids = np.fromiter(met, dtype=np.int64).reshape(-1, 2).T
        owner = np.searchsorted(ends, end, side="right")
        counts = np.bincount(owner, minlength=len(words))
        covered = np.bincount(owner, weights=self.spans[ids], minlength=len(words)).astype(np.int64)
        right = covered == np.diff(ends, prepend=0) - 1
        same = owner[1:] == owner[:-1]
        keys, where = np.unique((ids[:-1] * self.size + ids[1:])[same], return_inverse=True)
        goes = np.array([self.compatible(*divmod(k, self.size)) for k in keys.tolist()], dtype=bool)
        right[owner[1:][same][~goes[where]]] = False
        first = np.flatnonzero(np.append(True, ~same)[: len(ids)])
        heads, where = np.unique(ids[first], return_inverse=True)
        alone = np.array([self.compatible(None, i) for i in heads.tolist()], dtype=bool)
        right[owner[first][~alone[where]]] = False
        return right, counts, ids

    def encode_new(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words whose longest pieces go together, then the others, each by its own walk."""
        spaced = [w.replace(" ", SPACE) for w in words]
        right, counts, ids = self.longest(spaced)
        rest = np.flatnonzero(~right).tolist()
        rows = [self.word(spaced[k]) for k in rest]
        own = np.fromiter((i for row in rows for i in row), dtype=np.int32)
        lengths = np.concatenate([counts[right], np.array([len(r) for r in rows], dtype=np.int64)])
        named = [words[k] for k in np.flatnonzero(right).tolist()] + [words[k] for k in rest]
        return named, lengths, np.concatenate([ids[np.repeat(right, counts)].astype(np.int32), own])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one after another."""
        texts = pc.replace_substring(texts.fill_null(""), SPACE, " ")
        marked = np.asarray(pc.match_substring(texts, MARK))
        filled = np.asarray(pc.binary_length(texts)) > 0
        prefixed = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
        cut = pc.replace_substring(prefixed, "\n", f"{MARK}\n{MARK}")
        cut = pc.replace_substring_regex(cut, " +", rf"{MARK}\0")
        if self.cut_at_signs:
            cut = pc.replace_substring_regex(cut, r"([A-Za-z])([!-@\[-`{-~])", rf"\1{MARK}\2")
        lists = pc.split_pattern(cut, MARK)
        words = pc.dictionary_encode(pc.list_flatten(lists))
        at = self.places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(words.indices)]
        lengths = self.lengths[at]
        ends = np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(ends) else ends
        flat = ragged_take(self.starts[at], lengths, self.flat)
        if filled.all() and not marked.any():
            return counts, flat
        ids = np.split(flat, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(~filled | marked):
            text = f" {texts[int(k)].as_py()}".replace(" ", SPACE) if filled[k] else ""
            ids[k] = np.array(self.word(text), dtype=np.int32)
        return np.array([len(x) for x in ids], dtype=np.int64), np.concatenate(ids)

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: control pieces vanish, runs of bytes are UTF-8 (a byte that is not is one U+FFFD)."""
        rows = ids.tolist()
        if self.high[ids].any():
            shown = []
            for is_byte, run in itertools.groupby(rows, self.byte_of.__contains__):
                if is_byte:
                    shown.append(bytes(map(self.byte_of.__getitem__, run)).decode("utf-8", errors="one_by_one"))
                else:
                    shown += map(self.shown.__getitem__, run)
            text = "".join(shown)
        else:
            text = "".join(map(self.shown.__getitem__, rows))
        first = next((i for i in rows if i not in self.control), None)
        return text[1:] if first is not None and self.names[first].startswith(SPACE) else text

    def decimal(self, ids: np.ndarray) -> str:
        return " ".join(map(self.digits.__getitem__, ids.tolist()))


def pieces_of(path: str) -> Pieces:
    return per_process(("sentence pieces", path), lambda: Pieces(path))


def piece_ids(docs: DataFrame, model: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ids of its whole text, ``end_id`` last."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_work(batches, "text"):
            counts, ids = pieces_of(model).encode(batch.column("text"))
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]), pa.int32()),
                pa.array(np.insert(ids, ends, end_id), pa.int32()),
            )
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return in_batches(rows, encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def piece_texts(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the text its ids stand for; null ids give null."""
    kind = encoded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if not x.is_valid else pieces_of(model).decode(np.asarray(x.values, dtype=np.int32)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.string())], names=["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return in_batches(rows, decode, f"key {kind}, text string").withColumnRenamed("key", key)


def piece_digests(docs: DataFrame, model: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: key, n_tokens, ids_sha256, decoded_sha256.

    The ids are hashed as decimal numbers joined by one space. Nothing but digests leaves the task.
    """
    kind = docs.schema[key].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_work(batches, "text"):
            pieces = pieces_of(model)
            counts, ids = pieces.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            of_ids, of_text, at = [], [], 0
            for end in ends.tolist():
                own = ids[at:end]
                of_ids.append(hashlib.sha256(pieces.decimal(own).encode()).hexdigest())
                of_text.append(hashlib.sha256(pieces.decode(own).encode()).hexdigest())
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts + 1, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_batches(rows, digest, schema).withColumnRenamed("key", key)
