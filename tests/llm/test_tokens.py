"""Operators 1, 4, 6 and 9 against their libraries, on random and on difficult texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import odd
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quarrywork.llm import huffman, packing
from quarrywork.llm.packing import pack
from quarrywork.llm.sentence_pieces import Pieces, piece_digests, piece_ids, piece_texts
from quarrywork.llm.token_counts import token_counts
from quarrywork.llm.token_files import crc_shift, token_round_trip
from quarrywork.llm.words import Words

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("aAbBzéÉß .,;:!?'’\"-–s t\n\t\x1c ΣσςİıKſ中文１0123<|>endoftext_#%&̸́ﬁ\U0001f600▁\x00") + [
    "<|endoftext|>", "<|STARTOFTEXT|>", "<s>", "</s>", "<0x0A>", "'s", "'LL", "n't", " ", " ", "    ", "the", "Idiot",
]


def random_texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(0, 40))) for _ in range(n)]


def split(counts, ids):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_ids_equal_the_library(path):
    texts = [*random_texts(4000), None, "", " ", "a" * 70_000, "ab c. " * 30_000]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert split(*Words(path).encode(pa.array(texts))) == want


def test_piece_ids_and_texts_equal_the_library():
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE), Pieces(PIECE)
    texts = [*random_texts(6000, 2), None, "", " ", "\n", "a" * 3000, "ab c. " * 3000, "0" * 500]
    want = [library.encode(t or "") for t in texts]
    assert split(*pieces.encode(pa.array(texts))) == want
    assert [pieces.decode(np.array([*ids, 2])) for ids in want] == [library.decode([*ids, 2]) for ids in want]
    draw = random.Random(3)
    loose = [[draw.randrange(0, 300 if draw.random() < 0.5 else 32000) for _ in range(draw.randrange(12))] for _ in range(3000)]
    assert [pieces.decode(np.array(x, dtype=int)) for x in loose] == [library.decode(x) for x in loose]


def test_token_counts(spark, odd_docs, no_docs, library):
    got = sorted(map(tuple, token_counts(odd_docs, WORD).collect()), key=str)
    want = [
        (r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in odd.rows()
    ]
    assert got == sorted(want, key=str)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(odd_docs.filter("doc_id is not null"), PIECE).collect())
    assert got == sorted((r[0], len(model.encode(r[1] or ""))) for r in odd.rows() if r[0] is not None)
    assert token_counts(no_docs, WORD).collect() == []


def test_piece_digests(spark, odd_docs, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for r in odd.rows():
        ids = [*model.encode(r[1] or ""), 2]
        texts = " ".join(map(str, ids)), model.decode(ids)
        want.append((r[0], len(ids), *[hashlib.sha256(t.encode()).hexdigest() for t in texts]))
    assert sorted(map(tuple, piece_digests(odd_docs, PIECE).collect()), key=str) == sorted(want, key=str)
    texts = {(r["doc_id"], r["text"]) for r in piece_texts(piece_ids(odd_docs, PIECE), PIECE).collect()}
    assert texts == {(r[0], (r[1] or "").replace("▁", " ")) for r in odd.rows()}
    assert piece_digests(no_docs, PIECE).collect() == [] and piece_ids(no_docs, PIECE).collect() == []


def test_token_files(spark, odd_docs, no_docs, library):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_round_trip(odd_docs, WORD, 2).collect())
    all_ids = [(r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in odd.rows()]
    assert sorted([(i, n, c) for _, i, n, c in got], key=str) == sorted([(i, len(x), zlib.crc32(x.tobytes())) for i, x in all_ids], key=str)
    at = 0
    for start, _, n, _ in got:  # ascending keys, nulls first, no gap
        assert start == at
        at += n
    keys = [i for _, i, _, _ in got]
    assert keys == sorted(keys, key=lambda i: (i is not None, i or 0))
    assert token_round_trip(no_docs, WORD, 2).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=3000), st.integers(9, 16))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, dtype=np.int64) ** 2 % 401
    counts = np.bincount(ids, minlength=401)
    lengths = huffman.code_lengths(counts, limit)
    assert (lengths[counts > 0] > 0).all() and lengths.max(initial=0) <= limit
    code = huffman.canonical(lengths)
    if len(ids):
        assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    halves = [ids[: len(ids) // 3], ids[len(ids) // 3 :]]
    packed = [huffman.pack_bits(h, code) for h in halves]
    back = huffman.unpack_bits([p for p, _ in packed], [o for _, o in packed], [len(h) for h in halves], code)
    assert [b.tolist() for b in back] == [h.tolist() for h in halves]


def test_huffman_is_optimal_when_the_limit_does_not_bind():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    import heapq

    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 16) * counts).sum()) == cost
    assert huffman.code_lengths(counts, 4).max() == 4


@given(st.binary(max_size=40), st.binary(max_size=400))
def test_crc_shift(a, b):
    assert crc_shift(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    return by


def test_packing(spark, odd_docs, no_docs, library):
    rows = pack(odd_docs, WORD, 1).collect()
    fills = []
    for own in sequences(rows).values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        fills.append(at)
    assert max(fills) <= 2048 and all(f & (f - 1) == 0 for f in fills)  # no padding anywhere
    all_ids = [np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in odd.rows()]
    assert sum(fills) == sum(map(len, all_ids))
    for r, ids in zip(odd.rows(), all_ids):
        own = sorted((p for p in rows if p["doc_id"] == r[0] and p["doc_tokens"] == len(ids)), key=lambda p: p["start"])
        assert {(p["start"], p["ids_crc32"]) for p in own} >= {(p["start"], zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())) for p in own if r[0] == 6}
    assert pack(no_docs, WORD, 1).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=200), st.integers(1, 12))
def test_packer_places_every_id_once(sizes, max_open):
    packer = packing.Packer(32, max_open, 0)
    for doc, n in enumerate(sizes):
        packer.add(doc, np.arange(n, dtype="<u4"))
        assert packer.n_open <= max_open and packer.counts.sum() == packer.n_open
    packer.finish()
    found = defaultdict(list)
    for doc, start, n, crc, total, _, _ in packer.rows:
        assert total == sizes[doc] and crc == zlib.crc32(np.arange(start, start + n, dtype="<u4"))
        found[doc] += range(start, start + n)
    assert all(sorted(found[d]) == list(range(n)) for d, n in enumerate(sizes))


def test_level_minimises_the_sum_of_squares():
    draw = random.Random(5)
    packer = packing.Packer(16, 10**6, 0)
    for doc in range(300):
        size = draw.randrange(1, 16)
        before = packer.counts.copy()
        level = packer.level_for(size)

        def squares(h):
            after = before.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 16
            return int((after**2).sum())

        options = [h for h in range(17 - size) if h == 0 or before[h]]
        assert squares(level) == min(map(squares, options))
        packer.add(doc, np.zeros(size, dtype="<u4"))
