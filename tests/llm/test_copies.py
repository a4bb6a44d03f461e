"""Operators 2 and 8 against brute force, and their difficult inputs."""

import itertools
import re
from collections import defaultdict

import numpy as np
import odd
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrywork.llm import simhash
from quarrywork.llm.components import roots
from quarrywork.llm.exact_dedup import exact_dedup, keep_one_copy


def groups_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    return by


@pytest.mark.parametrize("digest", [None, "one hexadecimal digit"])
def test_exact_dedup(odd_docs, digest):
    weak = None if digest is None else F.substring(F.md5(F.col("text").cast("binary")), 1, 1)
    rows = exact_dedup(odd_docs.repartition(5), digest=weak, files_per_batch=1).collect()
    by = groups_of(odd.rows())
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    want = sorted(((r[0], largest[r[1] or ""], len(by[r[1] or ""])) for r in odd.rows()), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows), key=str) == want
    # exactly one row of each text stays, one of the largest identifier
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(by) == len({r["text_sha256"] for r in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_keeps_columns(odd_docs, no_docs):
    kept = keep_one_copy(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups_of(odd.rows()))
    assert exact_dedup(no_docs).collect() == [] and keep_one_copy(no_docs).collect() == []


def hot(n, other):
    return [(i, "the same words again", "en") for i in range(n)] + [(n + i, f"text number {i}", "en") for i in range(other)]


def test_exact_dedup_of_a_hot_text(spark):
    rows = exact_dedup(spark.createDataFrame(hot(3000, 300), "doc_id long, text string, lang string").repartition(7)).collect()
    assert len(rows) == 3300 and sum(r["kept"] for r in rows) == 301
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["group_size"] > 1} == {(2999, 3000)}


def brute_print(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, pairs):
    forest = simhash.Forest(n)
    for a, b in pairs:
        forest.join(a, b)
    return [forest.root(i) for i in range(n)]


def check_near_copies(docs, rows):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=str)
    prints = [brute_print(r[1]) for r in docs]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    top = brute_components(len(docs), pairs)
    least = defaultdict(list)
    for r, t in zip(docs, top):
        least[t].append(r[0])
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in least.items()}
    assert got == sorted(((r[0], f"{p:016x}", least[t]) for r, p, t in zip(docs, prints, top)), key=str)


def test_near_copies(odd_docs, no_docs):
    check_near_copies(odd.rows(), simhash.near_copies(odd_docs).collect())
    assert simhash.near_copies(no_docs).collect() == []


def test_near_copies_of_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_near_copies([(r["doc_id"], r["text"]) for r in docs.collect()], simhash.near_copies(docs).collect())


@pytest.mark.parametrize("bits, radius", [(64, 4), (256, 46)])
@pytest.mark.parametrize("seed", range(8))
def test_links_in_groups_lose_nothing(bits, radius, seed):
    draw = np.random.default_rng(seed)
    sizes = draw.choice([1, 2, 3, 10, 70, 300], size=6)
    prints = []
    for size in sizes:
        base = draw.integers(0, 2, bits)
        for _ in range(size):
            own = base.copy()
            own[draw.choice(bits, draw.integers(0, radius + 2), replace=False)] ^= 1
            prints.append(np.packbits(own).view(">u8").astype(np.uint64))
    prints = np.array(prints)
    child, parent = simhash.links_in_groups(prints, np.cumsum(sizes) - sizes, radius)
    group = np.repeat(np.arange(6), sizes)
    near = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= radius) & (group[:, None] == group[None])
    want = brute_components(len(prints), zip(*np.nonzero(near)))
    assert brute_components(len(prints), zip(child.tolist(), parent.tolist())) == want


def test_exact_keys_cannot_miss():
    draw = np.random.default_rng(0)
    keys = simhash.exact_keys(64, 4)
    for _ in range(2000):
        flips = draw.choice(64, 4, replace=False)
        x = np.uint64(sum(1 << int(b) for b in flips))
        assert any(not int(x & k[0]) for k in keys)


def test_large_keys_are_split_without_loss(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2, 64)
    prints = {np.packbits(base).tobytes()}
    while len(prints) < 300:
        own = np.unpackbits(np.frombuffer(draw.choice(sorted(prints)), np.uint8)).copy()
        own[draw.integers(0, 64)] ^= 1
        prints.add(np.packbits(own).tobytes())
    nodes = spark.createDataFrame([(p,) for p in prints], "fp binary")
    links = simhash.link_prints(nodes, simhash.exact_keys(64, 4), 64, 4, chunk=16)
    assert roots(links).select("root").distinct().count() == 1 and roots(links).count() == 300


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert roots(spark.createDataFrame([], "u long, v long")).collect() == []


def test_keep_one_of_near_copies(spark, odd_docs, no_docs):
    words = [f"w{i}" for i in range(400)]
    other = [f"v{i}" for i in range(400)]
    texts = [" ".join(words)] * 2 + [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (50, 150, 250)] + [" ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_near_copies(docs).collect()) == [10, 15]
    kept = simhash.keep_one_of_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() > 5
    assert simhash.keep_one_of_near_copies(no_docs).collect() == []
