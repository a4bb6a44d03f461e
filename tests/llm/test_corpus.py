"""Operators 11 to 13 against brute force, and their difficult inputs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from quarrywork.llm import common, decontamination, lexical_search, source_audit
from quarrywork.llm.decontamination import Winnow, decontaminate
from quarrywork.llm.lexical_search import lexical_top
from quarrywork.llm.source_audit import divergence


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def letters_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


ODD_ITEMS = [
    ("a", "the QUICK brown fox"), ("b", "über alle Maßen schön: der"), ("c", None), ("d", "..."), (None, "another text"), ("e", "jumps over the lazy dog and runs away the quick brown fox"),
    ("f", "no"), ("f", "here"), ("g", "thing word3 thing word4 thing word5 thing word6 thing word7 thing word8"), ("h", "never seen"), ("a", "the QUICK brown fox"),
]


def items_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "item_id string, text string")
    return df.withColumns({"file": F.lit("x"), "window": F.lit(3), "item": F.lit("y"), "size": F.lit(1), "place": F.lit(0)}) if extra else df


# 11


def brute_hits(docs, items, window=10):
    listed = []
    for name, text in items:
        words = words_of(text)
        n = min(window, len(words))
        listed += [(name, tuple(words[a : a + n])) for a in range(len(words) - n + 1)] if n else []
    by = defaultdict(set)
    for name, w in listed:
        by[w].add(name)
    out = []
    for row in docs:
        words = words_of(row[1])
        hit, names = set(), set()
        for n in {len(w) for w in by}:
            for a in range(len(words) - n + 1):
                found = by.get(tuple(words[a : a + n]))
                if found:
                    hit |= set(range(a, a + n))
                    names |= found
        out.append((row[0], len(words), len(hit), sorted(x for x in names if x is not None), bool(hit)))
    return sorted(out, key=str)


def found_hits(rows):
    for r in rows:
        assert r["n_items"] == len(r["items"]) and r["n_hit"] == sum(s["end"] - s["first"] for s in r["spans"])
        assert all(a["end"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows), key=str)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination_of_odd_texts(spark, odd_docs, no_docs, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST", most)
    got = decontaminate(odd_docs, items_of(spark, ODD_ITEMS)).collect()
    assert found_hits(got) == brute_hits(odd.rows(), ODD_ITEMS)
    if most:
        assert decontaminate(no_docs, items_of(spark, ODD_ITEMS)).collect() == []
        none = decontaminate(odd_docs, items_of(spark, ODD_ITEMS[2:4]))
        assert none.count() == len(odd.rows()) and none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_decontamination_with_few_different_words(spark):
    draw = random.Random(3)
    some = lambda n, letters: " ".join(draw.choice(letters) for _ in range(n))
    docs = [(i, some(draw.randrange(120), "ab" if i % 3 else "abcdef")) for i in range(150)]
    items = [(f"i{i}", some(draw.randrange(30), "abc")) for i in range(40)]
    for window in (10, 3):
        got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items_of(spark, items), window=window).collect()
        assert found_hits(got) == brute_hits(docs, items, window)


@pytest.mark.parametrize("size", range(1, 11))
def test_every_window_has_a_fingerprint(spark, size):
    draw = random.Random(size)
    texts = [" ".join(draw.choice("abcd") for _ in range(draw.randrange(1, 40))) for _ in range(20)]
    kind = Winnow(size)
    rows = decontamination.prints_of(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", F.split("text", " ")), [kind])
    chosen = rows.select("text", kind.chosen(f"grams_{size}", f"least_{size}").alias("c")).collect()
    for r in chosen:
        at = {c["at"] for c in r["c"]}
        n = len(r["text"].split())
        assert all(at & set(range(a, a + kind.span)) for a in range(n - size + 1)) and all(0 <= x <= n - kind.gram for x in at)


# 12


def brute_ranks(docs, items, k=20):
    tf = [Counter(words_of(r[1])) for r in docs]
    n = [sum(c.values()) for c in tf]
    documents, terms = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for name, text in items:
        scored = []
        for r, c, length in zip(docs, tf, n):
            score = 0
            for t, times in Counter(words_of(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * length * documents // terms)))
            if score > 0:
                scored.append((-score, r[0] is None, r[0] or 0))
        out += [(name, rank, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found_ranks(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_lexical_search_of_odd_texts(spark, odd_docs, no_docs):
    assert found_ranks(lexical_top(odd_docs, items_of(spark, ODD_ITEMS))) == brute_ranks(odd.rows(), ODD_ITEMS)
    assert lexical_top(no_docs, items_of(spark, ODD_ITEMS)).collect() == []
    assert lexical_top(odd_docs, items_of(spark, [])).collect() == []


def test_lexical_search_with_ties_blocks_and_small_buckets(spark, monkeypatch):
    draw = random.Random(5)
    text = lambda n: " ".join(f"t{int(draw.paretovariate(0.6)) % 300}" for _ in range(n))
    docs = [(i, text(draw.randrange(1, 60))) for i in range(600)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(300)]  # many copies of few texts, a third of all rows
    items = [(f"i{i}", text(draw.randrange(1, 25))) for i in range(30)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_ranks(docs, items)
    assert found_ranks(lexical_top(table, items_of(spark, items))) == want
    monkeypatch.setattr(lexical_search, "BUCKET", 16)
    monkeypatch.setattr(lexical_search, "FOCUS", 2)
    monkeypatch.setattr(lexical_search, "FIRST", 4)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 1000)
    assert found_ranks(lexical_top(table, items_of(spark, items))) == want


def test_bounds_are_never_below_the_score():
    draw = np.random.default_rng(0)
    lengths = draw.integers(1, 12, 200)
    term = np.concatenate([np.sort(draw.choice(30, n, replace=False)) for n in lengths])
    impact = draw.integers(1, 10**6, len(term))
    square = np.add.reduceat(impact.astype(float) ** 2, np.cumsum(lengths) - lengths)
    bucket = lexical_search.Bucket(np.repeat(np.arange(200), lengths), term, impact, lengths, square, 30)
    value = np.sort(draw.integers(1, 20_000, 30))[::-1]
    names = draw.permutation(30)
    dense = np.zeros(30, dtype=np.int64)
    dense[names] = value
    scores = bucket.scores(np.arange(200), dense)
    assert scores.tolist() == [int(dense[t] @ i) for t, i in zip(np.split(term, np.cumsum(lengths)[:-1]), np.split(impact, np.cumsum(lengths)[:-1]))]
    rest = math.sqrt(float((value[4:].astype(float) ** 2).sum()))
    for bar in np.quantile(scores, [0.1, 0.5, 0.9, 1.0]).astype(int):
        assert set(np.flatnonzero(scores >= bar)) <= set(bucket.may_reach(names[:4], value[:4], rest, int(bar)).tolist())


# 13


def brute_audit(rows, least, best=10):
    counts, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = Counter(letters_of(text))
        for t, n in own.items():
            counts[lang, source, t] += n
            docs[lang, t] += 1
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    out = []
    weights = {}
    for lang, source in groups:
        v, own = len(kept[lang]), {t: counts[lang, source, t] for t in kept[lang]}
        weights[lang, source] = {t: 1 + 10**9 * (n + 2) // (sum(own.values()) + 2 * v) for t, n in own.items()}
    for lang in {g[0] for g in groups}:
        of = sorted(s for x, s in groups if x == lang)
        every = {t: sum(counts[lang, s, t] for s in of) for t in kept[lang]}
        q = {t: 1 + 10**9 * (n + 2) // (sum(every.values()) + 2 * len(every)) for t, n in every.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in of:
            p = weights[lang, s]
            pairs = [(-sum(f(p[t], weights[lang, o][t]) for t in p), o.encode(), o) for o in of if o != s]
            terms = [(-f(p[t], q[t]), t.encode(), t) for t in p if counts[lang, s, t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])):
                out += [(lang, s, part, x, -value, rank) for rank, (value, _, x) in enumerate(found, 1)]
    return sorted(out)


def test_audit_of_odd_texts(spark, odd_docs, no_docs):
    rows = [(r[2], r[3], r[1]) for r in odd.rows()]
    for least in (1, 2, 10):
        assert sorted(map(tuple, divergence(odd_docs, min_documents=least).collect())) == brute_audit(rows, least)
    assert divergence(no_docs).collect() == []


@pytest.mark.parametrize("small", [False, True])
def test_audit_with_many_sources(spark, monkeypatch, small):
    if small:
        for name, value in (("SOURCES", 3), ("TERMS", 40), ("HELD", 50), ("CHUNK", 7)):
            monkeypatch.setattr(source_audit, name, value)
    draw = random.Random(2)
    rows = []
    for _ in range(900):
        source = draw.choice([None, "hot", "hot", "hot", *(f"s{k}" for k in range(9)), "é", "Z"])
        words = [f"t{chr(97 + int(draw.paretovariate(0.7)) % 26)}{draw.choice('aábcdé')}" for _ in range(draw.randrange(12))]
        rows.append((draw.choice(["en", "en", "de", None]), source, " ".join(words) or None))
    rows += [("xx", "alone", "1 2 3"), ("yy", "a", "rare"), ("yy", "b", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    assert sorted(map(tuple, divergence(docs).collect())) == brute_audit(rows, 10)


def test_skyband_keeps_the_best():
    draw = np.random.default_rng(4)
    for high in (5, 400):
        lang_n = draw.integers(1, high, 3000)
        n = draw.integers(1, lang_n + 1)
        stays = source_audit.Sweep(10).add(n, lang_n)
        surpassed = ((n[:, None] >= n) & (lang_n[:, None] <= lang_n) & np.triu(np.ones((3000, 3000), dtype=bool), 1)).sum(axis=0)
        assert (stays == (surpassed < 10)).all()
