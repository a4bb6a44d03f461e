"""Operators 7 and 10 against brute force, and their difficult inputs."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarrywork.llm.queries import DOMAIN_RULES, SPAM_RULES
from quarrywork.llm.top_vectors import bit_slices, score_slices, top_k, top_rows
from quarrywork.llm.url_rules import ALLOW, BLOCK, Rule, build_index, domain_rule, judge

URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://Example.ORG/es/x?y#z", "https://a.b.example.org/es/", "https://example.org/en/1",
    "https://example.org/en/19", "https://example.org/EN/1", "https://notexample.org/es/", "https://example.org?x=/es/", "http://x.com/fr/1", "http://x.com/fr",
    "http://com/de/a", "http://www.spam-farm.example.com/en", "http://spam-farm.example.org/en/2", "http://my-spam-farm.net/", "http://x.net/spam-farm./",
    "a://b://c/d", "https://é.Ümlaut.org/ñ", "http://x.com/fr/" + "long" * 5000, "http://x.org/ org/", "http://org\u2028/x", "http://y.org/a\nb",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    spam = re.match(r"([^/]*\.)?(spam-farm|cheap-pills)\.", host + path, re.DOTALL)
    return host, path, None, BLOCK if spam else ALLOW


def test_verdicts(spark):
    rows = [(k, u, "host", "path", "rule") for k, u in enumerate(URLS)] + [(None, "http://x.org/", "h", "p", "r"), (3, "http://x.com/de/", "h", "p", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")
    named = {r.name for r in DOMAIN_RULES}
    got = sorted(map(tuple, judge(pages, [*DOMAIN_RULES, *SPAM_RULES], named=named).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert judge(pages.limit(0), DOMAIN_RULES).collect() == []
    assert {r["verdict"] for r in judge(pages, []).collect()} == {ALLOW}


def test_rules_sit_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(k, f"http://shop.example.com/item/{k}") for k in range(9)] + [(9, "http://rare.example.com/")], "page_id long, url string")
    rules = [domain_rule("rare.example.com", "/", BLOCK), Rule("item", BLOCK, "anywhere"), Rule("||shop.example.com/it*em|", BLOCK, "wild")]
    index = build_index(pages, rules)
    assert [r.name for r in index.by_token["rare"]] == ["rare.example.com/"] and [r.name for r in index.by_token["shop"]] == ["wild"]
    assert [r.name for r in index.always] == ["anywhere"]


@settings(max_examples=150, deadline=None)
@given(st.text("ab./-*", max_size=10), st.text("ab./-", max_size=14), st.sampled_from(["", "|", "||"]), st.sampled_from(["", "|"]))
def test_a_fitting_url_has_the_tokens(body, target, start, end):
    rule = Rule(start + body + end, BLOCK, "r")
    if re.compile(rule.regex, re.DOTALL).search(target):
        assert rule.tokens <= set(re.findall("[a-z0-9]+", target))


def brute_top(rows, asked, k):
    out = []
    for q, v in rows:
        if q in asked:
            scored = sorted(((-int(np.dot(v, w)), c) for c, w in rows if c != q and len(w) == len(v)))
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 20, 500])
def test_top_k(spark, k):
    draw = np.random.default_rng(k)
    vectors = [(int(i), (draw.integers(-9, 9, 8) / 64 + 0.001).tolist()) for i in range(300)]
    vectors += [(i, vectors[5][1]) for i in range(300, 420)]  # a hot vector
    odd_ones = [(900, None), (920, []), (940, [1.0, None] * 4), (960, [float("nan")] * 8), (980, [float("inf")] * 8), (None, [0.1] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + odd_ones], "vec_id long, embedding array<float>, score int, rank int").repartition(5)
    got = sorted(map(tuple, top_k(table, F.col("vec_id") % 20 == 0, k).collect()))
    rows = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(int)) for i, v in vectors]
    assert got == brute_top(rows, {i for i, _ in vectors if i % 20 == 0}, k)
    assert top_k(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert top_k(table.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(1, 6), st.integers(1, 30), st.integers(0, 10**6))
def test_slices_add_up(rows, dims, k, seed):
    draw = np.random.default_rng(seed)
    values, query = draw.integers(-70, 70, (rows, dims)), draw.integers(-70, 70, dims)
    _, depth, slices = bit_slices(values)
    got = score_slices(query, depth, slices, ~slices)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:rows].astype(int) for s in got]
    total = sum(b << i for i, b in enumerate(bits)) if bits else np.zeros(rows, int)
    exact = values @ query
    assert (total - total[0] == exact - exact[0]).all()
    everyone = np.pad(np.packbits(np.ones(rows, np.uint8), bitorder="little"), (0, -(-rows // 8) * -1 % 8)).view("<u8")
    best = top_rows(got, everyone, k)
    order = sorted(range(rows), key=lambda r: (-exact[r], r))[:k]
    assert sorted(best.tolist()) == sorted(order)



def test_components_beyond_64_bits_are_refused(spark):
    near = [(0, [1e6, -1e6]), (20, [3e6, 2e6]), (1, [-5.5, 2.0])]
    got = top_k(spark.createDataFrame(near, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    of = {i: [math.floor(64 * x) for x in v] for i, v in near}
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in got} == {
        (q, c): sum(a * b for a, b in zip(of[q], of[c])) for q in (0, 20) for c in of if c != q
    }
    for large in (1e30, 3e9):
        table = spark.createDataFrame([*near, (2, [large, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="too large"):
            top_k(table, F.col("vec_id") % 20 == 0).collect()
