"""Operators 3 and 5: held-out quality, brute-force parts and difficult inputs."""

import math
import random

import numpy as np
import odd
import pyarrow as pa
import pytest
import regex
from hypothesis import example, given, settings, strategies as st
from pyspark.sql import functions as F

from quarrywork.llm import byte_cnn, toxic_passages
from quarrywork.llm.common import fold
from quarrywork.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def brute_segments(scores):
    """Ruzzo and Tompa's definition, by recursion: the best subsequence, then left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, a, b = best
    return [*brute_segments(scores[:a]), (best[0], a, b), *[(s, x + b, y + b) for s, x, y in brute_segments(scores[b:])]]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=14))
@example([0, 4, -4, 4, 4])
@example([4, -4, 4])
def test_segments(scores):
    """Whole parts of 2^-20, ties included: sums are exact, so the segments are those of the definition."""
    got = toxic_passages.segments(np.array(scores) / toxic_passages.PARTS)
    assert [(round(s * toxic_passages.PARTS), a, b) for s, a, b in got] == brute_segments(scores)


def brute_score(text, model):
    """Evidence by definition: all maximal segments, the least sum-statistic probability over the r best."""
    words = [w for w in regex.split(r"[^\pL]+", (text or "").lower()) if w]
    found = brute_segments([model.word_score(w) for w in words])
    best = []
    for r, s in enumerate(sorted((s for s, _, _ in found), reverse=True), 1):
        if model.expected(s, len(words)) > toxic_passages.EXPECTED:
            break
        best.append(model.rate * s - math.log(model.k * max(1, len(words))))
        total = sum(best)
        told = -math.log(-math.expm1(-math.exp(-total))) if r == 1 else total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r)
        yield told


def test_scores_by_brute_force(spark):
    """Every score of a small table from the definition, with the learned word scores, K and curve."""
    rows, docs, labels = toxic_table(spark)
    model = toxic_passages.learn(docs, labels, fold("key", 5) != 0)
    texts = [t for _, t, _ in rows[::9]] + ["", None, "vileword", "vileword filthy clean vileword vileword " * 3]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxic_passages.score(table, model, {"doc_id": F.col("doc_id")}).collect()}
    for k, text in enumerate(texts):
        evidence = max(brute_score(text, model), default=0.0)
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * max(evidence, 0) + model.offset))), rel=1e-6)


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_toxic_passages"](spark, MIDDLE).collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    labels = [(rows[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()]
    clean = [r["predicted"] for r, toxic in labels if r["held_out"] and not toxic]
    assert sum(clean) <= 0.03 * len(clean)
    scores = [(r["score"], toxic) for r, toxic in labels]
    better = [(a > b) + 0.5 * (a == b) for a, x in scores if x for b, y in scores if not y]
    assert np.mean(better) > 0.75


def toxic_table(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words[20:20] = ["vileword", draw.choice(["filthy", "filthier", "filthiest"]), "vileword"]
        rows.append((i, " ".join(words), i % 4 == 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    return rows, docs, labels


def test_toxic_passages_are_found(spark, odd_docs, no_docs):
    rows, docs, labels = toxic_table(spark)
    model = toxic_passages.learn(docs, labels, fold("key", 5) != 0)
    got = {r["doc_id"]: r for r in toxic_passages.score(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    assert all(got[i]["predicted"] == x for i, _, x in rows)
    assert all(got[i]["passages"][0]["first_word"] == 20 and got[i]["passages"][0]["end_word"] == 23 for i, _, x in rows if x)
    assert toxic_passages.keep_harmless(docs, model).count() == 300
    found = toxic_passages.score(odd_docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(fold("doc_id", 5) == 0, F.lit(False))})
    assert found.count() == len(odd.rows()) and found.filter("predicted = 1").count() == 0
    assert toxic_passages.keep_harmless(odd_docs, model).columns == odd_docs.columns
    assert toxic_passages.score(no_docs, model, {"doc_id": F.col("doc_id")}).collect() == []


def test_thinned_labels_keep_their_ratio(spark, monkeypatch):
    draw = random.Random(8)
    rows = []
    for i in range(2050):
        words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(30)]
        if i < 170:  # 50 toxic and 120 clean documents have the passage
            words[10:10] = ["vileword", "filthy", "vileword"]
        rows.append((i, " ".join(words), int(i < 50)))
    # copies of clean documents, which must not count
    rows += [(3000 + i, text, 0) for i, (_, text, _) in enumerate(rows[1000:1400])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = []
    for most in (toxic_passages.LABELLED, 300):
        monkeypatch.setattr(toxic_passages, "LABELLED", most)
        model = toxic_passages.learn(docs, labels, F.lit(True))
        got.append({r["doc_id"]: (r["score"], r["predicted"]) for r in toxic_passages.score(docs, model, {"doc_id": F.col("doc_id")}).collect()})
    whole, thinned = got
    assert all(0.2 < whole[i][0] < 0.45 for i in range(170))
    assert all(abs(whole[i][0] - thinned[i][0]) < 0.15 and whole[i][1] == thinned[i][1] for i in whole)


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        model = toxic_passages.learn(docs, none, fold("key", 5) != 0)
        assert model is None
        assert {(r["score"], r["predicted"]) for r in toxic_passages.score(docs, model, {"doc_id": F.col("doc_id")}).collect()} <= {(0.0, 0)}


def test_prior_counts_every_document(odd_docs):
    counts, every = toxic_passages.background(odd_docs, "text", ["quick ", "quic", "thin", "nowhere"])
    assert counts.tolist() == [3, 3, 1, 0] and every > 0


def test_language_held_out(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op5_byte_cnn"](spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()
    right = [rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in docs if rows[d["doc_id"]]["held_out"]]
    assert len(rows) == 1000 and np.mean(right) > 0.95


def test_language_of_odd_texts(spark, odd_docs, no_docs):
    sample = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    network = byte_cnn.learn(sample, fold("doc_id", 3) != 1)
    rows = byte_cnn.predict(odd_docs, network, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(rows) == len(odd.rows())
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    assert byte_cnn.predict(no_docs, network, {"doc_id": F.col("doc_id")}).collect() == []
    kept = byte_cnn.keep_known(odd_docs, network)
    assert kept.columns == odd_docs.columns and kept.filter("text is null or doc_id = 7").count() == 0
    assert byte_cnn.learn(no_docs, fold("doc_id", 3) != 1) is None
    assert {(r["lang_pred"], r["score"]) for r in byte_cnn.predict(odd_docs, None, {"doc_id": F.col("doc_id")}).collect()} == {("und", 0.0)}


def test_no_language_learned_keeps_texts(odd_docs):
    kept = byte_cnn.keep_known(odd_docs, None)
    want = [r for r in odd.rows() if any(c.isalpha() for c in r[1] or "")]
    assert kept.columns == odd_docs.columns
    assert sorted((r["text"] for r in kept.collect())) == sorted(r[1] for r in want)


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(byte_cnn, "TRAINED", 20)
    rows = [(i, f"text of {i % 60}", f"l{i % 60}") for i in range(300)]
    _, labels = byte_cnn.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), "doc_id", "text", "lang")
    assert set(labels) == {f"l{k}" for k in range(60)}


def test_plain_forward_pass(spark):
    """Mean log-probabilities of all windows, filter by filter, byte by byte."""
    sample = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    network = byte_cnn.learn(sample, fold("doc_id", 3) != 1)
    rows = sample.filter("n_chars < 1500").limit(12).collect()
    got = {r["doc_id"]: r for r in byte_cnn.predict(sample, network, {"doc_id": F.col("doc_id")}).collect()}
    for r in rows:
        body = r["text"].encode()
        total, size = np.zeros(len(network.labels)), 0
        for lo in range(0, len(body), byte_cnn.LENGTH):
            part = body[lo : lo + byte_cnn.LENGTH]
            padded = [*part, *[byte_cnn._PAD] * (byte_cnn.LENGTH - len(part) + byte_cnn._REACH)]
            peak = np.max([sum(network.embedding[padded[i + d]] @ network.kernel[d] for d in range(byte_cnn._REACH)) for i in range(byte_cnn.LENGTH)], axis=0)
            logits = np.maximum(peak + network.bias, 0) @ network.dense + network.offset
            total += (logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) * len(part)
            size += len(part)
        share = np.exp(total / size - (total / size).max())
        assert got[r["doc_id"]]["lang_pred"] == network.labels[int(share.argmax())]
        assert got[r["doc_id"]]["score"] == pytest.approx(share.max() / share.sum(), abs=2e-3)


def test_gradients():
    rng = np.random.default_rng(0)
    net = byte_cnn.new_network(["a", "b", "c"], rng)
    rows = rng.integers(0, 256, (4, byte_cnn.LENGTH + byte_cnn._REACH - 1))
    rows[:, byte_cnn.LENGTH :] = byte_cnn._PAD
    target = np.array([0, 1, 2, 1])

    def loss():
        return -net.log_probabilities(rows[:, : byte_cnn.LENGTH], net.tables())[np.arange(4), target].mean()

    grads = byte_cnn.gradients(net, rows, target)
    for part, grad in zip((net.embedding, net.kernel, net.bias, net.dense, net.offset), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, values = part[at], []
        for step in (1e-3, -1e-3):
            part[at] = kept + step
            values.append(loss())
        part[at] = kept
        assert (values[0] - values[1]) / 2e-3 == pytest.approx(grad[at], rel=0.05, abs=1e-3)


def test_windows_cover_the_whole_text():
    body = bytes(range(256)) * 3 + b"end"
    every = byte_cnn.windows(body)
    assert bytes(every[every != byte_cnn._PAD].astype(np.uint8)) == body and len(byte_cnn.windows(b"")) == 0


def test_network_widths():
    net = byte_cnn.new_network(["a"], np.random.default_rng(1))
    for k, width in enumerate(byte_cnn.WIDTHS):
        assert (net.kernel[width:, :, k * byte_cnn.FILTERS : (k + 1) * byte_cnn.FILTERS] == 0).all()


def test_words_are_cut_as_said():
    counts, lists = toxic_passages.cut_words(pa.array(["It's a DIRTY-word###, écrit", None, "", " 12 ", "x"]))
    assert counts.tolist() == [6, 0, 0, 0, 1]
    assert lists[0].as_py() == ["it", "s", "a", "dirty", "word", "écrit"]
