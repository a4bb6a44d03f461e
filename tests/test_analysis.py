"""The analysis by batches gives what the expressions give, text by text, and reads each text once."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrywork.functions import markdown as md, scan, terms, textstats as ts
from quarrywork.functions.fixed import KEYWORD_STOP_WORDS
from quarrywork.operators import analysis, keywords

BITS = [
    "apple pie ", "the ", "red plum ", "été ", "Straße ", "İstanbul ", "ΟΔΥΣΣΕΥΣ. ", "ΑΣ'Β ", ". ", "! ", "?", "...", "\n", "\n\n", "\n\n\n\n", "# ", "## ", "\n### ",
    "- ", "\n- ", "\n  * ", "\n\n \n+ a", "1. ", "\n12.  ", "\n٣. ", "`", "```", "**", "*", "__", "_", "[a](b)", "![i](u)", "![](u)", "> ", "\n> ", "|a|b|\n", "\n---\n",
    "\r\n", "\t", "\x85", "\xa0", " ", "\x1c", "‍", "²½Ⅷ", "Ⓐⓑ", "23 ", "queueing idea ", "beautiful ", "中文字", "😀", "K", "A.B", "der und nicht ", "\x00", "ǅ",
]


def odd_texts(n: int) -> list[str]:
    draw = random.Random(5)
    return ["".join(draw.choices(draw.sample(BITS, draw.choice([4, 9, len(BITS)])), k=draw.choice([0, 1, 3, 9, 40, 150]))) for _ in range(n)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_text_is_read_and_dealt_out_once(spark):
    docs = spark.createDataFrame([(i, f"# one apple tree {i}. two plum trees here.") for i in range(50)], "id bigint, t string")
    plan = plan_of(analysis.analyze_with_keywords(docs, "id", "t"))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1
    assert "Join" not in plan and "regexp_" not in plan and "Generate" not in plan and "HashAggregate" not in plan


def test_batches_give_what_expressions_give(spark):
    rows = [(i, t) for i, t in enumerate([*odd_texts(1_500), None, "", " \n", "# # x", "x"])]
    docs = spark.createDataFrame(rows, "id bigint, t string").repartition(8)
    found = analysis.analyze_documents(docs, "id", "t", plain="plain")
    plain = docs.select("id", "t", md.md_to_plain(F.col("t")).alias("plain"))
    hits = ts.language_hits(ts.letter_words(F.col("plain")))
    code = ts.best_language(hits, ts.word_count(F.col("plain")))
    parts = {
        "basic_stats": ts.text_stats(F.col("plain")), "reading_time": ts.reading_time(ts.word_count(F.col("plain"))), "structure": md.structure(F.col("t")),
        "readability": ts.readability(*ts.readability_inputs(F.col("plain")).values()), "language": {"code": code, "name": ts.language_name(code)},
    }
    error = F.when(~F.rlike(F.coalesce("t", F.lit("")), F.lit(r"(?U)\S")), F.lit("No content to analyze")).alias("error")
    want = plain.select("id", error, *[F.struct(*[c.alias(n) for n, c in p.items()]).alias(name) for name, p in parts.items()], "plain")
    assert found.dtypes == want.dtypes
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(rows)
    for row in want.collect():
        assert got[row.id] == row, rows[row.id]


def test_classes_are_those_of_java(spark):
    """Of all characters that the Java in use knows."""
    points = spark.range(0x110000).filter("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).filter("c <> ''")
    kinds = {scan.SPACE: r"(?U)\s", scan.LETTER: r"\p{L}", scan.NUMBER: r"\p{N}", scan.WORD: r"(?U)\w", scan.END: "[.!?]", scan.VOWEL: "[aeiouy]"}
    code = sum((F.when(F.rlike("c", F.lit(p)), k).otherwise(0) for k, p in kinds.items()), F.lit(0))
    known = points.filter(~F.rlike("c", F.lit(r"\p{Cn}"))).select("id", code.alias("k")).toPandas()
    table = scan.unpacked(scan.classes())
    assert len(known) > 200_000 and not [hex(i) for i, k in zip(known.id, known.k) if table[i] != k]


def simple_terms(texts, stop, top_n, max_features, max_df):
    """Sentence by sentence, from the definition."""
    sentences = {}
    for text in texts:
        lines = re.findall(rf"[^{scan.SPACES}.!?][^.!?\n]{{9,}}[^{scan.SPACES}.!?]", text)
        for place, line in enumerate(lines):
            words = [w for w in re.findall(r"[a-zé]+", line.lower()) if len(w) >= 2 and w not in stop]
            sentences.setdefault((len(lines), place), Counter()).update([*words, *map(" ".join, zip(words, words[1:]))])
    df, uses = Counter(t for s in sentences.values() for t in s), sum(sentences.values(), Counter())
    usable = {t for (n, _), s in sentences.items() for t in s if df[t] <= max_df * n}
    features = set(sorted(usable, key=lambda t: (-uses[t], t))[:max_features])
    values = {at: {t: s[t] * (math.log((1 + at[0]) / (1 + df[t])) + 1) for t in features & s.keys() if df[t] <= max_df * at[0]} for at, s in sentences.items()}
    squares, totals = Counter(), Counter()
    for (_, place), v in values.items():
        squares[place] += sum(x * x for x in v.values())
    for (n, place), v in values.items():
        for t, x in v.items():
            totals[t, n] += x / math.sqrt(squares[place]) / n
    return sorted(((t, s) for (t, _), s in totals.items()), key=lambda s: (-round(s[1], 8), s[0]))[:top_n]


def test_terms_of_many_documents_at_once():
    draw, table, stop = random.Random(2), scan.unpacked(scan.classes()), frozenset(KEYWORD_STOP_WORDS)
    bits = ["apple ", "the ", "red plum ", "é", "a", "b ", "pie ", ". ", "! ", "\n", ", ", "fig tree. "]
    docs = [["".join(draw.choices(bits, k=draw.choice([0, 5, 60, 300]))) for _ in range(draw.choice([1, 1, 1, 3]))] for _ in range(300)]
    docs.append(["ab cd " * 5_000 + ". foo bar baz. " + "ab xy " * 70_000])  # its squares pass 64 bits
    for top_n, max_features, max_df in ((10, 100, 0.9), (5, 7, 0.5)):
        got, sentences = terms.best_terms([t for d in docs for t in d], np.array([i for i, d in enumerate(docs) for _ in d]), stop, top_n, max_features, max_df, table)
        assert sentences.tolist() == [len(re.findall(rf"[^{scan.SPACES}.!?][^.!?\n]{{9,}}[^{scan.SPACES}.!?]", t)) for d in docs for t in d]
        for i, texts in enumerate(docs):
            want = simple_terms(texts, stop, top_n, max_features, max_df)
            assert [t for t, _ in got.get(i, [])] == [t for t, _ in want] and [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want], abs=1e-8)


def test_repeated_and_missing_keys(spark):
    """Texts of a key share their keywords, each row has them; rows without a key are analysed but have none."""
    two, one = "red apple pie here. green apple tart now. short", "lone fig fig words stand"
    rows = [(1, two), (1, one), (None, two), (None, two), (2, "too few words"), (3, None), (4, one)]
    docs = spark.createDataFrame(rows, "id bigint, t string")
    found = analysis.analyze_with_keywords(docs, "id", "t").collect()
    flat = {(r.id, r.rank_in_doc, r.keyword, r.score) for r in keywords.extract_keywords(docs, "id", "t").collect()}
    assert len(found) == len(rows) and {r.keywords is None for r in found if r.id in (None, 2, 3)} == {True}
    assert all(r.basic_stats.word_count == 9 for r in found if r.id is None)
    for key in (1, 4):
        for r in (r for r in found if r.id == key):
            assert [tuple(k) for k in r.keywords] == sorted((rank, word, score) for i, rank, word, score in flat if i == key)
    assert (4, 1, "fig", 0.4) in flat and {(i, rank) for i, rank, _, _ in flat if i is None} == {(None, n) for n in range(1, 9)}
    assert len(flat) == len(keywords.extract_keywords(docs, "id", "t").collect())


def test_keys_are_whole_across_batches():
    keys = [None, None, 1, 1, 1, 1, 2, 3, 3, 3]
    for size in (1, 2, 3, 4, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64())], names=["k"]) for i in range(0, len(keys), size)]
        parts = list(keywords._whole(iter(batches)))
        assert [k for _, own in parts for k in own] == keys == [k for some, _ in parts for b in some for k in b.column(0).to_pylist()]
        assert all(set(a[1]).isdisjoint(b[1]) for a, b in zip(parts, parts[1:]))
