import hashlib
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from quarrywork.functions import packers
from quarrywork.functions.fixed import EMBEDDING_WORDS
from quarrywork.operators import chunking, embedding, prepare

TEXTS = [
    "", "   \n", "short", "x" * 255, "x" * 256, "x" * 257, "word " * 700, "A sentence here. " * 300,
    "Para one is here.\n\n" * 90, "no-separators" * 200, "tail without mark. and the rest", "😀 emoji é. " * 120,
]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


def plain_windows(text, size, overlap):
    width, back = 4 * size, 4 * overlap
    out, start = [], 0
    while start < len(text):
        end = min(start + width, len(text))
        out.append((start, text[start:end]))
        start = end - back if end - back > start else end
    return out


@pytest.mark.parametrize("size, overlap", [(64, 0), (64, 10), (64, 32), (100, 7)])
def test_fixed_windows(spark, size, overlap):
    got = {}
    for r in chunking.chunk_fixed(docs(spark), "t", ["id"], size, overlap).orderBy("id", "idx").collect():
        got.setdefault(r.id, []).append((r.start_char, r.text))
        assert r.end_char == r.start_char + len(r.text) and r.char_count == len(r.text)
    for i, text in enumerate(TEXTS):
        want = plain_windows(text, size, overlap) if text.strip() else []
        assert got.get(i, []) == want


def test_sizes_are_clamped():
    assert chunking.clamp(1, 500) == (64, 32) and chunking.clamp(99999, -3) == (8192, 0)


@pytest.mark.parametrize("strategy", ["token", "character", "fixed_size"])
def test_chunks_cover_the_text(spark, strategy):
    rows = chunking.chunk_documents(docs(spark), "t", ["id"], 64, 16, strategy).orderBy("id", "idx").collect()
    for i, text in enumerate(TEXTS):
        mine = [r for r in rows if r.id == i]
        if not text.strip():
            assert not mine
            continue
        assert mine[0].start_char == 0 and max(r.end_char for r in mine) == len(text)
        for a, b in zip(mine, mine[1:]):
            assert b.start_char <= a.end_char
        for r in mine:
            assert text[r.start_char:r.end_char].strip() == r.text.strip()


def test_character_cut_prefers_sentence_ends():
    text = ("word " * 50 + "end. ") * 10
    spans = list(packers.cut_at_boundaries(text, 64, 8))
    assert len(spans) < 30 and spans[0][0].endswith(".") and spans[-1][2] == len(text)


def test_paragraph_packing():
    text = "\n\n".join(["a" * 100, "b" * 100, " ", "c" * 100, "d" * 400, "e"])
    spans = list(packers.pack_paragraphs(text, 64, 5))
    assert [t[:1] + t[-1:] for t, _, _ in spans] == ["ab", "bc", "cd", "de"]
    # an oversized paragraph stays whole, with the carried text before it
    assert spans[2][0] == "c" * 20 + "\n\n" + "d" * 400
    for body, low, high in spans:
        assert text[low:high].strip()[-1] == body[-1]


def test_sentence_packing_keeps_the_last_fragment():
    assert [t for t, _, _ in packers.pack_sentences("One. Two! no mark", 64, 0)] == ["One. Two! no mark"]
    assert [t for t, _, _ in packers.pack_sentences("no mark at all", 64, 4)] == ["no mark at all"]
    text = "word " * 60 + "end. next one here."
    spans = list(packers.pack_sentences(text, 64, 8))
    assert spans[-1][0] == "word end. next one here."


def test_long_texts_are_linear():
    text = "sentence number one is here. " * 40_000
    assert sum(1 for _ in packers.cut_at_boundaries(text, 512, 50)) > 500
    assert sum(1 for _ in packers.pack_sentences(text, 512, 50)) > 500


def test_header_paths(spark):
    text = "pre " * 70 + "\n# A\n" + "a " * 150 + "\n## B\n" + "b " * 150 + "\n# C\n" + "c " * 150
    df = spark.createDataFrame([(1, text)], "id int, t string")
    pieces = chunking.chunk_fixed(df, "t", ["id"], 64, 0)
    rows = chunking.chunk_headers(df, pieces, "id", "t").orderBy("idx").collect()
    marks = [(m.start(), len(m.group(1)), m.group(2)) for m in re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M)]
    for r in rows:
        path = {}
        for pos, level, title in marks:
            if pos <= r.start_char:
                path = {k: v for k, v in path.items() if k < level}
                path[level] = title
        want = " > ".join(v for _, v in sorted(path.items())) or "Document Root"
        assert r.section == want
    assert {r.section for r in rows} >= {"Document Root", "A", "A > B", "C"}


def features(text):
    text = text.lower()
    words = text.split()
    v = [0.0] * 100
    for c in text:
        if "a" <= c <= "t":
            v[ord(c) - 97] += 1
    for w in words:
        v[19 + min(len(w), 20)] += 1
    for i, w in enumerate(EMBEDDING_WORDS):
        v[40 + i] = words.count(w) / max(len(words), 1)
    n = max(len(text), 1)
    for i, c in enumerate(".,?!:"):
        v[60 + i] = text.count(c) / n * 100
    v[65], v[66] = len(words) / 100, len(text) / 1000
    v[68], v[69] = sum(c.isdigit() for c in text) / n, text.count("\n") / n * 100
    for i, b in enumerate(hashlib.md5(text.encode()).digest()):
        v[80 + i] = b / 255
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


def test_embedding_by_hand(spark):
    texts = ["The cat, the dog: 12 of 3!\nWas it?", "x", "Über alles " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in embedding.embed(df, "t").collect():
        assert r.embedding == pytest.approx(features(r.t), abs=1e-12)


def test_retrieval(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "id int, embedding array<double>"
    )
    best = embedding.retrieve_topk(rows, F.array(F.lit(2.0), F.lit(0.0)), 3, tie_break=["id"]).collect()
    assert [(r.id, round(r.score, 6)) for r in best] == [(1, 1.0), (2, 0.6), (3, 0.0)]


def test_dedup_with_a_dominant_text(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    kept = embedding.distinct_texts(df, "id", "t")
    assert kept.count() == len({t for _, t in rows})
    assert kept.filter("t = 'same text'").first().copies == 1000


def test_prepare_and_clean(spark):
    df = spark.createDataFrame([(1, "f", "# T\n\nAuthor: x\nmail a@b.org\n\n" + "word " * 900)], "id bigint, name string, t string")
    for export in ("jsonl", "arrays", "records"):
        row = prepare.prepare(df, "id", "t", 64, 8, "character", export, include_analysis=True).first()
        assert row.chunks_count > 10 and row.markdown_length == len(df.first().t) and row.basic_stats.word_count > 900
    lines = prepare.prepare(df, "id", "t", 64, 8).first().export
    assert [json.loads(e.value)["id"] for e in lines] == list(range(len(lines)))
    forms = {o: prepare.clean_documents(df, "id", "name", "t", metadata=True, emails=True, output=o).first().content
             for o in ("markdown", "text", "json", "xml", "other")}
    assert forms["markdown"] == forms["other"] and forms["markdown"].startswith("# T\n\n\nmail [EMAIL_REDACTED]")
    assert forms["text"].startswith("T\n") and json.loads(forms["json"])["document"]["filename"] == "f" and "<h1>T</h1>" in forms["xml"]


@pytest.mark.parametrize("strategy", ["fixed_size", "token", "character", "recursive_character", "semantic_window"])
def test_table_function_equals_the_operator(spark, sf, strategy):
    from quarrywork.functions.sqludf import register_functions

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")
    docs.createOrReplaceTempView("chunk_docs")
    register_functions(spark)
    columns = ["doc_id", "idx", "text", "token_count", "char_count", "start_char", "end_char"]
    called = spark.sql(f"SELECT d.doc_id, c.* FROM chunk_docs d, LATERAL chunk_document(d.text, 100, 10, '{strategy}') c").select(columns)
    built = chunking.chunk_documents(docs, "text", ["doc_id"], 100, 10, strategy).select(columns)
    assert sorted(map(tuple, called.collect())) == sorted(map(tuple, built.collect()))


def test_table_function_refuses_unknown_strategies(spark):
    from quarrywork.functions.sqludf import register_functions

    register_functions(spark)
    with pytest.raises(Exception, match="unknown chunking strategy"):
        spark.sql("SELECT * FROM chunk_document('some text', 100, 10, 'by_moon')").collect()


@pytest.mark.parametrize("strategy", ["fixed_size", "token", "character", "recursive_character", "semantic_window"])
def test_chunks_of_a_whole_table_from_sql(spark, sf, strategy):
    from quarrywork.functions.sqludf import register_functions

    register_functions(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).createOrReplaceTempView("chunk_docs")
    columns = ["doc_id", "idx", "text", "token_count", "char_count", "start_char", "end_char"]
    called = spark.sql(f"SELECT CAST(key AS BIGINT) AS doc_id, * FROM chunk_table(TABLE(SELECT doc_id, text FROM chunk_docs), 100, 10, '{strategy}')").select(columns)
    built = chunking.chunk_documents(docs, "text", ["doc_id"], 100, 10, strategy).select(columns)
    assert sorted(map(tuple, called.collect())) == sorted(map(tuple, built.collect()))
