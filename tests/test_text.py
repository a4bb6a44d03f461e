import math
import statistics

import pytest
from pyspark.sql import functions as F

from quarrywork.functions import markdown as md, requests as rq, textstats as ts
from quarrywork.functions.numbers import half_up, human_bytes
from quarrywork.operators import analysis, keywords, monitoring, sections


def one(spark, value, col, kind="string"):
    df = spark.createDataFrame([(value,)], f"t {kind}")
    return df.select(col(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, plain", [
    ("# Title\n\nBody **bold** and *it*.", "Title\n\nBody bold and it."),
    ("```py\nx\n```keep `gone` end", "keep  end"),
    ("[text](http://x) ![alt](http://y)", "text !alt"),
    ("- a\n* b\n1. c", "a\nb\nc"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("> quote\n---", "quote"),
    ("  \n ", ""),
    ("# Überschrift", "Überschrift"),
])
def test_md_to_plain(spark, raw, plain):
    assert one(spark, raw, md.md_to_plain) == plain


@pytest.mark.parametrize("raw, text", [
    ("## Head\n- item\n+ other", "Head\n• item\n• other"),
    ("```\ncode\n```", "code"),
    ("***both*** ~~gone~~ <b>tag</b>", "both gone tag"),
    ("[ref][1]\n[1]: http://x", "ref"),
    ("   indented   \nline ", "indented\nline"),
])
def test_md_to_text(spark, raw, text):
    assert one(spark, raw, md.md_to_text) == text


def test_cleaners(spark):
    assert one(spark, "a Sub Auto()\nx\nEnd Sub b {MACROBUTTON} javascript:x", md.remove_macros) == "a  b  x"
    assert one(spark, "Author: me\nText\n<meta name='x'>end", md.strip_metadata) == "\nText\nend"
    assert one(spark, "mail a.b+c@d-e.org now", md.redact_emails) == "mail [EMAIL_REDACTED] now"
    kept = one(spark, "Author: me a@b.org", lambda t: md.clean_text(t, metadata=False))
    assert kept == "Author: me [EMAIL_REDACTED]"
    with pytest.raises(ValueError):
        md.clean_text(F.lit(""), output="pdf")


def test_structure_counts_images_as_links(spark):
    row = spark.createDataFrame([("# a\n## b\n- x\n1. y\n![i](u) [l](u)\n| a |\n",)], "t string").select(
        *[c.alias(n) for n, c in md.structure(F.col("t")).items()]
    ).first()
    assert (row.h1, row.h2, row.headers_total, row.bullet_items, row.numbered_items) == (1, 1, 2, 1, 1)
    assert (row.links, row.images, row.links_only, row.table_rows) == (2, 1, 1, 1)


def test_sections(spark):
    text = "intro\nmore\n\n# One\nbody\n\npara <x>\n####### deep\nz"
    df = spark.createDataFrame([(1, "f", text)], "id bigint, name string, t string")
    rows = sections.md_sections(df, "id", "t").orderBy("section").collect()
    assert [(r.type, r.title, r.content) for r in rows] == [
        ("paragraph", None, "intro\nmore"), ("h1", "One", "body"), ("paragraph", None, "para <x>"), ("h6", "deep", "z"),
    ]
    xml = sections.md_to_xml(df, "id", "name", "t").first()["xml"]
    assert "<h1>One</h1>" in xml and "<p>para &lt;x&gt;</p>" in xml and 'filename="f"' in xml
    js = sections.md_to_json(df, "id", "name", "t").first()
    assert js.total_sections == 4 and '"type":"h1","title":"One"' in js.json


def test_text_stats(spark):
    row = spark.createDataFrame([("One two. Three!  \n\nFour",)], "t string").select(
        *[c.alias(n) for n, c in ts.text_stats(F.col("t")).items()]
    ).first()
    assert (row.word_count, row.sentence_count, row.paragraph_count) == (4, 3, 2)
    assert row.average_word_length == 4.3 and row.average_sentence_length == 1.3


@pytest.mark.parametrize("words, text", [(10, "Less than 1 minute"), (200, "About 1 minute"), (500, "About 2 minutes"), (700, "About 4 minutes")])
def test_reading_time(spark, words, text):
    assert one(spark, words, lambda n: ts.reading_time(n)["display"], "int") == text


def test_token_estimate(spark):
    assert [one(spark, t, ts.estimate_tokens) for t in ("", "a", "abcdefgh", "é" * 9)] == [0, 1, 2, 2]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Apple apple pear the and xy. pear apple fig été")], "id bigint, t string")
    rows = keywords.keywords_by_frequency(df, "id", "t").orderBy("rank_in_doc").collect()
    assert [(r.keyword, r.score) for r in rows] == [("apple", 0.5), ("pear", 0.3333), ("fig", 0.1667)]


def test_tfidf_by_hand(spark):
    text = "red apple pie here. green apple tart now. short"
    df = spark.createDataFrame([(1, text)], "id bigint, t string")
    rows = {r.keyword: r.score for r in keywords.keywords_by_tfidf(df, "id", "t", top_n=50).collect()}
    # "apple" is in both sentences, above the document-frequency limit
    assert "apple" not in rows
    # "here" is a stop word: red, pie and the two pairs share the unit length
    assert rows["red"] == rows["red apple"] == pytest.approx(0.5 / math.sqrt(4), abs=1e-4)


def test_keywords_of_a_single_sentence(spark):
    df = spark.createDataFrame([(1, "lone apple apple pear words"), (2, "too few words"), (3, "one apple tree. two apple trees.")], "id bigint, t string")
    rows = keywords.extract_keywords(df, "id", "t").collect()
    assert {r.keyword: r.score for r in rows if r.id == 1} == {"apple": 0.4, "lone": 0.2, "pear": 0.2, "words": 0.2}
    assert not [r for r in rows if r.id == 2] and [r for r in rows if r.id == 3]


def test_blank_document(spark):
    df = spark.createDataFrame([(1, " \n"), (2, "Some words are here for the test of it")], "id bigint, t string")
    rows = {r.id: r for r in analysis.analyze_documents(df, "id", "t").collect()}
    assert rows[1].error == "No content to analyze" and rows[2].error is None
    assert rows[2].language["code"] == "en" and rows[2].readability["available"] is False


def test_half_up_and_bytes(spark):
    assert one(spark, 2.675, lambda c: half_up(c, 2), "double") == 2.68
    assert [one(spark, n, human_bytes, "bigint") for n in (512, 1 << 20, 3 << 30)] == ["0.50 KB", "1.00 MB", "3.00 GB"]


@pytest.mark.parametrize("sql, verdict", [
    ("select 1", None), ("  SELECT a FROM t;", None), ("", "Empty SQL query"),
    ("SELECT 'drop'", "Blocked operation: DROP is not allowed"), ("SELECT updated FROM created", None),
    ("EXPLAIN SELECT 1", "Only SELECT queries are allowed"), ("SELECT 1; SELECT 2", "Multiple statements not allowed"),
    ("SELECT 1 -- x", "SQL comments not allowed"), ("WITH a AS (SELECT 1) SELECT * FROM a", None),
])
def test_guard(spark, sql, verdict):
    assert one(spark, sql, rq.guard_sql) == verdict


@pytest.mark.parametrize("raw, clean", [
    ("```sql\nSELECT 1;\n```", "SELECT 1"), ("Sure, with pleasure:\n select a", "select a"),
    ("x WITH t AS (SELECT 1) SELECT * FROM t;;", "WITH t AS (SELECT 1) SELECT * FROM t"), ("nothing", "nothing"),
])
def test_clean_sql(spark, raw, clean):
    assert one(spark, raw, rq.clean_sql) == clean


@pytest.mark.parametrize("n", [1, 19, 20, 21, 57, 400, 5000])
def test_p95_is_exclusive(spark, n):
    values = [float((i * 7919) % 1009) / 7 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = monitoring.p95_exclusive(df, [], "v").first()["p95"]
    want = statistics.quantiles(values, n=20)[18] if n >= 20 else max(values)
    assert got == pytest.approx(want, abs=1e-9)


def test_p95_with_one_dominant_value(spark):
    values = [5.0] * 9000 + [float(i) for i in range(3000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double")
    got = {r.k: r.p95 for r in monitoring.p95_exclusive(df, ["k"], "v").collect()}
    assert got == {"a": pytest.approx(statistics.quantiles(values, n=20)[18]), "b": 1.0}
