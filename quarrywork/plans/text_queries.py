"""Cleaning, text analysis and keyword queries over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed, markdown as md, textstats as ts
from ..operators import keywords, prepare, sections
from ..session import table, wide_table
from . import sqltext as sx
from .mapping import rounded
from .registry import query

# The documents hold little Markdown, so a Markdown page is built around each whole text.
MD_PARTS = (
    "# ", "{source}", "\n\n", "{text}", "\n\n## Notes on **", "{lang}", "**\n\n- first *item* [home](http://x.example/",
    "{doc_id}", ")\n- second __item__\n1. one\n2. two\n\n> quoted _words_\n\n```\nx = 1\n```\n\n`inline` ![pic](http://i.example/",
    "{doc_id}", ".png) <b>tag</b>\n\n| a | b |\n---\n\n\n\n### End\n#### Deep\nAuthor: someone\nlast ~~line~~ ", "{source}",
)


def md_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = wide_table(spark, sf, "documents", "doc_id")
    parts = [F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in MD_PARTS]
    return docs.select("doc_id", "lang", "source", F.concat(*parts).alias("md"))


MD_SQL = " || ".join(f"CAST({p[1:-1]} AS VARCHAR)" if p.startswith("{") else sx.q(p) for p in MD_PARTS)
MD_DOCS = f"md_docs AS (SELECT doc_id, lang, source, {MD_SQL} AS md FROM documents)"


def digest(text: Column) -> list[Column]:
    return [F.length(text).alias("n"), F.md5(text).alias("digest")]


def digest_sql(expr: str) -> str:
    return f"length({expr}) AS n, md5({expr}) AS digest"


PLAIN_SQL = sx.strip(sx.rules("md", md.PLAIN_RULES))
TEXT_SQL = sx.strip(
    "array_to_string(list_transform(string_split(" + sx.rules("md", md.TEXT_RULES) + ", chr(10)), lambda x: "
    + sx.strip("x") + "), chr(10))"
)


@query("md_to_plain", f"WITH {MD_DOCS}, p AS (SELECT doc_id, {PLAIN_SQL} AS t FROM md_docs) SELECT doc_id, {digest_sql('t')} FROM p")
def md_to_plain(spark, sf):
    plain = md_docs(spark, sf).select("doc_id", md.md_to_plain(F.col("md")).alias("t"))
    return plain.select("doc_id", *digest(F.col("t")))


@query("md_to_text", f"WITH {MD_DOCS}, p AS (SELECT doc_id, {TEXT_SQL} AS t FROM md_docs) SELECT doc_id, {digest_sql('t')} FROM p")
def md_to_text(spark, sf):
    plain = md_docs(spark, sf).select("doc_id", md.md_to_text(F.col("md")).alias("t"))
    return plain.select("doc_id", *digest(F.col("t")))


MACRO_SQL = sx.rules("html", md.MACRO_RULES)


@query("remove_macros", f"WITH p AS (SELECT page_id, {MACRO_SQL} AS t FROM pages) SELECT page_id, {digest_sql('t')} FROM p")
def remove_macros(spark, sf):
    clean = wide_table(spark, sf, "pages", "page_id").select("page_id", md.remove_macros(F.col("html")).alias("t"))
    return clean.select("page_id", *digest(F.col("t")))


META_SQL = sx.rules("md", md.METADATA_RULES)


@query("strip_metadata", f"WITH {MD_DOCS}, p AS (SELECT doc_id, {META_SQL} AS t FROM md_docs) SELECT doc_id, {digest_sql('t')} FROM p")
def strip_metadata(spark, sf):
    clean = md_docs(spark, sf).select("doc_id", md.strip_metadata(F.col("md")).alias("t"))
    return clean.select("doc_id", *digest(F.col("t")))


@query("strip_metadata_pages", f"WITH p AS (SELECT page_id, {sx.rules('html', md.METADATA_RULES)} AS t FROM pages) SELECT page_id, {digest_sql('t')} FROM p")
def strip_metadata_pages(spark, sf):
    clean = wide_table(spark, sf, "pages", "page_id").select("page_id", md.strip_metadata(F.col("html")).alias("t"))
    return clean.select("page_id", *digest(F.col("t")))


EMAIL_SQL = sx.replace_all("text", md.EMAIL_PATTERN, md.EMAIL_MASK)


@query("redact_emails", f"""WITH p AS (SELECT doc_id, {EMAIL_SQL} AS t FROM documents)
SELECT doc_id, {sx.count('t', r'EMAIL_REDACTED')} AS masked, {digest_sql('t')} FROM p""")
def redact_emails(spark, sf):
    clean = wide_table(spark, sf, "documents", "doc_id").select("doc_id", md.redact_emails(F.col("text")).alias("t"))
    return clean.select("doc_id", F.regexp_count("t", F.lit("EMAIL_REDACTED")).alias("masked"), *digest(F.col("t")))


CLEAN_SQL = sx.replace_all(sx.rules(sx.rules("md", md.MACRO_RULES), md.METADATA_RULES), md.EMAIL_PATTERN, md.EMAIL_MASK)


@query("clean_documents", f"WITH {MD_DOCS}, p AS (SELECT doc_id, {CLEAN_SQL} AS t FROM md_docs) SELECT doc_id, {digest_sql('t')} FROM p")
def clean_documents(spark, sf):
    clean = prepare.clean_documents(
        md_docs(spark, sf), "doc_id", "source", "md", macros=True, metadata=True, emails=True
    )
    return clean.select("doc_id", *digest(F.col("content")))


# -- sections -----------------------------------------------------------------------------


@query("md_sections", f"""WITH {MD_DOCS},
lines AS (SELECT doc_id, md_docs.source, generate_subscripts(string_split(md, chr(10)), 1) AS pos, unnest(string_split(md, chr(10))) AS raw FROM md_docs),
l AS (SELECT doc_id, pos, {sx.strip("raw")} AS line FROM lines),
b AS (SELECT *, SUM(CASE WHEN line = '' OR line LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM l),
s AS (SELECT doc_id, sec, MIN(CASE WHEN line LIKE '#%' THEN least(length(line) - length(ltrim(line, '#')), 6) END) AS level,
             string_agg(CASE WHEN line <> '' AND line NOT LIKE '#%' THEN line END, chr(10) ORDER BY pos) AS content
      FROM b GROUP BY doc_id, sec)
SELECT doc_id, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'h' || CAST(level AS VARCHAR) END AS type,
       COUNT(*) AS sections, CAST(SUM(length(content)) AS BIGINT) AS chars
FROM s WHERE content IS NOT NULL GROUP BY ALL""")
def md_sections(spark, sf):
    rows = sections.md_sections(md_docs(spark, sf), "doc_id", "md")
    return rows.groupBy("doc_id", "type").agg(
        F.count("*").alias("sections"), F.sum(F.length("content")).alias("chars")
    )


@query("md_to_xml")
def md_to_xml(spark, sf):
    return sections.md_to_xml(md_docs(spark, sf), "doc_id", "source", "md")


@query("md_to_json")
def md_to_json(spark, sf):
    return sections.md_to_json(md_docs(spark, sf), "doc_id", "source", "md")


# -- statistics ---------------------------------------------------------------------------


def stats_sql(t: str) -> str:
    w, s = sx.count(t, r"\S+"), sx.count(t, r"[^.!?\s][^.!?]*")
    letters = f"length({sx.replace_all(t, chr(92) + 's+')})"
    return f"""{w} AS word_count, length({t}) AS character_count,
  length(replace(replace(replace({t}, ' ', ''), chr(10), ''), chr(9), '')) AS character_count_no_spaces,
  {s} AS sentence_count,
  len(list_filter(string_split({t}, chr(10) || chr(10)), lambda x: regexp_matches(x, {sx.q(sx.re2(chr(92) + 'S'))}))) AS paragraph_count,
  {rounded(f"CAST({letters} AS DOUBLE) / greatest({w}, 1)", 1)} AS average_word_length,
  {rounded(f"CAST({w} AS DOUBLE) / greatest({s}, 1)", 1)} AS average_sentence_length"""


@query("text_stats", f"WITH {MD_DOCS}, p AS (SELECT doc_id, {PLAIN_SQL} AS t FROM md_docs) SELECT doc_id, {stats_sql('t')} FROM p")
def text_stats(spark, sf):
    plain = md_docs(spark, sf).select("doc_id", md.md_to_plain(F.col("md")).alias("t"))
    return plain.select("doc_id", *[c.alias(n) for n, c in ts.text_stats(F.col("t")).items()])


READING_SQL = f"""SELECT doc_id, w AS word_count, {rounded("CAST(w AS DOUBLE) / 200", 1)} AS minutes,
  CASE WHEN w < 200 THEN 'Less than 1 minute' WHEN w < 400 THEN 'About 1 minute'
       ELSE 'About ' || CAST(CAST(round_even(CAST(w AS DOUBLE) / 200, 0) AS BIGINT) AS VARCHAR) || ' minutes' END AS display"""


@query("reading_time", f"WITH p AS (SELECT doc_id, {sx.count('text', chr(92) + 'S+')} AS w FROM documents) {READING_SQL} FROM p")
def reading_time(spark, sf):
    counted = wide_table(spark, sf, "documents", "doc_id").select("doc_id", ts.word_count(F.col("text")).alias("word_count"))
    return counted.select("doc_id", "word_count", *[c.alias(n) for n, c in ts.reading_time(F.col("word_count")).items()])


def structure_sql(t: str) -> str:
    n = {k: sx.count(t, p) for k, p in md.STRUCTURE_PATTERNS.items()}
    fences = n.pop("fences")
    cols = [f"{v} AS {k}" for k, v in n.items()]
    cols += [
        f"{fences} // 2 AS code_blocks",
        f"{n['h1']} + {n['h2']} + {n['h3']} + {n['h4_plus']} AS headers_total",
        f"{n['bullet_items']} + {n['numbered_items']} AS list_items_total",
        f"{n['links']} - {sx.count(t, chr(33) + chr(92) + '[([^' + chr(92) + ']]+)' + chr(92) + ']' + chr(92) + '([^)]+' + chr(92) + ')')} AS links_only",
    ]
    return ", ".join(cols)


@query("md_structure", f"WITH {MD_DOCS} SELECT doc_id, {structure_sql('md')} FROM md_docs")
def md_structure(spark, sf):
    return md_docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in md.structure(F.col("md")).items()])


READABILITY_INPUTS_SQL = f"""{sx.count('text', chr(92) + 'S+')} AS w, greatest({sx.count('text', '[^.!?' + chr(92) + 's][^.!?]*')}, 1) AS s,
  len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) AS l,
  greatest(len(regexp_extract_all(lower(text), '[aeiouy]+')), {sx.count('text', chr(92) + 'S+')}) AS y,
  {sx.count('lower(text)', ts.COMPLEX_WORD)} AS c"""


def readability_sql() -> str:
    scores = {
        "flesch_reading_ease": "206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (y / w)",
        "flesch_kincaid_grade": "0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (y / w) - 15.59::DOUBLE",
        "gunning_fog": "0.4::DOUBLE * ((w / s) + 100 * c / w)",
        "smog_index": "1.043::DOUBLE * sqrt(c * (30 / s)) + 3.1291::DOUBLE",
        "automated_readability_index": "4.71::DOUBLE * l / w + 0.5::DOUBLE * (w / s) - 21.43::DOUBLE",
        "coleman_liau_index": "5.88::DOUBLE * l / w - 29.6::DOUBLE * s / w - 15.8::DOUBLE",
    }
    cols = [f"CASE WHEN w >= 10 THEN {rounded(v, 1)} END AS {k}" for k, v in scores.items()]
    f = scores["flesch_reading_ease"]
    level = " ".join(f"WHEN {f} >= {n} THEN {sx.q(t)}" for n, t in ts.READING_LEVELS)
    cols.append(f"CASE WHEN w < 10 THEN NULL {level} ELSE {sx.q(ts.HARDEST_LEVEL)} END AS reading_level")
    cols.append("w >= 10 AS available")
    return ", ".join(cols)


@query("readability", f"""WITH i AS (SELECT doc_id, {READABILITY_INPUTS_SQL} FROM documents),
d AS (SELECT doc_id, CAST(w AS DOUBLE) AS w, CAST(s AS DOUBLE) AS s, l, y, c FROM i)
SELECT doc_id, {readability_sql()} FROM d""")
def readability(spark, sf):
    inputs = ts.readability_inputs(F.col("text"))
    counted = wide_table(spark, sf, "documents", "doc_id").select("doc_id", *[c.alias(n) for n, c in inputs.items()])
    scores = ts.readability(*[F.col(n) for n in inputs])
    return counted.select("doc_id", *[c.alias(n) for n, c in scores.items()])


def language_sql() -> str:
    hits = {
        code: "len(list_filter(ws, lambda x: x IN (" + ", ".join(sx.q(w) for w in profile) + ")))"
        for code, profile in fixed.LANGUAGE_PROFILES.items()
    }
    cols = ", ".join(f"{h} AS h_{c}" for c, h in hits.items())
    top = "greatest(" + ", ".join(f"h_{c}" for c in hits) + ")"
    pick = " ".join(f"WHEN h_{c} = {top} THEN {sx.q(c)}" for c in hits)
    name = " ".join(f"WHEN {sx.q(c)} THEN {sx.q(n)}" for c, n in fixed.LANGUAGE_NAMES.items())
    return f"""WITH w AS (SELECT doc_id, lang, len({sx.words('text')}) AS n, regexp_extract_all(lower(text), '[\\p{{L}}]+') AS ws FROM documents),
h AS (SELECT doc_id, lang, n, {cols} FROM w),
c AS (SELECT doc_id, lang, {top} AS hits, CASE WHEN n < 5 OR {top} = 0 THEN NULL {pick} END AS code FROM h)
SELECT doc_id, lang, hits, code, CASE code {name} ELSE upper(code) END AS name FROM c"""


def guess_language(docs: DataFrame) -> DataFrame:
    hits = ts.language_hits(F.col("ws"))
    counted = docs.select(
        "doc_id", "lang", ts.word_count(F.col("text")).alias("n"), ts.telling_words(F.col("text")).alias("ws")
    ).select("doc_id", "lang", "n", *[c.alias(f"h_{k}") for k, c in hits.items()])
    named = {k: F.col(f"h_{k}") for k in hits}
    return counted.select(
        "doc_id", "lang", F.greatest(*named.values()).alias("hits"), ts.best_language(named, F.col("n")).alias("code")
    ).withColumn("name", ts.language_name(F.col("code")))


@query("detect_language", language_sql())
def detect_language(spark, sf):
    return guess_language(wide_table(spark, sf, "documents", "doc_id"))


@query("language_accuracy", f"SELECT lang, COUNT(*) AS docs, COUNT(*) FILTER (code = lang) AS agreed, COUNT(*) FILTER (code IS NULL) AS unknown FROM ({language_sql()}) GROUP BY lang")
def language_accuracy(spark, sf):
    return guess_language(wide_table(spark, sf, "documents", "doc_id")).groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("code") == F.col("lang")).alias("agreed"),
        F.count_if(F.col("code").isNull()).alias("unknown"),
    )


@query("token_count", """SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS token_count,
  length(text) AS character_count, 'estimation' AS method FROM documents""")
def token_count(spark, sf):
    return wide_table(spark, sf, "documents", "doc_id").select(
        "doc_id", ts.estimate_tokens(F.col("text")).alias("token_count"),
        F.length("text").alias("character_count"), F.lit("estimation").alias("method"),
    )


# -- keywords -----------------------------------------------------------------------------

STOP_SQL = "(" + ", ".join(sx.q(w) for w in fixed.KEYWORD_STOP_WORDS) + ")"

KEYWORDS_FREQ_SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) AS word FROM documents),
w AS (SELECT doc_id, word FROM t WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN {STOP_SQL}),
c AS (SELECT doc_id, word, COUNT(*) AS uses FROM w GROUP BY ALL),
r AS (SELECT *, SUM(uses) OVER (PARTITION BY doc_id) AS total,
             row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, word) AS rank_in_doc FROM c)
SELECT doc_id, word AS keyword, uses, {rounded("CAST(uses AS DOUBLE) / CAST(total AS DOUBLE)", 4)} AS score, rank_in_doc
FROM r WHERE rank_in_doc <= 10"""


@query("keywords_freq", KEYWORDS_FREQ_SQL)
def keywords_freq(spark, sf):
    return keywords.keywords_by_frequency(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("topk_per_group", KEYWORDS_FREQ_SQL.replace("rank_in_doc <= 10", "rank_in_doc <= 3"))
def topk_per_group(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return keywords.keywords_by_frequency(docs, "doc_id", "text", top_n=3)


TFIDF_SQL = f"""
WITH parts AS (SELECT doc_id, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]+'), 1) AS pos,
                      unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS raw FROM documents),
s AS (SELECT doc_id, pos, {sx.strip("raw")} AS sentence FROM parts),
k AS (SELECT doc_id, pos, sentence, COUNT(*) OVER (PARTITION BY doc_id) AS n FROM s WHERE length(sentence) > 10),
ws AS (SELECT doc_id, pos, n, list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'),
        lambda x: length(x) >= 2 AND x NOT IN {STOP_SQL}) AS toks FROM k WHERE n >= 2),
g AS (SELECT doc_id, pos, n, unnest(toks) AS term FROM ws
      UNION ALL SELECT doc_id, pos, n, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM ws),
tf AS (SELECT doc_id, pos, n, term, COUNT(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT doc_id, term, n, COUNT(*) AS df, SUM(tf) AS uses FROM tf GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, term) AS place FROM df
      WHERE df <= 0.9 * n) WHERE place <= 100),
x AS (SELECT tf.doc_id, tf.pos, tf.term, tf.n, tf.tf * (ln((1.0::DOUBLE + f.n) / (1.0::DOUBLE + f.df)) + 1) AS v
      FROM tf JOIN f ON tf.doc_id = f.doc_id AND tf.term = f.term),
u AS (SELECT doc_id, term, n, v / sqrt(SUM(CAST(v * v AS DECIMAL(28,12))) OVER (PARTITION BY doc_id, pos)::DOUBLE) AS v FROM x),
m AS (SELECT doc_id, term, CAST(SUM(CAST(v AS DECIMAL(28,12))) AS DOUBLE) / n AS score FROM u GROUP BY doc_id, term, n),
r AS (SELECT doc_id, term, {rounded("score", 4)} AS score,
             row_number() OVER (PARTITION BY doc_id ORDER BY CAST(score AS DECIMAL(28,8)) DESC, term) AS rank_in_doc FROM m)
SELECT doc_id, term AS keyword, score, rank_in_doc FROM r WHERE rank_in_doc <= 10"""


@query("keywords_tfidf", TFIDF_SQL)
def keywords_tfidf(spark, sf):
    return keywords.keywords_by_tfidf(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("analyze_doc", f"""WITH {MD_DOCS},
p AS (SELECT doc_id, md, {PLAIN_SQL} AS t FROM md_docs),
f AS (SELECT doc_id, md, t, {sx.count('t', chr(92) + 'S+')} AS w FROM p)
SELECT doc_id, CASE WHEN {sx.strip('md')} = '' THEN 'No content to analyze' END AS error, w AS word_count,
  length(t) AS character_count, {sx.count('t', '[^.!?' + chr(92) + 's][^.!?]*')} AS sentence_count,
  {rounded("CAST(w AS DOUBLE) / 200", 1)} AS minutes, {sx.count('md', md.STRUCTURE_PATTERNS['h1'])} AS h1,
  {sx.count('md', md.STRUCTURE_PATTERNS['links'])} AS links
FROM f""")
def analyze_doc(spark, sf):
    from ..operators.analysis import analyze_documents

    a = analyze_documents(md_docs(spark, sf), "doc_id", "md")
    return a.select(
        "doc_id", "error", "basic_stats.word_count", "basic_stats.character_count", "basic_stats.sentence_count",
        "reading_time.minutes", "structure.h1", "structure.links",
    )


@query("analyze_doc_keywords")
def analyze_doc_keywords(spark, sf):
    from ..operators.analysis import analyze_with_keywords

    return analyze_with_keywords(md_docs(spark, sf), "doc_id", "md")
