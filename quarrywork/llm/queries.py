"""The queries opN_ over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import byte_cnn, toxic_passages
from .common import fold
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .lexical_search import lexical_top
from .packing import pack
from .sentence_pieces import piece_digests
from .simhash import near_copies
from .source_audit import divergence
from .token_counts import token_counts
from .token_files import token_round_trip
from .top_vectors import top_k
from .url_rules import ALLOW, BLOCK, Rule, domain_rule, judge

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

DOMAIN_RULES = [
    domain_rule("org", "/", ALLOW),
    domain_rule("example.org", "/es/", BLOCK),
    domain_rule("example.org", "/en/1", BLOCK),
    domain_rule("com", "/fr/", ALLOW),
    domain_rule("com", "/de/", BLOCK),
]
#: What decides where none of the above fits: hosts with a label of these names.
SPAM_RULES = [Rule("||spam-farm.", BLOCK, "spam-farm"), Rule("||cheap-pills.", BLOCK, "cheap-pills")]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("file", "row")


def op3_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic_passages.learn(docs, table(spark, sf_dir, "labels"), fold("key", 5) != 0)
    columns = {"doc_id": F.col("doc_id"), "held_out": F.coalesce(fold("doc_id", 5) == 0, F.lit(False))}
    return toxic_passages.score(docs, model, columns).drop("passages")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1)


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold("doc_id", 3)
    network = byte_cnn.learn(docs, part != 1)
    return byte_cnn.predict(docs, network, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(part == 1, F.lit(False))})


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {r.name for r in DOMAIN_RULES}
    return judge(table(spark, sf_dir, "pages"), [*DOMAIN_RULES, *SPAM_RULES], named=named)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_URL_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || path, '^([^/]*\.)?(spam-farm|cheap-pills)\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""

_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

_LEAK_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS x
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS a FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, a, n, array_to_string(w[a:a + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d JOIN sizes ON n <= len(w))
), hits AS (SELECT r, a, n, item_id FROM places JOIN windows USING (n, x)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_RANK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), tf AS (SELECT r, t, any_value(doc_id) AS doc_id, count(*) AS tf FROM d GROUP BY r, t),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM len),
asked AS (SELECT item_id, t, count(*) AS c FROM i GROUP BY item_id, t),
weight AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t),
scored AS (
  SELECT item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN len USING (r), total GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

_AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
terms AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
langs AS (SELECT lang, sum(lang_n)::HUGEINT AS lang_total, count(*) AS v FROM terms GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, lang_n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source)::HUGEINT AS total
  FROM groups JOIN terms USING (lang) LEFT JOIN counts USING (lang, source, term)
), weighed AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v))::HUGEINT AS q
  FROM cells JOIN langs USING (lang)
), pairs AS (
  SELECT g.lang, g.source, o.source AS item,
         coalesce((SELECT sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) FROM weighed a JOIN weighed b ON a.lang = b.lang AND a.term = b.term
                   WHERE a.lang = g.lang AND a.source = g.source AND b.source = o.source), 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
), best AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM weighed WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM best QUALIFY rank <= 10
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_exact_dedup, op3_toxic_passages, op4_packing, op5_byte_cnn, op6_token_counts,
        op7_url_rules, op8_simhash, op9_sentence_pieces, op10_top_vectors, op11_decontamination,
        op12_lexical_search, op13_source_audit,
    )
}
SQL: dict[str, str] = {"op2_exact_dedup": _DEDUP_SQL, "op7_url_rules": _URL_SQL, "op10_top_vectors": _TOP_SQL, "op11_decontamination": _LEAK_SQL, "op12_lexical_search": _RANK_SQL, "op13_source_audit": _AUDIT_SQL}
