"""Chunking, embedding and retrieval over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, vectors
from ..operators import chunking, embedding, prepare
from ..session import table, wide_table
from . import sqltext as sx
from .mapping import rounded
from .registry import query
from .text_queries import MD_DOCS, MD_SQL, md_docs

SIZE, OVERLAP = 512, 50


def chunks(spark: SparkSession, sf: str, strategy: str = "fixed_size", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    docs = wide_table(spark, sf, "documents", "doc_id")
    return chunking.chunk_documents(docs, "text", ["doc_id", "source"], size, overlap, strategy)


def fixed_sql(size: int, overlap: int, src: str = "documents", text: str = "text", keep: str = "doc_id, source") -> str:
    width, back = 4 * size, 4 * overlap
    step = width - back
    tail = f"CASE WHEN n - {back} > k * {step} THEN [n - {back}] ELSE [] END" if back else "[]"
    return f"""cut AS (SELECT {keep}, {text} AS t, length({text}) AS n,
    greatest(0, CAST(ceil((length({text}) - {width}) / {step}.0) AS BIGINT)) AS k FROM {src}
    WHERE regexp_matches({text}, {sx.q(sx.re2(chr(92) + 'S'))})),
  placed AS (SELECT {keep}, t, unnest(list_concat(list_transform(range(0, k + 1), lambda i: i * {step}), {tail})) AS start_char FROM cut),
  chunks AS (SELECT {keep}, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS idx,
    substr(t, start_char + 1, {width}) AS text, start_char FROM placed)"""


CHUNKS = fixed_sql(SIZE, OVERLAP)
TOK = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"
CHUNK_COLS = f"""doc_id, idx, md5(text) AS digest, {TOK} AS token_count, length(text) AS char_count, start_char,
  start_char + length(text) AS end_char"""


def chunk_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "idx", F.md5("text").alias("digest"), "token_count", "char_count", "start_char", "end_char")


@query("chunk_fixed", f"WITH {CHUNKS} SELECT {CHUNK_COLS} FROM chunks")
def chunk_fixed(spark, sf):
    return chunk_rows(chunks(spark, sf))


@query("chunk_fixed_plain", f"WITH {fixed_sql(128, 0)} SELECT {CHUNK_COLS} FROM chunks")
def chunk_fixed_plain(spark, sf):
    return chunk_rows(chunks(spark, sf, size=128, overlap=0))


TOKEN_SIZE, TOKEN_OVERLAP = 128, 16


@query("chunk_token", f"""
WITH toks AS (SELECT doc_id, regexp_extract_all(text, {sx.q(sx.re2(chr(92) + 'S+' + chr(92) + 's*|' + chr(92) + 's+'))}) AS toks FROM documents
  WHERE regexp_matches(text, {sx.q(sx.re2(chr(92) + 'S'))})),
n AS (SELECT doc_id, toks, len(toks) AS n, greatest(0, CAST(ceil((len(toks) - {TOKEN_SIZE}) / {TOKEN_SIZE - TOKEN_OVERLAP}.0) AS BIGINT)) AS k FROM toks),
c AS (SELECT doc_id, toks, n, unnest(range(0, k + 1)) AS idx FROM n),
x AS (SELECT doc_id, idx, array_to_string(toks[idx * {TOKEN_SIZE - TOKEN_OVERLAP} + 1 : idx * {TOKEN_SIZE - TOKEN_OVERLAP} + {TOKEN_SIZE}], '') AS text,
  least({TOKEN_SIZE}, n - idx * {TOKEN_SIZE - TOKEN_OVERLAP}) AS token_count,
  length(array_to_string(toks[1 : idx * {TOKEN_SIZE - TOKEN_OVERLAP}], '')) AS start_char FROM c)
SELECT doc_id, idx, md5(text) AS digest, token_count, length(text) AS char_count, start_char, start_char + length(text) AS end_char FROM x""")
def chunk_token(spark, sf):
    return chunk_rows(chunks(spark, sf, "token", TOKEN_SIZE, TOKEN_OVERLAP))


def boundary_sql(start: str, size: int = SIZE) -> str:
    """End of the window at ``start``: pulled back to the last sentence or word end near it."""
    width = 4 * size
    end, low, half = f"least({start} + {width}, n)", f"greatest(least({start} + {width}, n) - 100, {start})", f"{start} + {width // 2}"
    near = f"substr(text, CAST({low} + 1 AS BIGINT), CAST({end} - {low} AS BIGINT))"
    dot = f"CASE WHEN strpos(reverse({near}), ' .') > 0 THEN {low} + length({near}) - strpos(reverse({near}), ' .') - 1 ELSE -1 END"
    gap = f"CASE WHEN strpos(reverse({near}), ' ') > 0 THEN {low} + length({near}) - strpos(reverse({near}), ' ') ELSE -1 END"
    return f"CAST(CASE WHEN {end} >= n THEN n WHEN {dot} > {half} THEN {dot} + 1 WHEN {gap} > {half} THEN {gap} ELSE {end} END AS BIGINT)"


CHAR_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE regexp_matches(text, {sx.q(sx.re2(chr(92) + 'S'))})),
c AS (SELECT doc_id, text, n, 0 AS idx, CAST(0 AS BIGINT) AS s, {boundary_sql('0')} AS e FROM d
  UNION ALL SELECT doc_id, text, n, idx + 1, e - {4 * OVERLAP}, {boundary_sql(f'(e - {4 * OVERLAP})')} FROM c WHERE e < n),
x AS (SELECT doc_id, idx, s, e, CASE WHEN n <= {4 * SIZE} THEN text ELSE {sx.strip('substr(text, s + 1, e - s)')} END AS t FROM c)
SELECT doc_id, idx, md5(t) AS digest, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, length(t) // 4) END AS token_count, length(t) AS char_count, s AS start_char, e AS end_char FROM x"""


@query("chunk_char", CHAR_SQL)
def chunk_char(spark, sf):
    return chunk_rows(chunks(spark, sf, "character"))


def packed_sql(source: str, parts: str, joiner: str, fits: str, carry: str) -> str:
    """Greedy packing piece by piece as a recursive table; ``parts`` are the raw pieces in order, ``source`` gives doc_id and t."""
    grown = f"length(cur) + {len(joiner.replace('chr(10)', 'n').replace(chr(39), '').replace(' || ', ''))} + length(body)"
    return f"""{source},
raw AS (SELECT doc_id, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS i FROM src),
placed AS (SELECT doc_id, i, part, COALESCE(SUM(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM raw),
bodies AS (SELECT doc_id, i, {sx.strip("part")} AS body, low + length(part) - length({sx.replace_all("part", r"^\s+")}) AS low FROM placed),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, body, CAST(low AS BIGINT) AS low, CAST(low + length(body) AS BIGINT) AS high FROM bodies WHERE body <> ''),
walk AS (
  SELECT doc_id, k, body AS cur, low AS s, high AS e, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS BIGINT) AS ds, CAST(NULL AS BIGINT) AS de FROM pieces WHERE k = 1
  UNION ALL
  SELECT w.doc_id, p.k, CASE WHEN {fits.format(n=grown)} THEN cur || {joiner} || body WHEN {carry} = '' THEN body ELSE {carry} || {joiner} || body END,
         CASE WHEN {fits.format(n=grown)} THEN s ELSE p.low END, p.high, CASE WHEN NOT ({fits.format(n=grown)}) THEN cur END, s, e
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.k = w.k + 1),
found AS (SELECT doc_id, k - 1 AS k, done AS t, ds AS s, de AS e FROM walk WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, k, cur, s, e FROM walk QUALIFY k = MAX(k) OVER (PARTITION BY doc_id)),
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, {sx.strip("t")} AS t, s, e FROM found)
SELECT doc_id, idx, md5(t) AS digest, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, length(t) // 4) END AS token_count, length(t) AS char_count, s AS start_char, e AS end_char"""


# the breaks go with the piece before them: offsets are sums of lengths
PARAGRAPH_SQL = packed_sql(
    f"WITH RECURSIVE {MD_DOCS}, src AS (SELECT doc_id, md AS t FROM md_docs)", r"regexp_extract_all(t, '(?s).*?\n\n|.+\z')", "chr(10) || chr(10)",
    f"{{n}} <= {4 * SIZE}", f"right(cur, {4 * OVERLAP})",
) + f", length(t) > {4 * SIZE} AS is_oversize FROM x"
SENTENCE_SQL = packed_sql(
    "WITH RECURSIVE src AS (SELECT doc_id, text AS t FROM documents)", f"regexp_extract_all(t, {sx.q('(?s)' + sx.re2('.*?(?:[.!?]+' + chr(92) + 's+|' + chr(92) + 'n{2,})|.+' + chr(92) + 'z'))})",
    "' '", f"greatest(1, ({{n}}) // 4) <= {SIZE}", f"array_to_string(list_slice({sx.words('cur')}, -{-(-OVERLAP // 4)}, -1), ' ')",
) + " FROM x"


@query("chunk_paragraph", PARAGRAPH_SQL)
def chunk_paragraph(spark, sf):
    packed = chunking.chunk_packed(md_docs(spark, sf), "md", ["doc_id"], "recursive_character", SIZE, OVERLAP)
    flagged = chunking.mark_oversize(packed, SIZE)
    return flagged.select("doc_id", "idx", F.md5("text").alias("digest"), "token_count", "char_count",
                          "start_char", "end_char", "is_oversize")


@query("chunk_sentence", SENTENCE_SQL)
def chunk_sentence(spark, sf):
    return chunk_rows(chunks(spark, sf, "semantic_window"))


HEAD = sx.q(r"(?m)^#{1,6}[\s\x0b\x1c-\x1f\x85\p{Z}]+.+$")


@query("chunk_headers", f"""
WITH {MD_DOCS}, {fixed_sql(128, 16, "md_docs", "md", "doc_id")},
f AS (SELECT doc_id, regexp_extract_all(md, {HEAD}) AS hs, md FROM md_docs),
g AS (SELECT doc_id, hs, regexp_split_to_array(md, {HEAD}) AS gaps FROM f),
h AS (SELECT doc_id, unnest(hs) AS line, unnest(list_transform(range(1, len(hs) + 1), lambda i:
       length(array_to_string(gaps[1:i], '')) + length(array_to_string(hs[1:i - 1], '')))) AS pos FROM g),
hl AS (SELECT doc_id, pos, length(regexp_extract(line, '^#+')) AS level,
       {sx.strip("regexp_replace(line, '^#{1,6}', '')")} AS title FROM h),
j AS (SELECT c.doc_id, c.idx, c.start_char, l.level AS lvl,
        (SELECT max_by(struct_pack(level := hl.level, title := hl.title), hl.pos) FROM hl
         WHERE hl.doc_id = c.doc_id AND hl.pos <= c.start_char AND hl.level <= l.level) AS top
      FROM chunks c, (SELECT unnest(range(1, 7)) AS level) l)
SELECT doc_id, idx, start_char, COALESCE(string_agg(top.title, ' > ' ORDER BY lvl) FILTER (top.level = lvl), 'Document Root') AS section
FROM j GROUP BY doc_id, idx, start_char""")
def chunk_headers(spark, sf):
    docs = md_docs(spark, sf)
    pieces = chunking.chunk_fixed(docs, "md", ["doc_id"], 128, 16)
    return chunking.chunk_headers(docs, pieces, "doc_id", "md").select("doc_id", "idx", "start_char", "section")


@query("chunk_stats", f"""WITH {CHUNKS},
s AS (SELECT doc_id, COUNT(*) AS total_chunks, CAST(SUM({TOK}) AS BIGINT) AS total_tokens FROM chunks GROUP BY doc_id)
SELECT doc_id, total_chunks, total_tokens, length(d.text) AS total_characters,
  {rounded("CAST(total_tokens AS DOUBLE) / total_chunks", 1)} AS average_chunk_tokens,
  {rounded("CAST(length(d.text) AS DOUBLE) / total_chunks", 1)} AS average_chunk_chars
FROM s JOIN documents d USING (doc_id)""")
def chunk_stats(spark, sf):
    return chunking.chunk_stats(chunks(spark, sf), table(spark, sf, "documents"), "doc_id", "text")


# -- vectors ------------------------------------------------------------------------------


def features_sql(t: str, ws: str) -> str:
    def occ(c: str) -> str:
        return f"(length({t}) - length(replace({t}, {c}, '')))"

    nc, nw = f"CAST(greatest(length({t}), 1) AS DOUBLE)", f"CAST(greatest(len({ws}), 1) AS DOUBLE)"
    v = [f"CAST({occ(sx.q(c))} AS DOUBLE)" for c in vectors.LETTERS]
    v += [f"CAST(len(list_filter({ws}, lambda w: least(length(w), 20) = {k})) AS DOUBLE)" for k in range(1, 21)]
    v += [f"len(list_filter({ws}, lambda w: w = {sx.q(w)})) / {nw}" for w in fixed.EMBEDDING_WORDS]
    v += [f"{occ(sx.q(c))} / {nc} * 100" for c in ".,?!:"]
    v += [f"len({ws}) / 100.0::DOUBLE", f"length({t}) / 1000.0::DOUBLE", "0.0::DOUBLE",
          f"len(regexp_extract_all({t}, '\\p{{Nd}}')) / {nc}", f"{occ('chr(10)')} / {nc} * 100"]
    v += ["0.0::DOUBLE"] * 10
    v += [f"CAST(CAST('0x' || substr(md5({t}), {2 * i + 1}, 2) AS INTEGER) AS DOUBLE) / 255.0::DOUBLE" for i in range(16)]
    v += ["0.0::DOUBLE"] * (vectors.DIMENSIONS - len(v))
    return "[" + ", ".join(v) + "]"


def embed_sql(src: str, keep: str, out: str) -> str:
    return f"""{out}_w AS (SELECT {keep}, text, lower(text) AS low, {sx.words('lower(text)')} AS ws FROM {src}),
  {out}_r AS (SELECT {keep}, text, {features_sql('low', 'ws')} AS raw FROM {out}_w),
  {out}_n AS (SELECT {keep}, text, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS size FROM {out}_r),
  {out} AS (SELECT {keep}, text, CASE WHEN size > 0 THEN list_transform(raw, lambda x: x / size) ELSE raw END AS embedding FROM {out}_n)"""


EMBEDDED = f"{CHUNKS}, {embed_sql('chunks', 'doc_id, source, idx, start_char', 'embedded')}"


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.embed_rows(chunks(spark, sf))


@query("embed_hash", f"""WITH {EMBEDDED}
SELECT doc_id, idx, {rounded("list_sum(list_transform(range(1, 101), lambda i: i * embedding[i]))", 6)} AS checksum,
  {rounded("sqrt(list_sum(list_transform(embedding, lambda x: x * x)))", 6)} AS length,
  {rounded("embedding[5]", 6)} AS dim_e, {rounded("embedding[23]", 6)} AS dim_three, {rounded("embedding[81]", 6)} AS dim_digest
FROM embedded""")
def embed_hash(spark, sf):
    from ..functions.numbers import half_up

    e = F.col("embedding")
    weighted = F.aggregate(F.transform(e, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return embedded(spark, sf).select(
        "doc_id", "idx", half_up(weighted, 6).alias("checksum"), half_up(vectors.norm(e), 6).alias("length"),
        half_up(e[4], 6).alias("dim_e"), half_up(e[22], 6).alias("dim_three"), half_up(e[80], 6).alias("dim_digest"),
    )


@query("embed_rows", f"""WITH {CHUNKS} SELECT doc_id, idx, 100 AS dimensions, 'tfidf-fallback' AS model,
  substr(md5(text), 1, 12) AS text_hash, {TOK} AS token_count FROM chunks""")
def embed_rows(spark, sf):
    return embedded(spark, sf).select("doc_id", "idx", "dimensions", "model", "text_hash", "token_count")


QUESTION = "Which of these tells how the house and the garden are kept?"
TASKS = ("the garden and the house", "la maison et le jardin", "what has been done with it")


def asked_sql(text: str, out: str) -> str:
    return embed_sql(f"(SELECT {sx.q(text)} AS text, 1 AS one)", "one", out)


@query("retrieve_topk", f"""WITH {EMBEDDED}, {asked_sql(QUESTION, 'asked')},
s AS (SELECT doc_id, idx, md5(e.text) AS digest, list_cosine_similarity(e.embedding, asked.embedding) AS raw FROM embedded e, asked)
SELECT doc_id, idx, digest, {rounded("raw", 6)} AS score FROM s ORDER BY raw DESC, doc_id, idx LIMIT 3""")
def retrieve_topk(spark, sf):
    from ..functions.numbers import half_up

    rows = embedded(spark, sf).select("doc_id", "idx", "text", "embedding")
    best = embedding.retrieve_topk(rows, embedding.query_vector(spark, QUESTION), 3, tie_break=["doc_id", "idx"])
    return best.select("doc_id", "idx", F.md5("text").alias("digest"), half_up(F.col("score"), 6).alias("score"))


@query("retrieve_vectors", f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT v AS tv FROM e WHERE vec_id = 0)
SELECT vec_id, label, {rounded("list_cosine_similarity(v, tv)", 6)} AS score FROM e, t
ORDER BY list_cosine_similarity(v, tv) DESC, vec_id LIMIT 10""")
def retrieve_vectors(spark, sf):
    from ..functions.numbers import half_up

    rows = table(spark, sf, "embeddings")
    asked = rows.filter(F.col("vec_id") == 0).select("embedding").scalar()
    best = embedding.retrieve_topk(rows, asked, 10, tie_break=["vec_id"])
    return best.select("vec_id", "label", half_up(F.col("score"), 6).alias("score"))


@query("retrieve_multi", f"""WITH {EMBEDDED}, {", ".join(asked_sql(t, f"asked{i}") for i, t in enumerate(TASKS))},
s AS ({" UNION ALL ".join(f"SELECT doc_id, source, idx, e.text, {i} AS task_no, {sx.q(t)} AS matched_task, list_cosine_similarity(e.embedding, asked{i}.embedding) AS score FROM embedded e, asked{i}" for i, t in enumerate(TASKS))}),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_no ORDER BY score DESC, doc_id, idx) AS place FROM s) WHERE place <= 3),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY task_no, place) AS again FROM r) WHERE again = 1)
SELECT doc_id, source, idx, matched_task, {rounded("score", 6)} AS relevance_score FROM f ORDER BY score DESC, doc_id, idx LIMIT 10""")
def retrieve_multi(spark, sf):
    from ..functions.numbers import half_up

    rows = embedded(spark, sf).select("doc_id", "source", "idx", "text", "embedding")
    best = embedding.retrieve_multi(rows, list(TASKS), ["doc_id", "idx"])
    return best.select("doc_id", "source", "idx", "matched_task", half_up(F.col("relevance_score"), 6).alias("relevance_score"))


@query("retrieve_fallback", f"""WITH {CHUNKS},
f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, idx) AS again FROM chunks)
SELECT doc_id, idx, source, 1.0 AS relevance_score, 'full_content' AS matched_task FROM f WHERE again = 1 ORDER BY doc_id, idx LIMIT 15""")
def retrieve_fallback(spark, sf):
    rows = chunks(spark, sf).select("doc_id", "idx", "source", "text")
    return embedding.retrieve_fallback(rows, ["doc_id", "idx"]).select(
        "doc_id", "idx", "source", "relevance_score", "matched_task"
    )


@query("dedup_text", """
SELECT doc_id, copies, substr(md5(text), 1, 12) AS text_hash FROM documents JOIN (
  SELECT MIN(doc_id) AS doc_id, COUNT(*) AS copies FROM documents GROUP BY md5(text)) USING (doc_id)""")
def dedup_text(spark, sf):
    kept = embedding.distinct_texts(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return kept.select("doc_id", "copies", "text_hash")


@query("text_fingerprint", "SELECT doc_id, substr(md5(text), 1, 12) AS text_hash FROM documents")
def text_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", embedding.text_hash(F.col("text")).alias("text_hash"))


# -- export forms -------------------------------------------------------------------------


@query("sink_jsonl", f"""WITH {CHUNKS} SELECT md5(to_json(struct_pack(id := idx, text := text, tokens := {TOK},
  metadata := struct_pack(start_char := start_char, end_char := start_char + length(text))))::VARCHAR) AS digest FROM chunks""")
def sink_jsonl(spark, sf):
    from ..sources.sinks import write_lines

    lines = embedding.jsonl_lines(chunks(spark, sf))
    return write_lines(lines, "jsonl").select(F.md5("value").alias("digest"))


@query("export_embedding_rows", f"""WITH {CHUNKS} SELECT doc_id, 'chunk_' || CAST(idx AS VARCHAR) AS id, {TOK} AS token_count,
  idx AS index, start_char AS char_start, start_char + length(text) AS char_end FROM chunks""")
def export_embedding_rows(spark, sf):
    rows = embedding.embedding_records(chunks(spark, sf), ["doc_id"])
    return rows.select("doc_id", "id", "token_count", "metadata.index", "metadata.char_start", "metadata.char_end")


@query("sink_vector_columnar", f"""WITH {CHUNKS}
SELECT source, doc_id, array_to_string(list('chunk_' || CAST(idx AS VARCHAR) ORDER BY idx), ',') AS ids, COUNT(*) AS vectors
FROM chunks GROUP BY source, doc_id""")
def sink_vector_columnar(spark, sf):
    batches = embedding.vector_batches(embedded(spark, sf), "source", "doc_id")
    return batches.select("source", "doc_id", F.array_join("ids", ",").alias("ids"), F.size("embeddings").alias("vectors"))


@query("sink_vector_records", f"""WITH {CHUNKS} SELECT doc_id, 'chunk_' || CAST(idx AS VARCHAR) AS id, md5(text) AS digest, 100 AS dimensions,
  {TOK} AS tokens, substr(md5(text), 1, 12) AS text_hash FROM chunks""")
def sink_vector_records(spark, sf):
    from ..session import materialize

    stored = materialize(embedding.vector_records(embedded(spark, sf), ["doc_id"]), "vector-records")
    return stored.select("doc_id", "id", F.md5("text").alias("digest"), F.size("vector").alias("dimensions"), "tokens", "text_hash")


@query("rag_prepare", f"""WITH {fixed_sql(SIZE, OVERLAP, keep="doc_id")}, c AS (SELECT doc_id, COUNT(*) AS chunks_count,
  md5(string_agg(md5(text), ',' ORDER BY idx)) AS digest FROM chunks GROUP BY doc_id)
SELECT doc_id, chunks_count, digest, length(text) AS markdown_length, length(CASE WHEN length(text) > 5000 THEN left(text, 5000) || '...' ELSE text END) AS preview_length
FROM c JOIN documents USING (doc_id)""")
def rag_prepare(spark, sf):
    docs = wide_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    rows = prepare.prepare(docs, "doc_id", "text", SIZE, OVERLAP, "fixed_size", export="records")
    texts = F.array_join(F.transform("export", lambda e: F.md5(e["text"])), ",")
    return rows.select("doc_id", "chunks_count", F.md5(texts).alias("digest"), "markdown_length",
                       F.length("markdown").alias("preview_length"))


@query("rag_prepare_packed")
def rag_prepare_packed(spark, sf):
    docs = wide_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    rows = prepare.prepare(docs, "doc_id", "text", SIZE, OVERLAP, export="arrays")
    return rows.select("doc_id", "chunks_count", "markdown_length", "markdown", "export.ids", "export.embeddings")
