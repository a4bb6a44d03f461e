"""Sources and sinks: the tables are written by Spark in a format, then read back and checked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.sqludf import register_functions
from ..operators import reports
from ..session import shared_path, table, wide_table
from ..sources import binaries, catalog, dumps, files, html, knowledge, sinks
from ..streaming import append
from ..streaming.runner import table_stream
from . import sqltext as sx
from .chunk_queries import CHAR_SQL
from .decision_queries import case_of
from .mapping import K_SQL, prop_k
from .registry import REGISTRY, query
from .text_queries import TEXT_SQL


@query("scan_csv", 'SELECT doc_id, md5(text) AS digest, lang FROM documents')
def scan_csv(spark, sf):
    path = shared_path(spark, "documents.csv")
    awkward = table(spark, sf, "documents").select(
        F.col("doc_id").alias("Doc ID"), F.col("text").alias("2nd: text"), F.col("lang").alias("lang!")
    )
    awkward.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = files.read_csv(spark, path, "`Doc ID` bigint, `2nd: text` string, `lang!` string")
    return rows.select(F.col("Doc_ID").alias("doc_id"), F.md5("col_2nd_text").alias("digest"), "lang")


@query("scan_csv_inferred", """SELECT o_orderkey AS order_key, o_totalprice AS total, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_orderstatus || '"' || chr(10) || o_orderpriority END AS note, CASE WHEN o_orderkey % 11 = 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'bad ' || chr(65533) END AS odd,
  o_orderkey % 11 IN (3, 4) AS broken, 'bigint,double,date,string,string' AS kinds FROM orders""")
def scan_csv_inferred(spark, sf):
    """Types, line ends and quotes inside values, bad bytes, short rows (remainder 3) and long ones (4)."""
    path = shared_path(spark, "orders.csv")
    key = F.col("o_orderkey") % 11
    note = F.concat(F.lit('"'), "o_orderstatus", F.lit('""\n'), "o_orderpriority", F.lit('"'))
    odd = F.when(F.col("o_orderkey") % 2 == 0, F.expr("concat('bad ', CAST(X'FF' AS STRING))")).otherwise("")
    start = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.when(key == 3, start).when(key == 4, F.concat_ws(",", start, note, odd, F.lit("more"))).otherwise(F.concat_ws(",", start, note, odd))
    rows = table(spark, sf, "orders").select(line.alias("value"))

    def headed(batches):  # every file begins with the header
        import pyarrow as pa

        for k, batch in enumerate(batches):
            if not k:
                yield pa.RecordBatch.from_arrays([pa.array(["Order Key,total,day,note,odd"], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    rows.mapInArrow(headed, "value string").write.option("lineSep", "\n").text(path)
    found = files.read_csv(spark, path, corrupt="broken")
    kinds = ",".join(f.dataType.simpleString() for f in found.schema.fields[:-1])
    return found.select(
        F.col("Order_Key").alias("order_key"), "total", F.date_format("day", "yyyy-MM-dd").alias("day"), "note", "odd", F.col("broken").isNotNull().alias("broken"),
        F.lit(kinds).alias("kinds"),
    )


@query("load_sql_dump", "SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def load_sql_dump(spark, sf):
    path = shared_path(spark, "documents.sql")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    dumps.insert_statements(docs, "documents").write.option("lineSep", ";\n").text(path)
    declared = {"doc_id": "bigint unsigned", "text": "text", "lang": "char(2)", "n_chars": "int"}
    loaded = dumps.dump_table(dumps.read_dump(spark, path), "documents", declared)
    return loaded.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("load_sql_dump_types", "SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def load_sql_dump_types(spark, sf):
    path = shared_path(spark, "orders.sql")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)"), "o_orderdate")
    dumps.insert_statements(orders, "orders").write.option("lineSep", ";\n").text(path)
    declared = {"o_orderkey": "bigint(20)", "o_custkey": "int", "o_totalprice": "decimal(12,2)", "o_orderdate": "datetime"}
    loaded = dumps.dump_table(dumps.read_dump(spark, path), "orders", declared)
    return loaded.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("load_pg_dump", """SELECT 'documents' AS table_name, doc_id AS id, 0 AS turn, md5(text) AS digest, lang AS kind FROM documents
UNION ALL SELECT 'conversations', conv_id, turn, md5(text), role FROM conversations""")
def load_pg_dump(spark, sf):
    """PostgreSQL's two forms: COPY blocks, and INSERT statements with line ends as they are."""
    path = shared_path(spark, "pg.sql")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    dumps.copy_blocks(docs, "documents").write.option("lineSep", "\n").text(path)
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    dumps.insert_statements(talks, "conversations", dumps.POSTGRES).write.mode("append").option("lineSep", ";\n").text(path)
    rows = dumps.read_dump(spark, path, dumps.POSTGRES)
    first = dumps.dump_table(rows, "documents", {"doc_id": "bigint", "text": "text", "lang": "text"})
    second = dumps.dump_table(rows, "conversations", {"conv_id": "bigint", "turn": "bigint", "role": "text", "text": "text"})
    columns = lambda name, key, turn, kind: (F.lit(name).alias("table_name"), F.col(key).alias("id"), turn.cast("bigint").alias("turn"), F.md5("text").alias("digest"), F.col(kind).alias("kind"))
    return first.select(*columns("documents", "doc_id", F.lit(0), "lang")).unionByName(second.select(*columns("conversations", "conv_id", F.col("turn"), "role")))


@query("load_sql_talks", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def load_sql_talks(spark, sf):
    path = shared_path(spark, "conversations.sql")
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    dumps.insert_statements(talks, "conversations").write.option("lineSep", ";\n").text(path)
    declared = {"conv_id": "bigint", "turn": "bigint", "role": "varchar(9)", "text": "text"}
    return dumps.dump_table(dumps.read_dump(spark, path), "conversations", declared).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("scan_semi", """SELECT 'json' AS format, COUNT(*) AS row_count, CAST(SUM(user_id) AS BIGINT) AS total FROM events
UNION ALL SELECT 'xml', COUNT(*), CAST(SUM(user_id) AS BIGINT) FROM events
UNION ALL SELECT 'text', COUNT(*), CAST(SUM(user_id) AS BIGINT) FROM events""")
def scan_semi(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    schema = "event_id bigint, user_id bigint, event_type string, props string"
    json_path, xml_path, text_path = (shared_path(spark, f"events.{e}") for e in ("json", "xml", "txt"))
    events.write.json(json_path)
    events.write.options(rowTag="event", rootTag="events").xml(xml_path)
    events.select(F.concat_ws("\t", "event_id", "user_id", "event_type").alias("value")).write.text(text_path)
    parts = {
        "json": files.read_json(spark, json_path, schema).select("user_id"),
        "xml": spark.read.schema(schema).option("rowTag", "event").xml(xml_path).select("user_id"),
        "text": files.read_text(spark, text_path).select(F.split_part("value", F.lit("\t"), F.lit(2)).cast("bigint").alias("user_id")),
    }
    counted = [df.agg(F.count("*").alias("row_count"), F.sum("user_id").alias("total")).select(F.lit(n).alias("format"), "*")
               for n, df in parts.items()]
    return reduce(DataFrame.unionByName, counted)


FORMATS = ("csv", "json", "orc", "parquet", "txt")


@query("ingest_dispatch", " UNION ALL ".join(f"SELECT '{f}' AS format, COUNT(*) AS row_count FROM orders" for f in FORMATS))
def ingest_dispatch(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    counted = []
    for name in FORMATS:
        path = shared_path(spark, "orders") + f".{name}"
        if name == "txt":
            orders.select(F.concat_ws(",", *orders.columns).alias("value")).write.text(path)
        else:
            writer = orders.write.option("header", True) if name == "csv" else orders.write
            writer.format(name).save(path)
        loaded = files.ingest(spark, path)
        counted.append(loaded.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("format"), "row_count"))
    return reduce(DataFrame.unionByName, counted)


@query("scan_metric_json", f"""SELECT event_type AS file_type, COUNT(*) AS metrics, CAST(SUM({K_SQL}) AS BIGINT) AS chunks FROM events GROUP BY event_type""")
def scan_metric_json(spark, sf):
    metric = F.struct(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("file_type"),
        F.col("value").alias("duration_seconds"), (F.col("event_type") != "error").alias("success"),
        prop_k().alias("chunks_generated"),
    )
    # one array per line of at most a thousand consecutive metrics
    batch = F.floor(F.col("event_id") / 1000)
    lines = table(spark, sf, "events").groupBy(batch.alias("batch")).agg(F.to_json(F.collect_list(metric)).alias("value")).select("value")
    path = shared_path(spark, "metrics.json")
    lines.write.text(path)
    loaded = files.read_metrics(spark, path, per_line=True)
    return loaded.groupBy("file_type").agg(F.count("*").alias("metrics"), F.sum("chunks_generated").alias("chunks"))


# -- whole files --------------------------------------------------------------------------

ENDINGS = (".html", ".txt", ".pdf", ".json", ".exe")
FILE_SQL = f"""f AS (SELECT page_id, html, 'page_' || page_id || list_extract([{", ".join(sx.q(e) for e in ENDINGS)}], CAST(page_id % 5 + 1 AS INTEGER)) AS name,
  list_extract([{", ".join(sx.q(e) for e in ENDINGS)}], CAST(page_id % 5 + 1 AS INTEGER)) AS ext FROM pages)"""


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under file names with varying endings."""
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), F.pmod("page_id", F.lit(len(ENDINGS))).cast("int"))
    return table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string"), ending).alias("name"), F.encode("html", "UTF-8").alias("content")
    )


def page_folder(spark: SparkSession, sf: str) -> str:
    folder = shared_path(spark, "page-files")
    binaries.write_files(page_rows(spark, sf), folder)
    return folder


def page_id():
    return F.regexp_extract("name", r"^page_(\d+)", 1).cast("bigint").alias("page_id")


@query("scan_binary_magic", f"""WITH {FILE_SQL} SELECT page_id, ext, CASE WHEN octet_length(encode(html)) < 8 THEN false WHEN starts_with(html, '<!DOCTYPE') OR starts_with(html, '<html') THEN ext IN ('.html', '.htm')
  WHEN starts_with(html, '<?xml') THEN ext = '.xml' WHEN starts_with(html, '{{') OR starts_with(html, '[') THEN ext = '.json' ELSE true END AS valid FROM f""")
def scan_binary_magic(spark, sf):
    found = binaries.read_files(spark, page_folder(spark, sf))
    return found.select(page_id(), "ext", binaries.valid_magic(F.col("content"), F.col("ext")).alias("valid"))


@query("scan_size_guard", f"""WITH {FILE_SQL} SELECT page_id, CASE WHEN ext = '.exe' THEN 'File type not supported' WHEN octet_length(encode(html)) > 1048576 THEN 'File too large. Maximum size is 1MB. Your file is ' || format('{{:.1f}}', octet_length(encode(html)) / 1048576.0) || 'MB.' END AS reason FROM f""")
def scan_size_guard(spark, sf):
    reason = binaries.reject_reason(F.col("length"), F.col("ext"), 1024 * 1024)
    # names and lengths come from the listing; no file is opened
    return binaries.read_files(spark, page_folder(spark, sf)).select(page_id(), reason.alias("reason"))


def references_sql(expr: str) -> str:
    """Character references in DuckDB: each piece after an ampersand by number or name."""
    names = ", ".join(f"{sx.q(k)}: {sx.q(v)}" for k, v in html.reference_names().items())
    old = ", ".join(f"{k}: {sx.q(v)}" for k, v in html._CP1252.items())
    return f"""(SELECT coalesce(string_agg(CASE WHEN i = 1 THEN piece WHEN found IS NULL THEN '&' || piece ELSE (CASE WHEN found = chr(160) THEN ' ' ELSE found END) || substr(piece, length(body) + 1) END, '' ORDER BY i), '') FROM (
      SELECT i, piece, body, CASE WHEN body ^@ '#' THEN CASE WHEN code BETWEEN 128 AND 159 THEN MAP {{{old}}}[code] WHEN code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(code) END
        WHEN body <> '' THEN MAP {{{names}}}[body] END AS found FROM (
      SELECT i, piece, body, CASE WHEN lower(body) ^@ '#x' THEN ('0x' || rtrim(substr(body, 3), ';'))::INTEGER WHEN body ^@ '#' THEN rtrim(substr(body, 2), ';')::INTEGER END AS code FROM (
      SELECT i, piece, regexp_extract(piece, {sx.q(html.REFERENCE)}) AS body FROM (SELECT unnest(string_split(x, '&')) AS piece, generate_subscripts(string_split(x, '&'), 1) AS i FROM (SELECT {expr} AS x))))))"""


def page_sql(expr: str) -> str:
    return sx.rules(references_sql(sx.rules(expr, html.MARK_RULES)), html.SPACE_RULES)


_PAGE_TEXT = page_sql("html")
_READ_TEXT = TEXT_SQL.replace("md", "page")
CONVERTED_SQL = f"""WITH {FILE_SQL}, v AS (SELECT *, CASE WHEN octet_length(encode(html)) < 8 THEN false WHEN starts_with(html, '<!DOCTYPE') OR starts_with(html, '<html') THEN ext IN ('.html', '.htm')
  WHEN starts_with(html, '<?xml') THEN ext = '.xml' WHEN starts_with(html, '{{') OR starts_with(html, '[') THEN ext = '.json' ELSE true END AS valid FROM f),
e AS (SELECT *, CASE WHEN ext IN ('.pdf', '.exe') THEN 'Conversion failed: no converter for ' || ext WHEN NOT valid THEN 'Conversion failed: content does not match type' END AS error FROM v),
t AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN ext = '.html' THEN {_PAGE_TEXT} ELSE html END END AS page FROM e)
SELECT page_id, regexp_replace(name, '\\.[^.]*$', '') || CASE WHEN error IS NULL THEN '.txt' ELSE '_error.txt' END AS output_name, length({_READ_TEXT}) AS chars, error FROM t"""


@query("batch_convert", CONVERTED_SQL)
def batch_convert(spark, sf):
    found = binaries.convert(binaries.read_files(spark, page_folder(spark, sf)), "text")
    return found.select(page_id(), "output_name", F.length("text").alias("chars"), "error")


@query("convert_accepted", CONVERTED_SQL + " WHERE ext IN ('.html', '.txt', '.pdf', '.json') AND octet_length(encode(html)) <= 2000")
def convert_accepted(spark, sf):
    """Only files that pass the guard are opened: the length is a filter of the source."""
    found = binaries.convert(binaries.accepted_files(spark, page_folder(spark, sf), 2000), "text")
    return found.select(page_id(), "output_name", F.length("text").alias("chars"), "error")


@query("convert_archives", CONVERTED_SQL)
def convert_archives(spark, sf):
    """Ten pages an archive, read back member by member."""
    folder = shared_path(spark, "page-archives")
    rows = page_rows(spark, sf)
    archive = F.concat(F.lit("pages_"), F.floor(F.col("page_id") / 10).cast("string"), F.lit(".zip"))
    binaries.write_files(binaries.zipped(rows, archive), folder)
    found = binaries.convert(binaries.expand_archives(binaries.read_files(spark, folder)), "text")
    return found.select(page_id(), "output_name", F.length("text").alias("chars"), "error")


@query("html_to_text", f"SELECT page_id, {page_sql('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return wide_table(spark, sf, "pages", "page_id").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query("html_meta", r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
  len(regexp_extract_all(html, '(?is)<a\s(?:[^>]*\s)?href\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)')) AS links, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def html_meta(spark, sf):
    return wide_table(spark, sf, "pages", "page_id").select(
        "page_id", html.title(F.col("html")).alias("title"), F.size(html.links(F.col("html"))).alias("links"),
        F.parse_url("url", F.lit("HOST")).alias("host"),
    )


KINDS = ("text/html; charset=utf-8", "text/plain", "application/pdf", "image/png", "")
URL_NAME = "COALESCE(nullif(list_extract(string_split(regexp_replace(split_part(url, '?', 1), '/+$', ''), '/'), -1), ''), 'document')"


@query("url_format_route", f"""WITH n AS (SELECT page_id, {URL_NAME} AS name, split_part(list_extract([{", ".join(sx.q(k) for k in KINDS)}], CAST(page_id % 5 + 1 AS INTEGER)), ';', 1) AS kind FROM pages)
SELECT page_id, CASE WHEN contains(name, '.') THEN name ELSE name || {case_of('kind', fixed.CONTENT_TYPE_EXTENSIONS, "'.html'")} END AS file_name FROM n""")
def url_format_route(spark, sf):
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.pmod("page_id", F.lit(len(KINDS))).cast("int"))
    return table(spark, sf, "pages").select("page_id", html.url_file_name(F.col("url"), kind).alias("file_name"))


def write_corpus(spark: SparkSession, sf: str) -> str:
    """Documents as text files of at most fifty documents each."""
    path = shared_path(spark, "corpus")
    table(spark, sf, "documents").select("text").write.option("maxRecordsPerFile", 50).text(path)
    return path


@query("scan_corpus_dir", "SELECT CAST(SUM(length(text) + 1) AS BIGINT) AS characters FROM documents")
def scan_corpus_dir(spark, sf):
    corpus = files.read_corpus(spark, write_corpus(spark, sf), "*.txt")
    return corpus.agg(F.sum(F.length("text")).alias("characters"))


@query("build_knowledge_base")
def build_knowledge_base(spark, sf):
    base = knowledge.build(spark, write_corpus(spark, sf), shared_path(spark, "knowledge.jsonl"), pattern="*.txt")
    return base.summary()


# -- telemetry sink -----------------------------------------------------------------------


@query("sink_append_event", """SELECT event_id, substr(sha256('ip-' || user_id), 1, 16) AS ip_hash, strftime(ts, '%Y-%m-%d') AS day, length(m) AS message_length, right(m, 5) AS message_end FROM (
  SELECT *, CASE WHEN length(repeat(props, event_id % 90)) > 500 THEN left(repeat(props, event_id % 90), 497) || '...' ELSE repeat(props, event_id % 90) END AS m FROM events)""")
def sink_append_event(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("ip-"), F.col("user_id").cast("string")).alias("ip"), F.col("ts").alias("created_at"),
        F.expr("repeat(props, CAST(event_id % 90 AS INT))").alias("error_message"),
    )
    path = shared_path(spark, "error-events")
    sinks.append_events(sinks.event_rows(rows), path)
    stored = spark.read.parquet(path)
    return stored.select(
        "event_id", "ip_hash", F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        F.length("error_message").alias("message_length"), F.right("error_message", F.lit(5)).alias("message_end"),
    )


@query("sink_append_stream", "SELECT event_id, user_id, substr(sha256('ip-' || user_id), 1, 16) AS ip_hash, strftime(ts, '%Y-%m-%d') AS day FROM events")
def sink_append_stream(spark, sf):
    """Events appended by a stream, then every day rewritten into few files and read back."""
    events = table_stream(spark, sf, "events").select(
        "event_id", "user_id", F.concat(F.lit("ip-"), F.col("user_id").cast("string")).alias("ip"), F.col("ts").alias("created_at"),
    )
    rows, path = sinks.event_rows(events), shared_path(spark, "event-table")
    append.append_stream(rows, path, shared_path(spark, "event-table-checkpoint"), compact_every=8)
    append.compact(spark, path, rows.schema, least=1)
    stored = append.read_appended(spark, path, rows.schema)
    return stored.select("event_id", "user_id", "ip_hash", F.date_format("day", "yyyy-MM-dd").alias("day"))


# -- functions in SQL ---------------------------------------------------------------------


@query("udf_register", f"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens, substr(md5(text), 1, 12) AS fingerprint,
  md5({sx.replace_all("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Z|a-z]" + "{2,}", "[EMAIL_REDACTED]")}) AS redacted FROM documents""")
def udf_register(spark, sf):
    catalog.register_views(spark, sf, ("documents",))
    register_functions(spark)
    return spark.sql("SELECT doc_id, token_count(text) AS tokens, text_hash(text) AS fingerprint, md5(redact_emails(text)) AS redacted FROM documents")


@query("udtf_chunk", CHAR_SQL)
def udtf_chunk(spark, sf):
    wide_table(spark, sf, "documents", "doc_id").createOrReplaceTempView("documents")
    register_functions(spark)
    return spark.sql("""SELECT d.doc_id, c.idx, md5(c.text) AS digest, c.token_count, c.char_count, c.start_char, c.end_char
      FROM documents d, LATERAL chunk_document(d.text, 512, 50, 'character') c""")


def chunk_table(spark: SparkSession, sf: str, size: int, overlap: int, strategy: str) -> DataFrame:
    wide_table(spark, sf, "documents", "doc_id").createOrReplaceTempView("documents")
    register_functions(spark)
    return spark.sql(f"""SELECT CAST(key AS BIGINT) AS doc_id, idx, md5(text) AS digest, token_count, char_count, start_char, end_char
      FROM chunk_table(TABLE(SELECT doc_id, text FROM documents), {size}, {overlap}, '{strategy}')""")


@query("udtf_chunk_table", CHAR_SQL)
def udtf_chunk_table(spark, sf):
    return chunk_table(spark, sf, 512, 50, "character")


@query("udtf_chunk_table_token", REGISTRY["chunk_token"].sql)
def udtf_chunk_table_token(spark, sf):
    return chunk_table(spark, sf, 128, 16, "token")


@query("udtf_chunk_table_fixed", REGISTRY["chunk_fixed"].sql)
def udtf_chunk_table_fixed(spark, sf):
    return chunk_table(spark, sf, 512, 50, "fixed_size")


@query("api_stats_rollup")
def api_stats_rollup(spark, sf):
    from .decision_queries import priced
    from .mapping import agents, as_of, capacity, conversions, errors, evaluations, sandbox_requests, security

    return reports.api_rollup(
        conversions(spark, sf), errors(spark, sf), security(spark, sf), capacity(spark, sf), sandbox_requests(spark, sf), priced(spark, sf),
        agents(spark, sf), evaluations(spark, sf), as_of(), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
    )
