import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrywork.functions.fixed import MAX_FILE_BYTES
from quarrywork.session import materialize, shared_root
from quarrywork.sources import binaries, chunked, dumps, files, html, knowledge, lexers, sinks

FINANCE = '''TransactionID,Date,Account,2nd Amount,Description,Status,Status
T-1,2023-01-15,A-9,"1,250.00","License, Annual",Cleared,
T-2,2023-01-16,,450.50,"Flight to NY
(Seat 12A)",Pending,"{""trip_id"": 555}"
T-3,2023/01/17,A-7,120.00,"Dinner - ""Steak""",Cleared,
,,,,,,
'''

DUMP = """/*!40101 SET NAMES utf8mb4 */;
-- table
CREATE TABLE `log` (
  `id` bigint unsigned NOT NULL,
  `body` json DEFAULT NULL
) ENGINE=InnoDB;
LOCK TABLES `log` WRITE;
INSERT INTO `log` VALUES (1,'{"ip": "1.2.3.4", "d": "a,b(c)"}','2023-12-01 08:00:00'),(2,'it''s \\\\ \\'q\\'\\nnew',NULL);
UNLOCK TABLES;
INSERT INTO "other" (a, b) VALUES (-1, 2.5), (3, 'x');
"""


def test_csv(spark, tmp_path):
    path = tmp_path / "q3 financials.csv"
    path.write_bytes(FINANCE.encode() + "T-9,,,\xff,,,\n".encode("latin-1"))
    df = files.read_csv(spark, str(path))
    assert df.columns == ["TransactionID", "Date", "Account", "col_2nd_Amount", "Description", "Status", "Status_2"] or \
        len(set(df.columns)) == 7
    rows = df.collect()
    assert len(rows) == 5
    by_id = {r.TransactionID: r for r in rows}
    assert by_id["T-2"].Description == "Flight to NY\n(Seat 12A)"
    assert by_id["T-3"].Description == 'Dinner - "Steak"'
    assert by_id["T-1"].col_2nd_Amount == "1,250.00"
    assert by_id["T-9"].col_2nd_Amount == "�"


@pytest.mark.parametrize("raw, name", [("a b", "a_b"), ("2x", "col_2x"), ("__", "unnamed"), ("é-é", "é_é"), ("a--b_", "a_b")])
def test_names(raw, name):
    assert files.column_name(raw) == name


def test_table_and_unique_names():
    assert files.table_name("x/" + "y" * 90 + ".csv") == "y" * 90
    assert files.unique_names(["a b", "a-b", "A_B", "c"]) == ["a_b", "a_b_2", "A_B_3", "c"]


def test_dump(spark, tmp_path):
    path = tmp_path / "crm.sql"
    path.write_text(DUMP)
    rows = dumps.read_dump(spark, str(path))
    assert {r.table_name: r["count"] for r in rows.groupBy("table_name").count().collect()} == {"log": 2, "other": 2}
    log = dumps.dump_table(rows, "log", {"id": "bigint unsigned", "body": "json", "at": "datetime"}).orderBy("id").collect()
    assert json.loads(log[0].body) == {"ip": "1.2.3.4", "d": "a,b(c)"} and log[0]["at"].hour == 8
    assert log[1].body == "it's \\ 'q'\nnew" and log[1]["at"] is None
    other = dumps.dump_table(rows, "other", {"a": "int", "b": "decimal(5,2)"}).collect()
    assert sorted((r.a, r.b and float(r.b)) for r in other) == [(-1, 2.5), (3, None)]


def test_dump_with_a_very_long_value(spark, tmp_path):
    path = tmp_path / "long.sql"
    body = ("it''s, (so) " * 40_000)
    path.write_text(f"INSERT INTO t VALUES (1,'{body}');\n")
    row = dumps.dump_table(dumps.read_dump(spark, str(path)), "t", {"a": "int", "b": "text"}).first()
    assert row.b == body.replace("''", "'")


NINE = """-- it's a comment; with a quote
INSERT INTO public.customers VALUES (1, 'a;
b');
INSERT INTO "public"."customers" (id, name) VALUES (2, 'x -- y'), (3, 'line
-- not a comment
end');
/*!40000 ALTER TABLE `customers` DISABLE KEYS */;
INSERT IGNORE INTO customers VALUES (4, _binary 'z'), (5, NOW()), (6, concat('a', lower('B,(')));
INSERT INTO customers VALUES (7, '-- don''t'), (8, N'n') ON DUPLICATE KEY UPDATE id = id;
REPLACE INTO `shop`.`customers` VALUES (9, NULL);
INSERT INTO customers SELECT * FROM old;
INSERT INTO customers VALUES (10, 'ok') oops (11;
CREATE TABLE t (a int);
"""


@pytest.mark.parametrize("split", [None, 40])
def test_dump_loses_nothing(spark, tmp_path, split):
    path = tmp_path / "nine.sql"
    path.write_text(NINE)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = dumps.read_dump(spark, str(path))
        listed = dumps.read_errors(spark, str(path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {r["id"]: r["name"] for r in dumps.dump_table(rows, "customers", {"id": "int", "name": "text"}).collect()}
    errors = [r["statement"] for r in listed.collect()]
    assert got == {
        1: "a;\nb", 2: "x -- y", 3: "line\n-- not a comment\nend", 4: "z", 5: "NOW()", 6: "concat('a', lower('B,('))", 7: "-- don't", 8: "n",
        9: None, 10: "ok",
    }
    assert sorted(e[:30] for e in errors) == ["INSERT INTO customers SELECT *", "INSERT INTO customers VALUES ("]


def test_copy_blocks(spark, tmp_path):
    path = tmp_path / "pg.sql"
    path.write_text("SET x = 'y';\nCOPY public.t (id, body) FROM stdin;\n1\tit's; a\\tb\n2\t\\N\n3\tc:\\\\dir;\n\\.\n\nINSERT INTO t VALUES (4, 'c:\\');\nINSERT INTO t VALUES (5, E'it\\'s');\n")
    rows = dumps.read_dump(spark, str(path), dumps.POSTGRES)
    got = {r["id"]: r["body"] for r in dumps.dump_table(rows, "t", {"id": "int", "body": "text"}).collect()}
    assert got == {1: "it's; a\tb", 2: None, 3: "c:\\dir;", 4: "c:\\", 5: "it's"}
    assert dumps.read_errors(spark, str(path), dumps.POSTGRES).collect() == []


@pytest.mark.parametrize("declared, kind", [
    ("tinyint(1)", "bigint"), ("INT unsigned", "bigint"), ("decimal(10,2)", "decimal(10,2)"), ("double", "double"),
    ("datetime", "timestamp"), ("enum('a')", "string"), ("varchar(9)", "string"), ("date", "date"),
])
def test_declared_types(declared, kind):
    assert dumps.spark_type(declared) == kind


def test_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert files.ingest(spark, str(tmp_path / "a.csv")).first().asDict() == {"x": 1, "y": 2}
    with pytest.raises(files.UnsupportedFile):
        files.ingest(spark, "a.xlsx")


def test_xml_and_metrics(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><e><id>1</id></e><e><id>2</id></e></r>")
    assert files.read_xml(spark, str(tmp_path / "a.xml"), "e").count() == 2
    (tmp_path / "m.json").write_text(json.dumps([{"file_type": ".csv", "success": True}, {"file_type": ".md"}]))
    rows = files.read_metrics(spark, str(tmp_path / "m.json")).collect()
    assert [r.file_type for r in rows] == [".csv", ".md"] and rows[0].success is True


def test_binary_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    good = {"a.pdf": b"%PDF-1.7 xx", "b.txt": "héllo wörld".encode(), "c.html": b"<!DOCTYPE html><p>Hi <b>you</b></p>", "d.bin": b"\x00" * 20}
    bad = {"e.pdf": b"<!DOCTYPE html>", "f.txt": b"\xff\xfe\xfa" * 5, "g.json": b"{}", "sub/h.png": b"\x89PNG____"}
    for name, data in {**good, **bad, ".hidden": b"secret file"}.items():
        (tmp_path / name).write_bytes(data)
    rows = binaries.read_files(spark, str(tmp_path))
    valid = {r.name: r.ok for r in rows.select("name", binaries.valid_magic(F.col("content"), F.col("ext")).alias("ok")).collect()}
    assert valid == {**{n: True for n in good}, "e.pdf": False, "f.txt": False, "g.json": False, "h.png": True}
    done = {r.name: r for r in binaries.convert(rows, "text").collect()}
    assert done["c.html"].text == "Hi you" and done["c.html"].output_name == "c.txt"
    assert done["f.txt"].error and done["f.txt"].output_name == "f_error.txt" and done["a.pdf"].text is None


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.txt", "first file text")
        z.writestr("in/.hidden.txt", "no")
        z.writestr("two.html", "<!DOCTYPE html><p>second</p>")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 not an archive")
    (tmp_path / "plain.txt").write_text("plain file text")
    rows = binaries.convert(binaries.expand_archives(binaries.read_files(spark, str(tmp_path))), "text").collect()
    assert {r.name: r.text for r in rows} == {
        "one.txt": "first file text", "two.html": "second", "plain.txt": "plain file text", "broken.zip": None,
    }


def test_size_guard(spark):
    df = spark.createDataFrame([(MAX_FILE_BYTES, ".pdf"), (MAX_FILE_BYTES + 1, ".pdf"), (1, ".exe")], "n bigint, ext string")
    got = [r[0] for r in df.select(binaries.reject_reason(F.col("n"), F.col("ext"))).collect()]
    assert got[0] is None and got[1].startswith("File too large. Maximum size is 50MB.") and got[2] == "File type not supported"


@pytest.mark.parametrize("page, text", [
    ("<h1>T</h1><p>a <i>b</i></p><ul><li>x<li>y</ul>", "# T\n\na *b*\n\n- x\n- y"),
    ("<head><title>n</title></head><script>x</script>vis<br>ible", "vis\nible"),
    ("<a href='u'>l</a> &amp; co", "[l](u) & co"),
    (None, None),
])
def test_html(spark, page, text):
    assert spark.createDataFrame([(page,)], "page string").select(html.html_to_text(F.col("page"))).first()[0] == text


@pytest.mark.parametrize("url, kind, name", [
    ("http://x.org/a/b.pdf?x=1", None, "b.pdf"), ("http://x.org/a/report", "text/plain; charset=x", "report.txt"),
    ("http://x.org/a/", "image/png", "a.html"),
])
def test_url_names(spark, url, kind, name):
    df = spark.createDataFrame([(url, kind)], "u string, k string")
    assert df.select(html.url_file_name(F.col("u"), F.col("k"))).first()[0] == name


def test_corpus_and_knowledge_base(spark, tmp_path):
    base = tmp_path / "docs"
    (base / "node_modules").mkdir(parents=True)
    (base / "a.md").write_text("# A\n" + "word " * 900)
    (base / "b.md").write_text("Text of b")
    (base / "blank.md").write_text(" \n")
    (base / "c.txt").write_text("not markdown")
    (base / "node_modules" / "v.md").write_text("vendored")
    assert files.read_corpus(spark, str(base)).count() == 2
    kb = knowledge.build(spark, str(base), str(tmp_path / "kb.jsonl"))
    row = kb.summary().first()
    assert (row.total_docs, row.total_chunks, row.embedding_dim) == (2, 3, 100)


def test_event_rows(spark, tmp_path):
    df = spark.createDataFrame([("1.2.3.4", "m" * 600, "2024-01-05 10:00:00"), ("x", "short", "2024-01-06 10:00:00")],
                               "ip string, error_message string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    path = str(tmp_path / "events")
    for _ in range(2):
        sinks.append_events(sinks.event_rows(df), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 4 and "ip" not in rows.columns
    longest = rows.orderBy(F.length("error_message").desc()).first()
    assert len(longest.error_message) == 500 and longest.error_message.endswith("...") and len(longest.ip_hash) == 16


def test_materialize(spark):
    df = materialize(spark.range(10), "unit")
    assert df.count() == 10 and shared_root(spark)


def narrow(spark, size):
    """Splits of ``size`` bytes, and chunks of a few lines."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        before = chunked.CHUNK, chunked.FIRST_CHUNK
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            chunked.CHUNK, chunked.FIRST_CHUNK = max(20, size // 3), 20
        try:
            yield
        finally:
            chunked.CHUNK, chunked.FIRST_CHUNK = before
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")

    return held()


PROBE = """/* don't */ INSERT INTO a VALUES (1, 'x');
INSERT INTO a VALUES (2, "it's"); # don't
# it's
INSERT INTO a VALUES (3, 'y') /* isn't; */; INSERT INTO b VALUES (4, 'z'), (5, 'a;b'); INSERT INTO a VALUES (6, 'l1\r\nl2\rl3\nl4');
/* a long
 comment; INSERT INTO a VALUES (99, 'no');
*/ INSERT INTO a VALUES (7, 'q /* no comment */ -- neither # nor this');
DELIMITER ;;
CREATE PROCEDURE p() BEGIN INSERT INTO a VALUES (98, 'no'); END ;;
DELIMITER ;
INSERT INTO `a` VALUES (8, 'back\\\\'), (9, 'quote\\''), (10, ''''), (11, "say ""hi"" to");
-- don't
INSERT INTO a VALUES (12, '
;
');
"""


@pytest.mark.parametrize("size", [None, 60])
def test_dump_of_awkward_comments_and_quotes(spark, tmp_path, size):
    path = tmp_path / "probe.sql"
    path.write_bytes(PROBE.encode())
    with narrow(spark, size):
        found = dumps.parsed(spark, str(path))
    rows = [(r["table_name"], int(r["values"][0]), r["values"][1]) for r in found.filter("reason is null").collect()]
    assert found.filter("reason is not null").collect() == []
    assert sorted(rows) == [
        ("a", 1, "x"), ("a", 2, "it's"), ("a", 3, "y"), ("a", 6, "l1\r\nl2\rl3\nl4"), ("a", 7, "q /* no comment */ -- neither # nor this"),
        ("a", 8, "back\\"), ("a", 9, "quote'"), ("a", 10, "'"), ("a", 11, 'say "hi" to'), ("a", 12, "\n;\n"), ("b", 4, "z"), ("b", 5, "a;b"),
    ]


PG_PROBE = """/* outer /* don't */ still; */ INSERT INTO t VALUES (1, 'c:\\');
INSERT INTO t VALUES (2, E'it\\'s; ok'), (3, $$dollar's; body$$), (4, $fn$a $$ b; $fn$);
CREATE FUNCTION f() RETURNS int AS $body$ BEGIN INSERT INTO t VALUES (99, 'no'); END; $body$ LANGUAGE plpgsql;
COPY public.t (id, body) FROM stdin;
5\tit's; -- a\\tb $$
6\t/* no
7\t\\N
\\.
INSERT INTO "t" VALUES (8, 'two
lines; "quoted'); COPY u FROM stdin;
9\tx
\\.
INSERT INTO t VALUES (10, 'end'::text);
"""


@pytest.mark.parametrize("size", [None, 60])
def test_postgres_dump_of_awkward_quotes(spark, tmp_path, size):
    path = tmp_path / "probe.sql"
    path.write_bytes(PG_PROBE.encode())
    with narrow(spark, size):
        found = dumps.parsed(spark, str(path), dumps.POSTGRES)
    rows = [(r["table_name"], int(r["values"][0]), r["values"][1]) for r in found.filter("reason is null").collect()]
    assert found.filter("reason is not null").collect() == []
    assert sorted(rows, key=lambda r: (r[0], r[1])) == [
        ("t", 1, "c:\\"), ("t", 2, "it's; ok"), ("t", 3, "dollar's; body"), ("t", 4, "a $$ b; "), ("t", 5, "it's; -- a\tb $$"), ("t", 6, "/* no"), ("t", 7, None),
        ("t", 8, 'two\nlines; "quoted'), ("t", 10, "end"), ("u", 9, "x"),
    ]


def test_lexers_do_not_depend_on_the_cuts():
    """Cut at any lines, run from every state, put together by state: the same statements as in one piece."""
    for dialect, text in ((dumps.MYSQL, PROBE), (dumps.POSTGRES, PG_PROBE)):
        lexer = lexers.SqlLexer(dialect, ("$$", "$fn$", "$body$"))
        lines = text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")]
        states = [lexer.start]
        for line in lines:
            states.append(lexer.scan(line, states[-1]).state)
        for lo in range(len(lines)):
            for hi in range(lo + 1, len(lines) + 1):
                assert lexer.scan("".join(lines[lo:hi]), states[lo]).state == states[hi]


def test_a_statement_without_end_is_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunked, "LONGEST", 200)
    path = tmp_path / "open.sql"
    path.write_text("INSERT INTO a VALUES (1, 'x');\nINSERT INTO a VALUES (2, 'never closed\n" + "INSERT INTO a VALUES (3, \"y\");\n" * 40)
    with narrow(spark, 300):
        found = dumps.parsed(spark, str(path))
    assert [r["values"] for r in found.filter("reason is null").collect()] == [["1", "x"]]
    errors = found.filter("reason is not null").collect()
    assert len(errors) == 1 and errors[0]["statement"].startswith("INSERT INTO a VALUES (2") and "characters" in errors[0]["reason"]


@pytest.mark.parametrize("size", [None, 200])
def test_multi_line_csv_in_many_tasks(spark, tmp_path, size):
    """One file whose values hold line ends, quotes and delimiters is cut at records, whatever the splits."""
    import csv as library
    import random

    draw = random.Random(7)
    word = lambda: "".join(draw.choice('ab,"\n\r é') for _ in range(draw.randrange(12)))
    rows = [[str(i), word().strip(" ") or "x", draw.choice(["1.5", "-2", ""])] for i in range(120)]
    path = tmp_path / "one.csv"
    with open(path, "w", newline="", encoding="utf-8") as file:
        library.writer(file, lineterminator="\n", quoting=library.QUOTE_ALL).writerows([["id", "text", "x"], *rows])
    with narrow(spark, size):
        found = files.read_csv(spark, str(path))
        splits = files.csv_records(spark, str(path)).select("split").distinct().count()
    assert found.dtypes == [("id", "bigint"), ("text", "string"), ("x", "double")]
    # Spark's parser turns line ends inside quotes into line feeds
    line = lambda t: t.replace("\r\n", "\n").replace("\r", "\n")
    with narrow(spark, size):
        given = files.read_csv(spark, str(path), "id bigint, text string, x double")
    for df in (found, given):
        assert sorted((r["id"], line(r["text"] or "")) for r in df.collect()) == [(int(i), line(t)) for i, t, _ in rows]
    assert splits > 10 if size else splits == 1


def test_csv_types_and_broken_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e\n1,true,2020-01-02,x,2020-01-02 03:04:05\n-2,false,,1.5,2021-01-02T03:04:05\n,,2020-02-30,2,\n4,true\n5,true,2020-01-01,y,,extra\n")
    found = files.read_csv(spark, str(path), corrupt="bad")
    assert found.dtypes == [("a", "bigint"), ("b", "boolean"), ("c", "string"), ("d", "string"), ("e", "timestamp"), ("bad", "string")]
    rows = {r["a"]: r for r in found.collect()}
    assert len(rows) == 5 and rows[4]["bad"] == "4,true" and rows[4]["b"] and rows[5]["bad"].endswith("extra") and rows[1]["bad"] is None
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    assert files.read_csv(spark, str(empty)).dtypes == [("a", "string"), ("b", "string")]


@pytest.mark.parametrize("page, text", [
    ("it&#8217;s caf&eacute; &#x27;q&#x27; <a href=/x/y>go</a>", "it\u2019s caf\u00e9 'q' [go](/x/y)"),
    ("&amp;lt; &amp;#65; &lt;b&gt; &#0; &#xD800; &#x110000; &#146; &#x1F600;", "&lt; &#65; <b> \ufffd \ufffd \ufffd \u2019 \U0001f600"),
    ("a&nbsp;b&#160;c &copy 2020 &unknown; & &; &#; &notit; R&D", "a b c \u00a9 2020 &unknown; & &; &#; &notit; R&D"),
    ("<a href='/a?x=1&amp;y=2'>one</a> <a class=k href = two target=_blank>2</a> <a>none</a>", "[one](/a?x=1&y=2) [2](two) [none]()"),
    ("&nGt; &NotEqualTilde; &CounterClockwiseContourIntegral;", "\u226b\u20d2 \u2242\u0338 \u2233"),
])
def test_references_and_links(spark, page, text):
    df = spark.createDataFrame([(page,)], "page string")
    assert df.select(html.html_to_text(F.col("page"))).first()[0] == text


def test_link_targets(spark):
    df = spark.createDataFrame([("<a href=/x/y>go</a><a id=1 HREF='b?c&amp;d'>x</a><a title=t href=\"e\">y</a><a name=z>w</a>",)], "page string")
    assert df.select(html.links(F.col("page"))).first()[0] == ["/x/y", "b?c&d", "e"]


def test_files_written_from_tasks_and_the_pushed_length(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}.txt", bytes([65] * (i * 100))) for i in range(1, 9)] + [("x.exe", b"1"), (None, b"2")], "name string, content binary")
    folder = shared_root(spark) + "/files-test-" + tmp_path.name
    assert binaries.write_files(rows.repartition(3), folder).count() == 9
    found = binaries.accepted_files(spark, folder, 350)
    assert sorted((r["name"], len(r["content"])) for r in found.collect()) == [(f"p{i}.txt", i * 100) for i in (1, 2, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,350)" in plan
    listed = binaries.read_files(spark, folder).select("name", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listed
