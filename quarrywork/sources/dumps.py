"""Rows of SQL dumps (MySQL and PostgreSQL), extracted as a Spark job.

A dump is read in splits, each by its own task. Where strings, quoted names, comments, dollar quotes, COPY blocks and
statements begin and end follows from a lexer that runs from all its states at once (:mod:`.lexers`), put together
from split to split (:mod:`.chunked`); so a value may hold any line end, quote, semicolon or comment sign, and a line any
number of statements.

INSERT statements and COPY blocks become ``(table_name, columns, values)``; values are cast to
the types the caller declares. What looks like data but yields no rows, or not all of its text, is
listed by :func:`read_errors`; nothing is left out in silence. Table definitions are not translated. Bodies between
``DELIMITER`` lines are not data, nor are MySQL's conditional comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import chunked
from .lexers import MYSQL, POSTGRES, SqlLexer

# A MySQL string may hold backslash escapes; a PostgreSQL string only if it has the prefix E.
_ESCAPED = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_PLAIN = r"'[^']*+(?:''[^']*+)*+'"
STRINGS = {
    MYSQL: rf'(?:{_ESCAPED}|"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+")',
    POSTGRES: rf"(?:[eE]{_ESCAPED}|{_PLAIN}|\$\$.*?\$\$|\$(?P<tag{{n}}>[^\W\d]\w*)\$.*?\$(?P=tag{{n}})\$)",
}
NAME = r"""(?:`[^`]+`|"[^"]+"|[\w$]+)"""
INSERT = re.compile(rf"(?is)\s*(?:INSERT|REPLACE)(?:\s+(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE))*\s+INTO\s+((?:{NAME}\s*\.\s*)*)({NAME})\s*(?:\(([^)]*)\)\s*)?VALUES?\s*")
COPY = re.compile(rf"(?is)\s*COPY\s+((?:{NAME}\s*\.\s*)*)({NAME})\s*(?:\(([^)]*)\)\s*)?FROM\s+stdin\b.*")
#: What may follow the rows of an INSERT.
TAIL = re.compile(r"(?is)\s*(?:(?:AS\s+\w+\s*)?ON\s+(?:DUPLICATE|CONFLICT)\b.*|RETURNING\b.*)?;?\s*")
DATA = re.compile(r"(?is)\s*(?:INSERT|REPLACE|COPY|LOAD)\b")
#: Rows put together before they go back to Spark.
MOST_ROWS = 1_000
#: Dollar quotes of different names in one set of files.
MOST_TAGS = 50

# Declared type families and the type rows are cast to.
TYPE_FAMILIES = (
    (r"(?i)^(tiny|small|medium|big)?int|^integer|^serial|^bigserial", "bigint"),
    (r"(?i)^(decimal|numeric)\s*\((\d+)\s*,\s*(\d+)\)", "decimal"),
    (r"(?i)^(decimal|numeric|real|double|float)", "double"),
    (r"(?i)^(datetime|timestamp)", "timestamp"),
    (r"(?i)^date\b", "date"),
    (r"(?i)^bool", "boolean"),
)


def spark_type(declared: str) -> str:
    """Spark type of a declared column type; anything unknown stays a string."""
    for pattern, target in TYPE_FAMILIES:
        hit = re.search(pattern, declared.strip())
        if hit:
            return f"decimal({hit.group(2)},{hit.group(3)})" if target == "decimal" else target
    return "string"


class Values:
    """Rows of statements and of COPY lines."""

    def __init__(self, dialect: str):
        string = iter(STRINGS[dialect].replace("{n}", str(n)) for n in range(9))
        literal = rf"(?:_\w+\s*|[bBnNxX])?{next(string)}(?:\s*::\s*[\w \[\]]++(?:\([\d, ]*\))?)*"
        quotes = "'\"" if dialect == MYSQL else "'$"
        call = rf"\((?:[^(){quotes}]++|{next(string)}|\((?:[^(){quotes}]++|{next(string)})*+\))*+\)"
        value = rf"(?:{literal}|(?:[^,(){quotes}]++|{call})++)"
        self.value = re.compile(rf"(?s)\s*(?P<value>{value})\s*(?P<end>[,)])")
        self.opens = re.compile(r"\s*,?\s*\(")
        self.quoted = re.compile(r"(?s)(_\w+\s*|[bBnNxXeE])?(['\"$].*)")
        self.mysql = dialect == MYSQL

    def plain(self, text: str) -> str | None:
        """A literal's value; other text stays as it is, NULL is null."""
        text = text.strip()
        found = self.quoted.match(text)
        if not found:
            return None if text.upper() == "NULL" else text
        prefix, body = found.groups()
        if body[0] == "$":
            tag = body[: body.index("$", 1) + 1]
            return body[len(tag) : body.rindex(tag)]
        quote = body[0]
        if not self.mysql and quote == '"':
            return text
        inner = body[1 : body.rindex(quote)].replace(quote * 2, quote) if quote * 2 in body[1:-1] else body[1 : body.rindex(quote)]
        return unescaped(inner) if "\\" in inner and (self.mysql or (prefix or "").lower() == "e") else inner

    def rows(self, body: str) -> tuple[list[list[str | None]], str]:
        """The rows after VALUES, and the text that follows them."""
        out, at = [], 0
        while True:
            opened = self.opens.match(body, at)
            row, end = [], opened.end() if opened else at
            while opened:
                found = self.value.match(body, end)
                if not found:
                    return out, body[at:]
                row.append(self.plain(found["value"]))
                end = found.end()
                if found["end"] == ")":
                    break
            if not opened:
                return out, body[at:]
            out.append(row)
            at = end


_SIGNS = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a"}


def unescaped(text: str) -> str:
    """Backslash escapes: named signs, and any other character for itself."""
    return re.sub(r"(?s)\\(.)", lambda m: _SIGNS.get(m[1], m[1]), text)


def _name(quoted: str) -> str:
    return quoted[1:-1] if quoted[0] in '`"' else quoted


def _listed(columns: str | None) -> list[str] | None:
    return [re.sub(r'[`"\s]', "", c) for c in columns.split(",")] if columns else None


_PARSED = "table_name string, columns array<string>, values array<string>, statement string, reason string"


def parsed(spark: SparkSession, path: str, dialect: str = MYSQL) -> DataFrame:
    """A row per row of data (reason is null), and one per statement that is not given back whole."""
    lines = chunked.read_lines(spark, path)
    tags: tuple[str, ...] = ()
    if dialect == POSTGRES:
        found = F.explode(F.regexp_extract_all("line", F.lit(r"(?U)(?=(\$(?:[^\W\d]\w*)?\$))"), F.lit(1)))
        tags = tuple(sorted(r["tag"] for r in lines.filter(F.contains("line", F.lit("$"))).select(found.alias("tag")).distinct().limit(MOST_TAGS + 1).collect()))
        if len(tags) > MOST_TAGS:
            raise ValueError(f"more than {MOST_TAGS} different dollar quotes")
    lexer = SqlLexer(dialect, tags)
    pieces = chunked.pieces(spark, path, lexer, lines)

    def rows_of(text: str, state: int, header: str | None, values: Values) -> Iterator[tuple]:
        statements: list[str] = []
        copied: list[tuple[str | None, str]] = []
        lexer.scan(text, state, statements, copied, header)
        for statement in statements:
            if not DATA.match(statement):
                continue
            found = INSERT.match(statement)
            if not found:
                if not COPY.match(statement):
                    yield None, None, None, statement, "not a list of values"
                continue
            rows, rest = values.rows(statement[found.end() :])
            for row in rows:
                yield _name(found[2]), _listed(found[3]), row, None, None
            if not rows or not TAIL.fullmatch(rest):
                yield None, None, None, statement, f"text beside the rows: {rest[:200]}"
        for head, body in copied:
            found = COPY.match(head or "")
            if not found:
                if body:
                    yield None, None, None, body[:1000], "lines of a COPY block whose opening is cut"
                continue
            name, listed = _name(found[2]), _listed(found[3])
            for line in body.removesuffix("\n").split("\n") if body else ():
                fields = [None if v == "\\N" else unescaped(v) if "\\" in v else v for v in line.removesuffix("\r").split("\t")]
                yield name, listed, fields, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values(dialect)
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string())
        for batch in batches:
            for text, state, header in zip(*[batch.column(c) for c in ("text", "state", "header")]):
                found = rows_of(text.as_py(), state.as_py(), header.as_py(), values)
                while rows := list(islice(found, MOST_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["table_name", "columns", "values", "statement", "reason"])

    long = pieces.long.select(
        *[F.lit(None).cast(k).alias(n) for n, k in (("table_name", "string"), ("columns", "array<string>"), ("values", "array<string>"))],
        F.regexp_replace("begins", r"^\s+", "").alias("statement"), F.concat(F.lit("a statement of "), F.col("size").cast("string"), F.lit(" characters")).alias("reason"),
    )
    return pieces.whole.select("text", "state", "header").mapInArrow(run, _PARSED).unionByName(long)


def read_dump(spark: SparkSession, path: str, dialect: str = MYSQL) -> DataFrame:
    """Every row of INSERT statements and COPY blocks as ``(table_name, columns, values)``; values are strings or NULL."""
    return parsed(spark, path, dialect).filter("reason is null").select("table_name", "columns", "values")


def read_errors(spark: SparkSession, path: str, dialect: str = MYSQL) -> DataFrame:
    """Statements that carry data which :func:`read_dump` cannot give back whole: statement and reason."""
    return parsed(spark, path, dialect).filter("reason is not null").select("statement", "reason")


def dump_table(rows: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """One table of a dump with its declared columns; values that do not fit become NULL."""
    casts = [
        F.get("values", F.lit(i)).try_cast(spark_type(declared)).alias(column)
        for i, (column, declared) in enumerate(columns.items())
    ]
    return rows.filter(F.col("table_name") == name).select(*casts)


def insert_statements(df: DataFrame, name: str, dialect: str = MYSQL) -> DataFrame:
    """Rows of a table as INSERT statements, the inverse of :func:`read_dump`.

    MySQL's tools write line ends inside strings as escapes, PostgreSQL's as they are.
    """
    def literal(field: T.StructField) -> Column:
        col = F.col(field.name).cast("string")
        if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            quoted = col
        else:
            escaped = F.replace(col, F.lit("\\"), F.lit("\\\\")) if dialect == MYSQL else col
            escaped = F.replace(escaped, F.lit("'"), F.lit("''"))
            escaped = F.replace(escaped, F.lit("\n"), F.lit("\\n")) if dialect == MYSQL else escaped
            quoted = F.concat(F.lit("'"), escaped, F.lit("'"))
        return F.coalesce(quoted, F.lit("NULL"))

    values = F.concat_ws(",", *[literal(f) for f in df.schema.fields])
    table = f"`{name}`" if dialect == MYSQL else f'public."{name}"'
    return df.select(F.concat(F.lit(f"INSERT INTO {table} VALUES ("), values, F.lit(")")).alias("value"))


def copy_blocks(df: DataFrame, name: str) -> DataFrame:
    """Rows of a table as PostgreSQL COPY blocks, one row each."""
    def field(col: Column) -> Column:
        text = F.replace(col.cast("string"), F.lit("\\"), F.lit("\\\\"))
        for sign, char in (("n", "\n"), ("r", "\r"), ("t", "\t")):
            text = F.replace(text, F.lit(char), F.lit(f"\\{sign}"))
        return F.coalesce(text, F.lit("\\N"))

    head = f'COPY public."{name}" ({", ".join(df.columns)}) FROM stdin;\n'
    return df.select(F.concat(F.lit(head), F.concat_ws("\t", *[field(F.col(c)) for c in df.columns]), F.lit("\n\\.\n")).alias("value"))
