"""Checks and conversion of whole files read with the ``binaryFile`` source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import CONVERTIBLE_EXTENSIONS, MAGIC_BYTES, MAX_FILE_BYTES, TEXT_EXTENSIONS
from ..functions.markdown import md_to_text
from ..session import materialize
from .html import html_to_text


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` with its lower-cased ending; hidden files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return with_extension(files.withColumn("name", name).filter(~F.startswith("name", F.lit("."))), "name")


def accepted_files(spark: SparkSession, path: str, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """The files below ``path`` that may be converted; the source itself leaves larger ones unopened."""
    return read_files(spark, path).filter((F.col("length") <= limit) & F.col("ext").isin(*CONVERTIBLE_EXTENSIONS))


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write every row's bytes as a file of its own below ``folder``, from the tasks; returns name and length.

    Names must be unique; a repeated task writes the same file again. ``folder`` lies where all executors can reach it.
    """
    place = re.sub(r"^file:/+", "/", folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(place)
        system.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for own, data in zip(*[batch.column(c).to_pylist() for c in ("name", "content")]):
                with system.open_output_stream(f"{base}/{own}", compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names=["name", "length"])

    rows = files.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).filter("name is not null and content is not null")
    return materialize(rows.mapInArrow(write, "name string, length bigint"), "written-files")


def zipped(files: DataFrame, group: Column, name: str = "name", content: str = "content") -> DataFrame:
    """One ZIP file per ``group``: its name and bytes. A group is as large as the archive that is wanted."""

    def pack(table: pa.Table) -> pa.Table:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            for own, body in sorted(zip(table.column("name").to_pylist(), table.column("content").to_pylist())):
                archive.writestr(zipfile.ZipInfo(own), body)
        return pa.table({"name": pa.array([table.column("archive")[0].as_py()], pa.string()), "content": pa.array([data.getvalue()], pa.binary())})

    rows = files.select(group.cast("string").alias("archive"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.groupBy("archive").applyInArrow(pack, "name string, content binary")


def with_extension(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("ext", F.lower(F.regexp_extract(F.col(name), r"(\.[^./]+)$", 1)))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files inside archives, one at a time; an archive or member that cannot be read becomes a row as it is."""
    def row(*values) -> pd.DataFrame:
        return pd.DataFrame([values], columns=["path", "name", "length", "content"])

    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for info in archive.infolist():
                        name = info.filename.rsplit("/", 1)[-1]
                        if not info.is_dir() and not name.startswith("."):
                            yield row(f"{path}!/{info.filename}", name, info.file_size, archive.read(info))
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                yield row(path, path.rsplit("/", 1)[-1], len(data), data)


def expand_archives(files: DataFrame) -> DataFrame:
    """Replace ZIP files by the files inside them; hidden members are skipped.

    Members leave the task one by one; :func:`reject_reason` tells which are too large to convert.
    """
    cols = ["path", "name", "length", "content"]
    zipped = F.col("ext") == ".zip"
    inside = files.filter(zipped).select("path", "content").mapInPandas(
        _members, "path string, name string, length bigint, content binary"
    )
    return with_extension(files.filter(~zipped).select(cols).unionByName(inside), "name")


def _starts(content: Column, magic: bytes) -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(magic)


def valid_magic(content: Column, ext: Column) -> Column:
    """Whether the leading bytes agree with the ending.

    Fewer than eight bytes are invalid. The first known signature decides; without one
    text endings must decode as UTF-8 and others pass.
    """
    checks = F.when(F.length(content) < 8, F.lit(False))
    for magic, endings in MAGIC_BYTES:
        checks = checks.when(_starts(content, magic), ext.isin(*endings))
    return checks.when(ext.isin(*TEXT_EXTENSIONS), F.is_valid_utf8(content.cast("string"))).otherwise(True)


def reject_reason(length: Column, ext: Column, limit: int = MAX_FILE_BYTES) -> Column:
    """Why a file is not accepted (ending or size), NULL when it is."""
    size = F.concat(
        F.lit(f"File too large. Maximum size is {limit // (1024 * 1024)}MB. Your file is "),
        F.format_string("%.1f", length / (1024 * 1024)), F.lit("MB."),
    )
    return F.when(~ext.isin(*CONVERTIBLE_EXTENSIONS), "File type not supported").when(length > limit, size)


PLAIN_TEXT = (".txt", ".csv", ".json", ".xml", ".md")
WEB_PAGES = (".html", ".htm")


def convert(files: DataFrame, output: str = "markdown") -> DataFrame:
    """One text per file, or an error instead; a bad file never fails the job."""
    as_text = F.col("content").cast("string")
    readable = F.is_valid_utf8(as_text)
    known = F.col("ext").isin(*PLAIN_TEXT, *WEB_PAGES)
    error = (
        F.when(~known, F.concat(F.lit("Conversion failed: no converter for "), F.col("ext")))
        .when(~readable, F.lit("Conversion failed: not UTF-8 text"))
        .when(~valid_magic(F.col("content"), F.col("ext")), F.lit("Conversion failed: content does not match type"))
    )
    staged = files.withColumn("error", error)
    page = F.when(F.col("error").isNull() & F.col("ext").isin(*WEB_PAGES), as_text)
    text = F.when(F.col("error").isNull(), F.coalesce(html_to_text(page), as_text))
    if output == "text":
        text = md_to_text(text)
    ending = ".txt" if output == "text" else ".md"
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    out_name = F.concat(stem, F.when(F.col("error").isNull(), F.lit(ending)).otherwise(F.lit("_error.txt")))
    return staged.select("path", "name", out_name.alias("output_name"), text.alias("text"), "error")
