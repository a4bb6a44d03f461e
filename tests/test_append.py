"""A stream that appends to a table by day: failures, restarts, late days and compaction lose and repeat nothing."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from quarrywork.session import shared_path
from quarrywork.streaming import append

SCHEMA = "id bigint, day date"
FILES = 6


def day(n):
    return datetime.date(2024, 3, 1 + n)


def put(spark, folder, k):
    """File ``k``: rows of its own day, of the day before, of the first day and of none."""
    rows = [(k * 100 + i, (day(k), day(max(k - 1, 0)), day(0), None)[i % 4]) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return rows


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def stored(spark, path):
    return sorted(tuple(r) for r in append.read_appended(spark, path, stream_schema(spark)).select("id", F.col("day").cast("string")).collect())


def stream_schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def expected(rows):
    return sorted((i, str(d) if d else None) for i, d in rows)


@pytest.fixture
def places(spark):
    return [shared_path(spark, f"append-{n}") for n in ("in", "table", "checkpoint")]


@pytest.mark.parametrize("compact_every", [0, 2])
@pytest.mark.parametrize("before", [True, False])
def test_restart_after_a_failure(spark, places, monkeypatch, compact_every, before):
    """The third batch fails before or after its rows are written; the restart runs it again."""
    folder, path, checkpoint = places
    rows = [r for k in range(FILES) for r in put(spark, folder, k)]
    written = []
    true_parquet = DataFrameWriter.parquet

    def parquet(self, target, *args, **kwargs):
        mine = f"raw/{append.BATCH}=2" in target and not written
        if mine and before:
            written.append(target)
            raise RuntimeError("lost")
        true_parquet(self, target, *args, **kwargs)
        if mine:
            written.append(target)
            raise RuntimeError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(Exception):
        append.append_stream(stream(spark, folder), path, checkpoint, compact_every, least=2)
    assert len(written) == 1
    append.append_stream(stream(spark, folder), path, checkpoint, compact_every, least=2)
    assert stored(spark, path) == expected(rows)
    append.compact(spark, path, stream_schema(spark))
    assert stored(spark, path) == expected(rows)


def test_stops_and_late_rows_after_compaction(spark, places):
    folder, path, checkpoint = places
    rows = []
    for k in range(FILES):
        rows += put(spark, folder, k)
        append.append_stream(stream(spark, folder), path, checkpoint)
        if k in (2, 4):
            assert append.compact(spark, path, stream_schema(spark)) > 0
            assert append.compact(spark, path, stream_schema(spark)) == 0
        assert stored(spark, path) == expected(rows)
    table = append.read_appended(spark, path, stream_schema(spark))
    assert append.compact(spark, path, stream_schema(spark), least=1) > 0
    files = append.read_appended(spark, path, stream_schema(spark)).filter(F.col("day") == day(0)).select(F.input_file_name().alias("f"))
    assert files.distinct().count() == 1
    assert table.count() == len(rows)  # a reader from before the compaction still finds its files


def test_failed_compaction_leaves_the_old_pieces(spark, places, monkeypatch):
    folder, path, checkpoint = places
    rows = [r for k in range(3) for r in put(spark, folder, k)]
    append.append_stream(stream(spark, folder), path, checkpoint)
    true_parquet = DataFrameWriter.parquet

    def parquet(self, target, *args, **kwargs):
        if target.endswith("/log"):
            raise RuntimeError("lost")
        true_parquet(self, target, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", parquet)
        with pytest.raises(RuntimeError):
            append.compact(spark, path, stream_schema(spark))
    assert stored(spark, path) == expected(rows)
    assert append.compact(spark, path, stream_schema(spark)) > 0
    assert stored(spark, path) == expected(rows)


def test_nothing_to_append(spark, places):
    folder, path, checkpoint = places
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    append.append_stream(stream(spark, folder), path, checkpoint)
    assert append.compact(spark, path, stream_schema(spark)) == 0
    assert stored(spark, path) == []


def test_names_it_needs(spark, places):
    folder, path, checkpoint = places
    put(spark, folder, 0)
    with pytest.raises(ValueError):
        append.append_stream(stream(spark, folder).withColumnRenamed("day", "at"), path, checkpoint)
    with pytest.raises(ValueError):
        append.append_stream(stream(spark, folder).withColumn("_run", F.lit(1)), path, checkpoint)
