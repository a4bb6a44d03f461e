"""What keeps tasks, workers and the driver small whatever the size of the tables."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quarrywork import session
from quarrywork.functions import sqludf, textstats, vectors
from quarrywork.operators import chunking, keywords, ordered
from quarrywork.sources import dumps


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_lookup_moves_no_repeated_points_to_the_driver(spark, monkeypatch):
    """Points repeated by level are never the broadcast side, though their table looks small."""
    draw = random.Random(3)
    points = [(i, draw.randrange(-500, 500)) for i in range(300)] + [(300, None), (7, 12)]
    spans = [(i, low, low + draw.randrange(-2, 12)) for i in range(200) for low in [draw.randrange(-500, 500)]]
    spans += [(-1, -(10**12), 10**12), (-2, None, 5), (-3, 10, None)]
    want = sorted((p, s) for p, at in points for s, low, high in spans if None not in (at, low, high) and low <= at < high)
    left = spark.createDataFrame(points, "id bigint, at bigint")
    right = spark.createDataFrame(spans, "span bigint, low bigint, high bigint")
    for most in (10**6, 100, 0):  # all levels broadcast, some, none
        monkeypatch.setattr(ordered, "FEW_CELLS", most)
        met = ordered.interval_lookup(left, "at", right, "low", "high", ["span"])
        assert sorted((r.id, r.span) for r in met.select("id", "span").collect()) == want
        plan = plan_of(met)
        assert "BuildLeft" not in plan and plan.count("SortMergeJoin") == (most < 10**6) and ("BroadcastHashJoin" in plan) == (most > 0)
    assert ordered.interval_lookup(left, "at", right.filter("span < -1"), "low", "high", ["span"]).count() == 0


def test_shares_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(session, "SHARE_BYTES", 1_000)
    docs = spark.createDataFrame([(i % 300, f"apple pear number {i} " * 20) for i in range(600)], "id bigint, t string")
    laid = session.lay_out(docs, "id", "t")
    assert laid.rdd.getNumPartitions() == docs.agg(F.ceil(F.sum(F.length("t")) / 1_000)).first()[0]
    assert laid.select("id", F.spark_partition_id().alias("p")).distinct().count() == 300
    found = keywords.keywords_by_frequency(docs, "id", "t", top_n=3)
    shares = [p for p in plan_of(found).splitlines() if "Exchange hashpartitioning" in p]
    assert len(shares) == 1 and "REPARTITION_BY_NUM" in shares[0]
    assert {(r.keyword, r.uses, r.score) for r in found.collect()} == {("apple", 40, 0.3333), ("number", 40, 0.3333), ("pear", 40, 0.3333)}


def test_tfidf_makes_no_row_per_term(spark):
    """Repeated and null keys are one document; a key whose rows have as many sentences shares their places."""
    text = "red apple pie here. green apple tart now. short"
    rows = [(1, text), (1, text), (None, text), (2, "one sentence alone"), (3, None), (None, "blue plum cake. old plum jam. raw plum stew.")]
    found = keywords.keywords_by_tfidf(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", top_n=50)
    plan = plan_of(found)
    assert "Generate" not in plan and "Window" not in plan and "HashAggregate" not in plan
    scores = {(r.id, r.keyword): r.score for r in found.collect()}
    assert {k for k, _ in scores} == {1, None}
    assert scores[1, "red"] == scores[1, "red apple"] == 0.25 and (1, "apple") not in scores
    # of the other row with this key, three sentences; places 0 and 1 are shared, so the unit length is too
    assert (None, "plum") not in scores and scores[None, "raw"] == 0.1667 and scores[None, "red"] < 0.25


def test_small_batches(spark):
    """Rows do not bound a batch of whole texts, bytes do; a bound that is smaller stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for start, end in (("67108864b", session.BATCH_BYTES), ("1000", 1000)):
        spark.conf.set(key, start)
        docs = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("one two. "), 2_000).alias("t"))
        sizes = docs.mapInArrow(lambda batches: batches, docs.schema)  # planned with the bound of its time
        chunking.chunk_documents(docs, "t", ["id"], strategy="semantic_window")
        assert int(spark.conf.get(key).rstrip("b")) == end
        most = sizes.mapInPandas(lambda frames: (f.head(1).assign(id=len(f)) for f in frames), docs.schema).agg(F.max("id")).first()[0]
        assert most <= max(1, end // 18_000 + 1)
    spark.conf.unset(key)


def test_chunk_table_gives_back_small_tables():
    rows = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["word " * 20_000] * 60)], names=["id", "t"])
    given = [pa.array([v] * 60) for v in (128, 16, "token")]
    tables = list(sqludf.ChunkTable.func.eval(None, rows, *given))
    assert len(tables) > 2 and max(t.nbytes for t in tables) < 2 * sqludf.MOST_HELD
    assert pa.concat_tables(tables).column("key").unique().to_pylist() == [str(i) for i in range(60)]


def test_dump_batches(spark, monkeypatch):
    """Rows of a long statement go back in parts, in order and without loss."""
    monkeypatch.setattr(dumps, "MOST_ROWS", 7)
    path = session.shared_path(spark, "test-dump")
    values = ",".join(f"({i},'t{i}')" for i in range(100))
    spark.createDataFrame([(f"INSERT INTO `d` VALUES {values};",)], "value string").write.text(path)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    loaded = dumps.dump_table(dumps.read_dump(spark, path), "d", {"i": "int", "t": "text"})
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= session.BATCH_BYTES
    assert [(r.i, r.t) for r in loaded.collect()] == [(i, f"t{i}") for i in range(100)]


def test_counts_put_no_matches_into_arrays(spark):
    texts = ["", " ", "a", "?!.", " a.b ! c?d e\n", "Queue aaa x́ 1² 中\U0001d7d8. ", "...a", "b  ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    exact = {"n_words": r"(?U)\S+", "n_sentences": r"(?U)[^.!?\s][^.!?]*", "n_letters": r"[\p{L}\p{N}]"}
    found = textstats.readability_inputs(t)
    counted = df.select(*[found[n].alias(n) for n in exact], textstats.sentence_count(t).alias("s"), found["n_syllables"].alias("y"))
    want = df.select(
        F.regexp_count(t, F.lit(exact["n_words"])), F.greatest(F.regexp_count(t, F.lit(exact["n_sentences"])), F.lit(1)), F.regexp_count(t, F.lit(exact["n_letters"])),
        F.regexp_count(t, F.lit(exact["n_sentences"])), F.greatest(F.regexp_count(F.lower(t), F.lit("[aeiouy]+")), F.regexp_count(t, F.lit(exact["n_words"]))),
    )
    assert [tuple(r) for r in counted.collect()] == [tuple(r) for r in want.collect()]
    assert "regexp_extract_all" not in plan_of(counted)


def test_norms_of_questions_and_rows_are_computed_once(spark):
    a, b = F.array(*[F.lit(float(i % 7)) for i in range(100)]), F.array(*[F.lit(float(i % 5)) for i in range(100)])
    r = spark.range(1).select(vectors.cosine(a, b).alias("x"), vectors.cosine(a, b, vectors.norm(a), vectors.norm(b)).alias("y")).first()
    assert r.x == r.y
