"""The pipeline's stages on the small tables and on difficult documents."""

import corpus_pipeline
import odd

from quarrywork.session import materialize


def walk(spark, docs, sf):
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf), "pipeline-test"))
    return kept


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = walk(spark, docs, sf)
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:])) and ids[5] == ids[4]
    texts = [r["text"] for r in kept[3].collect()]
    assert len(texts) == len(set(texts)) and len(ids[4]) > 0.7 * len(ids[0])
    assert kept[5].columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_odd_documents(spark, sf, odd_docs):
    kept = walk(spark, materialize(odd_docs, "odd"), sf)
    assert all(k.columns == odd_docs.columns for k in kept[:-1])
    assert kept[1].filter("text is null").count() == 0


def test_no_documents(spark, sf, no_docs):
    assert all(k.count() == 0 for k in walk(spark, materialize(no_docs, "none"), sf))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(odd.rows()) == odd.documents(spark).count()
