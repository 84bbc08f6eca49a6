import hashlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline as P
from orrery.llm import jaccard


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = P.classify(spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    assert docs.join(labels, "doc_id", "left_semi").join(good, "doc_id", "left_anti").count() <= 2
    known = P.identify(spark, docs.union(spark.createDataFrame([(-1, "12 34", "en", "s", 5), (-2, None, None, None, 0)], docs.schema)), SF)
    assert known.columns == docs.columns and known.where("doc_id < 0").count() == 0 and known.count() == docs.count()
    one = P.deduplicate(spark, docs, SF)
    groups = jaccard.near_duplicates(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.component_id for r in groups.collect()}
    some = P.mix(spark, docs, SF)
    assert some.columns == docs.columns and 0 < some.count() < docs.count()


def test_run_and_empty(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("known", [1_000_000, 0])
def test_deduplicate_moves_ids_not_texts(spark, monkeypatch, known):
    monkeypatch.setattr(jaccard, "KNOWN_IDS", known)
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    ids = [1, 1, 2, 3, 3, 4, 4, 5, None, None, 6]
    texts = ["a b c", "a b c", "d e f", "a b c", "a b c", None, None, "", "d e f", "d e f", "g h i"]
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)]
    got = [(r.doc_id, r.text) for r in P.deduplicate(spark, spark.createDataFrame(rows, schema), SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, "a b c"), (2, "d e f"), (4, None), (5, ""), (None, "d e f"), (None, "d e f"), (6, "g h i")], key=repr)
    if known:
        unique = spark.createDataFrame([r for r in rows if r[0] not in (1, 3, 4)] + [(7, "d e f", "en", "s", 1)], schema)
        out = P.deduplicate(spark, unique, SF)
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
        assert {r.doc_id for r in out.collect()} == {2, 5, 6, None}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "the " * 9000, "en", "s", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    docs = docs.withColumn("score", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    last = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in P.encode(spark, docs, SF).collect()}
    assert (1, 0, hashlib.sha256(b"").hexdigest()) in last
