"""The pipeline's stages, each on what the one before kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid
from tidemark.llm.common import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, sf), f"test-{name}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        if name in ("language_id", "decontamination"):
            assert out.exceptAll(docs).count() == 0 and out.count() >= 0.8 * docs.count(), name
        if name == "near_dedup":
            assert out.groupBy("doc_id").count().filter("count > 1").count() == 0
        docs = out
    assert docs.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).filter("not ok").count() == 0


def test_stages_take_awkward_rows(spark, sf):
    rows = [(1, "the and of that with", "en", "a", 1), (1, "the and of that with", "en", "a", 1), (None, None, None, None, None), (2, "", None, "b", 0), (None, "la de que el los", "es", None, 3), (3, "123", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0
        docs = materialize(stage(spark, docs, sf), "test-odd")


def test_language_stage_keeps_whatever_has_letters(spark, sf, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda *a, **k: langid.Model(["de", "en", "es", "fr"], np.zeros((langid.DIM, 4), np.float32), np.zeros(4)))  # a quarter each
    rows = [(1, "the la des"), (2, "word"), (3, "123 !?"), (4, ""), (5, None), (6, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf).collect()) == [1, 2, 6]


def test_language_stage_names_the_language_of_documents_without_one(spark, sf):
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    bare = whole.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang")))
    odd = [(900_001, "123 !?", None, "a", 6), (900_002, None, None, "a", 0), (900_003, "the and of that with", "fr", "a", 20), (None, "the and of that with", None, "a", 20), (None, "the and of that with", None, "a", 20)]
    docs = materialize(bare.unionByName(spark.createDataFrame(odd, whole.schema)), "test-bare")
    out = materialize(corpus_pipeline.language_id(spark, docs, sf), "test-named")
    kept = docs.filter("text is not null and doc_id is distinct from 900001")
    assert out.columns == docs.columns and out.drop("lang").exceptAll(kept.drop("lang")).count() == kept.drop("lang").exceptAll(out.drop("lang")).count() == 0
    given = docs.filter("lang is not null")
    assert given.exceptAll(out).count() == 0  # 900003 too, whatever its text
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    told = {r["doc_id"]: r["lang_pred"] for r in langid.identify(kept.filter("lang is null"), model).collect()}
    got = {r["doc_id"]: r["lang"] for r in out.filter("lang is not null").join(given.select("doc_id"), "doc_id", "left_anti").collect()}
    assert got == told and None in told and len(told) > 20
    truth = {r["doc_id"]: r["lang"] for r in whole.collect()}
    assert np.mean([got[d] == truth[d] for d in got if d is not None]) >= 0.95
