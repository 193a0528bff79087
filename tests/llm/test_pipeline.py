"""The pipeline's stages against plain versions, and every query on the smallest tables."""

import importlib

import numpy as np
import pytest

import corpus_pipeline
from edge import awkward, classes, nothing, repeated
from skytables.llm import language_id, queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.saved(stage(spark, docs, DATA), f"test-{name}")
        after = docs.collect()
        if name != "sequences":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_duplicates":
            order = sorted(before, key=lambda r: r.doc_id)
            first = classes([r.text for r in order])
            assert {r.doc_id for r in after} == {order[i].doc_id for i in set(first)}
        if name == "repeats":
            coded = [r.text.encode() for r in before]
            want = {r.doc_id: bytes(np.frombuffer(t, np.uint8)[np.frombuffer(m, np.uint8) == 0]).decode("utf-8", "ignore") for r, t, m in zip(before, coded, repeated(coded, 400))}
            assert {r.doc_id: r.text for r in after} == want
        if name == "sequences":
            assert sum(r.length for r in after) == sum(len(r.text.encode()) + 1 for r in before)
    assert len(before) > 100


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality(spark, corpus_pipeline.language(spark, docs, DATA), DATA)
    clean = labels.where("quality = 1").join(docs.where("size(split(text, ' ')) > 40"), "doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() == 0


@pytest.mark.parametrize("table", [awkward, nothing])
def test_stages_bear_anything(spark, table):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, docs, DATA), f"test-{name}")
        assert name == "sequences" or out.columns == docs.columns
        out.count()
        docs = out if name != "sequences" else docs


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_language_query_keeps_ids_out_of_prediction(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs)
    moved = docs.selectExpr("doc_id + 1 as doc_id", "text", "'xx' as lang", "source")
    a = {r.text: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert a == {r.text: r.lang_pred for r in language_id.predict(moved, model).collect()}


def test_all_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
