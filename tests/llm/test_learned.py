"""Classifiers by held-out accuracy, and their odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlab.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "12 34 ..."), (None, "hello there"), (None, None), (10**9 + 3, "日本語"), (10**9 + 4, "x" * 200000)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("label", F.lit("clash")).withColumn("turn", F.lit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    return docs, labels


def held(i, modulus, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


def check(rows, truth, modulus, remainder, least):
    for r in rows:
        assert r.held_out == held(r.doc_id, modulus, remainder)
        assert 0 <= r.score <= 1
    pairs = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(pairs) > 40 and np.mean([a == b for a, b in pairs]) >= least


def test_quality(spark, tables):
    docs, labels = tables
    rows = quality.quality_held_out(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.predicted == int(r.score >= 0.3) for r in rows)
    check(rows, {r.doc_id: r.quality for r in labels.collect()}, 5, 0, 0.93)


def test_toxicity(spark, tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.predicted == int(r.score >= 0.7) for r in rows)
    check(rows, {r.doc_id: r.toxic for r in labels.collect()}, 3, 1, 0.9)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert not [r for r in rows if r.held_out and r.predicted and truth.get(r.doc_id) == 0]


def test_reject_keeps_columns(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels, F.lit(True))
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < docs.count() - kept.count() < 150


def test_language(spark, tables):
    docs, _ = tables
    rows = language.language_held_out(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == docs.count()
    ok = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth.get(r.doc_id)]
    assert np.mean(ok) >= 0.97
    by = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None and r.doc_id >= 10**9}
    assert [by[10**9 + k] for k in (0, 1, 2)] == ["und"] * 3 and by[10**9 + 3] != "und"


def test_nothing_to_learn(spark, tables):
    docs, labels = tables
    few, none = docs.limit(3), labels.limit(0)
    assert {r.score for r in toxicity.toxicity(few, none).collect()} == {0.5}
    assert {r.score for r in quality.quality_held_out(few, none).collect()} == {0.5}
    assert {r.lang_pred for r in language.language_held_out(few.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    for out in (toxicity.toxicity(docs.limit(0), labels), quality.quality_held_out(docs.limit(0), labels), language.language_held_out(docs.limit(0))):
        assert out.count() == 0


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.arange(4.0), np.array([1.0, 0.0, 3.0, 4.0]), np.array([2.0, 2.0, 4.0, 4.0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0.25 and y[-1] == 1.0
