"""Held-out accuracy and defined results of the two classifiers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def auc(score, truth):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    ones = truth.sum()
    return (ranks[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))


def test_quality_on_the_held_out_fold(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    scored = queries.op5_quality_classifier(spark, SF)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    score, truth = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert auc(score, truth) > 0.9
    assert np.mean((score >= 0.3) == truth) > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_word_vectors_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    want = np.zeros(quality.BUCKETS * quality.DIM, np.int64)
    quality._cooccur(*quality.Units().of(texts), want, *quality.index_vectors())
    for n in (1, 70):  # more parts than SALTS
        assert (quality.word_vectors(docs.repartition(n)).reshape(-1) == want).all()


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 13)] + [(4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(edge_docs, labels)
    assert got.count() == edge_docs.count() and got.filter("score is null or isnan(score)").count() == 0
    assert quality.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.classify(edge_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(edge_docs, labels).columns == edge_docs.columns


def test_word_vectors_do_not_depend_on_partitions(docs):
    small = docs.limit(60)
    assert (quality.word_vectors(small.repartition(1)) == quality.word_vectors(small.repartition(5))).all()


def test_language_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, SF).join(docs, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_language_edges(spark, edge_docs, no_docs):
    taught = edge_docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 2 == 1, "bb"))
    got = {r["doc_id"]: r for r in langid.identify(taught).collect()}
    assert langid.identify(taught).count() == edge_docs.count()
    for i in (1, 2, 3, 13):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(edge_docs).collect()} == {"und"}  # no row teaches a language
    assert langid.identify(taught.limit(0)).count() == 0


def test_numbers_are_no_letters_and_marks_do_not_cut_words(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["½ ² ③", "Ⅷ 七 ४२"[0:1], "२ ४ \u0301", "naïve ½", ""]
    got = [(r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert [g for k, g in enumerate(got) if k != 3] == [("und", 0.0)] * 4 and got[3][0] != "und"
    assert langid.find("हिन्दी naïve don't Ⅷ x²y \u0301z") == ["हिन्दी", "naïve", "don", "t", "x", "y", "z"]


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    a, b = model.langs[:2]
    clean = lambda lang: docs.filter((F.col("lang") == lang) & (F.length("text") > 600)).orderBy("doc_id").first()["text"][:500]
    mixed = spark.createDataFrame([(1, clean(a) + " " + clean(b))], "doc_id long, text string")
    spans = langid.predict(mixed, model, spans=True).first()["spans"]
    assert spans[0]["lang"] == a and spans[-1]["lang"] == b and len(spans) <= 6


@pytest.mark.parametrize("seed", range(20))
def test_viterbi(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 7, 4)
    emit = -rng.random((int(sizes.sum()), 3)) * 5
    got, at = langid.viterbi(emit, sizes, 2.0), 0
    for n in sizes.tolist():
        own = emit[at : at + n]
        value = lambda path, own=own: sum(own[k, p] for k, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(value(p) for p in np.ndindex(*[3] * n))
        assert value(got[at : at + n].tolist()) == pytest.approx(best)
        at += n
