from __future__ import annotations

import corpus_pipeline
from docsieve.llm import queries
from tests.llm import brute


def test_pipeline_against_brute_force(spark, sf_dir, doc_rows):
    good = {r["doc_id"] for r in queries.op5_quality_classifier(spark, sf_dir).filter("predicted = 1").collect()}
    rows = [(i, t) for i, t in doc_rows if i in good]
    keep = {k for k, _ in brute.exact_groups(rows).values()}
    rows = [(i, t) for i, t in rows if i in keep]
    near = brute.near_components(rows)
    rows = sorted((i, t) for i, t in rows if near[i][1] == i)
    left = [x[3].decode("utf-8", "ignore") for x in brute.without_repeats([t for _, t in rows])]
    want = sorted((i, *p) for (i, _), t in zip(rows, left, strict=True) for p in brute.pieces(t))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_stages_keep_the_columns(spark, edge_docs, no_docs, sf_dir):
    for start in (edge_docs, no_docs):
        d = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, sf_dir)
            assert d.columns == start.columns
        corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).count()


def test_one_row_of_each_text_stays(spark):
    """Repeated rows and groups without any id must not reach the suffix stage as documents that repeat each other."""
    body = {k: " ".join(f"{k}{n * 7919 % 1000}" for n in range(120)) for k in "abcd"}
    rows = [(1, body["a"]), (1, body["a"]), (None, body["b"]), (None, body["b"]), (2, body["c"]), (3, body["c"].upper()), (3, body["c"]), (None, body["c"]), (4, body["d"])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `a.b` string")
    left = corpus_pipeline.exact_copies(spark, docs, "")
    assert left.columns == docs.columns
    left = corpus_pipeline.near_copies(spark, left, "")
    left = corpus_pipeline.repeated_passages(spark, left, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("1", body["a"]), ("None", body["b"]), ("3", body["c"]), ("4", body["d"])])
