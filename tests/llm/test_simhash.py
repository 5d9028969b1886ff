from __future__ import annotations

import random

from docsieve.llm import queries, simhash
from docsieve.llm.components import connected_components
from tests.llm import brute


def test_query(spark, sf_dir, doc_rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == brute.near_components(doc_rows)


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 4, 5, 6)]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in {*base, *near}]
    got = {tuple(r) for r in simhash.hamming_links(spark.createDataFrame(signed, "fp long")).collect()}
    flat = sorted(x for (x,) in signed)
    assert got == {(a, b) for k, b in enumerate(flat) for a in flat[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and set(root) - set(got) <= {a for a, b in edges if a == b}


def test_edges(edge_docs, no_docs):
    rows = [(r[0], r[1]) for r in edge_docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == len(rows)
    want = brute.near_components([r for r in rows if r[0] is not None])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, (_, c) in want.items()}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()} | {None}


def test_one_row_of_each_component_stays(spark):
    """An id that two components share must not take the last document of one of them away."""
    text = {k: " ".join(f"{k}{n * 7919 % 1000}" for n in range(60)) for k in "abc"}
    rows = [(1, text["a"]), (2, text["a"]), (2, text["b"]), (3, text["b"]), (1, text["b"]), (None, text["c"]), (None, text["c"]), (None, text["a"])]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in kept.collect()) == [("1", "a"), ("1", "b"), ("None", "c")]
    two = spark.createDataFrame([(1, text["a"]), (2, text["a"]), (2, text["b"])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][0]) for r in simhash.keep_one_per_group(two).collect()) == [(1, "a"), (2, "b")]
