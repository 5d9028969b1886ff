from __future__ import annotations

import pytest

from docsieve.llm import exact_dedup, queries
from tests.compare import oracle_rows, spark_rows
from tests.llm import brute


def test_query(spark, sf_dir):
    assert spark_rows(queries.op2_exact_dedup(spark, sf_dir)) == oracle_rows(queries.ORACLE_SQL["op2_exact_dedup"], sf_dir)


@pytest.mark.parametrize("bits", [64, 3])
def test_collisions_and_edges(edge_docs, bits):
    rows = [(r[0], r[1]) for r in edge_docs.select("doc_id", "text").collect()]
    groups = brute.exact_groups(rows)
    want = sorted((str(i), str(groups[(t or "").translate(brute.UPPER)][0]), groups[(t or "").translate(brute.UPPER)][1], brute.digest((t or "").translate(brute.UPPER).encode())) for i, t in rows)
    got = exact_dedup.exact_dedup(edge_docs, capacity=2, hash_bits=bits).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_stage_keeps_columns(edge_docs, no_docs):
    kept = exact_dedup.drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 2, 6, 7, 8, 9, 10, 11, 12, 13, 14, None}
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_directory_splits(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as h")
    directory = exact_dedup.build_directory(keys, 64).collect()
    assert len({r["bucket"] for r in directory}) >= 5000 // 64 and max(r["depth"] for r in directory) > min(r["depth"] for r in directory) - 1


def test_overfull_buckets_split(spark):
    """Hashes that share their first 20 bits: the directory must double until each bucket fits, and no further than that."""
    rows = [((5 << 44) | k << 30,) for k in range(64)] + [(-1 - (k << 50),) for k in range(8)] + [(7,)] * 20
    directory = exact_dedup.build_directory(spark.createDataFrame(rows, "h long"), capacity=4)
    found = {r["slot"]: r for r in directory.collect()}
    depth = next(iter(found.values()))["global_depth"]
    fill = {}
    for (h,) in rows:
        r = found[(h & (1 << 64) - 1) >> (64 - depth)]
        fill.setdefault(r["bucket"], []).append(h)
    assert depth > 20 and all(len(x) <= 4 or len(set(x)) == 1 for x in fill.values())
    assert any(len(x) > 1 for x in fill.values() if len(set(x)) > 1)
