from __future__ import annotations

import numpy as np

from docsieve.llm import hnsw, queries


def brute_force(rows, every, k=10):
    length = len(min(rows)[1]) if rows else 0
    rows = [(i, np.array(v, float)) for i, v in rows if len(v) == length]
    out = {}
    for i, q in rows:
        if i % every == 0:
            near = {j: float(np.sqrt(((v - q) ** 2).sum())) for j, v in rows if j != i}
            out[i] = sorted((d, j) for j, d in near.items())[:k]
    return out


def recall(found, truth):
    hit = total = 0
    for i, near in truth.items():
        got = found.get(i, [])
        worst = near[-1][0] if near else 0
        hit += sum(d <= worst + 1e-9 for d, _ in got)
        total += len(near)
    return hit / max(total, 1)


def by_query(df):
    found: dict[int, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        mine = found.setdefault(r["query_id"], [])
        mine.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(mine) and r["vec_id"] != r["query_id"] and mine == sorted(mine)
    return found


def test_query(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect() if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    truth = brute_force(rows, 100)
    found = by_query(queries.op7_hnsw_search(spark, sf_dir))
    assert set(found) == set(truth) and recall(found, truth) >= 0.95
    vector = dict(rows)
    for i, near in found.items():
        for d, j in near:
            assert d == float(np.sqrt(((np.array(vector[j], float) - np.array(vector[i], float)) ** 2).sum())) or abs(d - np.linalg.norm(np.array(vector[j], float) - np.array(vector[i], float))) < 1e-12


def test_shards_and_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    rows += [(i, rows[5][1]) for i in range(1500, 1900)]  # many copies
    bad = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] + [1.0] * 7), (2005, [None] * 8), (2006, [1.0] * 5), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], "vec_id long, embedding array<double>, h int, v string")
    found = by_query(hnsw.nearest(df, every=20, shard_rows=300))
    truth = brute_force(rows, 20)
    assert set(found) == set(truth) and recall(found, truth) >= 0.95
    copies = [i for i in truth if i >= 1500]
    assert copies and all([j for _, j in found[i]] == [j for _, j in truth[i]] for i in copies)
    assert hnsw.nearest(df.limit(0)).count() == 0
    few = by_query(hnsw.nearest(df.filter("vec_id < 4"), every=2))
    assert {i: len(n) for i, n in few.items()} == {0: 3, 2: 3}


def test_each_length_is_searched_on_its_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(300)]
    found = by_query(hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20))
    for size in (8, 5):
        own = [r for r in rows if len(r[1]) == size]
        truth = brute_force(own, 20)
        part = {i: found[i] for i in truth}
        assert truth and recall(part, truth) >= 0.95
    assert set(found) == {i for i, _ in rows if i % 20 == 0}


def test_many_blocks_and_turns(spark, monkeypatch):
    """The same rows, whatever share of the queries a task searches; the index passes one exchange and is not joined again."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    whole = by_query(hnsw.nearest(df, every=5, shard_rows=100))
    monkeypatch.setattr(hnsw, "BLOCK", 4)
    monkeypatch.setattr(hnsw, "TURN", 3)
    assert len(whole) == 120 and by_query(hnsw.nearest(df, every=5, shard_rows=100)) == whole
