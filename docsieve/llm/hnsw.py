"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

* Copies of a vector are one node. A window keeps the ids of the copies that any query can need (the k + 1 smallest), so
  a vector that a third of all rows share stays small; Spark trims such groups before the shuffle.
* Distinct vectors are dealt to shards of about ``shard_rows`` by a hash of their numbers. One task builds one shard's
  graph and returns it as flat arrays: vectors, neighbours by layer, entry point. The index covers every row and is a
  table in the shared folder.
* The stated queries are put into blocks of ``BLOCK`` rows; every pair of a shard and a block is searched, and the best
  k over all shards remain. Distances are computed again in double precision on the original numbers.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers take no part; vectors of
different lengths are not compared, each length is searched among its own; rows with a null id take no part; rows that
repeat an id count as one candidate at the smallest distance, and the smallest of their vectors asks; ties go to the smaller id; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import persist_table, scratch

M, EF_BUILD, EF_SEARCH, SHARD_ROWS, BLOCK, TURN = 16, 64, 128, 8192, 512, 64


class Graph:
    """One shard's graph; neighbours of layer l are rows of an integer matrix, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.x = vectors
        self.norm = np.einsum("ij,ij->i", vectors, vectors)
        self.layers, self.entry = layers, entry

    def build(self, m: int = M, ef: int = EF_BUILD, seed: int = 5) -> Graph:
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(int), 8)
        top = int(level.max()) if n else 0
        self.layers = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(top + 1)]
        size = [np.zeros(n, np.int32) for _ in range(top + 1)]
        self.entry, highest = 0, int(level[0]) if n else 0
        for i in range(1, n):
            at = [self.entry]
            for k in range(highest, -1, -1):
                found = self._search(self.x[i], at, 1 if k > level[i] else ef, k)
                if k <= level[i]:
                    for j in self._choose(found, m):
                        self._link(i, j, k, size)
                        self._link(j, i, k, size)
                at = [j for _, j in found]
            if level[i] > highest:
                self.entry, highest = i, int(level[i])
        return self

    def _choose(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Up to m neighbours, none closer to a chosen one than to the new node; then the nearest of the rest."""
        ids = np.array([j for _, j in found])
        own = np.array([d for d, _ in found])
        x = self.x[ids]
        between = self.norm[ids][:, None] + self.norm[ids][None, :] - 2 * x @ x.T
        chosen, near = [], np.zeros(len(ids), bool)
        for k in range(len(ids)):
            if not near[k]:
                chosen.append(k)
                if len(chosen) == m:
                    break
                near |= between[k] < own
        if len(chosen) < m:
            chosen += [k for k in range(len(ids)) if k not in set(chosen)][: m - len(chosen)]
        return ids[chosen].tolist()

    def _link(self, a: int, b: int, k: int, size: list[np.ndarray]) -> None:
        row = self.layers[k][a]
        if size[k][a] < len(row):
            row[size[k][a]] = b
            size[k][a] += 1
            return
        ids = np.append(row, b)
        d = self.norm[ids] - 2 * self.x[ids] @ self.x[a] + self.norm[a]
        order = np.argsort(d, kind="stable")
        row[:] = self._choose([(float(d[o]), int(ids[o])) for o in order], len(row))

    def _search(self, q: np.ndarray, starts: list[int], ef: int, k: int) -> list[tuple[float, int]]:
        layer, x, norm, q2 = self.layers[k], self.x, self.norm, float(q @ q)
        begin = np.array(starts)
        d = (norm[begin] - 2 * x[begin] @ q + q2).tolist()
        seen = np.zeros(len(x), bool)
        seen[begin] = True
        todo = list(zip(d, starts, strict=True))
        heapq.heapify(todo)
        best = [(-a, -b) for a, b in todo]
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while todo:
            dist, i = heapq.heappop(todo)
            if len(best) >= ef and dist > -best[0][0]:
                break
            near = layer[i]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            d = norm[near] - 2 * x[near] @ q + q2
            if len(best) >= ef:
                take = d < -best[0][0]
                near, d = near[take], d[take]
            for a, b in zip(d.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-a, -b))
                    heapq.heappush(todo, (a, b))
                elif a < -best[0][0]:
                    heapq.heapreplace(best, (-a, -b))
                    heapq.heappush(todo, (a, b))
        return sorted((-a, -b) for a, b in best)

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        at = [self.entry]
        for k in range(len(self.layers) - 1, 0, -1):
            at = [self._search(q, at, 1, k)[0][1]]
        return [j for _, j in self._search(q, at, ef, 0)]


def usable(vector: Column) -> Column:
    """Not null, not empty, finite and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def build_index(vectors: DataFrame, copies: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vectors`` (id, v) -> a row per shard: shard, n, ids (smallest ``copies`` by node), x, layers, entry."""
    same = Window.partitionBy("h", "v").orderBy("id")
    nodes = (
        vectors.select("id", "v", F.xxhash64("v").alias("h"))
        .withColumn("place", F.row_number().over(same))
        .filter(F.col("place") <= copies)
        .groupBy("h", "v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    nodes = persist_table(nodes, "hnsw-nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        pdf = pdf.iloc[np.argsort([i[0] for i in pdf["ids"]], kind="stable")]
        x = np.array(pdf["v"].tolist(), np.float64)
        graph = Graph(x).build()
        ids = [np.asarray(i, np.int64) for i in pdf["ids"]]
        return pd.DataFrame(
            {
                "shard": [int(pdf["shard"].iloc[0])],
                "n": [len(x)],
                "x": [x.astype("<f8").tobytes()],
                "layers": [[layer.astype("<i4").tobytes() for layer in graph.layers]],
                "entry": [graph.entry],
                "ids": [np.concatenate(ids).astype("<i8").tobytes()],
                "copies": [np.array([len(i) for i in ids]).astype("<i4").tobytes()],
            }
        )

    schema = "shard int, n int, x binary, layers array<binary>, entry int, ids binary, copies binary"
    sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(shards)).cast("int"))
    # A number of partitions of its own: adaptive execution would put many small shards, each long to build, into one task.
    return persist_table(sharded.repartition(shards, "shard").groupBy("shard").applyInPandas(make, schema), "hnsw-index")


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """``queries`` (query_id, q) against all shards -> query_id, vec_id, score of the best k of each shard. Blocks of queries
    are sent to the shards; a shard goes through the shuffle once for each ``TURN`` blocks, which one task searches."""
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    shards, turns = (index.agg(F.max("shard")).first()[0] or 0) + 1, math.ceil(blocks / TURN)
    block = F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int")
    asked = queries.withColumn("block", block).groupBy("block").agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    asked = asked.select("asked", F.pmod("block", F.lit(turns)).alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    # Both sides dealt alike, so the join adds no exchange; a number of partitions of its own, so that no task gets many shards.
    sides = [t.repartition(shards * turns, "shard", "turn") for t in (held, asked)]
    pairs = sides[0].hint("merge").join(sides[1], ["shard", "turn"])  # every block meets every shard once

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                x = np.frombuffer(row.x, "<f8").reshape(row.n, -1)
                layers = [np.frombuffer(b, "<i4").reshape(row.n, -1) for b in row.layers]
                graph = Graph(x, layers, int(row.entry))
                count = np.frombuffer(row.copies, "<i4")
                first, ids = np.cumsum(count) - count, np.frombuffer(row.ids, "<i8")
                out_q, out_v, out_s = [], [], []
                for one in row.asked:
                    q = np.asarray(one["q"], np.float64)
                    if len(q) != x.shape[1]:
                        continue
                    near = np.array(graph.search(q, ef))
                    d = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
                    held = [(float(a), int(v)) for a, j in zip(d, near, strict=True) for v in ids[first[j] : first[j] + count[j]] if v != one["query_id"]]
                    for a, v in heapq.nsmallest(k, held):
                        out_q.append(one["query_id"])
                        out_v.append(v)
                        out_s.append(a)
                yield pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})

    spark = index.sparkSession
    # A row holds a whole shard, so Arrow batches are kept to a few rows while this table is written.
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "4")
    try:
        return persist_table(pairs.mapInPandas(find, "query_id long, vec_id long, score double"), "hnsw-found", keep=True)
    finally:
        spark.conf.set(rows, before)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k nearest other rows of its length.
    Each length of vector has an index of its own (one pass of jobs for each; tables have one length as a rule)."""
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    found = None
    for n in [r["n"] for r in whole.select(F.size("v").alias("n")).distinct().orderBy("n").collect()] or [0]:
        rows = whole.filter(F.size("v") == n)  # vectors of one length are near each other or not, those of two are not comparable
        queries = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q")).groupBy("query_id").agg(F.min("q").alias("q"))
        with scratch(vectors.sparkSession):
            part = search_index(build_index(rows, k + 1, shard_rows), queries, k, ef)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
