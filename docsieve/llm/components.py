"""Connected components by alternating large-star and small-star rounds, each cut off in shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import persist_table, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # A table of its own: the join then has plain exchanges, and Spark can split the edges of a star's centre.
    least = persist_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = persist_table(down.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node, root): the smallest node reachable from each node that has an edge.

    Self loops and repeated edges are harmless. The number of rounds grows with the logarithm of the longest path;
    only a count and a hash of the edges come to the driver.
    """
    with scratch(edges.sparkSession):
        cur = persist_table(edges.filter("a <> b").select("a", "b").distinct(), "cc")
        last, now = None, _mark(cur)
        while now[0] and now != last:
            cur, last = persist_table(_small_star(_large_star(cur)), "cc"), now
            now = _mark(cur)
        roots = cur.select(F.col("b").alias("node")).distinct()
        found = cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        return persist_table(found, "cc-roots", keep=True)
