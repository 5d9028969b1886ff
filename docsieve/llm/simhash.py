"""SimHash near-duplicate groups with a pigeonring filter.

A 64-bit fingerprint is cut into a ring of five segments (13, 13, 13, 13, 12 bits). If two fingerprints differ in at
most 4 bits, some segment i starts a chain whose cumulative differences over 1, 2, 3, 4 segments are at most 0, 1, 2, 3
(l * 4 / 5 rounded down). The first two conditions are an equality join: one side offers (i, segment i, segment i+1),
the other side the same with at most one bit of segment i+1 flipped. The longer chains and the full Hamming distance
are checked in the join. Only distinct fingerprints take part, so copies cost nothing here.

Defined results: null and empty texts have no word and fingerprint 0, linked like any other; rows may repeat; a null
doc_id counts only if its component has no other id; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.common import persist_table, scratch
from docsieve.llm.components import connected_components

WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = tuple(int(64 - sum(WIDTHS[: i + 1])) for i in range(5))
SEED = 42


def simhash(text: str | None, words_per_shingle: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, k = b" ".join(words), min(words_per_shingle, len(words))
    stops = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate(([0], stops[:-1]))[: len(words) - k + 1].tolist()
    ends = (stops[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(begins, ends, strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1).cast("long"))


def _key(fp: Column, i: int, flip: int = 0) -> Column:
    after = (i + 1) % 5
    pair = F.shiftleft(_segment(fp, i), 16).bitwiseOR(_segment(fp, after))
    return pair.bitwiseXOR(F.lit((i << 32) | flip).cast("long"))


def _chain_mask(i: int, length: int) -> int:
    bits = sum(((1 << WIDTHS[j % 5]) - 1) << SHIFTS[j % 5] for j in range(i, i + length))
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def hamming_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b), a < b: all pairs at 4 or fewer differing bits (a pair may repeat)."""
    fp = F.col("fp")
    offers = fps.select(fp.alias("b"), F.explode(F.array(*[_key(fp, i) for i in range(5)])).alias("key"))
    flips = [_key(fp, i, f) for i in range(5) for f in [0, *(1 << j for j in range(WIDTHS[(i + 1) % 5]))]]
    probes = fps.select(fp.alias("a"), F.explode(F.array(*flips)).alias("key"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftright("key", 32).cast("int") + 1
    budget = F.bit_count(x) <= 4
    for length in (3, 4):
        masks = F.array(*[F.lit(_chain_mask(i, length)).cast("long") for i in range(5)])
        budget &= F.bit_count(x.bitwiseAND(F.element_at(masks, start))) <= length - 1
    return probes.join(offers, "key").filter((F.col("a") < F.col("b")) & budget).select("a", "b")


def _components(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, root): the smallest fingerprint reachable over links."""
    roots = connected_components(hamming_links(nodes.select("fp")))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (the smallest id reachable over links)."""
    with scratch(docs.sparkSession):
        fps = persist_table(docs.select(F.col(id_col).alias("doc_id"), simhash_udf(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")), "simhash", keep=True)
        nodes = persist_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
        # Tables of their own, so that Spark can split a very large component in the join.
        placed = persist_table(_components(nodes), "simhash-placed", keep=True)
        smallest = persist_table(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-roots", keep=True)
    members = placed.join(smallest, "root").select("fp", "component_id")
    return fps.join(members, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id, one without an id only if no other has any.

    Rows are told apart by a key of their own, which is written with them, since ids may repeat.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    fp = simhash_udf(F.coalesce(F.col(text_col), F.lit("")))
    rows = persist_table(docs.select(F.struct(*columns).alias("_nd_row"), F.col(id_col).alias("_nd_id"), fp.alias("fp"), F.monotonically_increasing_id().alias("_nd_key")), "simhash-rows", keep=True)
    first = F.min(F.struct(F.col("_nd_id").isNull().alias("no_id"), F.col("_nd_id").alias("id"), F.col("_nd_key").alias("key")))
    with scratch(docs.sparkSession):
        nodes = persist_table(rows.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
        kept = persist_table(_components(nodes).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_nd_key")), "simhash-kept", keep=True)
    return rows.join(kept, "_nd_key").select("_nd_row.*")
