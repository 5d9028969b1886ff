"""Exact deduplication over an extendible-hash index that lives in shared files.

Everything here is DataFrame code.

1. *Entries*: texts are grouped by (hash, text). Spark combines on the map side, so a text that a third of all rows
   share crosses the network once per map task. The grouping key is the text itself, that is, bytes are compared.
   One entry per distinct text goes to the shared folder.
2. *Directory*: entries are counted by hash prefix. As long as a bucket holds more than ``capacity`` entries of more
   than one hash, the directory doubles (the prefix grows by a bit) and such buckets split; there is no greatest depth.
   A bucket that needs no more than its local depth fills several slots. Only slots that hold entries are listed.
3. *Owners*: entries are dealt out by range of bucket; each owner task chains the entries of one hash. The index is
   written in three parts: hashes of a single row, of copies of one text, and of colliding texts (chains).
4. Every document finds its bucket by the directory and looks its hash up there. Only where texts collide does the
   lookup compare the text as well.

Defined results: null text counts as empty; a null doc_id never becomes keep_id unless all ids of the group are null;
rows that repeat one (doc_id, text) are one document, all of them carry the same answer, but ``drop_copies`` returns one
row of each text; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import ascii_lower, persist_table, scratch, whole_text

BROADCAST_SLOTS = 1 << 18  # a directory of more slots (24 bytes each) is joined by a shuffle


def text_hash(text: Column, hash_bits: int = 64) -> Column:
    """XXH64 of the text; ``hash_bits`` below 64 keeps the leading bits only (to provoke collisions)."""
    h = F.xxhash64(text)
    return h if hash_bits >= 64 else F.shiftleft(F.shiftright(h, 64 - hash_bits), 64 - hash_bits)


def _prefix(h: Column, depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(h, 64 - depth)


def build_directory(entries: DataFrame, capacity: int) -> DataFrame:
    """(slot, bucket, depth, global_depth): for each slot of the doubled directory, the first slot of its bucket and the
    bucket's local depth."""
    depth = max(0, math.ceil(math.log2(max(entries.count(), 1) / capacity)))
    while True:
        slots = entries.groupBy(_prefix(F.col("h"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"), (F.min("h") != F.max("h")).alias("mixed"))
        slots = persist_table(slots, "dedup-slots")
        if depth == 64 or slots.filter(F.col("mixed") & (F.col("n") > capacity)).isEmpty():
            break
        depth += 1
    nodes = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    nodes = nodes.withColumn("node", F.expr(f"shiftrightunsigned(slot, {depth} - depth)"))
    filled = nodes.groupBy("depth", "node").agg(F.sum("n").alias("filled"))
    fits = nodes.join(filled, ["depth", "node"]).filter((F.col("filled") <= capacity) | (F.col("depth") == depth))
    local = fits.groupBy("slot").agg(F.min("depth").alias("depth"))
    return local.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - depth), {depth} - depth)")).withColumn("global_depth", F.lit(depth))


def in_bucket(rows: DataFrame, directory: DataFrame, h: str) -> DataFrame:
    """``rows`` with _xd_bucket, the bucket that the directory gives for the hash in column ``h``."""
    first = directory.select("global_depth").first()
    slots = directory.select(F.col("slot").alias("_xd_slot"), F.col("bucket").alias("_xd_bucket"))
    if directory.count() <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    return rows.withColumn("_xd_slot", _prefix(F.col(h), first[0] if first else 0)).join(slots, "_xd_slot").drop("_xd_slot")


def build_index(keyed: DataFrame, capacity: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``keyed`` has _xd_id, _xd_norm, h. Returns the directory, the index (bucket, h, keep_id, group_size, n_texts, kind),
    its chained hashes (h) and their texts (h, chain_text, keep_id, group_size)."""
    with scratch(keyed.sparkSession):
        entries = keyed.groupBy("h", "_xd_norm").agg(F.max("_xd_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        entries = persist_table(entries.drop("_xd_norm"), "dedup-entries")
        directory = persist_table(build_directory(entries, capacity), "dedup-directory", keep=True)
        owned = (
            in_bucket(entries, directory, "h")
            .withColumnRenamed("_xd_bucket", "bucket")
            .repartitionByRange("bucket")
            .groupBy("bucket", "h")
            .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"))
        )
        kind = F.when(F.col("n_texts") > 1, "chain").when(F.col("group_size") > 1, "copies").otherwise("single")
        index = persist_table(owned.withColumn("kind", kind), "dedup-index", partition_by="kind", keep=True)
        # A table of its own, so that its true size decides between a broadcast and a shuffle of the texts.
        chained = persist_table(index.filter("kind = 'chain'").select("h"), "dedup-chains", keep=True)
    texts = keyed.join(chained, "h").groupBy("h", F.col("_xd_norm").alias("chain_text"))
    return directory, index, chained, texts.agg(F.max("_xd_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, hash_bits: int = 64) -> DataFrame:
    """``docs`` with _xd_keep_id, _xd_group_size, _xd_kept and _xd_sha256 of the normalised text.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id of a group is kept.
    """
    base = docs.withColumn("_xd_norm", ascii_lower(whole_text(text_col))).withColumn("_xd_h", text_hash(F.col("_xd_norm"), hash_bits))
    keyed = base.select(F.col(id_col).alias("_xd_id"), "_xd_norm", F.col("_xd_h").alias("h"))
    directory, index, chained, chain_texts = build_index(keyed, capacity)
    groups = index.filter("kind = 'copies'").select(F.col("bucket").alias("_xd_gb"), F.col("h").alias("_xd_gh"), F.lit(None).cast("string").alias("_xd_chain_text"), F.col("keep_id").alias("_xd_gk"), F.col("group_size").alias("_xd_gs"))
    chains = in_bucket(chain_texts.filter("group_size > 1"), directory, "h").select(F.col("_xd_bucket").alias("_xd_gb"), F.col("h").alias("_xd_gh"), F.col("chain_text").alias("_xd_chain_text"), F.col("keep_id").alias("_xd_gk"), F.col("group_size").alias("_xd_gs"))
    chained = chained.select(F.col("h").alias("_xd_ch"))
    rows = (
        base.withColumn("_xd_sha256", F.sha2(F.col("_xd_norm").cast("binary"), 256))
        .join(chained, F.col("_xd_h") == F.col("_xd_ch"), "left")
        .withColumn("_xd_own_text", F.when(F.col("_xd_ch").isNotNull(), F.col("_xd_norm")))
        .drop("_xd_norm", "_xd_ch")
    )
    rows = in_bucket(rows, directory, "_xd_h")
    found = rows.join(groups.unionByName(chains), (F.col("_xd_bucket") == F.col("_xd_gb")) & (F.col("_xd_h") == F.col("_xd_gh")) & F.col("_xd_own_text").eqNullSafe(F.col("_xd_chain_text")), "left")
    keep = F.when(F.col("_xd_gs").isNull(), F.col(id_col)).otherwise(F.col("_xd_gk"))
    found = found.withColumn("_xd_keep_id", keep).withColumn("_xd_group_size", F.coalesce("_xd_gs", F.lit(1)).cast("long"))
    found = found.withColumn("_xd_kept", F.col(id_col).eqNullSafe(F.col("_xd_keep_id")))
    return found.drop("_xd_h", "_xd_bucket", "_xd_gb", "_xd_gh", "_xd_gk", "_xd_gs", "_xd_own_text", "_xd_chain_text")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = mark_copies(slim, capacity=capacity, hash_bits=hash_bits)
    return marked.select("doc_id", F.col("_xd_keep_id").alias("keep_id"), F.col("_xd_group_size").alias("group_size"), F.col("_xd_kept").alias("kept"), F.col("_xd_sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of equal texts, with all its columns.

    Several rows of a group can carry its keep_id (repeated rows, or no id in the whole group). Of these the one with the
    largest text before lower-casing stays; only rows that have copies are shuffled for that.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = mark_copies(docs, id_col, text_col).filter("_xd_kept")
    kept = persist_table(marked.select(F.struct(*columns).alias("_xd_row"), whole_text(text_col).alias("_xd_text"), "_xd_sha256", "_xd_group_size"), "dedup-kept", keep=True)
    copied = kept.filter("_xd_group_size > 1").groupBy("_xd_sha256").agg(F.max_by("_xd_row", "_xd_text").alias("_xd_row"))
    return kept.filter("_xd_group_size = 1").select("_xd_row").unionByName(copied.select("_xd_row")).select("_xd_row.*")
