"""Bounded-space online best-fit packing of tokenised documents into sequences.

Tokenising is spread over the input's partitions. Pieces without their tokens (a few integers each) are then dealt out
anew, ordered by a hash of the id, and every task packs its stream: a fixed number of open bins, kept in a bitset keyed
by free space, so that the fullest bin that still holds a piece is one bit search away. When no open bin holds the
piece a new one opens, and beyond the limit the fullest open bin closes first. Memory per task does not grow.

Defined results: null text is an empty document, which is its end token alone; rows may repeat, each is packed; a null
doc_id stays null; an empty table gives none.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.common import whole_text

LIMIT, END_ID, OPEN_BINS = 1024, 2, 4096


class BestFitBins:
    """Open bins by free space: bit f of ``mask`` is set while some open bin has f tokens free."""

    def __init__(self, limit: int = LIMIT, open_bins: int = OPEN_BINS):
        self.limit, self.most, self.count, self.made = limit, open_bins, 0, 0
        self.mask = 0
        self.by_free: list[list[int]] = [[] for _ in range(limit + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``limit`` tokens."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            slot = self.by_free[free]
            chosen = slot.pop()
            if not slot:
                self.mask ^= 1 << free
            self.count -= 1
        else:
            chosen, free = self.made, self.limit
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(chosen)
            self.mask |= 1 << left
            self.count += 1
            if self.count > self.most:
                self._close_fullest()
        return chosen, self.limit - free

    def _close_fullest(self) -> None:
        free = (self.mask & -self.mask).bit_length() - 1
        slot = self.by_free[free]
        slot.pop(0)
        if not slot:
            self.mask ^= 1 << free
        self.count -= 1


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    if not ranks_path:
        return whole, special, None
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return whole, special, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, json_path: str, ranks_path: str | None) -> np.ndarray:
    """Token ids as the tokenizers library gives them; texts free of special strings take the same vocabulary's ranks."""
    whole, special, ranks = _encoders(json_path, ranks_path)
    if ranks is None or any(s in text for s in special):
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(ranks.encode_ordinary(text), dtype="<u4")


def cut(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a first one that may be shorter."""
    if n <= limit:
        return [(0, n)]
    first = n % limit
    return ([(0, first)] if first else []) + [(s, limit) for s in range(first, n, limit)]


def tokenise_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, end_id: int = END_ID, limit: int = LIMIT, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if ``keep_ids``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text, json_path, ranks_path), np.uint32(end_id)).astype("<u4")
                for p, (s, n) in enumerate(cut(len(ids), limit)):
                    who.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    if keep_ids:
                        kept.append(ids[s : s + n].astype("i4"))
            columns = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim.mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, limit: int = LIMIT, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset."""
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = BestFitBins(limit, open_bins)
        base = TaskContext.get().partitionId() << 40
        for frame in frames:
            put = [bins.place(int(n)) for n in frame["length"]]
            yield frame.assign(sequence_id=np.array([base + b for b, _ in put], "i8"), offset=np.array([o for _, o in put], "i8"))

    # No count is named, so that adaptive execution merges small partitions: fewer tasks leave fewer bins half empty.
    dealt = pieces.withColumn("_pk", F.xxhash64("doc_id", "piece")).repartition("_pk").sortWithinPartitions("_pk", "doc_id", "piece", "ids_crc32").drop("_pk")
    return dealt.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, keep_ids: bool = False, **names: str) -> DataFrame:
    """Tokenise, cut and pack; with ``keep_ids`` the ids of each piece come along, ready to be laid out by offset."""
    return pack_pieces(tokenise_pieces(docs, json_path, ranks_path, keep_ids=keep_ids, **names))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token sequences themselves (``packed`` with its ids); a sequence has ``limit`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
