from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docsieve.llm import packing, queries
from tests.llm import brute


def held_against_library(packed, rows):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    assert got == sorted((i if i is not None else -1, *p) for i, t in rows for p in brute.pieces(t))
    by: dict[int, list] = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_query(spark, sf_dir, doc_rows):
    packed = queries.op1_best_fit_packing(spark, sf_dir).collect()
    n = held_against_library(packed, doc_rows)
    assert n <= 1.05 * sum(r["length"] for r in packed) / 1024 + 8


def test_edges(spark, edge_docs, no_docs):
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    held_against_library(packing.pack_documents(edge_docs, *paths).collect(), [(r[0], r[1]) for r in edge_docs.select("doc_id", "text").collect()])
    assert packing.pack_documents(no_docs, *paths).count() == 0
    laid = packing.sequences(packing.pack_documents(edge_docs, *paths, keep_ids=True))
    assert laid.select(F.max(F.size("ids"))).first()[0] <= 1024


@pytest.mark.parametrize("open_bins", [1, 3, 50])
def test_bins_are_best_fit(open_bins):
    rng = random.Random(open_bins)
    bins, naive, made = packing.BestFitBins(100, open_bins), {}, 0
    for _ in range(2000):
        n = rng.randint(1, 100)
        chosen, offset = bins.place(n)
        fits = {b: f for b, f in naive.items() if f >= n}
        if fits:
            assert naive[chosen] == min(fits.values()) and offset == 100 - naive[chosen]
        else:
            assert (chosen, offset) == (made, 0)
            naive[chosen], made = 100, made + 1
        naive[chosen] -= n
        if not naive[chosen]:
            del naive[chosen]
        if len(naive) > open_bins:
            fullest = min(naive.values())
            gone = [b for b, f in naive.items() if f == fullest and b not in bins.by_free[f]]
            assert len(gone) == 1
            del naive[gone[0]]
