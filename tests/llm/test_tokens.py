from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsieve.llm import piece_sampling, queries, token_count
from tests.llm import brute

TRICKY = ["it's I'll we've they'd 'tis ''s 'r 're 'ree don't'll", "x'l x'll x've' 'v", "ABC123def 4½ ² ⅷ", "a b c\x85d\x1cE", "<|endoftext|>a <|startoftext|><|endoftext|>", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ŉ ﬁ", "é ä", "'" * 9, "!?'s!'s", "​﻿", "한국어 中文字 かな"]


def test_counts_are_the_library_s(spark, sf_dir, doc_rows):
    rows = queries.op8_token_counts(spark, sf_dir).collect()
    text = dict(doc_rows)
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        n = brute.library_count(text[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text[r["doc_id"]] or "").encode()), n, n > 2048)


def test_tricky_texts():
    for chunk in (1, 7, 256):
        counter = token_count.TokenCounter(token_count.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")), chunk)
        assert counter.counts(TRICKY).tolist() == [brute.library_count(t) for t in TRICKY]


def test_random_words_and_all_characters(monkeypatch):
    monkeypatch.setattr(token_count, "STATES", 3000)  # forgets what it has compiled many times over
    counter = token_count.TokenCounter(token_count.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for letters in ("ab", "etaoinshrdlu", "=-!'s", "éßあ\U0001f600z") for _ in range(1500)]
    texts += [c * k for c in "a!=" for k in range(1, 90)] + [f"a{chr(c)}a x{chr(c)}1{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 7 == 0]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert counter.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_edges(edge_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(r[0], r[1]) for r in edge_docs.select("doc_id", "text").collect()]
    got = token_count.count_tokens(edge_docs, path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), brute.library_count(t)) for i, t in rows)
    assert token_count.count_tokens(no_docs, path).count() == 0


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_sampled_pieces_decode_losslessly(spark, sf_dir, edge_docs, no_docs, doc_rows):
    whole = queries.op3_sentencepiece_sampling(spark, sf_dir)
    assert whole.count() == len(doc_rows) and whole.filter("not lossless").count() == 0
    ids = piece_sampling.encode_sampled(edge_docs, MODEL)
    back = sorted((str(r["doc_id"]), r["text"]) for r in piece_sampling.decode_ids(ids, MODEL).collect())
    assert back == sorted((str(r[0]), r[1] or "") for r in edge_docs.select("doc_id", "text").collect())
    assert piece_sampling.encode_sampled(no_docs, MODEL).count() == 0


def test_row_key_alone_decides(docs):
    def of(d):
        return {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in piece_sampling.encode_sampled(d, MODEL, keep_ids=False).collect()}

    some = docs.orderBy("doc_id").limit(80)
    assert of(some.repartition(1)) == of(some.repartition(7)) == of(some.orderBy(F.desc("doc_id")))
    other = piece_sampling.encode_sampled(some, MODEL, seed=1, keep_ids=False)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in other.collect()} != of(some)


def test_samples_follow_the_posterior():
    lattice = piece_sampling.Lattice(MODEL)
    word, paths = piece_sampling.MARK + "lower", {}

    def walk(at, ids, weight):
        if at == len(word):
            paths[tuple(ids)] = math.exp(weight)
        for stop in range(at + 1, len(word) + 1):
            if word[at:stop] in lattice.piece:
                i, w = lattice.piece[word[at:stop]]
                walk(stop, [*ids, i], weight + w)

    walk(0, [], 0.0)
    total, n = sum(paths.values()), 20_000
    drawn = Counter(tuple(x.tolist()) for x in lattice.encode(["lower"] * n, piece_sampling.mix(np.arange(n, dtype=np.uint64))))
    assert set(drawn) <= set(paths)
    for p, w in paths.items():
        share = w / total
        assert abs(drawn[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3
