from __future__ import annotations

import random

import pytest

from docsieve.llm import queries, suffix_dedup
from tests.llm import brute


def report(rows):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def expected(rows):
    return sorted((str(i), *x[:3], brute.digest(x[3])) for (i, _), x in zip(rows, brute.without_repeats([t for _, t in rows]), strict=True))


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = random.Random(seed)
    s = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(0, 120))]
    assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:])


def test_query(spark, sf_dir, doc_rows):
    assert report(queries.op9_suffix_dedup(spark, sf_dir).collect()) == expected(doc_rows)


@pytest.mark.parametrize("group", [2000, 3])
def test_planted_passages(spark, group):
    rng = random.Random(group)
    word = lambda: "".join(rng.choice("abcdeéß\U0001f600") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)], word()]
        texts.append("".join(parts))
    texts += ["a" * 199, "a" * 200, "a" * 201, "ab" * 300, texts[0], None, "", "z" * 5000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert report(suffix_dedup.repeat_report(df, group=group).collect()) == expected(rows)


def test_edges(edge_docs, no_docs):
    rows = [(r[0], r[1]) for r in edge_docs.select("doc_id", "text").collect()]
    assert report(suffix_dedup.repeat_report(edge_docs).collect()) == expected(rows)
    out = suffix_dedup.remove_repeats(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert suffix_dedup.repeat_report(no_docs).count() == 0
