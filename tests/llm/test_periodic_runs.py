from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docsieve.llm import periodic_runs, queries


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if j > i and len(x) >= max(6, 4 * q) and not any(x[r:] == x[:-r] for r in range(1, q)):
                out.append((i, len(x), q))
            i = max(j, i + 1)
    return sorted(out)


def random_words(rng: random.Random, t: int) -> list[int]:
    n, k = rng.randint(0, 90), rng.randint(1, 4)
    if t % 3 == 0:
        return [rng.randrange(k) for _ in range(n)]
    if t % 3 == 1:
        w: list[int] = []
        while len(w) < n:
            w += [rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
        return w
    part = [rng.randrange(k) for _ in range(rng.randint(1, 20))] * rng.randint(1, 6)
    w = ([*part, rng.randrange(3), *part, 9, *part] * rng.choice([1, 4]))[:400]
    for _ in range(rng.randint(0, 2)):
        w[rng.randrange(len(w))] = 7
    return w


@pytest.mark.parametrize(("key", "window"), [(1024, 1 << 19), (2, 16), (1, 1)])
def test_runs_against_all_periods(monkeypatch, key, window):
    monkeypatch.setattr(periodic_runs, "KEY", key)
    monkeypatch.setattr(periodic_runs, "WINDOW", window)
    rng = random.Random(key)
    for t in range(600):
        w = random_words(rng, t)
        assert periodic_runs.runs(np.array(w, np.int64)) == plain_runs(w), w


def test_long_texts_of_few_words():
    same = np.zeros(300_000, np.int64)
    assert periodic_runs.runs(same) == [(0, 300_000, 1)]
    many = np.array(([0] * 100 + [1]) * 1000)
    assert len(periodic_runs.runs(many)) == 1001
    rng = np.random.default_rng(1)
    far = np.concatenate([rng.integers(0, 99, 50), np.tile(rng.integers(0, 5000, 20_000), 5), rng.integers(0, 99, 50)])
    assert [(n >= 100_000, q) for _, n, q in periodic_runs.runs(far) if q > 20] == [(True, 20_000)]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), s, n, q, 1000 * n // q if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_rows(spark, sf_dir, doc_rows):
    short = {i: t for i, t in doc_rows if len(t or "") < 8000}  # the plain version takes the square of a text
    got = [r for r in queries.op13_periodic_runs(spark, sf_dir).collect() if r["doc_id"] in short]
    assert order(got) == order(expected(i, t) for i, t in short.items())


def test_edges(spark, edge_docs, no_docs):
    cut = edge_docs.filter("length(text) < 1000 or text is null")
    got = periodic_runs.report(cut).collect()
    assert order(got) == order(expected(r["doc_id"], r["text"]) for r in cut.collect())
    assert len(periodic_runs.report(edge_docs).collect()) == edge_docs.count()
    assert periodic_runs.report(no_docs).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "go " * 9 + "on a b a b a b a b a end"), (2, "  x y")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic_runs.find_runs(docs).collect()}
    assert rows[1]["collapsed"] == "go on a b end" and [tuple(r) for r in rows[1]["runs"]] == [(0, 9, 1), (10, 9, 2)]
    assert rows[2]["collapsed"] == "  x y" and rows[2]["runs"] == []
