from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest

from docsieve.llm import pii, queries

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and pii.luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(re.sub("[^0-9]", "", t)) <= 15),
)
TEXTS = [
    "mail a.b+c@x.example.com. or a@b.c@d.e and é@x.de, x@y, @a.b, a@-.-, a@b..c", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.2.3.04 and 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112, 41111111111111111111, 1 2",
    "+1 (743) 555-3824 4111111111111111 +49.30-1234567) +1 +12 +123 +1((((((2 ++49 123 456 78", "0" * 3000 + ".1.2.3", "a" * 5000, "@" * 300 + "a@b.co", "1.1.1." * 500, "", "😀 a@b.cd 😀 10.0.0.1",
]


def by_pattern(text: str) -> list[tuple[int, int, int]]:
    return [(k, m.start(), m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m.group())]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == by_pattern(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        text = "".join(rng.choice(list("a1.@+-() 9é2"), int(rng.integers(0, 60))))
        assert pii.base_spans(text) == by_pattern(text)


def test_luhn_sum_of_a_span():
    text = "x 4111 1111 1111 1111 and 79927398713 or 123456789012345"
    lat = pii.Lattice(text, 0, len(text), [])
    s, e, k = lat.candidates(0, lat.n)
    f = lat.features(s, e)
    for i in range(len(s)):
        d = re.sub("[^0-9]", "", text[lat.at[s[i]] : lat.at[e[i] - 1] + lat.size[e[i] - 1]])
        assert bool(f[i, 17]) == (len(d) >= 13 and pii.luhn(d))


def every_segmentation(n, segments, label):
    """All paths over n tokens as tuples of (end, label)."""
    if n == 0:
        return [()]
    stack, out = [((), 0)], []
    while stack:
        path, t = stack.pop()
        if t == n:
            out.append(path)
            continue
        steps = [(t + 1, label[t] + 1, None)] if t in label else [(t + 1, 0, None), *segments.get(t, ())]
        stack += [((*path, (t, *x)), x[0]) for x in steps]
    return out


@pytest.mark.parametrize("text", ["+1 (269) 555-3296 4524132264652876", "a@b.co 10 12 14 16 18", "no 269 555 32964 x", "joe [at] ab [dot] de", "1.2.3.4 5555 1234567"])
def test_decoding_and_expectations_against_all_segmentations(text):
    model = pii.trained()
    base = pii.base_spans(text)
    lat = pii.Lattice(text, 0, len(text), sorted(base, key=lambda x: x[1]))
    s, e, k = lat.candidates(0, lat.n)
    f = lat.features(s, e)
    score = (f * model.weights[k]).sum(axis=1)
    segments: dict = {}
    for i in range(len(s)):
        segments.setdefault(int(s[i]), []).append((int(e[i]), int(k[i]) + 1, i))

    def value(path):
        labels = [0, *(x[2] for x in path)]
        return sum(score[x[3]] for x in path if x[3] is not None) + sum(model.moves[a, b] for a, b in itertools.pairwise(labels))

    paths = every_segmentation(lat.n, segments, lat.label)
    best = max(paths, key=value)
    want = [(x[2] - 1, int(lat.at[x[0]]), int(lat.at[x[1] - 1] + lat.size[x[1] - 1])) for x in best if x[3] is not None]
    assert model.decode(lat) == want
    if not base:
        grad_w, grad_m = np.zeros_like(model.weights), np.zeros_like(model.moves)
        total = pii._expected(lat.n, s.tolist(), e.tolist(), k, f, model.weights, model.moves, grad_w, grad_m)
        weight = np.exp([value(p) for p in paths])
        assert total == pytest.approx(np.log(weight.sum()))
        seen = np.zeros_like(grad_w)
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for x in p:
                if x[3] is not None:
                    seen[k[x[3]]] += w * f[x[3]]
        assert np.allclose(-grad_w, seen)


def found(text):
    base, added = pii.find(text, pii.trained())
    return [(pii.KINDS[k], text[s:e]) for k, s, e in base], [(pii.KINDS[k], text[s:e]) for k, s, e in added]


@pytest.mark.parametrize(
    ("text", "added"),
    [
        ("und +1 (269) 555-3296 4524132264652876 and on", [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]),
        ("the 7536784127813050 4845168114407329 of", [("card", "7536784127813050"), ("card", "4845168114407329")]),
        ("call (743) 555-3824 today", [("phone", "(743) 555-3824")]),
        ("mail john.doe (at) example (dot) com now", [("email", "john.doe (at) example (dot) com")]),
        ("at 2001:db8::ff00:42:8329 or", [("ip", "2001:db8::ff00:42:8329")]),
        ("password=135299847ac0e0f0dc on 2021-03-04 12:30:45, isbn 978-3-16-148410-0", []),
        ("1,234,567.89 and 1990-2000, 12:30:45, we meet at noon. Dot", []),
    ],
)
def test_added_spans(text, added):
    assert found(text)[1] == added


def test_held_out_table():
    """A second draw of the labelled table: nearly all texts get exactly their spans."""
    rows = pii.labelled(seed=77)
    got = [set(sum(pii.find(t, pii.trained()), [])) for t, _ in rows]
    none = [g for g, (_, w) in zip(got, rows, strict=True) if not w]
    assert sum(g >= set(w) for g, (_, w) in zip(got, rows, strict=True)) / len(rows) > 0.97
    base_only = [set(pii.base_spans(t)) for t, w in rows if not w]
    assert sum(g == b for g, b in zip(none, base_only, strict=True)) / len(none) > 0.97


def test_long_windows_are_cut_without_loss():
    one = "(743) 555-3824, 4111 1111 1111 1112 and +1 (269) 555-3296 4524132264652876; "
    text = one * 3000
    _, added = pii.find(text, pii.trained())
    whole = pii.find(one * 3, pii.trained())[1]
    middle = [(k, s - len(one), e - len(one)) for k, s, e in whole if len(one) <= s < 2 * len(one)]
    for i in (1, 700, 1500, 2990):
        assert [(k, s - i * len(one), e - i * len(one)) for k, s, e in added if i * len(one) <= s < (i + 1) * len(one)] == middle


def test_query_rows(spark, sf_dir, doc_rows):
    got = {r["doc_id"]: r for r in queries.op11_pii(spark, sf_dir).collect()}
    model = pii.trained()
    assert len(got) == len(doc_rows)
    for i, t in doc_rows:
        base = by_pattern(t or "")
        write = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == j for x in base) for j in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(write(base).encode()).hexdigest()
        assert got[i]["spans"] == write(sorted(base + pii.find(t or "", model)[1]))


def test_edges(edge_docs, no_docs):
    rows = pii.report(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (1, 2, 3, 7))
    assert pii.report(no_docs).count() == 0
