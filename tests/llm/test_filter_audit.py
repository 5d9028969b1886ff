from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from docsieve.llm import filter_audit, queries
from tests.compare import oracle_rows, spark_rows


def test_query_against_sql(spark, sf_dir):
    got = spark_rows(queries.op12_filter_audit(spark, sf_dir))
    assert got == oracle_rows(queries.ORACLE_SQL["op12_filter_audit"], sf_dir)


def fails(rows, k):
    doc_id, text = rows[k][0], rows[k][1] or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
    return (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), copy)


def plain_audit(rows, labels):
    """Every order applied to every document, one after the other."""
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, x in labels if i is not None and x == 1}
    marks = [fails(rows, k) for k in range(len(rows))]
    count: Counter = Counter()
    parts = {r[2] or "" for r in rows}
    for order in map("".join, permutations("ABCDE")):
        for (doc_id, _, lang, *_), f in zip(rows, marks, strict=True):
            part, gone = lang or "", False
            for step, name in enumerate(order, 1):
                own, at = f["ABCDE".index(name)], (part, order, step)
                if own and not gone:
                    count[at, "removed"] += 1
                    count[at, "good_lost"] += doc_id in good
                    count[at, "toxic_lost"] += doc_id in toxic
                    count[part, name] += 1
                count[at, "redundant"] += own and gone
                count[at, "unique_fails"] += own and sum(f) == 1
                gone |= own
                count[at, "kept"] += not gone
    for part in parts:
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                at = (part, order, step)
                yield (*at, *(count[at, c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), count[part, name])


def test_edges_against_every_order(spark, edge_docs, no_docs):
    long_word = " ".join(f"w{i}" for i in range(120))
    more = [(20, long_word, "en"), (20, long_word, "en"), (21, long_word, "de"), (19, long_word, None), (22, long_word + " #", "en"), (23, "A" * 50, ""), (None, long_word, "de"), (24, "x " * 200, "en")]
    extra = spark.createDataFrame([(i, t, g, "s", 0, 0, "k", 1, 2.0, "fp") for i, t, g in more], edge_docs.schema)
    docs = edge_docs.unionByName(extra)
    labels = [(20, 1, 0), (20, 0, 1), (21, 1, None), (24, None, 1), (None, 1, 1), (999, 1, 1)]
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, rated)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(plain_audit(rows, labels))
    assert filter_audit.audit(no_docs, rated).count() == 0


def test_spectrum_inverts_to_the_cells(spark):
    counts = [(7 * m * m + 3) % 11 for m in range(32)]
    sums = {f"w{s}": sum(c * (-1) ** ((m & s).bit_count()) for m, c in enumerate(counts)) for s in range(32)}
    spectrum = spark.createDataFrame([("p", 0, *sums.values())], "part string, label int, " + ", ".join(f"{k} long" for k in sums))
    row = filter_audit.cells(spectrum).first()
    assert row["every"] == counts and row["good"] == row["toxic"] == [0] * 32
