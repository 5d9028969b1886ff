"""Places of hits, and term checks with few and with many rules."""

from __future__ import annotations

import random
import re

from docsieve.operators import terms as T
from docsieve.operators.places import Places


def test_places():
    text = "file: a b.txt \nfoo [第3页] x\nbar x [第12页]\n#  工作表： Q1 \nx\r#工作表：Q2\nlast x" + " y" * 100
    p = Places(text)
    at = [m.start() for m in re.finditer("x", text)][1:]  # the first is in the name
    got = [p.location(k, "x") for k in at]
    assert got[0] == "文件：a b.txt，页码：第3页，行：2，附近线索：foo [第3页] x"
    assert got[1] == "文件：a b.txt，页码：第12页，行：3，附近线索：bar x [第12页]"  # a marker counts for its whole line
    assert got[2].startswith("文件：a b.txt，页码：第12页，工作表：Q2，行：5")  # CR ends a line of markers, LF alone is counted
    assert got[3].startswith("文件：a b.txt，页码：第12页，工作表：Q2，行：6，附近线索：last x y") and got[3].endswith("...")
    assert Places("").location(0, "x") == "行：1" and Places("a\n\nb").location(1, "\n") == "行：1，附近线索：a"
    assert p.excerpt(0, 4).endswith("...") and Places("a 　 b").excerpt(0, 1) == "a b"
    # The same line again, then another one, then the first one.
    assert [p.location(k, "x") for k in (at[0], at[0], at[1], at[0])] == [got[0], got[0], got[1], got[0]]


def test_hits_far_apart_in_a_very_long_text():
    text = "".join(f"[第{k}页] word{k}\n" for k in range(100_000))
    p = Places(text)
    for k in (0, 1, 777, 99_999):
        assert p.location(text.index(f"word{k}\n"), f"word{k}") == f"页码：第{k}页，行：{k + 1}，附近线索：[第{k}页] word{k}"


def test_many_rules_give_what_few_give():
    rng = random.Random(5)
    words = ["ab", "ABC", "b-c", "Σας", "ß", "词", "İx", "c_d", "d.", "é", "a"]
    rules = [T.CommonRule(w.upper() + ("" if k % 2 else "q"), (w, w + rng.choice(words)), rng.choice(["all", "zh"])) for k, w in enumerate(words)]
    more = [T.CommonRule(f"never{k}", (f"no such term {k}",)) for k in range(200)]
    few, many = T.TermFinder(rules), T.TermFinder(rules + more)
    assert not few.automata and many.automata
    for _ in range(300):
        text = "".join(rng.choice([*words, " ", " ", ".", "_", "\n"]) for _ in range(rng.randint(0, 60)))
        for language in ("zh", "latin"):
            assert few.selected(text, language) == many.selected(text, language)
            assert few.matches(text, language) == many.matches(text, language)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (None, "a foo"), (None, "a foo"), (3, "foo " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = [T.CommonRule("bar", ("foo",))]
    got = sorted((r["doc_id"] or 0, r["hits"], r["first_pos"], r["positions"]) for r in T.common_matches(df, rules).collect())
    assert got == [(0, 1, 2, [2])] * 2 + [(3, 2000, 0, [0, 4, 8, 12, 16])]
    items = T.common_items(df, rules).collect()
    assert {r["idx"] for r in items} == {1} and all(r["location"].startswith("行：1，附近线索：") for r in items)
    assert T.common_items(df.limit(0), rules).collect() == [] and T.common_matches(df, []).collect() == []
    sens = [T.SensitiveRule("foo", "bar"), T.SensitiveRule("a foo", "b")]
    assert sorted((r["doc_id"] or 0, r["idx"], r["description"].count("foo")) for r in T.sensitive_items(df, sens).collect()) == [(0, 1, 1), (0, 1, 1), (0, 2, 1), (0, 2, 1), (3, 1, 1)]
    assert sorted((r["doc_id"] or 0, r["kinds"], r["total_hits"], r["hidden_kinds"]) for r in T.sensitive_summary(df, sens, limit=1).collect()) == [(0, 2, 2, 1), (0, 2, 2, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 2000, 0)]
    assert T.sensitive_items(df, []).collect() == []


def test_a_hot_group_of_findings_gathers_distinct_places_only(spark):
    from pyspark.sql import functions as F

    from docsieve.operators import report as R

    names = {"task_id": F.lit(1), "code": F.lit("c"), "type": F.lit("issue"), "category": F.lit("k"), "excerpt": F.lit(""), "impact": F.lit(""), "suggestion": F.lit(""), "confidence": F.lit("low")}
    idx = F.col("id")
    hot = spark.range(20_000).select(
        idx.alias("idx"), *[v.alias(k) for k, v in names.items()], F.when(idx == 777, "critical").otherwise("low").alias("severity"),
        F.when(idx % 4 == 0, "").when(idx % 4 == 1, "p1").when(idx % 4 == 2, " p12 ").otherwise("q").alias("location"), F.when(idx < 19_990, F.lit(" d  x")).otherwise("").alias("description"),
    )
    rows = {r["idx"]: r for r in R.deduplicate(hot.withColumn("category", F.when(F.col("description") == "", "").otherwise(F.col("category")))).collect()}
    first = rows[0]
    assert (first["merged"], first["location"], first["severity"]) == (19_990, "p1；p12；q", "critical")
    assert len(rows) == 11 and all(rows[k]["merged"] == 1 for k in range(19_990, 20_000))  # without content nothing is merged
