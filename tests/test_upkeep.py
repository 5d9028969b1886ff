"""Similarity, suppression hits, migrations, pages as text and reports about lists on small inputs."""

from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docsieve.functions import sampling, similarity
from docsieve.functions import text as X
from docsieve.functions.markup import html_lines
from docsieve.operators import report as R
from docsieve.operators import rule_tables as RT
from docsieve.operators import terms as T
from docsieve.operators import upkeep as U


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_matched_characters_against_the_library():
    rng = random.Random(2)
    for t in range(400):
        k, long = rng.choice([2, 4, 10, 26]), t % 5 == 0
        a = "".join(chr(97 + rng.randrange(k)) for _ in range(rng.randint(150, 300) if long else rng.randint(0, 60)))
        b = "".join(rng.choice([a[rng.randrange(len(a))] if a else "x", chr(97 + rng.randrange(k)), "é"]) for _ in range(rng.randint(150, 300) if long else rng.randint(0, 60)))
        if t % 3 == 0 and a:
            i = rng.randrange(len(a))
            b = b[: len(b) // 2] + a[i : i + 20] + b[len(b) // 2 :]
        assert similarity.matched_characters(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_bound_of_the_similarity_never_falls_short(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.substring("text", 1, 70).alias("t"))
    more = spark.createDataFrame([("",), ("a",), ("abc",), ("abcd",), ("abcd efgh",), ("矛盾的资料",), ("冲突文档",)], "t string")
    t = b.unionByName(more)
    both = t.join(t.select(F.col("t").alias("u")), F.length("t") + F.length("u") > -1)
    short = both.filter(similarity.similarity_bound(F.col("t"), F.col("u")) < F.least(similarity.similarity(F.col("t"), F.col("u")), F.lit(similarity.THRESHOLD)) - 1e-12)
    assert short.count() == 0


def test_hits_are_recorded_once(spark):
    rules = spark.createDataFrame([(1, "r", 3), (2, "s", None)], "id int, name string, hit_count long")
    items = spark.createDataFrame([(1, 7, "c", "x"), (1, 7, "c", "x"), (2, 7, "c", None), (None, 7, "c", "y")], "rule_id int, task_id int, code string, id string")
    none = spark.createDataFrame([], "rule_id int, task_id int, code string, item_id string")
    first, recorded = R.record_hits(rules, none, items)
    second, again = R.record_hits(first, recorded, items)
    assert rows(first) == rows(second) == [(1, "r", 4), (2, "s", 1)] and again.count() == 2


def test_changes_of_rules(spark):
    rules = spark.createDataFrame([(1, "c", False, "0"), (2, "c", True, "0"), (3, "gone", True, "1"), (4, "c", True, "0")], "id int, check_code string, enabled boolean, updated_at string")
    log = spark.createDataFrame([(1, 1, "enable", "5"), (2, 1, "look", "6"), (3, 4, "delete", "7"), (4, 4, "enable", "8"), (5, 2, "disable", "9"), (6, 99, "enable", "9")], "seq int, id int, action string, at string")
    left = R.rule_list(R.changed_rules(rules, log), spark.createDataFrame([("c", "C"), ("c", "B")], "code string, name string"))
    assert [(r["id"], r["enabled"], r["check_name"]) for r in left.collect()] == [(2, False, "B"), (1, True, "B"), (3, True, None)]


def test_counts_of_results_that_are_all_suppressed(spark):
    fields = "task_id int, code string, type string, acceptance string"
    shown = spark.createDataFrame([(1, "a", "issue", "accepted"), (1, "a", "issue", "pending"), (1, "a", "non_issue", "pending")], fields)
    got = {r["task_id"]: r for r in R.counts(shown, suppressed=spark.createDataFrame([(1, "a", "issue", ""), (2, "a", "issue", "")], fields)).collect()}
    assert (got[1]["issue"], got[1]["accepted_issue"], got[1]["pending_issue_acceptance"], got[1]["suppressed"]) == (2, 1, 1, 1)
    assert (got[2]["issue"], got[2]["suppressed"]) == (0, 1)


# -- migrations -------------------------------------------------------------------------------------------------------


def test_steps_run_once_and_in_order(spark):
    seen = []

    def step(name):
        def change(tables):
            seen.append(name)
            return {"t": tables["t"].withColumn("v", F.concat("v", F.lit(name)))}

        return U.Step(name, change)

    start = {"t": spark.createDataFrame([("",)], "v string"), "other": spark.range(1)}
    steps = [step("a"), step("b"), step("c"), U.Step("always", lambda x: {"t": x["t"].filter("v <> 'no'")}, always=True)]
    out, done = U.migrate(start, spark.createDataFrame([("b",), ("b",), ("x",)], "name string"), steps)
    assert out["t"].first()[0] == "ac" and seen == ["a", "c"] and set(out) == {"t", "other"}
    twice, done2 = U.migrate(out, done, steps)
    assert twice["t"].first()[0] == "ac" and seen == ["a", "c"] and rows(done2) == rows(done)
    with pytest.raises(ValueError, match="one name"):
        U.migrate(start, done, [step("a"), step("a")])


def test_owners_and_keys(spark):
    fields = "task_id int, ip string, username string, owner_subject string, owner_name string, owner_source string, status string, api_key string"
    tasks = spark.createDataFrame([(1, "1.2.3.4", "u", None, None, None, "failed", "k"), (2, "1.2.3.4", None, "sub", "", "sso", "queued", "k"), (3, None, "u", "", "own", "", None, "k")], fields)
    got = U.without_finished_keys(U.fill_owners(tasks)).select("task_id", "owner_subject", "owner_name", "owner_source", "api_key")
    assert rows(got) == [(1, "ip:1.2.3.4", "u", "ip", None), (2, "sub", "", "sso", "k"), (3, None, "own", "ip", "k")]
    assert rows(U.fill_owners(U.fill_owners(tasks))) == rows(U.fill_owners(tasks))


def test_thinking_flag(spark):
    models = spark.createDataFrame([(1, 1, "m", True, "t"), (2, 1, "m", False, "t"), (3, 2, "m", True, "t"), (4, None, "m", True, "t"), (5, None, "m", None, "t")], "id int, provider_id int, model_name string, force_disable_thinking boolean, updated_at string")
    assert rows(U.one_thinking_flag(models, F.lit("n")).select("id", "force_disable_thinking", "updated_at")) == [(2, False, "t"), (3, False, "n"), (4, False, "n"), (5, None, "t")]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ([("old", "5"), ("x", "1")], [("new", "5"), ("x", "1")]),
        ([("old", "5"), ("new", "6")], [("new", "6")]),
        ([("old", None)], [("new", None)]),
        ([("new", "6")], [("new", "6")]),
        ([], []),
    ],
)
def test_renamed_setting(spark, before, after):
    df = spark.createDataFrame([(k, v, "t") for k, v in before], "key string, value string, updated_at string")
    once = U.renamed_setting(df, "old", "new", F.lit("n"))
    assert rows(once.select("key", "value")) == after and rows(U.renamed_setting(once, "old", "new", F.lit("m"))) == rows(once)


def test_stock_prompts(spark):
    fields = "code string, name string, description string, prompt string, sort_order int"
    defaults = spark.createDataFrame([("a", "A", "", "new text", 10)], fields)
    markers = spark.createDataFrame([("a", 1, "one"), ("a", 1, "two"), ("a", 2, "three")], "code string, set int, marker string")
    checks = spark.createDataFrame([("a", "x", "", p, 1, "t") for p in ("one two", "one", "three", "new text", None, "mine")] + [("a", "A", "", "new text", 10, "t"), ("b", "x", "", "one two", 1, "t")], fields + ", updated_at string")
    once = U.refreshed_prompts(checks, defaults, markers, F.lit("n"))
    assert sorted((r["code"], str(r["prompt"]), r["updated_at"]) for r in once.collect()) == sorted([("a", "new text", "n")] * 3 + [("a", "new text", "t"), ("a", "one", "t"), ("a", "None", "t"), ("a", "mine", "t"), ("b", "one two", "t")])
    assert rows(U.refreshed_prompts(once, defaults, markers, F.lit("m"))) == rows(once)


# -- texts ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        ("", []),
        ("just text &lt;b&gt; &amp;amp;", ["just text <b> &amp;"]),
        ("<p> a <b>b</b>c</p><p></p>", ["a", "b", "c"]),
        ("a<script>x < y </scripty></SCRIPT >b<style>p{}</style>c<noscript><p>no</p></noscript>d", ["a", "b", "c", "d"]),
        ("<title>a <b> c</title><textarea><p></textarea>", ["a <b> c", "<p>"]),
        ("a<!-- <p>b</p> -->c<!doctype x><?php y ?>d", ["a", "c", "d"]),
        ("1 < 2 <3 > 2", ["1 < 2 <3 > 2"]),
        ('<a title="x > y" alt=\'<p>\'>z</a>', ["z"]),
        ("<a title=\"open>z</a> 'q", ["z", "'q"]),
        ("a</>b</ p>c", ["a", "b", "c"]),
        ("a<script>b", ["a"]),
        ("a<!-- b", ["a"]),
        ("a<p b", ["a"]),
    ],
)
def test_text_nodes(html, lines):
    assert html_lines(html) == lines


def test_odd_pages_take_time_in_proportion():
    for html in ("<" * 300_000, '<a "' * 100_000, "<a '\"" * 100_000, "<!--" * 100_000, "<noscript>" * 50_000, "<title>" * 50_000, "&" * 300_000, "<a " * 100_000):
        html_lines(html)


def test_list_reports(spark):
    given = [(1, None, None), (2, None, "why"), (3, 0, None), (4, 5, None), (5, 5, "late error")]
    t = spark.createDataFrame(given, "task_id int, n int, e string")
    got = {r["task_id"]: r for r in U.list_report(t, "sensitive", F.col("n"), F.array(F.lit("p1"), F.lit("p2")), F.col("e")).collect()}
    assert set(got) == {1, 2, 3, 5} and got[1]["suggestion"].endswith("：\n- p1\n- p2") and got[1]["location"] == "本地词表文件"
    assert (got[2]["description"], got[2]["location"], got[2]["summary"]) == ("why", "p1", "敏感词检查结论：敏感词表读取失败。\n词表文件：p1")
    assert got[3]["description"].startswith("未读取到有效敏感词规则") and got[5]["description"] == "late error"


def test_report_as_text_is_what_a_library_writes(spark):
    item = {f: v for f, v in zip(U.REPORT_FIELDS, ("类", 'a"b\\', "", "line\nend\t", "é😀", "", "issue"), strict=True)}
    fields = ", ".join(f"{f} string" for f in U.REPORT_FIELDS)
    df = spark.createDataFrame([(1, "总", [tuple(item.values())] * 2), (2, None, [])], f"task_id int, summary string, items array<struct<{fields.replace(' string', ':string')}>>")
    got = {r["task_id"]: r["body"] for r in U.report_json(df).collect()}
    assert got[1] == json.dumps({"summary": "总", "items": [item, item]}, ensure_ascii=False, indent=2)
    assert got[2] == json.dumps({"summary": "", "items": []}, ensure_ascii=False, indent=2)


def test_document_groups(spark):
    metas = [None, "", "x", "[]", "{}", '{"groups":{}}', '{"groups":[{"role":"a","files":[{"n":1},2]},{"files":[]},{"label":"L","files":[{}]},3]}']
    got = [r[0] for r in spark.createDataFrame([(m,) for m in metas], "m string").select(U.document_groups(F.col("m"))).collect()]
    assert got[:6] == [[]] * 6 and [tuple(g) for g in got[6]] == [("a", "文档", ['{"n":1}']), ("", "L", ["{}"])]


def test_small_texts(spark):
    df = spark.createDataFrame([("**bold  ** and **x\t**\r\n** y **\r", [])], "t string, a array<string>")
    assert tuple(df.select(U.tidy_markdown(F.col("t")), U.preview(F.col("a"))).first()) == ("**bold** and **x**\n** y**\n", "未发现")
    assert [r[0] for r in spark.range(1).select(F.length(U.now_text()), F.length(U.token())).collect()] == [19]
    assert spark.range(50).select(U.token().alias("t")).distinct().count() == 50
    assert [r[0] for r in spark.createDataFrame([("Ab",), ("ab",), ("中文",)], "t string").select(X.has_case(F.col("t"))).collect()] == [True, True, False]


def test_texts_of_media_items_and_first_rules(spark):
    df = spark.createDataFrame([(" d ", "x", None)], "description string, a string, b string")
    assert df.select(R.media_text({c: F.col(c) for c in df.columns}, {"a": "A", "b": "B"})).first()[0] == "d\nA：x"
    rules = spark.createDataFrame([("s", 2, "k", "late"), ("s", 1, "k", "first"), ("t", 1, "l", "other")], "sheet string, row_number int, k string, v string")
    assert rows(RT.first_of_each(rules, ["k"]).select("v")) == [("first",), ("other",)]


def test_better_of_two_page_texts(spark):
    good, bad = "alpha beta gamma delta epsilon", "��� alpha"
    cases = [("", good, good), (good, " ", good), (good, bad, good), (bad, good, good), (good + " zeta eta theta iota kappa lambda", good, good + " zeta eta theta iota kappa lambda"), (good, good, good), (None, None, "")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert [r[0] for r in df.select(sampling.better_page_text(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]


def test_rules_skipped_by_language(spark):
    rules = [T.CommonRule("A"), T.CommonRule("B", (), "zh"), T.CommonRule("C", (), "zh"), T.CommonRule("D", (), "other")]
    df = spark.createDataFrame([(1, "请打开应用程序并登录账户后查看设备状态和报警信息"), (2, "This is a longer English sentence about a device, for a test."), (3, None)], "doc_id long, text string")
    assert rows(T.rule_scopes(df, rules)) == [(1, "zh", 3, 1), (2, "latin", 1, 3), (3, "unknown", 1, 3)]
    assert rows(T.rule_scopes(df, []).select("applied", "skipped")) == [(0, 0)] * 3
