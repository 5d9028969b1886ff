"""Ordered lookups, rule files, batches, the registry of checks, groups, composed texts and names on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docsieve.operators import composed as CO
from docsieve.operators import lifecycle as L
from docsieve.operators import operations as O
from docsieve.operators import ordered as OR
from docsieve.operators import registry as RG
from docsieve.operators import report as R
from docsieve.operators import term_tables as TT
from docsieve.operators import terms as T
from docsieve.sources import batch_insert as BI
from docsieve.sources import term_files as TF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- ordered ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_asof_against_a_walk(spark, width):
    rng = random.Random(width)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), k) for k in range(60)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 20, 3)]), rng.choice([None, "x", "y"])) for _ in range(25)]
    got = OR.asof(spark.createDataFrame(left, "g string, at int, k int"), spark.createDataFrame(right, "g string, at int, v string"), ["g"], "at", ["v"], width=width)
    want = []
    for g, at, k in left:
        before = [(a, v is not None, v or "") for h, a, v in right if h == g and a is not None and at is not None and a <= at]
        best = max(before, default=None)
        want.append((g, at, k, best[2] if best and best[1] else None))
    assert rows(got) == sorted(want, key=repr)


def test_asof_refuses_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, "x")], "g int, at int, v string")
    with pytest.raises(ValueError, match="both sides"):
        OR.asof(df, df, ["g"], "at", ["v"])


def test_markers_of_a_long_document(spark):
    """One document whose hits lie in many stretches: each sees the last marker, also from far before its own."""
    text = "start hit\n" + "".join(f"[第{k}页]\n" + "x" * 500 + " hit " + "y" * 700 + "\n" for k in range(1, 40)) + "# 工作表： S1 \n" + "z" * 5000 + " hit"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "hit [第 页] [第7页")], "doc_id long, text string")
    got = OR.marked_hits(OR.hit_rows(docs, ["hit", "(", "."]), OR.marker_rows(docs), width=64).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["page"], r["sheet"]) for r in got] == [(1, None, None)] + [(1, str(k), None) for k in range(1, 40)] + [(1, "39", "S1"), (4, None, None)]
    assert [r["pos"] for r in got if r["doc_id"] == 1] == [i for i in range(len(text)) if text.startswith("hit", i)]


@pytest.mark.parametrize("width", [2, 100])
def test_heading_paths(spark, width):
    lines = [(None, "intro"), (1, "A"), (None, "a"), (3, "A.x"), (2, "A1"), (None, "b"), (3, "A1.x"), (1, "B"), (None, "c"), (12, "deep"), (None, "d"), (9, "deeper"), (0, "C"), (None, "e")]
    df = spark.createDataFrame([(1, k, n, t) for k, (n, t) in enumerate(lines)], "d int, at int, level int, label string")
    got = [r["path"] for r in OR.heading_paths(df, ["d"], "at", "level", "label", width=width).orderBy("at").collect()]
    path, want = [], []
    for n, t in lines:
        if n is not None:
            n = min(9, max(1, n))
            path = [p for p in path if p[0] < n] + [(n, t)]
        want.append([p[1] for p in path])
    assert got == want


def test_a_line_that_repeats_100_000_times(spark):
    many = spark.range(100_000).select(F.lit(1).alias("d"), F.lit("same").alias("line"), F.col("id").alias("at"))
    n = OR.occurrences(many, ["d"], "line", "at", width=1000)
    assert n.filter("n <> at + 1").count() == 0
    other = many.filter("at >= 40000").unionByName(spark.createDataFrame([(1, "new", 5)], "d int, line string, at long"))
    side = OR.aligned(many, other, ["d"], "line", "at", width=1000)
    assert side.filter("at_b is null").count() == 40_000 and side.filter("at_a is null").select("line").collect()[0][0] == "new"


def test_lines_replaced_by_occurrence(spark):
    text = spark.createDataFrame([(1, k, t) for k, t in enumerate(["a", "b", "a", "a", None])], "d int, at int, line string")
    changes = spark.createDataFrame([(1, 0, "a", None), (1, 1, "a", "A2"), (1, 2, "zzz", "no")], "d int, at int, line string, new string")
    assert [r["line"] for r in OR.replaced_lines(text, changes, ["d"], "line", "at", "new").orderBy("at").collect()] == ["a", "b", "A2", "a", None]


def test_numbers_by_range(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k * 37 % 101) for k in range(300)], "g int, k int").distinct()
    want = []
    for g in (None, 0, 1, 2):
        want += [(g, k, n) for n, k in enumerate(sorted(r["k"] for r in df.collect() if r["g"] == g), 1)]
    assert rows(OR.numbered(df, ["g"], ["k"])) == sorted(want, key=repr)
    assert OR.numbered(df.limit(0), ["g"], ["k"]).count() == 0
    moved = O.reorder(spark.createDataFrame([(1, 30), (2, 10), (3, 20), (4, 40)], "id int, place int"), [4, 9, 1, 4], "id", "place")
    assert [r["id"] for r in moved.orderBy("place").collect()] == [4, 1, 2, 3] and {r["place"] for r in moved.collect()} == {10, 20, 30, 40}
    assert [r["id"] for r in O.reorder(moved, [], "id", "place").orderBy("place").collect()] == [4, 1, 2, 3]


# -- files and batches ------------------------------------------------------------------------------------------------


def test_encodings_and_headers_of_term_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("note,,\n规范写法,错误用法\nApp,\"APP，app\n、apps\"\n,x\nWeb,/\n".encode("gb18030"))
    (tmp_path / "b.CSV").write_bytes("﻿标准写法：,常见错误/不推荐用法,适用语种\nApp,aPP,中文\nApp,Apps,全部\n".encode())
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "_d.csv").write_bytes(b"\xff\xff")
    (tmp_path / "e.txt").write_bytes(b"no list")
    assert rows(TF.read_rules(spark, str(tmp_path)).select("standard", "discouraged", "language_scope", "sheet", "row_number")) == [
        ("App", ["APP", "app", "apps", "Apps"], "all", "a.csv", 3), ("App", ["aPP"], "zh", "b.CSV", 2), ("Web", [], "all", "a.csv", 5),
    ]
    assert TF.term_cells(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    rules = TT.common_rules(TF.read_rules(spark, str(tmp_path / "a.csv")))
    found = T.term_candidates(spark.createDataFrame([(1, "apps and APP")], "doc_id long, text string"), rules)
    assert {(r["observed"], r["standard"]) for r in found.collect()} == {("apps", "App"), ("APP", "App")}


def test_faulty_term_files_name_file_and_row(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes("规范写法,错误用法,适用语言\na,b,全部\nc,d,英文\n".encode())
    with pytest.raises(Exception, match="bad.csv, row 3"):
        TF.read_rules(spark, str(tmp_path)).collect()
    (tmp_path / "worse.csv").write_bytes(b"\x81\xff\xff")
    with pytest.raises(Exception, match="worse.csv is in none of the encodings"):
        TF.term_cells(spark, str(tmp_path / "worse.csv")).collect()
    with pytest.raises(Exception, match="nowhere"):
        TF.term_cells(spark, str(tmp_path / "nowhere")).collect()


@pytest.mark.parametrize("chunk", [2, 1000])
def test_term_tables_as_literal_rules(spark, docs, chunk):
    pairs = [("the", "der"), ("the", "die"), ("th", ""), ("aa", "b"), ("(", "["), ("é", "e"), ("", "none"), (None, "none"), ("the", "der")]
    extra = spark.createDataFrame([(9001, "aaaaa (("), (9002, None), (9003, "")], "doc_id long, text string")
    texts = docs.unionByName(extra)
    got = TT.term_matches(texts, spark.createDataFrame(pairs, "invalid string, standard string"), chunk=chunk)
    want = T.sensitive_matches(texts, [T.SensitiveRule(a, b) for a, b in pairs if a])
    columns = ["doc_id", "invalid", "standard", "hits", "first_pos", "positions"]
    assert rows(got.select(columns)) == rows(want.select(columns))
    assert TT.term_matches(texts, spark.createDataFrame([], "invalid string, standard string")).count() == 0


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def test_batches_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.range(100).select("id", F.lit("x").alias("owner")).repartition(4)
    assert BI.insert_batch(good, path, "one", ["id"], ["owner"]) and not BI.insert_batch(good, path, "one", ["id"])
    late = spark.range(100, 200).select("id", F.when(F.col("id") != 197, "x").alias("owner")).repartition(4)
    with pytest.raises(Exception, match="column owner has no value"):
        BI.insert_batch(late, path, "two", ["id"], ["owner"])
    for df, batch in ((good.limit(1), "three"), (spark.createDataFrame([(300, "a"), (300, "b")], "id long, owner string"), "four")):
        with pytest.raises(ValueError, match="there already or twice"):
            BI.insert_batch(df, path, batch, ["id"])
    with pytest.raises(Exception, match="column id has no value"):
        BI.insert_batch(spark.createDataFrame([(None, "a"), (None, "b")], "id long, owner string"), path, "five", ["id"])
    with pytest.raises(Exception, match="no name of a batch"):
        BI.insert_batch(spark.createDataFrame([(1000, "a")], good.schema), path, "../x", ["id"])
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["batch=one"] and BI.batches_there(path) == ["one"]
    assert BI.read_batches(spark, path, good.schema).count() == 100
    assert BI.insert_batch(late.fillna("y"), path, "two", ["id"]) and BI.read_batches(spark, path, good.schema).agg(F.sum("id")).first()[0] == sum(range(200))


# -- wrong rows of before ---------------------------------------------------------------------------------------------


def test_upsert_with_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", ""), (None, "b", "keep"), (2, "c", "")], "id int, v string, note string")
    new = spark.createDataFrame([(1, "x", "n", 1), (1, "y", "n", 2), (None, "z", "n", 1), (3, None, "n", 1)], "id int, v string, note string, at int")
    assert rows(O.upsert(old, new, ["id"], keep_filled=("note",), order=("at",))) == sorted([(1, "y", "n"), (None, "z", "keep"), (2, "c", ""), (3, None, "n")], key=repr)


def test_two_ends_of_a_task_are_one(spark):
    fields = "task_id int, status string, claim_token string, cancel_requested boolean, finished_at string"
    tasks = spark.createDataFrame([(1, "running", "t", False, None), (2, "running", "t", True, None), (3, "queued", "t", False, None), (4, "running", None, False, None)], fields)
    ends = spark.createDataFrame([(1, "failed", "t", "2"), (1, "completed", None, "1"), (1, "completed", "other", "0"), (2, "failed", "t", None), (3, "failed", "t", "1"), (4, "failed", "t", "1"), (4, None, None, "1")], "task_id int, end_status string, claim_token string, ended_at string")
    got = L.finish(tasks, ends).select("task_id", "status", "finished_at")
    assert rows(got) == [(1, "completed", "1"), (2, "canceled", None), (3, "queued", None), (4, "running", None)]


def test_other_sides_that_repeat_add_no_rows(spark):
    tasks = spark.createDataFrame([(1, "c", None, None, "t", None)], "task_id int, code string, name string, prompt string, document_text string, cleaned_at string")
    assert L.clean_expired(tasks, spark.createDataFrame([(1,), (1,)], "task_id int"), F.lit("now")).count() == 1
    live = spark.createDataFrame([("c", "b", "p"), ("c", "a", "q")], "code string, name string, prompt string")
    assert [(r["name"], r["prompt"]) for r in L.snapshot_or_live(tasks, live).collect()] == [("a", "q")]


def test_notes_of_a_clamped_limit(spark):
    merged = spark.range(40).select(F.lit(1).alias("task_id"), F.lit("c").alias("code"), F.lit(1).alias("merged"), (F.col("id") + 1).alias("rank"))
    shown = R.limit_items(merged, 100).count()
    note = R.limit_note(merged, 100).first()
    assert (shown, note["displayed_count"], note["omitted_count"]) == (30, 30, 10)


def test_storage_in_its_order(spark):
    tasks = spark.createDataFrame([(1, "running"), (2, "failed"), (3, "completed"), (4, "failed")], "task_id int, status string")
    files = spark.createDataFrame([(1, 900), (2, 5), (3, 7), (4, 5)], "task_id int, bytes int")
    assert [r["task_id"] for r in L.usage(files, tasks).collect()] == [3, 2, 4, 1]


# -- registry ---------------------------------------------------------------------------------------------------------

BUILTIN = [(f"b{k}", "document", f"B{k}", "", f"p{k}", True, k * 10) for k in (1, 2, 3)]
BUILTIN_FIELDS = "code string, task_type string, name string, description string, prompt string, enabled boolean, sort_order int"
COMMAND_FIELDS = "seq int, action string, code string, task_type string, name string, description string, prompt string, enabled boolean, codes array<string>"


def registry(spark, commands):
    full = [(*c, *[None] * (9 - len(c))) for c in commands]
    return spark.createDataFrame(BUILTIN, BUILTIN_FIELDS), spark.createDataFrame(full, COMMAND_FIELDS)


def test_commands_of_the_registry(spark):
    log = [
        (1, "create", "c1", "document", " mine ", None, " do ", True), (2, "create", "c1", "document", "again", "", "x", True), (3, "create", "b1", "document", "n", "", "x", True), (4, "delete", "b1"), (5, "edit", "b2", None, "new", "d", "other", False),
        (6, "reset", "b2"), (7, "edit", "b3", None, "n", "", " ", True), (8, "disable", "b3"), (9, "enable", "nobody"), (10, "delete", "c1"), (11, "edit", "c1", None, "late", "", "x", True), (12, "create", "c2", "image", "pic", "", "x", False),
        (13, "reset", "c2"), (14, "fly", "b1"), (15, "reorder", None, "document", None, None, None, None, []), (16, "reorder", None, "document", None, None, None, None, ["b3", "c2", "gone", "b3"]), (17, "create", "c3", "odd", "last", "", "x", True),
    ]
    builtin, commands = registry(spark, log)
    got = {r["code"]: r for r in RG.current_checks(builtin, commands).collect()}
    assert sorted((r["task_type"], r["sort_order"], c) for c, r in got.items()) == [("document", 10, "c3"), ("document", 20, "b3"), ("document", 30, "b1"), ("document", 40, "b2"), ("image", 10, "c2")]
    assert (got["b2"]["name"], got["b2"]["prompt"], got["b2"]["enabled"], got["b2"]["builtin"]) == ("new", "p2", False, True)
    assert (got["b3"]["enabled"], got["c2"]["enabled"], got["c3"]["task_type"]) == (False, False, "document")
    why = {r["seq"]: r["problem"] for r in RG.refused(builtin, commands).collect()}
    assert why == {2: "code is taken", 3: "code is taken", 4: "built-in", 7: "no name or prompt", 9: "no such check", 11: "no such check", 13: "nothing to reset to", 14: "unknown action", 15: "empty order"}


def test_order_without_commands_and_reversed(spark):
    builtin, none = registry(spark, [])
    assert [r["code"] for r in RG.current_checks(builtin, none).orderBy("sort_order").collect()] == ["b1", "b2", "b3"]
    assert RG.next_sort_order(builtin).first()["sort_order"] == 0
    _, turned = registry(spark, [(1, "reorder", None, "document", None, None, None, None, ["b3", "b2", "b1"])])
    assert [r["code"] for r in RG.current_checks(builtin, turned).orderBy("sort_order").collect()] == ["b3", "b2", "b1"]


def test_prefixes_of_codes(spark):
    df = spark.createDataFrame([("image",), ("x",), (None,)], "t string").select(RG.code_of(RG.task_type(F.col("t")), F.lit("1")))
    assert [r[0] for r in df.collect()] == ["custom-image-1", "custom-1", "custom-1"]


# -- groups, texts, reviews, names ------------------------------------------------------------------------------------


def test_groups_with_own_other_and_no_source(spark):
    checks = spark.createDataFrame([(t, c, k) for t in (1, 2, 3, 4) for k, c in enumerate(["image-wiring", "p1", "p2", "p3", "image-drawing-standard"])], "task_id int, code string, place int")
    images = spark.createDataFrame([(1, "page", 1, "image/png"), (1, "resource", 2, "image/gif"), (1, "resource", 3, None), (2, "page", 1, "image/png"), (2, "page", 2, "text/plain"), (3, "resource", 1, "image/png")], "task_id int, source string, place int, mime_type string")
    meta = spark.createDataFrame([(1, 9, 4, 5, " broken "), (1, 9, 4, 5, " broken "), (2, None, None, 0, "")], "task_id int, total_pages int, selected_pages int, omitted_pages int, image_error string")
    got = {(r["task_id"], r["target"], r["group"]): r for r in CO.check_groups(checks, images, meta, size=2, batch=1).collect()}
    assert len(got) == 12 and got[1, "page", 0]["codes"] == ["p1", "p2"] and got[1, "page", 1]["codes"] == ["p3"]
    told = {k: (r["source"], r["fallback"], r["checkable"], r["skipped"], r["batches"], len(r["notes"])) for k, r in got.items() if k[2] == 0}
    assert told == {
        (1, "page", 0): ("page", False, 1, 0, 1, 1), (1, "resource", 0): ("resource", False, 1, 1, 1, 1), (2, "page", 0): ("page", False, 1, 1, 1, 0), (2, "resource", 0): ("page", True, 1, 1, 1, 1),
        (3, "page", 0): ("resource", True, 1, 0, 1, 1), (3, "resource", 0): ("resource", False, 1, 0, 1, 0), (4, "page", 0): (None, False, 0, 0, 0, 0), (4, "resource", 0): (None, False, 0, 0, 0, 0),
    }
    assert got[1, "page", 0]["notes"][0].startswith("PDF 共 9 页，本次页面级检查按长文档策略选取 4 页，未覆盖 5 页")


def summary(spark, contents, notes=()):
    batches = spark.createDataFrame([(1, k, label, text) for k, label, text in contents], "task_id int, batch int, label string, content string")
    said = spark.createDataFrame([(1, k, n) for k, n in enumerate(notes)], "task_id int, at int, note string")
    return CO.issue_summary(batches, said).first()["body"]


def test_summary_reads_bare_sections(spark):
    text = "### 检查项：a｜b\n总体判断\n发现明确问题：图片 89 页面顶部的表格缺失规范的表编号和标题。\n\n明确问题\n- 图片 89（page089-screenshot）：页面顶部的表格缺失表编号。\n  - 线索：表格上方仅有“设置时间”文字，未见“表X-X”格式标题。\n\n需人工确认\n- 未发现需人工确认项。"
    body = summary(spark, [(23, "PDF第89页", text), (30, "", "明确问题\n无")])
    assert "- 批次 23/30（PDF第89页）： 图片 89（page089-screenshot）：页面顶部的表格缺失表编号" in body and "线索：表格上方仅有" not in body


def test_summary_parts_issues_from_what_a_person_confirms(spark):
    text = "### 检查项：x\n#### 明确问题\n- PDF第3页：页面显示正常，文字清晰。\n- PDF第3页：未发现明确问题。\n- PDF第3页：页面截图较小，需人工确认清晰度。\n- PDF第3页：右下角表格标题缺失。\n#### 需人工确认\n- 未发现需人工确认项。"
    issues, manual = summary(spark, [(1, "PDF第3页", text)]).split("#### 明确问题", 1)[1].split("#### 需人工确认", 1)
    assert "右下角表格标题缺失" in issues and "页面显示正常" not in issues and "未发现明确问题" not in issues and "截图较小" not in issues
    assert "页面截图较小，需人工确认清晰度" in manual


def test_summary_limits_and_empty_batches(spark):
    many = "明确问题\n" + "\n".join(f"- 第 {k} 处错误" for k in range(40)) + "\n- 第 1 处错误"
    body = summary(spark, [(1, None, many)], ["a", " a", "", "b"])
    assert body.count("处错误") == 30 and body.endswith("#### 需人工确认\n- a\n- b")
    assert summary(spark, [(1, None, None)]) == "### 检查汇总\n\n#### 明确问题\n- 未发现明确问题。\n\n#### 需人工确认\n- 未发现需人工确认项。"


def test_rendered_check(spark):
    checks = spark.createDataFrame([(1, "c", "Name", None), (1, "d", None, " said ")], "task_id int, code string, name string, summary string")
    items = spark.createDataFrame([(1, "c", 2, "issue", "p1", "文字缺失；", "文字", "", "补上"), (1, "c", 1, " ISSUE", "", None, "看 x", "影响大", ""), (1, "c", 3, "other", "", "y", "", "", ""), (1, "c", 4, "issue", "p", "", "", "", "")], "task_id int, code string, idx int, status string, location string, description string, excerpt string, impact string, suggestion string")
    got = {r["code"]: r["body"] for r in CO.rendered_checks(checks, items).collect()}
    assert got["c"] == "### 检查项：c｜Name\n\n#### 总体判断\n发现明确问题。\n\n#### 明确问题\n- 看 x；影响：影响大\n- p1：文字缺失；建议：补上\n\n#### 需人工确认\n- y\n\n#### 未发现问题\n- 未单独列出正常项。"
    assert got["d"] == "### 检查项：d｜\n\n#### 总体判断\nsaid\n\n#### 明确问题\n- 未发现明确问题。\n\n#### 需人工确认\n- 未发现需人工确认项。\n\n#### 未发现问题\n- 未单独列出正常项。"


def test_older_rows_need_one_candidate(spark):
    items = spark.createDataFrame([(1, "a", "1", "A", 1), (1, "a", "2", "A", 2), (1, "b", "3", "A", 2), (2, "a", "1", "A", 1)], "task_id int, code string, item_id string, check_name string, idx int")
    given = [(1, 5, None, "", " A ", "条目 1"), (1, 6, "a", "1", "", ""), (1, 7, "", "", "A", "条目 2"), (1, 8, "a", " ", "A", "条目 1"), (1, 9, "a", "9", "", ""), (1, 10, "a", "2", "", ""), (1, 11, "", None, "", "条目 1")]
    got = CO.matched_reviews(spark.createDataFrame(given, "task_id int, row_number int, code string, item_id string, check_name string, marker string"), items)
    assert [(r["row_number"], r["item_id"], r["problem"]) for r in got.orderBy("row_number").collect()] == [
        (5, "1", None), (6, None, "item named before"), (7, None, "no single candidate"), (8, None, "half an id"), (9, None, "item is gone"), (10, "2", None), (11, None, "no single candidate"),
    ]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (["a", "a", "a-2", "a"], ["a", "a-2", "a-2-2", "a-3"]),
        (["a-2", "a", "a", "a"], ["a-2", "a", "a-3", "a-4"]),
        (["a", "a-2", "a", "a"], ["a", "a-2", "a-3", "a-4"]),
        (["d/x.tar.gz", "/d/x.tar.gz", "e/x.tar.gz"], ["d/x.tar.gz", "d/x.tar-2.gz", "e/x.tar.gz"]),
        ([".b", ".b", ".b-2", None, "", "/"], [".b", ".b-2", ".b-2-2", "document", "document-2", "document-3"]),
        (["a-2", "a-2", "a-2-2", "a-2"], ["a-2", "a-2-2", "a-2-2-2", "a-2-3"]),
    ],
)
def test_unique_names(spark, given, want):
    df = spark.createDataFrame([(g, k, n) for g in (1, None) for k, n in enumerate(given)], "task int, k int, name string")
    got = CO.unique_names(df, ["task"], "k", "name")
    for g in (1, None):
        assert [r["unique_name"] for r in got.orderBy("k").collect() if r["task"] == g] == want


def test_too_many_files_of_a_name(spark):
    with pytest.raises(Exception, match="more than 999 files"):
        CO.unique_names(spark.range(1001).select(F.lit(1).alias("t"), "id", F.lit("a").alias("name")), ["t"], "id", "name").count()
