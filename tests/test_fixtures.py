"""Literal inputs with known results (FIXTURES.md)."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docsieve.functions import answers as A
from docsieve.functions import sampling, similarity
from docsieve.functions import text as X
from docsieve.functions import values as V
from docsieve.operators import combined as C
from docsieve.operators import lifecycle as L
from docsieve.operators import report as R
from docsieve.operators import rule_tables as RT


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def items_of(spark, answer):
    results = spark.createDataFrame([(1, "c", answer)], "task_id long, code string, result string").withColumn("report", A.reports(F.col("result")))
    return results.first()["report"], R.report_items(results).orderBy("idx").collect()


def test_split_cells(spark):
    assert one(spark, "c string", [("Open AI；open-ai、OPEN AI，n/a",)], RT.split_terms(F.col("c"))) == [(["Open AI", "open-ai", "OPEN AI"],)]


def test_unknown_language_scope_names_sheet_and_row(spark):
    cells = spark.createDataFrame([("s", 1, ["常用词", "常见错误", "适用语种"]), ("s", 2, ["a", "b", "英文"])], "sheet string, row_number int, cells array<string>")
    with pytest.raises(Exception, match="sheet s, row 2"):
        RT.rules_of(cells).collect()


def test_language_samples(spark):
    rows = [("请打开应用程序并登录账户后查看设备状态和报警信息",), ("This is a longer English sentence about a device, for a test.",), ("打开 APP。",), ("",), ("これはテストです。" * 5,), ("이것은 한국어 문장입니다 그리고 더 길게 씁니다 계속 써요",), ("安装设备并检查状态" * 6 + " and then look at the status of the whole device again, " * 2,)]
    got = [r[0] for r in one(spark, "t string", rows, X.estimate_language(F.col("t")))]
    assert got == ["zh", "latin", "uncertain", "unknown", "other", "other", "mixed"]


def test_model_numbers_are_no_latin_text(spark):
    rows = [("AB12-CD abc 12 :x9 a-b-c #a1#",), ("a" * 60_000 + "1",), ("a-" * 30_000,)]
    assert [r[0] for r in one(spark, "t string", rows, X.language_counts(F.col("t"))["latin"])] == [6, 0, 30_000]


def test_hard_tokens(spark):
    rows = [("1. 安装要求 设备电流为 10A。 访问 https://example.com/a。",), ("额定 10% 与 25℃ 及 5 kg",)]
    got = [r[0] for r in one(spark, "t string", rows, X.hard_tokens(F.col("t")))]
    assert set(got[0]) == {"1", "10a", "https://example.com/a"} and got[1] == ["10", "25", "5 kg"]


def test_cut_answer(spark):
    item = lambda k: json.dumps({"status": "issue", "description": f"d{k}", "severity": "严重"}, ensure_ascii=False)
    report, items = items_of(spark, '{"summary":"总体","items":[' + item(1) + "," + item(2) + ',{"status":"issue","description":"cut')
    assert report["summary"] == "总体" and [(i["description"], i["severity"]) for i in items] == [("d1", "high"), ("d2", "high")]


def test_two_statuses(spark):
    assert items_of(spark, '{"items":[{"status":"issue":"suggestion","description":"x"}]}')[1][0]["type"] == "suggestion"


@pytest.mark.parametrize("form", [lambda s: s, lambda s: json.dumps(s), lambda s: json.dumps(json.dumps(s)), lambda s: f"Here:\n```json\n{s}\n```", lambda s: s.replace("A B", "A\nB\tC")])
def test_forms_of_json(spark, form):
    report, items = items_of(spark, form('{"summary":"S","issues":[{"status":"issue","issue":"A B","evidence":["e","f"],"risk":{"b":1,"a":true}}]}'))
    assert report["summary"] == "S" and items[0]["description"].split() in (["A", "B"], ["A", "B", "C"])
    assert items[0]["excerpt"] == "e；f" and items[0]["impact"] == '{"a": true, "b": 1}' and items[0]["type"] == "issue"


def test_items_without_fields(spark):
    report, items = items_of(spark, '["疑似缺页", {"foo": 1, "类型": "建议"}, "", {"category": "issue", "description": "d"}]')
    assert [(i["description"], i["type"], i["category"]) for i in items] == [("疑似缺页", "suggestion", ""), ('{"foo": 1, "类型": "建议"}', "suggestion", ""), ("d", "issue", "")]
    assert items_of(spark, "没有 JSON 的一句话")[1][0]["description"] == "没有 JSON 的一句话" and items_of(spark, None)[1] == []


def test_no_action_items(spark):
    _, items = items_of(spark, json.dumps({"items": [{"status": "issue", "description": "a", "impact": "无实质影响。", "suggestion": "无需修改。"}, {"status": "issue", "description": "b", "impact": "No material impact.", "suggestion": "No modification required."}]}, ensure_ascii=False))
    assert [i["type"] for i in items] == ["non_issue", "issue"]


def test_results_of_a_task(spark):
    held = json.dumps([{"code": "a", "structured_items": [{"description": "x"}], "summary": "s"}, None, {"code": "b", "report_json": {"items": ["y"]}}, {"code": "c", "result": "1. 问题描述：z"}], ensure_ascii=False)
    tasks = spark.createDataFrame([(1, held), (2, "{}"), (3, None), (4, "x")], "task_id long, result_json string")
    rows = R.report_items(R.read_results(tasks)).orderBy("code").collect()
    assert [(r["task_id"], r["code"], r["description"]) for r in rows] == [(1, "a", "x"), (1, "b", "y"), (1, "c", "z")]


def test_suppression_similarity(spark):
    rows = [("面向客户资料中残留内部备注", "客户交付文档仍保留研发内部备注"), ("面向客户资料中残留内部备注", "文档中缺少安全警告")]
    got = [round(r[0], 3) for r in one(spark, "a string, b string", rows, similarity.similarity(F.col("b"), F.col("a")))]
    assert got == [0.714, 0.273]


def test_merge_and_limit(spark):
    fields = "task_id long, code string, idx int, type string, category string, location string, excerpt string, description string, impact string, suggestion string, severity string, confidence string"
    rows = [(1, "c", 1, "issue", "", "第10页", "", "a", "", "", "high", "high"), (1, "c", 2, "issue", "", "", "", "b", "", "", "critical", "medium"), (1, "c", 3, "issue", "", "第30页", "", "a", "", "", "low", "low"), (1, "c", 4, "issue", "", "", "", "c", "", "", "low", "high"), (1, "c", 5, "issue", "", "", "", "d", "", "", "low", "low")]
    merged = R.deduplicate(spark.createDataFrame(rows, fields))
    shown = R.limit_items(R.rank_items(merged), 2).orderBy("rank").collect()
    assert [(r["description"], r["location"], r["severity"]) for r in shown] == [("a", "第10页；第30页", "high"), ("c", "", "low")]
    assert R.limit_note(merged, 2).first()["omitted_count"] == 2


def test_combined_answer(spark):
    answers = spark.createDataFrame([(1, '{"results":[{"code":"a","x":1},{"code":"unknown"},{"code":"a","x":2}]}')], "task_id long, answer string")
    asked = spark.createDataFrame([(1, "a"), (1, "b")], "task_id long, code string")
    first = C.split_combined(answers, asked)
    assert [(r["code"], r["missing"]) for r in first.orderBy("code").collect()] == [("a", False), ("b", True)]
    filled = C.with_placeholders(first, first.limit(0), F.lit("again")).orderBy("code").collect()
    assert json.loads(filled[0]["answer"])["x"] == 1 and filled[1]["answer"] == "again"


def test_one_bad_review_refuses_all(spark):
    items = spark.createDataFrame([("c", "1"), ("c", "2")], "code string, item_id string")
    fields = "task_id long, code string, item_id string, item_type string, acceptance string, rejection_reason string, rejection_note string"
    good, bad = (1, "c", "1", "问题", "accepted", "", ""), (1, "c", "2", "issue", "rejected", "other", " ")
    checked = C.checked_import(spark.createDataFrame([good, bad, (1, "c", "", "issue", "accepted", "", "")], fields), items, F.lit(1)).collect()
    assert sorted(str(r["problem"]) for r in checked) == ["None", "half an item id", "no note"]
    assert C.import_reviews(spark.createDataFrame([good, bad], fields), items, F.lit(1)).count() == 0
    assert C.import_reviews(spark.createDataFrame([good], fields), items, F.lit(1)).first()["item_type"] == "issue"


def test_sampling(spark):
    pages = lambda *row: one(spark, "t int, l int, c array<int>", [row], sampling.sampled_pages(F.col("t"), F.col("l"), F.col("c")))[0][0]
    assert pages(200, 10, [50, 120]) == [1, 2, 3, 4, 5, 50, 101, 120, 199, 200]
    assert pages(30, 5, [9, 10, 11]) == [1, 2, 3, 9, 10]
    assert one(spark, "d double", [(5.2,)], sampling.sampled_times(F.col("d"), F.lit(3)))[0][0] == [0.0, 2.55, 5.1]


def test_candidate_pages(spark):
    text = "file: a\n\n[第1页]\nplain\n\n[第2页]\n见下表\n\n[第3页]\nplain"
    assert one(spark, "t string, i array<int>", [(text, [5])], sampling.candidate_pages(F.col("t"), F.col("i"))) == [([2, 5],)]


def test_page_context(spark):
    text = "file: a.pdf\n\n" + "\n\n".join(f"[第{k}页]\ntext {k}" for k in range(1, 6))
    said = one(spark, "t string, i array<int>", [(text, [2]), (text, []), ("x" * 30_000, [1])], C.page_context(F.col("t"), F.col("i"), F.array(F.lit("- p"))))
    assert "text 3" in said[0][0] and "text 4" not in said[0][0] and said[0][0].startswith("file: a.pdf\n\n")
    assert said[1][0] == text and said[2][0] == "x" * 20_000 + C.CUT_NOTE


def test_names_and_paths(spark):
    assert one(spark, "n string, t string", [("../报告.txt", " 内容 ")], L.document_text(F.col("n"), F.col("t"))) == [("file: 报告.txt\n\n内容",)]
    assert one(spark, "n string", [("é" * 50 + "?",)], L.safe_name(F.col("n"), 11)) == [("é" * 5,)]
    assert [r[0] for r in one(spark, "p string", [("a/b.png",), ("../a",), ("/a",), ("a/..",), ("",), (None,)], L.safe_path(F.col("p")))] == [True] + [False] * 5


def test_values(spark):
    v = F.col("v")
    assert [r[0] for r in one(spark, "v string", [(" Yes",), ("off",), ("?",), (None,)], V.tolerant_bool(v, True))] == [True, False, True, True]
    assert [r[0] for r in one(spark, "v string", [(" 7 ",), ("x",), (None,)], V.tolerant_int(v, 3))] == [7, 3, 3]
    assert [r[0] for r in one(spark, "v string", [("2026-02-30",), ("2026-02-03",), ("2026-2-3",)], V.date_or(v, F.lit("2000-01-01").cast("date")).cast("string"))] == ["2000-01-01", "2026-02-03", "2000-01-01"]
    assert [r[0] for r in one(spark, "v array<int>", [([],), ([4],), ([2, 3, 4],), ([1, 5],)], V.page_list_label(v))] == ["", "4", "2-4", "1、5"]
    assert one(spark, "v array<int>", [([1, 2, 3, 4, 5, 6, 7],)], V.chunks(v, 3)) == [([[1, 2, 3], [4, 5, 6], [7]],)]
    assert [r[0] for r in one(spark, "v string", [("a.PDF",), ("a.exe",), ("a",)], V.allowed_file(v))] == [True, False, False]
    assert [r[0] for r in one(spark, "v binary", [(b"\x89PNG\r\n\x1a\n..",), (b"RIFF1234WEBP",), (b"x",)], V.magic_mime(v))] == ["image/png", "image/webp", ""]
    assert [r[0] for r in one(spark, "v double", [(2.0,), (2.5,), (None,)], V.number_text(v))] == ["2", "2.5", ""]
