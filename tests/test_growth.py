"""Faults that were found on larger tables and odd rows."""

from __future__ import annotations

import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.functions import answers as A
from docsieve.functions import sampling
from docsieve.operators import combined as C
from docsieve.operators import composed as CO
from docsieve.operators import report as R
from docsieve.operators import terms
from docsieve.plans import catalogue, reports, structure, upkeep  # noqa: F401
from tests.compare import oracle_rows, spark_rows


def test_an_answer_is_read_once(spark):
    """However the planner pushes the filters on its report."""
    rows = spark.createDataFrame([(1, "c", '{"items":[{"issue":"x"}]}'), (1, "d", "1. plain")], "task_id long, code string, result string")
    found = R.report_items(rows.withColumn("report", A.reports(F.col("result")))).select("code", "description")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_first_report") == 1
    assert sorted(map(tuple, found.collect())) == [("c", "x"), ("d", "plain")]


def test_items_of_one_id_count_as_often_as_they_are_reviewed(spark, sf_dir, tmp_path):
    with duckdb.connect() as db:  # a third of the line items twice, the second time with another flag
        db.execute(f"""COPY (SELECT * FROM '{sf_dir}/lineitem.parquet' UNION ALL SELECT * REPLACE (CASE l_returnflag WHEN 'R' THEN 'A' ELSE 'R' END AS l_returnflag)
            FROM '{sf_dir}/lineitem.parquet' WHERE l_orderkey % 3 = 0) TO '{tmp_path}/lineitem.parquet'""")
    got = spark_rows(catalogue.QUERIES["op_review_overlay"](spark, str(tmp_path)))
    assert got == oracle_rows(catalogue.ORACLE_SQL["op_review_overlay"], str(tmp_path))


def test_pages_of_very_long_documents_cost_no_more(spark):
    """Work and memory follow the limit, not the number of pages: two billion pages would not fit an array."""
    d = spark.createDataFrame([(2_000_000_000, 12, [5]), (3, 12, None), (0, 12, None), (40, 4, [9, 41, 0])], "total int, most int, c array<int>")
    got = [r[0] for r in d.select(sampling.sampled_pages(F.col("total"), F.col("most"), F.col("c"))).collect()]
    assert got[0] == [1, 2, 3, 4, 5, 6, 400000001, 800000001, 1200000000, 1600000000, 1999999999, 2000000000] and got[1:] == [[1, 2, 3], [], [1, 2, 3, 9]]


def test_a_text_of_many_pages_is_split_once(spark):
    text = "\n".join(f"[第{k}页]\nsaid {k}" for k in range(20_000))
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(F.element_at(sampling.page_sections(F.col("t")), -1).alias("s")).first()["s"]
    assert (got["page"], got["section"]) == (19_999, "[第19999页]\nsaid 19999")
    assert time.time() - began < 30


def test_spots_are_made_a_few_documents_at_a_time():
    texts = pa.array(["a bad b"] * (2 * terms.DOCUMENTS + 1))
    found = pa.array([[{"invalid": "bad", "positions": [2]}]] * len(texts))
    got = terms._spots.func(texts, found)
    assert len(got) == len(texts) and got[-1].as_py() == [{"location": "行：1，附近线索：a bad b", "excerpt": "a bad b"}]


def shuffles(df) -> int:
    """Shuffles by hash in the plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_answers_meet_their_codes_without_shuffles_by_code(spark, sf_dir):
    got = catalogue.QUERIES["op_combined_answers"](spark, sf_dir)
    assert shuffles(got) == 2
    assert spark_rows(got) == oracle_rows(catalogue.ORACLE_SQL["op_combined_answers"], sf_dir)


def test_parts_without_a_code_belong_to_the_only_code(spark):
    said = '{"results":[{"x":1},{"code":"a","x":2},{"code":"b"},{"code":"a","x":3}]}'
    answers = spark.createDataFrame([(t, said) for t in (1, 2, 3, 4)] + [(5, None), (6, "none")], "task_id long, answer string")
    asked = spark.createDataFrame([(1, "a", 7), (2, "a", 7), (2, "c", 8), (2, "a", 9), (3, None, 7), (4, "", 7), (4, "b", 7), (5, "a", 7), (6, "a", 7), (None, "a", 7)], "task_id long, code string, more int")
    got = {(r["task_id"], r["code"], r["more"]): r["answer"] for r in C.split_combined(answers, asked).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(1, "a", 7): '{"x": 1}', (2, "a", 7): '{"code": "a", "x": 2}', (2, "a", 9): '{"code": "a", "x": 2}', (4, "", 7): '{"x": 1}', (4, "b", 7): '{"code": "b"}'}
    assert len(got) == 10


def test_groups_of_checks_are_dealt_by_task_once(spark, sf_dir):
    got = catalogue.QUERIES["op_check_groups"](spark, sf_dir)
    assert shuffles(got) <= 3  # checks, images and notes
    assert spark_rows(got) == oracle_rows(catalogue.ORACLE_SQL["op_check_groups"], sf_dir)


def test_images_fill_batches_by_their_number(spark):
    checks = spark.createDataFrame([(1, "p", 1), (2, "p", 1), (3, "p", 1), (None, "p", 1)], "task_id int, code string, place int")
    images = spark.createDataFrame([(1, "page", k, "image/png" if k % 2 else "text/plain") for k in range(10)] + [(2, "other", 1, "image/png"), (3, None, 1, "image/png")], "task_id int, source string, place int, mime_type string")
    meta = spark.createDataFrame([], "task_id int, total_pages int, selected_pages int, omitted_pages int, image_error string")
    got = {r["task_id"]: (r["source"], r["checkable"], r["skipped"], r["batches"]) for r in CO.check_groups(checks, images, meta, batch=4).collect()}
    assert got == {1: ("page", 5, 5, 2), 2: (None, 0, 0, 0), 3: (None, 0, 0, 0)}


def test_answers_are_summed_up_by_task_alone(spark, sf_dir):
    got = catalogue.QUERIES["op_issue_summary"](spark, sf_dir)
    assert shuffles(got) <= 3  # answers, how many there are, and findings with notes
    assert spark_rows(got) == oracle_rows(catalogue.ORACLE_SQL["op_issue_summary"], sf_dir)


def test_lines_of_an_answer_keep_their_sections(spark):
    said = "x\n明确问题\n" + "页面正常\n" * 3000 + "- 标题缺失\n未发现问题\n- 图片错误\n**需人工确认：看一下**\n- 随便\n- 图片清晰"
    batches = spark.createDataFrame([(1, 1, said, "a"), (1, 2, "# 图片错误\n图片模糊\n正常", None), (2, 1, None, "b")], "task_id int, batch int, content string, label string")
    got = sorted((r["task_id"], r["batch"], r["at"], r["kind"], r["line"], r["label"]) for r in CO.summary_lines(batches).collect())
    assert got == [(1, 1, 3002, "issue", "标题缺失", "a"), (1, 1, 3005, "manual", "看一下", "a"), (1, 1, 3006, "manual", "随便", "a"), (1, 2, 1, "issue", "图片模糊", None)]


def test_files_are_dealt_by_their_names_once(spark, sf_dir):
    got = catalogue.QUERIES["op_unique_names"](spark, sf_dir)
    assert shuffles(got) <= 2  # one, which both kinds of groups read
    assert spark_rows(got) == oracle_rows(catalogue.ORACLE_SQL["op_unique_names"], sf_dir)


def test_a_name_that_repeats_too_often_stops_before_it_is_walked(spark):
    files = spark.range(1002).select(F.lit(1).alias("t"), "id", F.when(F.col("id") == 0, "a-b.txt").when(F.col("id") == 1, "a-2.txt").otherwise("a.txt").alias("name"))
    with pytest.raises(Exception, match="more than 999 files of the name a.txt"):
        CO.unique_names(files, ["t"], "id", "name").count()
    fine = {r["id"]: r["unique_name"] for r in CO.unique_names(files.filter("id < 1000"), ["t"], "id", "name").collect()}
    assert len(set(fine.values())) == 1000 and (fine[1], fine[2], fine[3], fine[999]) == ("a-2.txt", "a.txt", "a-3.txt", "a-999.txt")


def test_merged_items_keep_their_texts_and_words(spark):
    """As written in the first item, whatever the group's key and the vocabulary make of them."""
    fields = "task_id long, code string, idx long, type string, category string, location string, excerpt string, description string, impact string, suggestion string, severity string, confidence string, more string"
    rows = [(1, "c", 2, " issue", None, "p2", "", "a  b", None, "", "odd", None, "y"), (1, "c", 1, "issue ", "", "p1", "", " a b", "", "", None, "high", "x"), (1, "c", 3, "issue", "", "p3", "", "", "", None, "", "sure", "z"), (1, "c", 4, "issue", "k", " p4", "", "d", "", "", "low", "low", None)]
    got = {r["idx"]: r for r in R.deduplicate(spark.createDataFrame(rows, fields)).collect()}
    assert {k: (r["type"], r["category"], r["description"], r["impact"], r["suggestion"], r["location"], r["severity"], r["confidence"], r["merged"], r["more"]) for k, r in got.items()} == {
        1: ("issue ", "", " a b", "", "", "p1；p2", None, "high", 2, "x"), 3: ("issue", "", "", "", None, "p3", "", "sure", 1, "z"), 4: ("issue", "k", "d", "", "", "p4", "low", "low", 1, None),
    }


def test_merging_shuffles_a_text_once(spark, sf_dir):
    plan = catalogue.QUERIES["op_item_dedupe"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(idx, idx#" in plan and ", type, type#" not in plan
