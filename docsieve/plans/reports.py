"""Registered queries of answers, rule tables, task changes and composed texts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import answers as A
from docsieve.operators import combined as C
from docsieve.operators import lifecycle as L
from docsieve.operators import report as R
from docsieve.operators import rule_tables as RT
from docsieve.plans.catalogue import ITEMS_SQL, TASKS_SQL, query
from docsieve.sources.tables import decoded, items, read, tasks
from docsieve.streaming import frames


# ---------------------------------------------------------------- answers


ANSWER_SQL = """a AS (SELECT l_orderkey AS task_id, 'c' || CAST(l_linenumber AS VARCHAR) AS code,
    CASE l_returnflag WHEN 'R' THEN 'issue' WHEN 'A' THEN 'suggestion' ELSE 'non_issue' END AS type,
    CASE WHEN l_tax < 0.03 THEN 'high' ELSE 'low' END AS severity, 'page ' || CAST(l_partkey AS VARCHAR) AS location, 'part ' || CAST(l_suppkey AS VARCHAR) AS description FROM lineitem)"""


@query(f"""WITH {ANSWER_SQL} SELECT task_id, code, CAST(1 AS INTEGER) AS idx, type, severity, location, description,
    substr(sha1(code || chr(10) || '1' || chr(10) || '严重程度：' || CASE severity WHEN 'high' THEN '高' ELSE '低' END || chr(10) || '位置：' || location || chr(10) || '问题描述：' || description), 1, 16) AS id FROM a""")
def op_json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as an answer in one of six forms: plain, fenced, in prose, encoded twice, with two statuses, cut off."""
    li = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "issue").when(F.col("l_returnflag") == "A", "suggestion").otherwise("non_issue")
    level = F.when(F.col("l_tax") < 0.03, "serious").otherwise("minor")
    level = F.when(level == "serious", "严重").otherwise("minor")
    item = F.to_json(F.struct(kind.alias("status"), level.alias("priority"), F.concat(F.lit("page "), F.col("l_partkey").cast("string")).alias("where"), F.concat(F.lit("part "), F.col("l_suppkey").cast("string")).alias("finding")))
    whole = F.concat(F.lit('{"summary":"s","findings":['), item, F.lit("]}"))
    form = F.col("l_linenumber") % 6
    answer = (
        F.when(form == 0, whole)
        .when(form == 1, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\nDone.")))
        .when(form == 2, F.concat(F.lit("The answer is "), whole, F.lit(" as asked.")))
        .when(form == 3, F.get_json_object(F.to_json(F.struct(F.to_json(F.struct(whole.alias("v"))).alias("x"))), "$.x"))
        .when(form == 4, F.regexp_replace(whole, '"status":"', '"status":"suggestion":"'))
        .otherwise(F.concat(F.lit('{"summary":"s","items":['), item, F.lit(',{"status":"issue","finding":"cut')))
    )
    answer = F.when(form == 3, F.get_json_object(answer, "$.v")).otherwise(answer)
    results = li.select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("code"), A.reports(answer).alias("report"), answer.alias("result"))
    return R.report_items(results).select("task_id", "code", "idx", "type", "severity", "location", "description", "id")


@query("""SELECT o_orderkey AS task_id, CAST(k + 1 AS INTEGER) AS idx, 'sec ' || CAST(o_custkey AS VARCHAR) || '.' || CAST(k AS VARCHAR) AS location, 'value ' || CAST(k AS VARCHAR) || ' is wrong' AS description,
    CASE k WHEN 0 THEN '改正；再查' ELSE '' END AS suggestion, CASE k WHEN 0 THEN 'issue' ELSE 'suggestion' END AS type FROM orders, range(2) t(k)""")
def op_legacy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a plain report of two findings, a heading before them and one after."""
    o, who = read(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    said = F.concat(
        F.lit("总体判断\n一句话\n1. 位置：sec "), who, F.lit(".0\n问题描述：value 0 is wrong\n修改建议：改正\n- 修改建议：改正\n修改建议：再查\n"),
        F.lit("2. 位置：sec "), who, F.lit(".1\n   - value 1 is wrong\n检查汇总\n完"),
    )
    results = o.select(F.col("o_orderkey").alias("task_id"), F.lit("c").alias("code"), A.reports(said).alias("report"), said.alias("result"))
    return R.report_items(results).select("task_id", "idx", "location", "description", "suggestion", "type")


MARKS = ("未发现问题", "参数不一致", "疑似缺图", "建议统一名称", "页面正常", "内容可能有误", "图片模糊", "普通说明")
MARKS_SQL = "marks(k, mark) AS (VALUES (0, '未发现问题'), (1, '参数不一致'), (2, '疑似缺图'), (3, '建议统一名称'), (4, '页面正常'), (5, '内容可能有误'), (6, '图片模糊'), (7, '普通说明'))"


@query(f"""WITH {MARKS_SQL} SELECT o_orderkey AS task_id, CASE k WHEN 0 THEN 'non_issue' WHEN 1 THEN 'issue' ELSE 'suggestion' END AS type,
    CASE k WHEN 0 THEN 'negative' WHEN 1 THEN 'issue' WHEN 2 THEN 'manual' WHEN 4 THEN 'normal' WHEN 5 THEN 'manual' WHEN 6 THEN 'issue' ELSE 'other' END AS line_kind FROM orders JOIN marks ON k = o_orderkey % 8""")
def op_text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.try_element_at(F.array(*[F.lit(m) for m in MARKS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    said = F.concat(F.lit("第 "), F.col("o_orderkey").cast("string"), F.lit(" 项 "), mark)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), A.inferred_type(said).alias("type"), A.summary_kind(said).alias("line_kind"))


@query("""WITH asked AS (SELECT o_orderkey AS task_id, 'c' || CAST(k AS VARCHAR) AS code FROM orders, range(1, 5) t(k)),
    got AS (SELECT l_orderkey AS task_id, 'c' || CAST(l_linenumber AS VARCHAR) AS code, min(l_partkey) AS part FROM lineitem GROUP BY ALL)
    SELECT asked.task_id, asked.code, CASE WHEN part IS NULL THEN 'no answer' ELSE CAST(part AS VARCHAR) END AS answer FROM asked LEFT JOIN got USING (task_id, code)""")
def op_combined_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines are one answer's parts, with a part of an unknown code and a second part of each code; four codes are asked."""
    # both tables are dealt by order once: the sums, the unfolded codes and the join below need no shuffle of their own
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), "l_linenumber", "l_partkey").repartition("task_id")
    li = li.groupBy("task_id", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    part = F.to_json(F.struct(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("code"), F.col("l_partkey").alias("part")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", part.alias("p")))), lambda x: x["p"]), ",")
    again = F.regexp_replace(parts, '"part":', '"part":9')
    answers = li.groupBy("task_id").agg(F.concat(F.lit('Answer: {"results":[{"code":"other"},'), parts, F.lit(","), again, F.lit("]}")).alias("answer"))
    tasks_asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id")).repartition("task_id")
    asked = tasks_asked.select("task_id", F.explode(F.array(*[F.lit(f"c{k}") for k in range(1, 5)])).alias("code"))
    first = C.split_combined(answers, asked).withColumn("answer", F.get_json_object("answer", "$.part"))
    return C.with_placeholders(first, first.limit(0), F.lit("no answer"))


@query(f"""WITH {ITEMS_SQL}, g AS (SELECT DISTINCT task_id, code, type, category, description FROM items)
    SELECT task_id, code, count(*) FILTER (type = 'issue') AS issue, count(*) AS total, CASE WHEN count(*) <= 0 THEN '-' ELSE printf('%.1f', count(*) FILTER (type = 'issue') / count(*) * 100) || '%' END AS issue_detection_rate FROM g GROUP BY task_id, code""")
def op_report_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge, rank, limit and count, as a report is shown."""
    shown = R.limit_items(R.rank_items(R.deduplicate(items(spark, sf_dir).withColumn("acceptance", F.lit("pending")))))
    return R.with_rates(R.counts(shown)).select("task_id", "code", "issue", "total", "issue_detection_rate")


@query(f"""WITH {ITEMS_SQL}, g AS (SELECT task_id, type, category, description, code, count(*) AS n FROM items GROUP BY ALL), c AS (SELECT task_id, code, sum(n) AS original_count, count(*) AS kept FROM g GROUP BY task_id, code)
    SELECT task_id, code, CAST(original_count AS BIGINT) AS original_count, CAST(original_count - kept AS BIGINT) AS duplicate_count, least(kept, 1) AS displayed_count, kept - least(kept, 1) AS omitted_count FROM c WHERE original_count > kept OR kept > 1""")
def op_limit_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limit_note(R.deduplicate(items(spark, sf_dir)), limit=1).select("task_id", "code", "original_count", "duplicate_count", "displayed_count", "omitted_count")


@query(f"""WITH {ITEMS_SQL}, f AS (SELECT code, description, min(task_id * 1000000000 + idx) AS at FROM items WHERE type = 'non_issue' AND acceptance = 'rejected' GROUP BY code, description)
    SELECT code AS check_code, description, sha256('{{"check_code":"' || code || '","description":"' || description || '","task_type":"document"}}') AS fingerprint, 'false_positive' AS reason, false AS enabled FROM f""")
def op_rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir).withColumns({"task_type": F.lit("document"), "text": F.lit(""), "rejection_reason": F.lit("false_positive")})
    return R.rule_candidates(found).select("check_code", "description", "fingerprint", "reason", "enabled")


# ---------------------------------------------------------------- rule tables


@query("""WITH r AS (SELECT p_partkey AS n, 'std' || CAST(p_partkey % 40 AS VARCHAR) AS standard, CASE p_partkey % 3 WHEN 0 THEN 'zh' ELSE 'all' END AS language_scope, 's' || CAST(p_partkey % 2 AS VARCHAR) AS sheet, 'bad' || CAST(p_partkey % 100 AS VARCHAR) AS term FROM part),
    t AS (SELECT standard, language_scope, term, min(sheet || lpad(CAST(n AS VARCHAR), 9, '0')) AS pos FROM r GROUP BY ALL)
    SELECT standard, language_scope, string_agg(term, ',' ORDER BY pos) AS discouraged FROM t GROUP BY standard, language_scope""")
def op_rule_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rule rows of two sheets with notes above the header, placeholders and repeated terms in the cells."""
    p, n = read(spark, sf_dir, "part"), F.col("p_partkey")
    scope = F.when(n % 3 == 0, "简体中文").when(n % 3 == 1, " ALL ").otherwise("")
    term = F.concat(F.lit("bad"), (n % 100).cast("string"))
    rows = p.select(F.concat(F.lit("s"), (n % 2).cast("string")).alias("sheet"), (n + 10).cast("long").alias("row_number"), F.array(F.concat(F.lit("std"), (n % 40).cast("string")), F.concat(term, F.lit("；n/a、"), term, F.lit("，-")), scope).alias("cells"))
    heads = spark.createDataFrame([(s, k, c) for s in ("s0", "s1") for k, c in ((1, ["notes", "", ""]), (2, ["常用词", "note", ""]), (3, [" 正确写法：", "常见错误（不推荐用法）", "适用语种"]))], "sheet string, row_number long, cells array<string>")
    return RT.united(RT.rules_of(heads.unionByName(rows))).select("standard", "language_scope", F.array_join("discouraged", ",").alias("discouraged"))


# ---------------------------------------------------------------- task changes


@query(f"""WITH {TASKS_SQL}, u AS (SELECT l_orderkey AS task_id, max(CAST(l_quantity AS INTEGER) * 2) FILTER (l_linenumber % 2 = 1) AS own, max(CAST(l_quantity AS INTEGER) * 2) FILTER (l_linenumber % 3 = 0 AND l_linenumber % 2 = 0) AS free FROM lineitem GROUP BY l_orderkey)
    SELECT tasks.task_id, status, CASE WHEN status = 'running' THEN greatest(40, coalesce(own, 0), coalesce(free, 0)) ELSE 40 END AS progress FROM tasks LEFT JOIN u USING (task_id)""")
def op_progress_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select("task_id", "status", F.lit("t1").alias("claim_token"), F.lit(40).alias("progress"))
    n = F.col("l_linenumber")
    token = F.when(n % 2 == 1, "t1").when(n % 3 == 0, F.lit(None).cast("string")).otherwise("stale")
    updates = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_quantity").cast("int") * 2).alias("progress"), token.alias("claim_token"))
    return L.apply_progress(t, updates).select("task_id", "status", "progress")


@query(f"""WITH {TASKS_SQL} SELECT task_id, CASE WHEN status = 'running' AND task_id % 3 <> 0 THEN CASE WHEN task_id % 5 = 0 THEN 'canceled' WHEN task_id % 2 = 0 THEN 'failed' ELSE 'completed' END ELSE status END AS status, (status = 'running' AND task_id % 3 <> 0) AS ended FROM tasks""")
def op_finish_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select("task_id", "status", F.lit("t1").alias("claim_token"), (F.col("task_id") % 5 == 0).alias("cancel_requested"), F.lit(None).cast("string").alias("finished_at"))
    ends = t.select("task_id", F.when(F.col("task_id") % 2 == 0, "failed").otherwise("completed").alias("end_status"), F.when(F.col("task_id") % 3 == 0, "stale").when(F.col("task_id") % 3 == 1, "t1").alias("claim_token"), F.lit("now").alias("ended_at"))
    return L.finish(t, ends).select("task_id", "status", F.col("finished_at").isNotNull().alias("ended"))


BULK = ["7", "x", 1, 2, 3, "3", -4, 5, 6, 32, 33, 34]


@query(f"WITH {TASKS_SQL} SELECT task_id, CASE status WHEN 'completed' THEN 'deleted' ELSE 'skipped' END AS outcome FROM tasks WHERE task_id IN (7, 1, 2, 3, 5, 6, 32, 33, 34)")
def op_bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir)
    return L.bulk_delete(t, BULK, t.select("task_id"))[2]


@query(f"WITH {TASKS_SQL} SELECT l_orderkey AS task_id, count(*) AS hits FROM lineitem WHERE l_orderkey NOT IN (SELECT task_id FROM tasks WHERE status = 'completed' AND task_id IN (7, 1, 2, 3, 5, 6, 32, 33, 34)) GROUP BY l_orderkey")
def op_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"))
    return L.bulk_delete(tasks(spark, sf_dir), BULK, hits)[1].groupBy("task_id").agg(F.count(F.lit(1)).alias("hits"))


@query(f"WITH {TASKS_SQL} SELECT task_id, CASE WHEN status = 'completed' AND task_id % 2 = 0 THEN NULL ELSE owner END AS document_text, CASE WHEN status = 'completed' AND task_id % 2 = 0 THEN 'now' END AS cleaned_at FROM tasks")
def op_clean_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select("task_id", "status", F.col("owner").alias("document_text"), F.lit(None).cast("string").alias("cleaned_at"))
    return L.clean_expired(t, t.filter("status = 'completed' and task_id % 2 = 0"), F.lit("now")).select("task_id", "document_text", "cleaned_at")


@query("SELECT o_orderkey AS task_id, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') + 1 AS INTEGER) AS days, CAST(o_orderdate AS DATE) - 6 AS last_7, CAST(o_orderdate AS DATE) - 29 AS last_30, CAST(date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS TIMESTAMP) AS until, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp, o_orderdate + INTERVAL 90 SECOND AS deadline FROM orders")
def op_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, day = read(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    r = L.day_range(day, F.lit("1999-01-01").cast("date"))
    last = L.day_range(day, day)
    return o.select(F.col("o_orderkey").alias("task_id"), r["days"].alias("days"), last["last_7"].alias("last_7"), last["last_30"].alias("last_30"), last["to"].alias("until"), L.file_stamp(F.col("o_orderdate")).alias("stamp"), L.lease_deadline(F.col("o_orderdate")).alias("deadline"))


@query(f"""WITH {TASKS_SQL} SELECT l_orderkey AS task_id, status, count(*) AS files, CAST(sum(l_partkey) AS BIGINT) AS bytes, status = 'completed' AS cleanable FROM lineitem JOIN tasks ON task_id = l_orderkey GROUP BY l_orderkey, status""")
def op_storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").cast("long").alias("bytes"))
    return L.usage(files, tasks(spark, sf_dir))


@query("""WITH r AS (SELECT l_orderkey AS task_id, 'check_' || CAST(l_suppkey % 5 AS VARCHAR) AS code, CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS done, CAST(l_partkey AS VARCHAR) AS result FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY task_id, code ORDER BY done DESC, result DESC) AS k FROM r)
    SELECT task_id, code, result, CAST(100 - CAST(right(code, 1) AS INTEGER) AS INTEGER) AS sort_order FROM b WHERE k = 1""")
def op_check_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = items(spark, sf_dir).select("task_id", "code", F.when(F.col("acceptance") == "accepted", "completed").otherwise("partial").alias("state"), F.regexp_replace("location", "^p", "").alias("result"))
    checks = spark.range(5).select(F.concat(F.lit("check_"), F.col("id").cast("string")).alias("code"), (100 - F.col("id")).cast("int").alias("sort_order"), "id")
    return L.in_check_order(results, checks).select("task_id", "code", "result", "sort_order")


# ---------------------------------------------------------------- what comes in


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'checkable' WHEN 1 THEN 'skipped: no type' ELSE 'skipped: video/mp4' END AS media, page_id % 5 = 0 AS safe, length(html) > 4000 AS too_long,
    'file: ' || CAST(page_id AS VARCHAR) || '.html' || chr(10) || chr(10) || url AS said, to_base64(encode(url)) AS coded, md5(url) AS decoded FROM pages""")
def op_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = read(spark, sf_dir, "pages"), F.col("page_id")
    mime = F.when(n % 4 == 0, "image/png").when(n % 4 == 1, "").otherwise("video/mp4")
    path = F.when(n % 5 == 0, "a/b..c/d.png").when(n % 5 == 1, "/etc/x").when(n % 5 == 2, "a/../../x").when(n % 5 == 3, "C:\\x").otherwise("..")
    name = F.concat(F.lit("../up\\"), n.cast("string"), F.lit(".html"))
    coded = F.base64(F.encode("url", "UTF-8"))
    coded = F.regexp_replace(coded, "\\r\\n", "")
    return p.select("page_id", L.media_status(mime).alias("media"), L.safe_path(path).alias("safe"), L.too_long(F.col("html"), 4000).alias("too_long"), L.document_text(name, F.concat(F.lit("  "), F.col("url"), F.lit("\n"))).alias("said"), coded.alias("coded"), F.md5(F.try_to_binary(coded, F.lit("base64"))).alias("decoded"))


@query("""WITH l AS (SELECT l_orderkey AS task_id, list(CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS v FROM lineitem GROUP BY l_orderkey),
    d AS (SELECT task_id, v, list_filter(v, lambda x, i: list_position(v, x) = i)[1:3] AS first_three FROM l)
    SELECT task_id, array_to_string(first_three, ',') AS first_three, CASE WHEN v[1] = v[-1] THEN v[1] ELSE v[1] || '-' || v[-1] END AS label, array_to_string(v[1:2], '、') || CASE WHEN len(v) > 2 THEN ' 等 ' || CAST(len(v) AS VARCHAR) || ' 个' ELSE '' END AS title FROM d""")
def op_short_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").cast("string").alias("s")))).alias("r"))
    v = F.transform("r", lambda x: x["s"])
    return rows.select("task_id", F.array_join(L.first_distinct(v, 3), ",").alias("first_three"), L.span_label(v).alias("label"), L.group_title(F.array(v)).alias("title"))


@query("""SELECT o_orderkey AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 'a=accepted' WHEN 1 THEN 'a=accepted,b=rejected' ELSE 'a=rejected' END AS reviews FROM orders""")
def op_review_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    held = F.create_map(F.lit("a"), F.lit("accepted"))
    out = L.put(held, F.when(n == 1, "b").when(n == 2, "a").otherwise("z"), F.when(n == 0, "pending").otherwise("rejected"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.array_join(F.array_sort(F.transform(F.map_entries(out), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("reviews"))


@query("""WITH s AS (SELECT l_orderkey AS task_id, l_linenumber AS page, 'text of ' || CAST(l_partkey AS VARCHAR) AS said, l_returnflag = 'R' AS image FROM lineitem),
    near AS (SELECT a.task_id, a.page, a.said FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.task_id = a.task_id AND b.image AND abs(b.page - a.page) <= 1))
    SELECT task_id, string_agg('[第' || CAST(page AS VARCHAR) || '页]' || chr(10) || said, chr(10) || chr(10) ORDER BY page, said) AS body FROM near GROUP BY task_id""")
def op_page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the pages of an order's text; returned ones carry an image."""
    n = F.col("l_linenumber")
    page = F.concat(F.lit("[第"), n.cast("string"), F.lit("页]\ntext of "), F.col("l_partkey").cast("string"))
    docs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), page.alias("p")))).alias("r"), F.collect_list(F.when(F.col("l_returnflag") == "R", n.cast("int"))).alias("images"))
    text = F.concat(F.lit("file: a.pdf\n\n"), F.array_join(F.transform("r", lambda x: x["p"]), "\n\n"))
    said = C.page_context(text, F.col("images"), F.array(F.lit("- x")))
    return docs.filter(F.size("images") > 0).select("task_id", F.substring_index(said, "相关文档文本：\n", -1).alias("body"))


@query("""SELECT l_orderkey AS task_id, string_agg('## lines ' || CAST(l_linenumber AS VARCHAR) || '：n' || CAST(l_suppkey AS VARCHAR) || chr(10) || l_linestatus, chr(10) || chr(10) ORDER BY l_linenumber, 'n' || CAST(l_suppkey AS VARCHAR) || chr(10) || l_linestatus) AS text
    FROM lineitem GROUP BY l_orderkey""")
def op_group_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.lit("lines").alias("group"), F.col("l_linenumber").alias("place"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_linestatus").alias("text"))
    return C.group_text(li, ["task_id"]).select("task_id", F.regexp_replace("text", "^# lines\\n\\n", "").alias("text"))


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT DISTINCT code, CAST(idx AS VARCHAR) AS item_id FROM items WHERE task_id <> 2), r AS (SELECT task_id, code, CAST(idx AS VARCHAR) AS item_id, idx FROM items), n AS (SELECT code, item_id, count(*) AS times FROM r GROUP BY ALL)
    SELECT r.task_id, r.code, r.item_id, CASE WHEN r.task_id % 11 = 0 THEN 'other task' WHEN k.item_id IS NULL THEN 'unknown item' WHEN times > 1 THEN 'item named twice' WHEN idx % 7 = 0 THEN 'unknown type' WHEN idx % 5 = 0 THEN 'unknown acceptance' WHEN idx % 3 = 0 THEN 'no reason' END AS problem
    FROM r LEFT JOIN k USING (code, item_id) JOIN n USING (code, item_id)""")
def op_review_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    i = F.col("idx")
    rows = it.select("task_id", "code", i.cast("string").alias("item_id"), F.when(i % 7 == 0, "?").when(i % 2 == 0, "问题").otherwise("suggestion").alias("item_type"), F.when(i % 5 == 0, "maybe").when(i % 3 == 0, "rejected").otherwise("accepted").alias("acceptance"), F.lit("").alias("rejection_reason"), F.lit("").alias("rejection_note"))
    known = it.filter("task_id <> 2").select("code", i.cast("string").alias("item_id"))
    task = F.when(F.col("task_id") % 11 == 0, F.lit(-1)).otherwise(F.col("task_id"))
    return C.checked_import(rows, known, task).select("task_id", "code", "item_id", "problem")


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT o_orderkey AS task_id, 'check_' || CAST(k AS VARCHAR) AS code FROM orders, range(2) t(k))
    SELECT r.task_id, r.code, idx, coalesce(type, '未拆分') AS type FROM r LEFT JOIN items USING (task_id, code)""")
def op_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.explode(F.array(F.lit("check_0"), F.lit("check_1"))).alias("code"))
    return C.export_rows(results, items(spark, sf_dir)).select("task_id", "code", "idx", "type")


@query("SELECT c_mktsegment AS task_type, CAST(min(c_custkey) - 10 AS BIGINT) AS sort_order FROM customer GROUP BY c_mktsegment")
def op_first_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("task_type"), F.col("c_custkey").cast("long").alias("sort_order"))
    return L.first_sort_order(checks)


@query("SELECT r_name AS provider, string_agg(n_name, ',' ORDER BY n_nationkey) AS models FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def op_provider_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider with its models in order, by one join instead of a query for each."""
    both = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.groupBy(F.col("r_name").alias("provider")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return rows.select("provider", F.array_join(F.transform("r", lambda x: x["n_name"]), ",").alias("models"))


@query("SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE c_name END AS name, c_mktsegment AS prompt FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def op_snapshot_or_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("code"), F.when(F.col("o_orderkey") % 2 == 0, "own").alias("name"), F.lit(None).cast("string").alias("prompt"))
    live = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("prompt"))
    return L.snapshot_or_live(t, live).select("task_id", "name", "prompt")


# ---------------------------------------------------------------- answer streams, files


@query("""WITH l AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN 'bad' WHEN conv_id % 5 = 0 AND turn >= 4 THEN 'done' WHEN role = 'system' THEN 'none' ELSE 'data' END AS kind FROM conversations),
    s AS (SELECT *, coalesce(bool_or(kind <> 'data') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM l WHERE kind <> 'none'),
    d AS (SELECT *, kind = 'data' AND role = 'assistant' AND text <> '' AS says, kind = 'data' AND role = 'user' AND text <> '' AS thinks FROM s WHERE NOT ended),
    g AS (SELECT conv_id AS request_id, count(*) FILTER (kind = 'data') AS frames, bool_or(kind = 'done') AS done, count(*) FILTER (says) AS content_chunks, CAST(coalesce(sum(length(text)) FILTER (says), 0) AS BIGINT) AS content_chars,
      count(*) FILTER (thinks) AS reasoning_chunks, CAST(coalesce(sum(length(text)) FILTER (thinks), 0) AS BIGINT) AS reasoning_chars, bool_or(kind = 'bad') AS bad, trim(coalesce(string_agg(text, '' ORDER BY turn) FILTER (says), ''), chr(10) || ' ') AS answer FROM d GROUP BY conv_id)
    SELECT request_id, frames, done, content_chunks, content_chars, reasoning_chunks, reasoning_chars, md5(answer) AS answer, CASE WHEN bad THEN 'bad' WHEN answer <> '' THEN 'ok' WHEN reasoning_chunks > 0 THEN 'reasoning only' ELSE 'empty' END AS outcome FROM g""")
def op_stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answer streams: what users say is reasoning, what assistants say is content."""
    c = read(spark, sf_dir, "conversations")

    def told(field: str):
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias(field)).alias("delta"))).alias("choices"))))

    line = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 2), "data: {cut").when((F.col("conv_id") % 5 == 0) & (F.col("turn") >= 4), "data: [DONE]")
    line = line.when(F.col("role") == "system", ": keep").when(F.col("role") == "user", told("reasoning_content")).otherwise(told("content"))
    stats = frames.chunk_statistics(frames.read_frames(c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), line.alias("line"))))
    return stats.select("request_id", "frames", "done", "content_chunks", "content_chars", "reasoning_chunks", "reasoning_chars", F.md5("answer").alias("answer"), "outcome")


@query("SELECT doc_id, md5(text) AS text FROM documents")
def op_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(decoded(F.encode("text", "UTF-8"))).alias("text"))
