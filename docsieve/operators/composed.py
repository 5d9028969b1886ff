"""Groups of checks with the images they look at, answers put back into text, imported reviews matched to items, and names
that do not collide. All of it is per task; what is gathered is bounded by a task's checks, batches and files."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import answers as A
from docsieve.functions import text as X
from docsieve.operators.ordered import numbered

LINES, LINE_LENGTH, GROUP_SIZE, NAMES = 30, 240, 3, 999
# The checks that look at extracted images; all others look at pages.
RESOURCE_CODES = ("image-small-language-text", "image-device-installation", "image-wiring", "image-drawing-standard")
# Notes of a group, headings and stock lines of composed texts, names of sections.
FALLBACK_NOTE = "当前检查对象缺少首选图片源，已回退使用另一类 PDF 图像；细节判断需要人工确认。"
OMITTED_NOTE = ("PDF 共 ", " 页，本次页面级检查按长文档策略选取 ", " 页，未覆盖 ", " 页；未覆盖页需要人工抽查或调高 image_page_check_max_pages 后重跑。")
ERROR_NOTE = "PDF 内嵌图片提取异常，图片资源类检查可能未覆盖全部原始图片："
NO_ISSUE, NO_MANUAL, NO_NORMAL, SOME_ISSUE = "未发现明确问题。", "未发现需人工确认项。", "未单独列出正常项。", "发现明确问题。"
SECTIONS = {"总体判断": "总体判断", "明确问题": "明确问题", "发现问题": "明确问题", "发现明确问题": "明确问题", "明确冲突": "明确问题", "需人工确认": "需人工确认", "需要人工确认": "需人工确认", "未发现问题": "未发现问题"}


# -- checks and their sources -----------------------------------------------------------------------------------------


def target_of(code: Column) -> Column:
    """page or resource."""
    return F.when(code.isin(*RESOURCE_CODES), "resource").otherwise("page")


def _targets(checks: DataFrame, images: DataFrame) -> DataFrame:
    """task_id, target, source: where the checks of a target get their images, null if the task has none."""
    wanted = checks.select("task_id", target_of(F.col("code")).alias("target")).distinct()
    has = images.groupBy("task_id").agg(F.bool_or(F.col("source") == "page").alias("_page"), F.bool_or(F.col("source") == "resource").alias("_resource"))
    first = F.col("target")
    own = F.when(first == "page", F.col("_page")).otherwise(F.col("_resource"))
    other = F.when(first == "page", F.col("_resource")).otherwise(F.col("_page"))
    return wanted.join(has, "task_id", "left").select("task_id", "target", F.when(own, first).when(other, F.when(first == "page", "resource").otherwise("page")).alias("source"))


def image_batches(checks: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """task_id, target, source, place, image_index, batch: each image of the source that a target uses. Images count from 1;
    those that are none by their type have no batch and are skipped."""
    used = images.join(_targets(checks, images), ["task_id", "source"])
    counted = numbered(used, ["task_id", "target"], ["place"], "image_index")
    good = F.coalesce(F.col("mime_type"), F.lit("")).startswith("image/")
    kept = numbered(counted.filter(good), ["task_id", "target"], ["place"], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")
    columns = ["task_id", "target", "source", "place", "image_index", "batch"]
    return kept.select(columns).unionByName(counted.filter(~good).withColumn("batch", F.lit(None).cast("long")).select(columns))


def check_groups(checks: DataFrame, images: DataFrame, meta: DataFrame, size: int = GROUP_SIZE, batch: int = 4) -> DataFrame:
    """Groups of at most ``size`` checks of one target, with their source (the own one, else the other one, else none), the
    numbers of images and batches, and the notes that a person has to read. ``checks``: task_id, code, place; ``images``:
    task_id, source, place, mime_type; ``meta``: task_id, total_pages, selected_pages, omitted_pages, image_error."""
    # A task's checks are dealt by task once, and are no more than there are checks; its images, which may be many, are counted.
    dealt = checks.select("task_id", "place", "code", target_of(F.col("code")).alias("target")).repartition("task_id")
    place = F.row_number().over(Window.partitionBy("task_id", "target").orderBy("place", "code"))
    grouped = dealt.withColumn("_n", place).withColumn("group", F.floor((F.col("_n") - 1) / size).cast("long"))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("_n", "code"))), lambda x: x["code"])
    grouped = grouped.groupBy("task_id", "target", "group").agg(codes.alias("codes"))
    good = F.coalesce(F.col("mime_type"), F.lit("")).startswith("image/")
    per = {f"_{s}_{name}": F.count_if((F.col("source") == s) & which) for s in ("page", "resource") for name, which in (("checkable", good), ("skipped", ~good))}
    out = grouped.filter("task_id is not null").join(images.groupBy("task_id").agg(*[c.alias(k) for k, c in per.items()]), "task_id", "left").join(meta.dropDuplicates(["task_id"]), "task_id", "left")
    has = {s: F.coalesce(F.col(f"_{s}_checkable") + F.col(f"_{s}_skipped"), F.lit(0)) > 0 for s in ("page", "resource")}
    first = F.col("target")
    own = F.when(first == "page", has["page"]).otherwise(has["resource"])
    other = F.when(first == "page", has["resource"]).otherwise(has["page"])
    out = out.withColumn("source", F.when(own, first).when(other, F.when(first == "page", "resource").otherwise("page")))
    out = out.withColumns({name: F.when(F.col("source") == "page", F.col(f"_page_{name}")).when(F.col("source") == "resource", F.col(f"_resource_{name}")) for name in ("checkable", "skipped")})
    out = out.withColumn("batches", F.ceil(F.col("checkable") / batch).cast("long"))  # images fill their batches in order
    page, back = F.col("target") == "page", F.col("source") != F.col("target")
    told = [F.lit(OMITTED_NOTE[0]), F.coalesce(F.col("total_pages").cast("string"), F.lit("-")), F.lit(OMITTED_NOTE[1]), F.coalesce(F.col("selected_pages"), F.lit(0)).cast("string"), F.lit(OMITTED_NOTE[2]), F.col("omitted_pages").cast("string"), F.lit(OMITTED_NOTE[3])]
    error = F.trim(X.text_of(F.col("image_error")))
    notes = F.array(F.when(page & (F.col("omitted_pages") > 0), F.concat(*told)), F.when(~page & (error != ""), F.concat(F.lit(ERROR_NOTE), error)), F.when(back, F.lit(FALLBACK_NOTE)))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("checkable", "skipped", "batches")]
    return out.select("task_id", "target", "group", "codes", "source", F.coalesce(back, F.lit(False)).alias("fallback"), *numbers, F.filter(notes, lambda x: x.isNotNull()).alias("notes"))


# -- answers as text --------------------------------------------------------------------------------------------------


def item_line() -> Column:
    """One item as a line: place, what it says, and the details that the line does not hold yet; null without a text."""
    f = {c: F.trim(X.text_of(F.col(c))) for c in ("location", "description", "suggestion", "excerpt", "impact")}
    said = F.coalesce(*[F.nullif(f[c], F.lit("")) for c in ("description", "suggestion", "excerpt")])
    line = F.when(f["location"] != "", F.concat(f["location"], F.lit("："), said)).otherwise(said)
    details = F.array(*[F.when((f[c] != "") & ~F.contains(line, f[c]), F.concat(F.lit(label), f[c])) for c, label in (("excerpt", "证据："), ("impact", "影响："), ("suggestion", "建议："))])
    details = F.filter(details, lambda x: x.isNotNull())
    return F.when(F.size(details) > 0, F.concat(F.rtrim(line, F.lit("；。")), F.lit("；"), F.array_join(details, "；"))).otherwise(line)


def _bullets(lines: Column, none: str) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(f"- {none}"))


def rendered_checks(checks: DataFrame, items: DataFrame) -> DataFrame:
    """task_id, code, body: the answer to each check as text with sections, also where it has no item. ``checks``: task_id,
    code, name, summary; ``items``: task_id, code, idx, status and the text fields. A status other than issue or non_issue
    asks for a person."""
    status = F.lower(F.trim(X.text_of(F.col("status"))))
    kind = F.when(status == "issue", "issue").when(status == "non_issue", "normal").otherwise("manual")
    lines = items.select("task_id", "code", "idx", kind.alias("kind"), item_line().alias("line")).filter("line is not null")
    per = lines.groupBy("task_id", "code").agg(F.array_sort(F.collect_list(F.struct("idx", "line", "kind"))).alias("all"))
    out = checks.join(per, ["task_id", "code"], "left")

    def of(name: str) -> Column:
        return F.coalesce(F.transform(F.filter("all", lambda x: x["kind"] == F.lit(name)), lambda x: x["line"]), F.array().cast("array<string>"))

    summary = F.trim(X.text_of(F.col("summary")))
    summary = F.when(summary != "", summary).when(F.size(of("issue")) > 0, SOME_ISSUE).otherwise(NO_ISSUE)
    body = F.concat(
        F.lit("### 检查项："), X.text_of(F.col("code")), F.lit("｜"), X.text_of(F.col("name")), F.lit("\n\n#### 总体判断\n"), summary, F.lit("\n\n#### 明确问题\n"), _bullets(of("issue"), NO_ISSUE),
        F.lit("\n\n#### 需人工确认\n"), _bullets(of("manual"), NO_MANUAL), F.lit("\n\n#### 未发现问题\n"), _bullets(of("normal"), NO_NORMAL),
    )
    return out.select("task_id", "code", body.alias("body"))


def _normal_line(line: Column) -> Column:
    """Without bullet and number, white space as one blank, LINE_LENGTH characters at most."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(line), "^[-*]\\s*", ""), "^\\d+[.)、]\\s*", ""), "(?U)\\s+", " ")
    return F.trim(F.substring(plain, 1, LINE_LENGTH))


def _telling_lines(content: Column) -> Column:
    """Of an answer's lines those that name a section or may be a finding: at, section, line (what it says), says (its kind),
    loose (what it says where no section counts) and loosely (the kind of that). Each step of a line is computed once."""
    table = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    pair = "^([^:：]*)[:：]\\s*(.+)$"

    def sectioned(head: Column) -> Column:
        def chosen(p: Column) -> Column:
            before = F.when(p["rest"] != "", table[p["title"]])
            return F.struct(F.coalesce(p["alone"], before).alias("section"), F.when(p["alone"].isNull() & before.isNotNull(), p["rest"]).alias("own"))

        parts = F.struct(table[head].alias("alone"), F.trim(F.regexp_extract(head, pair, 1)).alias("title"), F.trim(F.regexp_extract(head, pair, 2)).alias("rest"))
        return X.let(parts, chosen)

    def told(raw: Column, at: Column) -> Column:
        bare = F.trim(raw)
        head = F.btrim(F.regexp_replace(F.regexp_replace(bare, "^#{1,6}\\s*", ""), "^[-*]\\s*", ""), F.lit("*_` \t"))
        head = F.regexp_replace(head, "^\\d+[.)、]\\s*", "")

        def lined(s: Column, line: Column) -> Column:
            loose = F.when(~bare.startswith("#"), F.when(s["section"].isNull(), line).otherwise(_normal_line(bare)))
            kinds = lambda loose, says: F.struct(at.alias("at"), s["section"].alias("section"), line.alias("line"), says.alias("says"), loose.alias("loose"), F.when(loose == line, says).otherwise(A.summary_kind(loose)).alias("loosely"))
            return X.let(loose, lambda loose: X.let(A.summary_kind(line), lambda says: kinds(loose, says)))

        said = lambda s: F.when(s["section"].isNull(), raw).otherwise(s["own"])
        return X.let(X.let(head, sectioned), lambda s: X.let(_normal_line(said(s)), lambda line: lined(s, line)))

    def telling(x: Column) -> Column:
        return x["section"].isNotNull() | ((x["line"] != "") & ~x["says"].isin("negative", "normal")) | ((x["loose"] != "") & x["loosely"].isin("issue", "manual"))

    return F.filter(F.transform(X.lines(content), told), telling)


def summary_lines(batches: DataFrame) -> DataFrame:
    """(task_id, batch, content, …), one row a batch -> task_id, batch, …, at, kind (issue or manual), line: what their answers say.
    A batch whose sections name findings gives those; one without gives the lines of all its text that speak of a finding.
    An answer comes in one row, so its lines are told apart in place, and only those that tell something are unfolded."""
    given = [c for c in batches.columns if c != "content"]
    lines = batches.select(*given, F.inline(_telling_lines(F.col("content"))))
    whole = Window.partitionBy("task_id", "batch")
    under = lines.withColumn("_under", F.last("section", ignorenulls=True).over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    says = F.col("says")
    told = F.when((F.col("_under") == "明确问题") & says.isin("issue", "manual"), says).when((F.col("_under") == "需人工确认") & ~says.isin("negative", "normal"), "manual")
    found = under.withColumn("_kind", F.when(F.col("line") != "", told))
    both = found.withColumn("_named", F.bool_or(F.col("_kind").isNotNull()).over(whole))
    loose = F.when((F.col("loose") != "") & F.col("loosely").isin("issue", "manual"), F.col("loosely"))
    out = both.select(*given, "at", F.when(F.col("_named"), F.col("_kind")).otherwise(loose).alias("kind"), F.when(F.col("_named"), F.col("line")).otherwise(F.col("loose")).alias("line"))
    return out.filter("kind is not null")


def issue_summary(batches: DataFrame, notes: DataFrame) -> DataFrame:
    """task_id, body: the findings of all batches, issues first, then what a person has to confirm, LINES of each at most,
    equal lines once. ``batches``: task_id, batch (from 1), label (pages or times), content; ``notes``: task_id, at, note, at
    the end of the second list. A task with batches always has a body."""
    total = batches.groupBy("task_id").agg(F.max("batch").alias("_of"))
    said = summary_lines(batches.select("task_id", "batch", "label", "content"))
    rows = said.select("task_id", "kind", F.col("batch").cast("long").alias("batch"), F.col("at").cast("long").alias("at"), "label", "line", F.lit(False).alias("_note"))
    more = notes.select("task_id", F.lit("manual").alias("kind"), F.lit(1 << 62).alias("batch"), F.col("at").cast("long").alias("at"), F.lit(None).cast("string").alias("label"), F.trim("note").alias("line"), F.lit(True).alias("_note")).filter("line <> ''")
    # Findings meet their task once; what follows is by task.
    both = total.join(rows.unionByName(more), "task_id", "left")
    label = F.when(F.col("_of") > 1, F.concat(F.lit("批次 "), F.col("batch").cast("string"), F.lit("/"), F.col("_of").cast("string"))).otherwise("批次 1")
    label = F.concat(label, F.when(X.text_of(F.col("label")) != "", F.concat(F.lit("（"), F.col("label"), F.lit("）："))).otherwise("："))
    line = F.when(F.col("_note"), F.col("line")).otherwise(F.concat(label, F.lit(" "), F.col("line")))
    once = both.select("task_id", "kind", F.struct(F.col("batch").alias("a"), F.col("at").alias("b")).alias("place"), line.alias("line")).groupBy("task_id", "kind", "line").agg(F.min("place").alias("place"))
    best = once.withColumn("_n", F.row_number().over(Window.partitionBy("task_id", "kind").orderBy("place"))).filter(F.col("_n") <= LINES)
    per = best.groupBy("task_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("_n", "line")))), lambda x: x["line"]).alias(k) for k in ("issue", "manual")])
    body = F.concat(F.lit("### 检查汇总\n\n#### 明确问题\n"), _bullets(F.col("issue"), NO_ISSUE), F.lit("\n\n#### 需人工确认\n"), _bullets(F.col("manual"), NO_MANUAL))
    return per.select("task_id", body.alias("body"))


# -- reviews and names ------------------------------------------------------------------------------------------------


def matched_reviews(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Imported rows (task_id, row_number, code, item_id, check_name, marker) with the item they speak of. A row with an id
    names its item; an older one, with neither code nor id, is matched by the check's name and ``条目 N`` if exactly one item
    fits. ``problem`` says why a row has no item: half an id, no or several candidates, an item that is gone, or an item that
    a row before it names. ``items``: task_id, code, item_id, check_name, idx."""
    code, item = F.trim(X.text_of(F.col("code"))), F.trim(X.text_of(F.col("item_id")))
    r = rows.select("task_id", "row_number", F.trim(X.text_of(F.col("check_name"))).alias("_name"), F.trim(X.text_of(F.col("marker"))).alias("_marker"), code.alias("_code"), item.alias("_item"))
    kind = F.when((F.col("_code") != "") & (F.col("_item") != ""), "exact").when((F.col("_code") == "") & (F.col("_item") == ""), "older").otherwise("half")
    r = r.withColumn("_kind", kind)
    older = items.groupBy("task_id", F.trim(X.text_of(F.col("check_name"))).alias("_name"), F.concat(F.lit("条目 "), F.col("idx").cast("string")).alias("_marker")).agg(F.count(F.lit(1)).alias("_fits"), F.min(F.struct("code", "item_id")).alias("_one"))
    r = r.join(older, ["task_id", "_name", "_marker"], "left")
    unique = F.coalesce(F.col("_fits"), F.lit(0)) == 1
    r = r.withColumns({"_c": F.when(F.col("_kind") == "exact", F.col("_code")).when((F.col("_kind") == "older") & unique, F.col("_one.code")), "_i": F.when(F.col("_kind") == "exact", F.col("_item")).when((F.col("_kind") == "older") & unique, F.col("_one.item_id"))})
    there = items.select("task_id", F.col("code").alias("_c"), F.col("item_id").cast("string").alias("_i")).distinct().withColumn("_there", F.lit(True))
    r = r.join(there, ["task_id", "_c", "_i"], "left")
    first = r.filter("_there").groupBy("task_id", "_c", "_i").agg(F.min("row_number").alias("_first"))
    r = r.join(first, ["task_id", "_c", "_i"], "left")
    problem = F.when(F.col("_kind") == "half", "half an id").when((F.col("_kind") == "older") & ~unique, "no single candidate").when(F.col("_there").isNull(), "item is gone").when(F.col("row_number") > F.col("_first"), "item named before")
    return r.select("task_id", "row_number", F.when(problem.isNull(), F.col("_c")).alias("code"), F.when(problem.isNull(), F.col("_i")).alias("item_id"), problem.alias("problem"))


def _numbered_names(x: str):
    """The name with -2, -3, … before its suffix."""
    path = PurePosixPath(x)
    end = f"-2{path.suffix}"
    head = str(path.with_name(path.stem + end)).removesuffix(end)
    return lambda k: f"{head}-{k}{path.suffix}"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _walked(lists: pa.Array) -> pa.Array:
    """The names of a group in order, each as it was given or with the first ending that is free then."""
    out, ends = [], [0]
    for names in lists.to_pylist():
        used: dict[str, int] = {}  # a name that is taken, and the last number that was tried for it
        for x in names:
            pick = x
            if x in used:
                name = _numbered_names(x)
                free = ((k, name(k)) for k in range(used[x] + 1, NAMES + 1))
                number, pick = next((f for f in free if f[1] not in used), (0, ""))
                if not number:
                    raise ValueError(f"more than {NAMES} files of the name {x}")
                used[x] = number
            used[pick] = 1  # each name is taken once, so the keys are the names in order
        out += used
        ends.append(len(out))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string()))


def unique_names(files: DataFrame, by: Sequence[str], on: str, name: str) -> DataFrame:
    """``unique_name``: the first file of a name in its group keeps it, each later one gets the first of ``-2``, ``-3``, … that
    is free then, before the suffix; NAMES files of one name at most, more stop the query. A made name may meet a given one
    only if they differ in such endings alone, so names are grouped by what is left without them. Where a group has one name
    only, files are numbered; only where several meet and one of them repeats are they walked, in the order of ``on`` (which
    must tell the files of a group apart). Files are dealt by what they are grouped by once and for all; a group is sorted
    on disk where it is large, and only one that is walked is gathered."""
    clean = F.coalesce(F.nullif(F.btrim(X.text_of(F.col(name)), F.lit("/\\")), F.lit("")), F.lit("document"))
    pattern = "(?s)^(.*?[^/])((?:-\\d+)*)(\\.[^./]+)?$"
    head, ends, suffix = (F.regexp_extract("_name", pattern, k) for k in (1, 2, 3))
    keys = [*by, "_root"]
    rooted = files.withColumn("_name", clean).withColumn("_root", F.concat(head, F.lit("\n"), suffix)).repartition(*keys)
    told = rooted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_name").orderBy(on)))
    many = F.raise_error(F.concat(F.lit(f"more than {NAMES} files of the name "), F.col("_name"))).cast("string")
    told = told.filter(F.when(F.col("_n") > NAMES, many).otherwise("") == "")
    whole = Window.partitionBy(*keys)
    told = told.withColumn("_meet", (F.max("_n").over(whole) > 1) & (F.count_if(F.col("_n") == 1).over(whole) > 1))
    made = F.concat(head, ends, F.lit("-"), F.col("_n").cast("string"), suffix)
    alike = told.filter("not _meet").withColumn("unique_name", F.when(F.col("_n") == 1, F.col("_name")).otherwise(made))
    row = F.struct(F.struct(*files.columns).alias("row"), F.col("_name").alias("name"))
    order = lambda a, b: F.when(a["row"][on] < b["row"][on], -1).when(a["row"][on] > b["row"][on], 1).otherwise(0)
    groups = told.filter("_meet").groupBy(*keys).agg(F.array_sort(F.collect_list(row), order).alias("_g"))
    walked = groups.select(F.inline(F.arrays_zip(F.col("_g").alias("f"), _walked(F.transform("_g", lambda x: x["name"])).alias("unique_name")))).select("f.row.*", "unique_name")
    return walked.unionByName(alike.select(*files.columns, "unique_name"))
