"""Migrations of stored tables, reports about lists that are missing or cannot be read, and small reads around tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import text as X
from docsieve.functions import values as V
from docsieve.operators.lifecycle import DELETABLE
from docsieve.operators.operations import effective_owner, in_days

Tables = dict[str, DataFrame]

# Texts of the reports about term lists, by check.
LISTS = {
    "common": {
        "missing": ("常用词检查表配置", "未找到可读取的常用词检查表。系统需要读取“常用词”和“常见错误/不推荐用法”两列后才能执行检查。", "本次任务无法判断常用词写法和大小写是否符合词表要求。", "请将检查表放到以下任一路径，推荐使用 instance/common_terms.xlsx：\n", "常用词检查结论：未配置常用词检查表，未执行规则匹配。", 8),
        "invalid": ("常用词检查表读取失败", "常用词检查表无法读取。", "本次任务无法完成常用词规则匹配。", "请确认检查表格式为 xlsx、xlsm、xls 或 csv，并包含“常用词”和“常见错误/不推荐用法”两列。", "常用词检查结论：常用词检查表读取失败。\n词表文件："),
        "empty": "未读取到有效常用词规则，请确认表头包含“常用词”和“常见错误/不推荐用法”两列。",
    },
    "sensitive": {
        "missing": ("敏感词表配置", "未找到可读取的敏感词表。系统需要从本地 Excel/CSV 词表中读取“不规范用语”和“规范用语”两列后才能执行检查。", "本次任务无法判断文档是否包含公司内部维护的不规范用语。", "请将词表放到以下任一路径，推荐使用 instance/sensitive_terms.xlsx：\n", "敏感词检查结论：未配置敏感词表，未执行敏感词匹配。", 6),
        "invalid": ("敏感词表读取失败", "敏感词表无法读取。", "本次任务无法完成敏感词匹配。", "请确认词表格式为 xlsx、xlsm、xls 或 csv，并包含“不规范用语”和“规范用语”两列。", "敏感词检查结论：敏感词表读取失败。\n词表文件："),
        "empty": "未读取到有效敏感词规则，请确认表头包含“不规范用语”和“规范用语”两列。",
    },
}
NONE_FOUND = "未发现"


# -- migrations -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """A change of stored tables that is made once: its name is written down, and a name that is there is never run again.
    ``always`` steps are run each time and must change nothing that they have changed before."""

    name: str
    change: Callable[[Tables], Tables]
    always: bool = False


def migrate(tables: Mapping[str, DataFrame], done: DataFrame, steps: Sequence[Step]) -> tuple[Tables, DataFrame]:
    """The tables after all steps that are due, in order, and the names of all steps done (``done``: name). Only the names of
    ``steps`` are looked up, so what comes to the driver is bounded by them."""
    names = [s.name for s in steps if not s.always]
    if len(set(names)) < len(names):
        raise ValueError("two steps of one name")
    known = {r["name"] for r in done.filter(F.col("name").isin(names)).select("name").distinct().collect()}
    out = dict(tables)
    for s in steps:
        if s.always or s.name not in known:
            out |= s.change(out)
    new = [(n,) for n in names if n not in known]
    return out, done.unionByName(done.sparkSession.createDataFrame(new, "name string")) if new else done


def fill_owners(tasks: DataFrame) -> DataFrame:
    """Tasks of before there were owners belong to their address; names and sources are filled where they are empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return tasks.withColumns({
        "owner_subject": F.when(blank("owner_subject"), F.concat(F.lit("ip:"), F.col("ip"))).otherwise(F.col("owner_subject")),
        "owner_name": F.when(blank("owner_name") & F.col("username").isNotNull(), F.col("username")).otherwise(F.col("owner_name")),
        "owner_source": F.when(blank("owner_source"), "ip").otherwise(F.col("owner_source")),
    })


def without_finished_keys(tasks: DataFrame) -> DataFrame:
    """Finished tasks keep no key."""
    return tasks.withColumn("api_key", F.when(~F.coalesce(F.col("status").isin(*DELETABLE), F.lit(False)), F.col("api_key")))


def one_thinking_flag(models: DataFrame, now: Column) -> DataFrame:
    """Models with the flag set go where the same model is there without it; the flag of the others is taken off."""
    plain = models.filter("not force_disable_thinking").select(F.col("provider_id").alias("_p"), F.col("model_name").alias("_m")).distinct()
    twin = [F.col("provider_id").eqNullSafe(F.col("_p")), F.col("model_name").eqNullSafe(F.col("_m"))]
    set_ones = models.filter("force_disable_thinking").join(plain, twin, "left_anti")
    return models.filter("not coalesce(force_disable_thinking, false)").unionByName(set_ones.withColumns({"force_disable_thinking": F.lit(False), "updated_at": now}))


def renamed_setting(settings: DataFrame, old: str, new: str, now: Column) -> DataFrame:
    """A setting under a new key: an old value is taken over if the new key has none, and goes in any case."""
    both = settings.filter(F.col("key").isin(old, new)).groupBy().agg(F.max(F.when(F.col("key") == old, F.struct("value"))).alias("_old"), F.bool_or(F.col("key") == new).alias("_has"))
    moved = both.filter(F.col("_old").isNotNull() & ~F.coalesce("_has", F.lit(False))).select(F.lit(new).alias("key"), F.col("_old.value").alias("value"), now.alias("updated_at"))
    return settings.filter(~F.coalesce(F.col("key") == old, F.lit(False))).unionByName(moved)


def refreshed_prompts(checks: DataFrame, defaults: DataFrame, markers: DataFrame, now: Column) -> DataFrame:
    """Checks whose prompt is a stock one (the default of today, or one that holds all markers of a set) take over name,
    description, prompt and order of their default; prompts that people have written stay. ``markers``: code, set, marker.
    A check that has all of it already is not touched, so its time of change stays."""
    fields = ["name", "description", "prompt", "sort_order"]
    base = defaults.groupBy("code").agg(*[F.min_by(f, "sort_order").alias(f"_{f}") for f in fields])
    told = checks.select("code", "prompt").distinct().join(markers, "code").groupBy("code", "prompt", "set").agg(F.bool_and(F.contains(X.text_of(F.col("prompt")), F.col("marker"))).alias("_all"))
    stock = told.groupBy(F.col("code").alias("_c"), F.col("prompt").alias("_p")).agg(F.bool_or("_all").alias("_stock"))
    out = checks.join(base, "code", "left").join(stock, (F.col("code") == F.col("_c")) & F.col("prompt").eqNullSafe(F.col("_p")), "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    due = F.col("_prompt").isNotNull() & (F.coalesce("_stock", F.lit(False)) | (F.col("prompt") == F.col("_prompt"))) & ~same
    out = out.withColumn("_due", F.coalesce(due, F.lit(False)))
    return out.withColumns({**{f: F.when(F.col("_due"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}, "updated_at": F.when(F.col("_due"), now).otherwise(F.col("updated_at"))}).select(checks.columns)


# -- reports about lists ----------------------------------------------------------------------------------------------


def list_report(tasks: DataFrame, check: str, rules: Column, paths: Column, error: Column) -> DataFrame:
    """The report of tasks whose term list cannot be used: task_id, summary and the fields of its one item. ``rules``: how many
    were read, null if no list was found; ``paths``: where was looked, the first of them the list that was found; ``error``:
    why it could not be read. Tasks with rules have none."""
    t = LISTS[check]
    missing, invalid = t["missing"], t["invalid"]
    why = V.first_text(error, F.when(rules == 0, F.lit(t["empty"])).otherwise(""))
    kind = F.when(rules.isNull() & (X.text_of(error) == ""), "missing").when((why != "") | (rules == 0), "invalid")
    path = F.coalesce(F.get(paths, 0), F.lit(""))
    looked = F.array_join(F.transform(F.slice(paths, 1, missing[5]), lambda p: F.concat(F.lit("- "), p)), "\n")
    rows = tasks.select("*", kind.alias("_kind"), path.alias("_path"), looked.alias("_looked"), why.alias("_why")).filter("_kind is not null")
    gone = F.col("_kind") == "missing"
    pick = lambda a, b: F.when(gone, a).otherwise(b)
    return rows.select(
        "task_id", pick(F.lit(missing[4]), F.concat(F.lit(invalid[4]), F.col("_path"))).alias("summary"), pick(F.lit(missing[0]), F.lit(invalid[0])).alias("category"), pick(F.lit("本地词表文件"), F.col("_path")).alias("location"), F.lit("").alias("excerpt"),
        pick(F.lit(missing[1]), V.first_text(F.col("_why"), F.lit(invalid[1]))).alias("description"), pick(F.lit(missing[2]), F.lit(invalid[2])).alias("impact"),
        pick(F.concat(F.lit(missing[3]), F.col("_looked")), F.lit(invalid[3])).alias("suggestion"), F.lit("suggestion").alias("type"),
    )


REPORT_FIELDS = ("category", "location", "excerpt", "description", "impact", "suggestion", "type")


def report_json(reports: DataFrame) -> DataFrame:
    """task_id, body: a report (summary, items: array of structs) as JSON text, two blanks a level, other letters kept."""
    fields = lambda x: [F.concat(F.lit(f'      "{f}": '), V.json_string(X.text_of(x[f]))) for f in REPORT_FIELDS]
    items = F.transform("items", lambda x: F.concat(F.lit("    {\n"), F.concat_ws(",\n", *fields(x)), F.lit("\n    }")))
    listed = F.when(F.size("items") > 0, F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n  ]"))).otherwise("[]")
    return reports.select("task_id", F.concat(F.lit('{\n  "summary": '), V.json_string(X.text_of(F.col("summary"))), F.lit(',\n  "items": '), listed, F.lit("\n}")).alias("body"))


# -- reads around tasks -----------------------------------------------------------------------------------------------


def now_text(now: Column | None = None) -> Column:
    """The time to the second, as text."""
    return F.date_format(F.localtimestamp() if now is None else now, "yyyy-MM-dd HH:mm:ss")


def token() -> Column:
    """A random token of 32 hex digits, another for each row."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def of_mode(tasks: DataFrame, prefix: str) -> DataFrame:
    """Tasks whose owner (or address) begins with the prefix of a way to sign in."""
    return tasks.filter(effective_owner(F.col("owner"), F.col("ip")).startswith(prefix))


def owner_overview(tasks: DataFrame, types: Sequence[str], first: Column, last: Column, n: int = 10) -> DataFrame:
    """Owners of a range of days by tasks, then latest task, then name: address, display name, tasks in all and by type."""
    subject = effective_owner(F.col("owner"), F.col("ip"))
    by_type = [F.count_if(F.col("task_type") == t).alias(f"type_{k}") for k, t in enumerate(types)]
    per = tasks.filter(in_days(F.col("created_at"), first, last)).groupBy(subject.alias("subject")).agg(F.min("ip").alias("ip"), F.max("username").alias("username"), F.count(F.lit(1)).alias("tasks"), *by_type, F.max("created_at").alias("last_task_at"))
    return per.orderBy(F.desc("tasks"), F.desc("last_task_at"), F.asc("subject")).limit(n)


def type_totals(tasks: DataFrame, types: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """A row for each type, also where it has no task: tasks, tasks by status, owners."""
    asked = tasks.sparkSession.createDataFrame([(t,) for t in types], "task_type string")
    per = tasks.groupBy("task_type").agg(F.count(F.lit(1)).alias("tasks"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.countDistinct(effective_owner(F.col("owner"), F.col("ip"))).alias("users"))
    return asked.join(per, "task_type", "left").select("task_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tasks", *statuses, "users")])


def submitted(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (owner, submission_token) that made a task before: an empty token never did."""
    seen = tasks.select("owner", "submission_token").filter("submission_token <> ''")
    return requests.join(seen, ["owner", "submission_token"], "left_semi")


def file_cache(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Finished tasks that still have files, those that ended first in front, then the smaller, then by id."""
    sums = files.groupBy("task_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("size_bytes"))
    due = tasks.filter(F.col("status").isin(*DELETABLE) & F.col("cleaned_at").isNull())
    out = due.join(sums, "task_id").select("task_id", F.coalesce("finished_at", "updated_at", "created_at").alias("finished_at"), "size_bytes", "file_count")
    return out.orderBy("finished_at", "size_bytes", "task_id")


def document_groups(meta: Column) -> Column:
    """The groups of a metadata text: array of (role, label, files as JSON texts); groups without a file that is an object
    are left out, and what is no such text has none."""
    held = F.try_variant_get(F.try_parse_json(meta), "$.groups", "array<variant>")
    text = lambda g, key, other: F.coalesce(F.nullif(F.try_variant_get(g, f"$.{key}", "string"), F.lit("")), F.lit(other))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    files = lambda g: F.transform(F.filter(F.coalesce(F.try_variant_get(g, "$.files", "array<variant>"), F.array().cast("array<variant>")), is_object), lambda f: F.to_json(f))
    groups = F.transform(F.filter(F.coalesce(held, F.array().cast("array<variant>")), is_object), lambda g: F.struct(text(g, "role", "").alias("role"), text(g, "label", "文档").alias("label"), files(g).alias("files")))
    return F.filter(groups, lambda g: F.size(g["files"]) > 0)


def tidy_markdown(text: Column) -> Column:
    """Line ends as \\n, and no blanks before the end of bold text."""
    lines = F.regexp_replace(X.text_of(text), "\r\n?", "\n")
    return F.regexp_replace(lines, "\\*\\*([^*\n]*?\\S)[ \t　]+\\*\\*", "**$1**")


def preview(values: Column) -> Column:
    """A list as text, or that nothing was found."""
    return F.when(F.size(values) > 0, F.array_join(values, "、")).otherwise(NONE_FOUND)
