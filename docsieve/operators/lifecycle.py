"""Guarded changes of a task table, checks of what comes in, and small lists around tasks, as plans over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import text as X

DELETABLE = ("completed", "failed", "canceled")
BULK_LIMIT, LEASE_SECONDS, STATUS_IDS = 20, 90, 100


def owned(token: Column, given: Column) -> Column:
    """A change that names no token always fits; one that does must name the task's own."""
    return given.isNull() | token.eqNullSafe(given)


def apply_progress(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """(task_id, progress, claim_token) onto running tasks of that token. Progress never falls; updates of other owners,
    or of tasks that no longer run, change nothing. One update per task is kept, the furthest."""
    best = updates.groupBy("task_id", F.col("claim_token").alias("_token")).agg(F.max("progress").alias("_progress"))
    hit = (F.col("status") == "running") & owned(F.col("claim_token"), F.col("_token"))
    joined = tasks.join(best, "task_id", "left").withColumn("_new", F.when(hit, F.col("_progress")))
    others = [c for c in tasks.columns if c not in ("task_id", "progress")]
    return joined.groupBy("task_id", *others).agg(F.greatest(F.max("progress"), F.coalesce(F.max("_new"), F.max("progress"))).alias("progress"))


def finish(tasks: DataFrame, ends: DataFrame) -> DataFrame:
    """(task_id, end_status, claim_token, ended_at) onto running tasks of that token: completed, failed or canceled. Of several
    ends that fit a task the first counts (ties: by status). A task whose cancellation was asked for ends as canceled."""
    e = ends.filter(F.col("end_status").isNotNull()).select("task_id", F.col("end_status").alias("_end"), F.col("claim_token").alias("_token"), F.col("ended_at").alias("_at"))
    running = tasks.filter("status = 'running'").select("task_id", "claim_token").distinct()
    fits = running.join(e, "task_id").filter(owned(F.col("claim_token"), F.col("_token")))
    first = fits.groupBy("task_id").agg(F.min_by(F.struct("_end", "_at"), F.struct(F.col("_at").isNull(), "_at", "_end")).alias("_first"))
    out = tasks.join(first, "task_id", "left").withColumn("_hit", (F.col("status") == "running") & F.col("_first").isNotNull())
    end = F.when(F.col("cancel_requested"), "canceled").otherwise(F.col("_first._end"))
    return out.withColumns({"finished_at": F.when(F.col("_hit"), F.col("_first._at")).otherwise(F.col("finished_at")), "status": F.when(F.col("_hit"), end).otherwise(F.col("status"))}).drop("_first", "_hit")


def wanted_ids(ids: list, cap: int) -> list[int]:
    """Distinct positive whole numbers in order, ``cap`` at most."""
    numbers = [int(i) for i in ids if str(i).strip().lstrip("+").isdigit()]
    return list(dict.fromkeys(n for n in numbers if n > 0))[:cap]


def statuses(tasks: DataFrame, ids: list) -> DataFrame:
    """The asked tasks, 100 at most."""
    return tasks.filter(F.col("task_id").isin(wanted_ids(ids, STATUS_IDS)))


def bulk_delete(tasks: DataFrame, ids: list, hits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks left, hits left, what happened to each asked task). Queued and running tasks are skipped; more than 20 ids
    are refused."""
    if len(ids) > BULK_LIMIT:
        raise ValueError(f"at most {BULK_LIMIT} tasks at a time")
    asked = F.col("task_id").isin(wanted_ids(ids, BULK_LIMIT))
    goes = asked & F.col("status").isin(*DELETABLE)
    outcome = tasks.filter(asked).select("task_id", F.when(goes, "deleted").otherwise("skipped").alias("outcome"))
    gone = tasks.filter(goes).select("task_id")
    return tasks.filter(~F.coalesce(goes, F.lit(False))), hits.join(F.broadcast(gone), "task_id", "left_anti"), outcome  # 20 rows at most


def clean_expired(tasks: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    """The text of due tasks emptied and the time of it written; the rest as it was."""
    marked = tasks.join(due.select("task_id").distinct().withColumn("_due", F.lit(True)), "task_id", "left")
    is_due = F.coalesce("_due", F.lit(False))
    return marked.withColumns({"document_text": F.when(is_due, F.lit(None).cast("string")).otherwise(F.col("document_text")), "cleaned_at": F.when(is_due, now).otherwise(F.col("cleaned_at"))}).drop("_due")


def lease_deadline(now: Column) -> Column:
    return now + F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS")


def day_range(first: Column, last: Column) -> dict[str, Column]:
    """Bounds of a range of days [from, to), the number of days, and where the last 7 and 30 days begin."""
    return {"from": first.cast("timestamp"), "to": F.date_add(last, 1).cast("timestamp"), "days": F.datediff(last, first) + 1, "last_7": F.date_sub(last, 6), "last_30": F.date_sub(last, 29)}


def too_long(text: Column, limit: Column | int) -> Column:
    return F.length(X.text_of(text)) > limit


def media_status(mime_type: Column) -> Column:
    """checkable, or why it is skipped."""
    return F.when(X.text_of(mime_type).startswith("image/"), "checkable").when(F.trim(X.text_of(mime_type)) == "", "skipped: no type").otherwise(F.concat(F.lit("skipped: "), mime_type))


def safe_path(path: Column) -> Column:
    """A relative path that stays below its root."""
    p = X.text_of(path)
    return (p != "") & ~p.rlike("^[/\\\\]|^[A-Za-z]:") & ~p.rlike("(^|[/\\\\])\\.\\.([/\\\\]|$)")


def document_text(name: Column, text: Column) -> Column:
    """The text under a line with the file's base name; an empty text stays empty."""
    base = F.substring_index(F.translate(X.text_of(name), "\\", "/"), "/", -1)
    body = F.regexp_replace(X.text_of(text), "(?U)^\\s+|\\s+$", "")
    return F.when(body == "", "").otherwise(F.concat(F.lit("file: "), base, F.lit("\n\n"), body))


def safe_name(name: Column, limit: int = 80) -> Column:
    """Characters that file systems refuse become ``_``; at most ``limit`` bytes, cut between characters."""
    clean = F.regexp_replace(F.trim(X.text_of(name)), "[\\x00-\\x1f\\\\/:*?\"<>|]+", "_")
    fits = F.transform(F.sequence(F.lit(0), F.least(F.length(clean), F.lit(limit))), lambda n: F.substring(clean, 1, n))
    cut = F.try_element_at(F.filter(fits, lambda t: F.octet_length(t) <= limit), F.lit(-1))
    return F.when(F.octet_length(clean) <= limit, clean).otherwise(cut)


def file_stamp(time: Column) -> Column:
    return F.regexp_replace(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), "\\D", "")


def first_distinct(values: Column, limit: int = 30) -> Column:
    """The first distinct texts that are not blank, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")), 1, limit)


def span_label(labels: Column) -> Column:
    """First to last of a batch's labels; one if they agree; empty without any."""
    a, b = F.try_element_at(labels, F.lit(1)), F.try_element_at(labels, F.lit(-1))
    return F.when(F.size(labels) == 0, "").when(a == b, a).otherwise(F.concat(a, F.lit("-"), b))


def group_title(groups: Column, names: int = 2) -> Column:
    """Each group by its first names, and how many there are if more."""
    part = F.transform(groups, lambda g: F.concat(F.array_join(F.slice(g, 1, names), "、"), F.when(F.size(g) > names, F.concat(F.lit(" 等 "), F.size(g).cast("string"), F.lit(" 个"))).otherwise("")))
    return F.array_join(F.filter(part, lambda p: p != ""), " / ")


def put(reviews: Column, key: Column, value: Column) -> Column:
    """A map with one entry set, or taken out where the value is ``pending``."""
    without = F.map_filter(reviews, lambda k, _: k != key)
    return F.when(value == "pending", without).otherwise(F.map_concat(without, F.create_map(key, value)))


def usage(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, bytes) -> per task: files, bytes, and whether they may be cleaned; finished tasks first, largest first."""
    sums = files.groupBy("task_id").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return tasks.select("task_id", "status").join(sums, "task_id").withColumn("cleanable", F.col("status").isin(*DELETABLE)).orderBy(F.desc("cleanable"), F.desc("bytes"), "task_id")


def in_check_order(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Results (code, state, …) by the checks' order; of two for one check the completed one stays."""
    best = results.groupBy("task_id", "code").agg(F.max_by("result", F.struct((F.col("state") == "completed").alias("c"), F.col("result").alias("r"))).alias("result"))
    return best.join(checks.select("code", "sort_order", "id"), "code")


def first_sort_order(checks: DataFrame, by: str = "task_type") -> DataFrame:
    """The order that puts a new check before all others of its type."""
    return checks.groupBy(by).agg((F.min("sort_order") - 10).alias("sort_order"))


def snapshot_or_live(tasks: DataFrame, live: DataFrame) -> DataFrame:
    """A task's own snapshot of a check, or the live check of that code where it has none (of several, the least by name)."""
    found = live.groupBy("code").agg(F.min(F.struct("name", "prompt")).alias("_live")).select("code", F.col("_live.name").alias("_name"), F.col("_live.prompt").alias("_prompt"))
    return tasks.join(found, "code", "left").withColumns({"name": F.coalesce("name", "_name"), "prompt": F.coalesce("prompt", "_prompt")}).drop("_name", "_prompt")
