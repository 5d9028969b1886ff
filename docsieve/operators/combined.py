"""Answers to several checks at once, the text that goes with a batch of images, and imported reviews."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import answers as A
from docsieve.functions import sampling
from docsieve.functions import text as X

CONTEXT_LIMIT = 20_000
# Notes in composed texts, and what a review may say.
CUT_NOTE = "\n\n[文档上下文已按当前批次截断]"
SCOPE_NOTE = "document_text_scope: 仅提供当前图片所在页及前后 1 页的文本，避免跨页误配。"
REVIEW_ROWS = 5_000
ITEM_TYPES = {"issue": "问题", "suggestion": "建议", "non_issue": "非问题"}
ACCEPTANCES = ("pending", "accepted", "rejected")


_write = json.JSONEncoder(ensure_ascii=False).encode


def _first_parts(answers: list[str | None] | None) -> dict[str, tuple[int, dict]]:
    """Place and value of the first part of each code."""
    first: dict[str, tuple[int, dict]] = {}
    for value in answers or ():
        found = A.find_json(value, salvage=False)
        if isinstance(found, dict):
            found = found.get("results", [found] if isinstance(found.get("items"), list) else None)
        for k, r in enumerate(found if isinstance(found, list) else ()):
            if isinstance(r, dict) and ((code := A.field_text(r.get("code"))) not in first or k < first[code][0]):
                first[code] = (k, r)
    return first


@F.arrow_udf(T.ArrayType(T.StringType()))
def _answered(answers: pa.Array, codes: pa.Array) -> pa.Array:
    """For each code that a task asks the text of its part, null without one. Only parts that are asked for are written."""
    texts, ends = [], [0]
    for said, asked in zip(answers.to_pylist(), codes.to_pylist(), strict=True):
        first = _first_parts(said)
        for code in asked:
            names = () if code is None else (code, "") if len(asked) == 1 else (code,)
            part = min((first[c] for c in names if c in first), key=lambda x: x[0], default=None)
            texts.append(None if part is None else _write(part[1]))
        ends.append(len(texts))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(texts, pa.string()))


def split_combined(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """(task_id, answer) and (task_id, code) -> an answer for each asked code: the first part that names exactly that code.
    Parts of other codes are ignored. ``missing`` marks the codes to ask again; they have no answer. A single answer
    without a code belongs to the only code asked. Answers and codes meet by task alone, before the answers are read: what is
    gathered are the codes that a task asks and the answers to them, and no part is unfolded or shuffled."""
    others = [c for c in asked.columns if c not in ("task_id", "code")]
    codes = asked.groupBy("task_id").agg(F.collect_list(F.struct("code", *others)).alias("_asked"))
    said = answers.groupBy("task_id").agg(F.collect_list("answer").alias("_said"))
    both = codes.join(said, "task_id", "left").withColumn("_texts", _answered("_said", "_asked.code"))
    rows = both.select("task_id", F.inline(F.arrays_zip(F.col("_asked").alias("a"), F.col("_texts").alias("answer"))))
    return rows.select("task_id", "a.*", "answer").withColumn("missing", F.col("answer").isNull())


def with_placeholders(first: DataFrame, second: DataFrame, note: Column) -> DataFrame:
    """The missing codes filled from a second round, and those still missing by a note."""
    again = second.filter("not missing").select("task_id", "code", F.col("answer").alias("_again"))
    return first.join(again, ["task_id", "code"], "left").withColumn("answer", F.coalesce("answer", "_again", note)).drop("_again", "missing")


def document_header(text: Column) -> Column:
    """The leading ``file:`` lines."""

    def head(rows: Column, flags: Column) -> Column:
        begin = F.array_position(flags, True).cast("int")
        after = F.slice(flags, F.greatest(begin, F.lit(1)), F.greatest(F.size(flags), F.lit(1)))
        end = F.array_position(after, False).cast("int")
        n = F.when(end == 0, F.size(after)).otherwise(end - 1)
        lines = F.transform(F.slice(rows, F.greatest(begin, F.lit(1)), F.greatest(n, F.lit(0))), lambda x: F.trim(x))
        return F.when(begin > 0, F.array_join(lines, "\n")).otherwise("file: document")

    return X.let(X.lines(text), lambda rows: X.let(F.transform(rows, lambda x: x.startswith("file:")), lambda flags: head(rows, flags)))


def trimmed(text: Column, limit: int = CONTEXT_LIMIT) -> Column:
    """At most ``limit`` characters, with a note where text was cut off."""
    cut = lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), "(?U)\\s+$", ""), F.lit(CUT_NOTE)))
    return X.let(F.regexp_replace(X.text_of(text), "(?U)^\\s+|\\s+$", ""), cut)


def page_context(text: Column, image_pages: Column, image_lines: Column, limit: int = CONTEXT_LIMIT) -> Column:
    """The sections of the images' pages and of those next to them, under the document's header; the whole text where no
    page is known or none is met."""
    near = F.flatten(F.transform(F.coalesce(image_pages, F.array().cast("array<int>")), lambda p: F.array(p - 1, p, p + 1)))
    sections = sampling.page_sections(text)
    chosen = X.let(near, lambda pages: F.filter(sections, lambda s: F.array_contains(pages, s["page"]) & (F.trim(s["section"]) != "")))

    def scoped(some: Column) -> Column:
        body = F.array_join(F.transform(some, lambda s: s["section"]), "\n\n")
        said = F.concat(document_header(text), F.lit(f"\n\n{SCOPE_NOTE}\ncurrent_batch_images:\n"), F.array_join(image_lines, "\n"), F.lit("\n\n相关文档文本：\n"), body)
        return F.when(F.size(some) > 0, said).otherwise(text)

    return trimmed(X.let(chosen, scoped), limit)


def group_text(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by…, group, place, name, text) -> the groups' texts under their headings, in order."""
    one = parts.withColumn("line", F.concat(F.lit("## "), F.col("group"), F.lit(" "), F.col("place").cast("string"), F.lit("："), F.col("name"), F.lit("\n"), X.text_of(F.col("text"))))
    groups = one.groupBy(*by, "group").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("rows"))
    groups = groups.withColumn("body", F.concat(F.lit("# "), F.col("group"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n")))
    return groups.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "body"))), lambda g: g["body"]), "\n\n").alias("text"))


def checked_import(rows: DataFrame, items: DataFrame, task_id: Column) -> DataFrame:
    """Rows of a review table with ``problem``, null where a row may be stored: its task, its item (which must exist and be
    named once), its type and acceptance (codes or labels), and what a rejection has to say."""
    words = {w: k for k, label in ITEM_TYPES.items() for w in (k, label)}
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    named = rows.groupBy("code", "item_id").agg(F.count(F.lit(1)).alias("_times"))
    known = items.select("code", "item_id").distinct().withColumn("_known", F.lit(True))
    out = rows.withColumn("_type", table[F.trim(X.text_of(F.col("item_type")))]).join(named, ["code", "item_id"], "left").join(known, ["code", "item_id"], "left")
    ids = [F.trim(X.text_of(F.col(c))) == "" for c in ("code", "item_id")]
    problem = (
        F.when(F.col("task_id") != task_id, "other task")
        .when(ids[0] & ids[1], "no item")
        .when(ids[0] | ids[1], "half an item id")
        .when(F.col("_known").isNull(), "unknown item")
        .when(F.col("_times") > 1, "item named twice")
        .when(F.col("_type").isNull(), "unknown type")
        .when(~F.coalesce(F.col("acceptance").isin(*ACCEPTANCES), F.lit(False)), "unknown acceptance")
        .when((F.col("acceptance") == "rejected") & (F.trim(X.text_of(F.col("rejection_reason"))) == ""), "no reason")
        .when((F.col("rejection_reason") == "other") & (F.trim(X.text_of(F.col("rejection_note"))) == ""), "no note")
    )
    return out.withColumn("problem", problem).withColumn("item_type", F.col("_type")).drop("_type", "_times", "_known")


def import_reviews(rows: DataFrame, items: DataFrame, task_id: Column) -> DataFrame:
    """The rows to store: all of them, or none if any has a problem or there are more than ``REVIEW_ROWS``."""
    checked = checked_import(rows, items, task_id)
    n, bad = checked.agg(F.count(F.lit(1)), F.count("problem")).first()  # two numbers
    return checked.drop("problem").filter(F.lit(bad == 0 and n <= REVIEW_ROWS))


def export_rows(results: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item, and one for each result without items, which is marked as not split."""
    out = results.join(items, ["task_id", "code"], "left")
    return out.withColumn("type", F.coalesce("type", F.lit("未拆分")))
