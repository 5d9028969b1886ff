"""Frames of a model's answer stream: lines are read by columns alone, so the same plan serves a table and a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import text as X

# Fields that carry reasoning, in this order, and the mark of the end.
REASONING_FIELDS = ("reasoning", "reasoning_content", "reasoning_details", "reasoning_text", "reasoning_opaque")
DONE, BRIEF = "[DONE]", 300


def brief(value: Column, limit: int = BRIEF) -> Column:
    """One line of at most ``limit`` characters, with dots where something was cut off."""
    flat = F.replace(F.trim(value), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(flat.substr(1, limit), F.lit("...")))


def payload(line: Column) -> Column:
    """What a line carries: nothing (null) for empty lines, comments and event names, else the text after ``data:``."""
    said = F.regexp_replace(X.text_of(line), "^(?U)\\s+|(?U)\\s+$", "")
    body = F.when(said.startswith("data:"), F.regexp_replace(said, "^data:(?U)\\s*", "")).otherwise(said)
    return F.when((said != "") & ~said.startswith(":") & ~said.startswith("event:"), body)


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _text(value: Column, path: str) -> Column:
    """A JSON string that is not empty; null for anything else."""
    inner = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.nullif(inner.try_cast("string"), F.lit("")))


def _first_filled(value: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(_at(value, p), F.lit("")) for p in paths], value.cast("string"))


def _reasoning(message: Column) -> Column:
    """(field, text) of the first reasoning field that is filled; a list counts by its brief text."""
    found = []
    for name in REASONING_FIELDS:
        inner = F.try_variant_get(message, f"$.{name}", "variant")
        listed = F.when(F.schema_of_variant(inner).startswith("ARRAY") & (_at(message, f"$.{name}") != "[]"), brief(_at(message, f"$.{name}"), 1000))
        said = F.coalesce(_text(message, f"$.{name}"), listed)
        found.append(F.when(said.isNotNull(), F.struct(F.lit(name).alias("field"), said.alias("text"))))
    return F.coalesce(*found)


def read_frames(lines: DataFrame) -> DataFrame:
    """``lines`` (request_id, seq, line) -> one row per frame: kind (``data``, ``done``, ``bad`` for what is no JSON, or
    ``error``), error, content (the first choice's), and what all choices carry: contents, reasoning, tool_calls, finish."""
    body = payload(F.col("line"))
    data = F.try_parse_json("body")
    out = lines.withColumn("body", body).filter("body is not null").withColumn("data", F.when(F.col("body") != DONE, data))
    v = F.col("data")
    fault = F.try_variant_get(v, "$.error", "variant")
    kind = F.schema_of_variant(fault)
    # Void, false, zero and empty values are no fault.
    faulty = F.coalesce(~F.coalesce(fault.cast("string"), F.lit("")).isin("", "null", "false", "0", "{}", "[]"), F.lit(False))
    error = F.when(faulty, brief(F.when(kind.startswith("OBJECT"), _first_filled(fault, ("$.message", "$.msg", "$.code"))).otherwise(fault.cast("string"))))
    failed = F.try_variant_get(v, "$.success", "boolean") == F.lit(False)
    error = F.coalesce(error, F.when(failed, brief(_first_filled(v, ("$.message", "$.msg", "$.errorCode", "$.code")))))
    choices = F.coalesce(F.try_variant_get(v, "$.choices", "array<variant>"), F.array().cast("array<variant>"))
    messages = F.filter(F.flatten(F.transform(choices, lambda c: F.array(F.try_variant_get(c, "$.delta", "variant"), F.try_variant_get(c, "$.message", "variant")))), lambda m: F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)))
    head = F.try_variant_get(v, "$.choices[0]", "variant")
    delta = F.try_variant_get(head, "$.delta.content", "variant")
    # An empty text in ``delta`` still comes before ``message``.
    content = F.when(F.schema_of_variant(delta) == "STRING", delta.cast("string")).otherwise(_text(head, "$.message.content"))
    out = out.withColumn("error", error)
    told = F.when(F.col("body") == DONE, "done").when(v.isNull(), "bad").when(F.col("error").isNotNull(), "error").otherwise("data")
    return out.select(
        "request_id",
        "seq",
        told.alias("kind"),
        "error",
        X.text_of(content).alias("content"),
        F.filter(F.transform(messages, lambda m: _text(m, "$.content")), lambda t: t.isNotNull()).alias("contents"),
        F.filter(F.transform(messages, _reasoning), lambda r: r.isNotNull()).alias("reasoning"),
        F.size(F.filter(messages, lambda m: F.coalesce(F.schema_of_variant(F.try_variant_get(m, "$.tool_calls", "variant")).startswith("ARRAY") & (_at(m, "$.tool_calls") != "[]"), F.lit(False)))).alias("tool_calls"),
        F.filter(F.transform(choices, lambda c: F.nullif(_at(c, "$.finish_reason"), F.lit(""))), lambda t: t.isNotNull()).alias("finish"),
    )


def chunk_statistics(frames: DataFrame) -> DataFrame:
    """Per request, up to the frame that ends it: frames, done, chunks and characters of content and reasoning, the fields
    and reasons seen, the whole answer, and the outcome (``ok``, ``bad``, ``error``, ``reasoning only`` or ``empty``)."""
    before = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("kind") != "data").over(before), F.lit(False))
    seen = frames.withColumn("_ended", ended).filter(~F.col("_ended"))
    is_data = F.col("kind") == "data"

    def chars(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, b: a + F.length(b))

    def names(values: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(is_data, values))))), ",")

    stats = seen.groupBy("request_id").agg(
        F.count_if(is_data).alias("frames"),
        F.bool_or(F.col("kind") == "done").alias("done"),
        F.sum(F.when(is_data, F.size("contents")).otherwise(0)).alias("content_chunks"),
        F.sum(F.when(is_data, chars(F.col("contents"))).otherwise(0)).alias("content_chars"),
        F.sum(F.when(is_data, F.size("reasoning")).otherwise(0)).alias("reasoning_chunks"),
        F.sum(F.when(is_data, chars(F.transform("reasoning", lambda r: r["text"]))).otherwise(0)).alias("reasoning_chars"),
        names(F.transform("reasoning", lambda r: r["field"])).alias("reasoning_fields"),
        F.sum(F.when(is_data, F.col("tool_calls")).otherwise(0)).alias("tool_call_chunks"),
        names(F.col("finish")).alias("finish_reasons"),
        F.max(F.when(F.col("kind").isin("bad", "error"), F.col("kind"))).alias("fault"),
        F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_data, F.struct("seq", "content")))), lambda c: c["content"]), ""), "^(?U)\\s+|(?U)\\s+$", "").alias("answer"),
    )
    outcome = F.coalesce("fault", F.when(F.col("answer") != "", "ok").when(F.col("reasoning_chunks") > 0, "reasoning only").otherwise("empty"))
    return stats.withColumn("outcome", outcome).drop("fault")
