"""Streams: guards with state, daily counts with a watermark, frames of answers; decoding of files; greedy terms."""

from __future__ import annotations

import datetime
import json

import duckdb
from pyspark.sql import functions as F

from docsieve.operators import operations as O
from docsieve.operators import terms as T
from docsieve.plans import twins
from docsieve.sources.tables import decoded
from docsieve.streaming import frames, guards


def streamed(spark, df, folder, plan, mode="append"):
    """The rows that a streaming plan gives for a table, read file by file. Batches without data are off: state that waits
    for the clock would ask for them without end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = f"out_{abs(hash(str(folder)))}"
    run = plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).collect()


def test_watch_stops_repeats_length_and_reasoning(spark, tmp_path):
    rows = [("plain", k, f"chunk {k} ", "", True) for k in range(4)]
    rows += [("repeat", k, "abcdefgh" * 6, "", True) for k in range(3)]
    rows += [("thinking", k, "", "r" * 100, True) for k in range(5)]
    rows += [("allowed", k, "", "r" * 100, False) for k in range(5)]
    rows += [("long", k, "".join(chr(33 + (k * 7919 + i * i * 31 + i // 90) % 9000) for i in range(30_000)), "", True) for k in range(4)]
    df = spark.createDataFrame(rows, "request_id string, seq long, content string, reasoning string, thinking_disabled boolean").coalesce(1)
    seen: dict = {}
    for r in streamed(spark, df, tmp_path, guards.watch):
        seen.setdefault(r.request_id, []).append((r.seq, r.verdict))
    last = {k: max(v) for k, v in seen.items()}
    assert last == {"plain": (3, "ok"), "repeat": (0, "repeats"), "thinking": (2, "no answer"), "allowed": (4, "ok"), "long": (2, "too long")}
    assert all(v == "ok" for k in seen for _, v in sorted(seen[k])[:-1])


def test_daily_counts(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, d, h), s) for d, h, s in [(1, 1, "a"), (1, 5, "a"), (1, 9, "b"), (2, 1, "a")]]
    got = streamed(spark, spark.createDataFrame(rows, "created_at timestamp, status string").coalesce(1), tmp_path, guards.daily_counts, "complete")
    assert {(r.day.day, r.status, r.n) for r in got} == {(1, "a", 2), (1, "b", 1), (2, "a", 1)}


LINES = [
    ("a", 1, ": keep-alive"), ("a", 2, "event: message"), ("a", 3, ""), ("a", 4, None),
    ("a", 5, 'data: {"choices":[{"delta":{"reasoning":"hm","content":""}}]}'), ("a", 6, 'data:{"choices":[{"delta":{"content":" hi"},"finish_reason":null}]}'),
    ("a", 7, '{"choices":[{"message":{"content":" you "},"finish_reason":"stop"}]}'), ("a", 8, "data: [DONE]"), ("a", 9, "no json"),
    ("b", 1, 'data: {"error":{"message":"busy"}}'), ("c", 1, "oops"), ("d", 1, 'data: {"success":false,"msg":"denied"}'),
    ("e", 1, 'data: {"choices":[{"delta":{"reasoning_text":"only"}}]}'), ("f", 1, 'data: {"choices":[{"delta":{"tool_calls":[{"id":1}],"content":["x"]},"finish_reason":"tool_calls"}]}'), ("g", 1, "data: 5"),
    ("h", 1, 'data: {"error":"x' + "y" * 400 + '"}'),
]


def test_frames(spark):
    lines = spark.createDataFrame(LINES, "request_id string, seq int, line string")
    read = frames.read_frames(lines)
    faults = {r.request_id: (r.kind, r.error) for r in read.filter("kind in ('bad', 'error') and request_id <> 'a'").collect()}
    assert faults == {"b": ("error", "busy"), "c": ("bad", None), "d": ("error", "denied"), "h": ("error", "x" + "y" * 299 + "...")}
    got = {r.request_id: r for r in frames.chunk_statistics(read).collect()}
    a = got["a"]
    assert (a.frames, a.done, a.content_chunks, a.content_chars, a.reasoning_chunks, a.reasoning_fields, a.finish_reasons, a.answer) == (3, True, 2, 8, 1, "reasoning", "stop", "hi you")
    assert {k: v.outcome for k, v in got.items()} == {"a": "ok", "b": "error", "c": "bad", "d": "error", "e": "reasoning only", "f": "empty", "g": "empty", "h": "error"}
    assert (got["f"].tool_call_chunks, got["f"].finish_reasons, got["g"].frames) == (1, "tool_calls", 1)


def test_frames_of_a_stream(spark, tmp_path):
    lines = spark.createDataFrame(LINES, "request_id string, seq int, line string")
    got = streamed(spark, lines, tmp_path, frames.read_frames)
    assert sorted(map(repr, got)) == sorted(map(repr, frames.read_frames(lines).collect()))


def test_decoded(spark):
    rows = [("中文".encode(),), ("中文".encode("gb18030"),), (b"\xef\xbb\xbfa",), (b"\xff",), (None,), (b"",)]
    df = spark.createDataFrame(rows, "c binary")
    assert [r[0] for r in df.select(decoded(F.col("c"))).collect()] == ["中文", "中文", "﻿a", None, None, ""]
    assert [r[0] for r in df.select(decoded(F.col("c"), keep_mark=False)).collect()][2] == "a"


def test_batches_of_a_large_group(spark):
    rows = [("hot" if k % 3 else None, k * 37 % 1009) for k in range(1009)]
    df = spark.createDataFrame(rows, "g string, k int")
    got: dict = {}
    for r in O.batches(df, ["g"], ["k"], 5).collect():
        got.setdefault(r.g, []).append((r.k, r.batch))
    assert sum(map(len, got.values())) == len(rows)
    assert all([b for _, b in sorted(v)] == [i // 5 for i in range(len(v))] for v in got.values())
    assert O.batches(df.limit(0), ["g"], ["k"], 5).collect() == []


def test_greedy_terms_that_overlap(spark):
    texts = ["new york city hall", "New York city and new york", "city hall city", "york city hall york city hall", "", "hall new  york"]
    rules = [T.CommonRule("NY", ("new york", "york city")), T.CommonRule("City Hall", ("city hall",)), T.CommonRule("York City Hall", ("york",))]
    pairs = [(r.standard, t, "discouraged") for r in rules for t in r.discouraged] + [(r.standard, r.standard, "case") for r in rules]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, T.common_matches(df, rules).select("doc_id", "observed", "standard", "kind", "hits", "first_pos").collect()))
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents AS SELECT * FROM (SELECT unnest(?) AS doc_id, unnest(?) AS text)", [list(range(len(texts))), texts])
        assert got == sorted(db.execute(twins.common_terms(pairs)).fetchall())
    assert json.dumps(got).count("york city") >= 1
