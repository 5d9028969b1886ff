"""Guards over streams of answer chunks: output budget, repeated tails, reasoning without an answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_CHARS, WINDOWS, ALIKE = 65_536, (16, 32, 64, 128, 256), 0.9
REASONING = {False: (8000, 32_000), True: (64, 256)}  # chunks and characters, by whether thinking is switched off


def repeated_tail(text: Column) -> Column:
    """Whether the end of a text is three like windows of 16, 32, 64, 128 or 256 characters."""
    n = F.length(text)

    def alike(a: Column, b: Column, size: int) -> Column:
        same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
        return F.aggregate(F.slice(same, 1, size), F.lit(0), lambda s, v: s + v) / size >= ALIKE

    found = F.lit(False)
    for size in WINDOWS:
        first, second, third = (text.substr(n - k * size + 1, F.lit(size)) for k in (3, 2, 1))
        found = found | F.coalesce((n >= 3 * size) & alike(first, second, size) & alike(first, third, size), F.lit(False))
    return found


def _tail_repeats(text: str) -> bool:
    for size in WINDOWS:
        if len(text) < 3 * size:
            break
        a, b, c = (text[len(text) - k * size : len(text) - (k - 1) * size] for k in (3, 2, 1))
        if all(sum(x == y for x, y in zip(a, other, strict=True)) / size >= ALIKE for other in (b, c)):
            return True
    return False


def step(state: dict, content: str, reasoning: str, thinking_disabled: bool) -> str:
    """Advance one request's counters by a chunk; the verdict is ``ok`` or why the stream has to stop."""
    state["chars"] += len(content)
    state["tail"] = (state["tail"] + content)[-3 * WINDOWS[-1] :]
    if content:
        state["answered"] = True
    elif reasoning and not state["answered"]:
        state["chunks"] += 1
        state["thought"] += len(reasoning)
    chunks, chars = REASONING[thinking_disabled]
    if state["chars"] > MOST_CHARS:
        return "too long"
    if content and _tail_repeats(state["tail"]):
        return "repeats"
    if not state["answered"] and (state["chunks"] >= chunks or state["thought"] >= chars):
        return "no answer"
    return "ok"


OUTPUT = "request_id string, seq long, chars long, verdict string"
STATE = "chars long, tail string, answered boolean, chunks long, thought long, stopped boolean"


def watch(chunks: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """``chunks`` (request_id, seq, content, reasoning, thinking_disabled) as a stream -> verdict of each chunk until a
    request is stopped. State per request has a fixed size and goes after an hour without a chunk. For streams that go on:
    as state waits for the clock, batches without data never end by themselves."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names = ("chars", "tail", "answered", "chunks", "thought", "stopped")
        held = dict(zip(names, state.get, strict=True)) if state.exists else dict(zip(names, (0, "", False, 0, 0, False), strict=True))
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if held["stopped"]:
                break
            verdict = step(held, row.content or "", row.reasoning or "", bool(row.thinking_disabled))
            held["stopped"] = verdict != "ok"
            out.append((key[0], row.seq, held["chars"], verdict))
        state.update(tuple(held[n] for n in names))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["request_id", "seq", "chars", "verdict"])

    return chunks.groupBy("request_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def daily_counts(tasks: DataFrame, late: str = "1 day") -> DataFrame:
    """Tasks per day and status of a stream, closed once the watermark has passed the day."""
    return tasks.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("day"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("day.start").alias("day"), "status", "n")
