"""Runs of words that repeat with a period, at least four times over, and texts without the repetitions.

A run with period q of [B, 2B), B a power of two, has 4q words at least, so before its last period there lie two
neighbouring blocks of B words aligned to multiples of B, and both occur again q words on. Per scale B the aligned blocks
become integer-sequence keys of an Aho-Corasick automaton (pyahocorasick), the words are searched with it, and pairs of
neighbouring blocks that both occur again at the same distance from [B, 2B) are seeds: from there the run is extended in
both directions, word by word. Scales go up, so a stretch inside a run of a smaller period seeds nothing (its distances are
multiples of that period), which keeps the number of seeds in proportion to words / B.

Blocks can only seed if each of their words comes again within 2B words; the others are never put into the automaton, nor
is what lies out of their reach searched. Keys longer than KEY words are cut to KEY (extension decides), and an automaton
holds the blocks of WINDOW words, so its memory is bounded however long a text is. Texts of a batch are handled side by
side, with a separator of its own after each, which no run can contain.

Defined results: null, empty and blank texts have no words and no run; repeated rows are answered each; a text of a null
doc_id is taken as it is; an empty table gives none; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import whole_text
from docsieve.llm.token_count import _groups

TIMES, LEAST = 4, 6
KEY, WINDOW, TOGETHER = 1024, 1 << 19, 4_000_000


def _next_distance(w: np.ndarray) -> np.ndarray:
    """How far on each word comes again (the length where it does not)."""
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    out = np.full(len(w), len(w), np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _same_ahead(w: np.ndarray, at: int, d: int) -> int:
    """How many words from ``at`` on equal the word d later."""
    n, step = 0, 64
    while at + n + d < len(w):
        a, b = w[at + n : at + n + step], w[at + n + d : at + n + d + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            return n + int(differ[0])
        n, step = n + len(b), 2 * step
    return n


def _same_behind(w: np.ndarray, at: int, d: int) -> int:
    """How many words before ``at`` equal the word d later."""
    n, step = 0, 64
    while n < at:
        a = max(0, at - n - step)
        differ = np.flatnonzero(w[a : at - n] != w[a + d : at - n + d])
        if len(differ):
            return at - n - a - 1 - int(differ[-1]) + n
        n, step = at - a, 2 * step
    return n


def _seeds(w: np.ndarray, pairs: np.ndarray, scale: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block begin, distance) where a block and its right neighbour both occur again at that distance of [scale, 2 * scale)."""
    key = min(scale, KEY)
    out_x, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for window in np.split(pairs, np.flatnonzero(np.diff(pairs // max(WINDOW, 16 * scale))) + 1):
        if not len(window):
            continue
        blocks = np.unique(np.concatenate([window, window + scale]))
        automaton, number = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
        names = np.zeros(len(blocks), np.int64)
        for j, x in enumerate(blocks.tolist()):
            words = tuple(w[x : x + key].tolist())
            names[j] = number.setdefault(words, len(number))
            automaton.add_word(words, int(names[j]))
        automaton.make_automaton()
        # where a block may occur again: from its begin + scale to its end + 2 * scale; what overlaps is searched once
        begins, ends = blocks + scale, np.minimum(blocks + 2 * scale + key, len(w))
        cut = np.flatnonzero(begins[1:] > ends[:-1]) + 1
        base = int(begins[0])
        found = np.full(int(ends[-1]) - base + 1, -1, np.int64)
        for a, b in zip(begins[np.concatenate([[0], cut])].tolist(), ends[np.concatenate([cut - 1, [len(ends) - 1]])].tolist(), strict=True):
            hits = list(automaton.iter(tuple(w[a:b].tolist())))
            if hits:
                place, name = np.array(hits, np.int64).T
                found[place + (a - base - key + 1)] = name
        mine, right = names[np.searchsorted(blocks, window)], names[np.searchsorted(blocks, window + scale)]
        per = max(1, 4_000_000 // scale)
        for k in range(0, len(window), per):
            x = window[k : k + per]
            d = np.arange(scale, 2 * scale)
            there = x[:, None] + d[None, :] - base
            inside = there + scale < len(found)
            first = np.where(inside, found[np.minimum(there, len(found) - 1)], -1) == mine[k : k + per, None]
            second = np.where(inside, found[np.minimum(there + scale, len(found) - 1)], -1) == right[k : k + per, None]
            stop, held = x[:, None] + d[None, :] + 2 * scale, reach[x][:, None]
            row, col = np.nonzero(first & second & (stop > held) & (stop <= len(w)))
            row, far = x[row], d[col]
            # where a run of a smaller period ends, the word must come again too (keys may be cut and not tell)
            edge = reach[row]
            ok = (edge - far < row) | (w[np.minimum(edge, len(w) - 1)] == w[np.maximum(edge - far, 0)])
            out_x.append(row[ok])
            out_d.append(far[ok])
    return np.concatenate(out_x), np.concatenate(out_d)


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the word numbers, by start, then period."""
    found: list[tuple[int, int, int]] = []
    if len(w) < LEAST:
        return found
    again = _next_distance(w)
    reach = np.zeros(len(w), np.int64)  # where the furthest run of a smaller period ends that holds the word
    scale = 1
    while TIMES * scale <= len(w):
        blocks = np.arange(0, len(w) - scale + 1, scale)
        close = np.maximum.reduceat(again, np.append(blocks, len(w) - len(w) % scale) if len(w) % scale else blocks)[: len(blocks)] < 2 * scale
        x = blocks[:-1][close[:-1] & close[1:]]
        x = x[reach[x] < x + 4 * scale]
        if len(x):
            x, d = _seeds(w, x, scale, reach)
            new = []
            for q in np.unique(d).tolist():
                at = np.sort(x[d == q])
                k = 0
                while k < len(at):
                    begin = int(at[k])
                    ahead = _same_ahead(w, begin, q)
                    start = begin - _same_behind(w, begin, q)
                    end = begin + ahead + q
                    if end - start >= max(LEAST, TIMES * q) and reach[start] < end:
                        new.append((start, end - start, q))
                    k = max(k + 1, int(np.searchsorted(at, begin + ahead)))
            for start, length, _ in new:  # after the scale: periods of one scale are never multiples of each other
                np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])
            found += new
        scale *= 2
    return sorted(found)


def planted(words: np.ndarray, doc_id) -> np.ndarray:
    """Every tenth document, by crc32 of its id, with the words from a place on replaced by a repetition."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i < a, i, a + (i - a) % p)]


def _numbered(texts: list[str], ids: list, plant: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts with a separator of its own after each, the texts' first places, and the words."""
    number: dict[bytes, int] = {}
    parts = []
    for text, doc_id in zip(texts, ids, strict=True):
        w = text.encode("utf-8", "surrogatepass").split()  # bytes split at space and 0x09 to 0x0D, nothing else
        w = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
        parts.append(planted(w, doc_id) if plant else w)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    joined = np.empty(begins[-1], np.int64)
    for k, (b, p) in enumerate(zip(begins.tolist(), parts, strict=False)):
        joined[b : b + len(p)] = p
        joined[b + len(p)] = len(number) + k
    return joined, begins, list(number)


def find_runs(docs: DataFrame, column: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period), collapsed: the words that are left, joined by a
    space, when each run keeps its first period only. ``plant`` first repeats words in a tenth of the documents."""
    slim = docs.select("doc_id", whole_text(column).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def answer(texts: list[str], ids: list) -> tuple[list, list]:
        w, begins, words = _numbered(texts, ids, plant)
        all_runs = runs(w)
        drop = np.zeros(len(w) + 1, np.int64)
        for start, length, period in all_runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        keep = np.cumsum(drop)[:-1] == 0
        owner = np.searchsorted(begins, [r[0] for r in all_runs], side="right") - 1
        per_text: list[list] = [[] for _ in texts]
        for (start, length, period), k in zip(all_runs, owner.tolist(), strict=True):
            per_text[k].append({"start": start - int(begins[k]), "length": length, "period": period})
        left = []
        for b, e in zip(begins[:-1].tolist(), (begins[1:] - 1).tolist(), strict=True):
            left.append(b" ".join(map(words.__getitem__, w[b:e][keep[b:e]].tolist())).decode("utf-8", "surrogatepass"))
        return per_text, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for s in _groups(sizes, TOGETHER) if sizes else []:
                part = batch.slice(s.start, s.stop - s.start)
                found, left = answer(part.column(1).to_pylist(), part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(item)), pa.array(left, pa.string())], names=["doc_id", "runs", "collapsed"])

    return slim.mapInArrow(run, f"doc_id {id_type}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, its longest run (ties: smallest start, then period), and digests of the runs and of the text that is left."""
    found = find_runs(docs, plant=True)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.order")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("*", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
