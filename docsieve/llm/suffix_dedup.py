"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays over owner groups.

1. Equal texts become one row with a count. Texts are told apart by 128 bits of hash.
2. Every 200-byte window of a text has one anchor: the 32-byte gram with the smallest hash in it (the leftmost of
   equals). Equal windows have equal anchors at the same place, so the work falls apart by anchor. Neighbouring windows
   with one anchor form a *stretch*. An anchor that occurs once holds no repeat. Where all stretches of an anchor are
   equal (128 bits of hash and the anchor), all their windows repeat.
3. For the other anchors one copy of each distinct stretch is fetched from its text. An owner task takes whole groups of
   at most ``GROUP`` stretches and builds the suffix array over the bytes of each group; neighbours in it that agree in
   200 bytes are repeats.
4. A group with more stretches is split, exactly: its windows are dealt out by their distance to the anchor into
   narrower cells (``WIDTHS``), and all bytes that the windows of a cell have in common are the key of the new groups.
   Equal windows share the cell and the key, so none is lost; parts that are equal are merged. Only groups that are
   still too large are split again. The narrowest cell is one window, whose key is the window itself.
5. The windows found are gathered by text; a byte goes if any of them covers it.

The suffix arrays are built by linear grouping: suffixes are grouped by Lyndon prefix, groups are processed in
descending order along previous-smaller pointers, and a second pass emits each group's order; there is no recursion and
no renaming. All groups of a batch advance side by side, one step of each at a time.

Texts cross the network compressed. Defined results: null counts as empty; texts shorter than the window lose nothing; a
repeated row counts as another document, whatever its id; ids do not matter and may be null; an empty table gives none.
A removal may cut a multi-byte character; ``remove_repeats`` drops its remains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.common import persist_table, scratch, whole_text
from docsieve.llm.piece_sampling import mix

WINDOW, GRAM, GROUP = 200, 32, 64
SIDE = WINDOW - GRAM
WIDTHS = (SIDE + 1, 43, 11, 3, 1)  # of the cells, by how often a group was split
POSITION_BITS = 20
STEP = (1 << POSITION_BITS) - WINDOW
BATCH = 1_000_000  # bytes whose suffix arrays are built side by side


def _groups_in_descent(order: np.ndarray, group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """First pass: refine the groups of all texts in place; returns the previous smaller suffix of each (-1: none).

    A group is named by its first place in ``order``, so names compare as the groups do. ``group`` has one element more,
    below all names, which -1 points to.
    """
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    size = np.bincount(group[:-1], minlength=n)
    before = np.arange(-1, n - 1)
    before[begin] = -1
    smaller = np.full(n + 1, -1)
    chosen = np.zeros(n, bool)
    high, low = end - 1, begin
    high, low = high[high > low], low[high > low]
    while len(high):
        own = group[order[high]]
        many = high - own + 1
        ends = np.cumsum(many)
        members = order[np.repeat(own - ends + many, many) + np.arange(ends[-1])]
        mine = np.repeat(own, many)
        p = before[members]
        todo = (group[p] > mine).nonzero()[0]
        while len(todo):
            p[todo] = smaller[p[todo]]
            todo = todo[group[p[todo]] > mine[todo]]
        smaller[members] = p
        todo = (group[p] == mine).nonzero()[0]
        while len(todo):  # members of one group pass on what they point to, which doubles the reach
            p[todo] = smaller[p[todo]]
            smaller[members[todo]] = p[todo]
            todo = todo[group[p[todo]] == mine[todo]]
        p = np.sort(p[p >= 0])
        if len(p):
            first = (p[1:] != p[:-1]).nonzero()[0] + 1
            first = np.concatenate(([0], first))
            counts = np.append(first[1:], len(p)) - first
            p = p[first]
            g = group[p]
            if len(p) > 1:
                by = np.lexsort((counts, g))
                p, g, counts = p[by], g[by], counts[by]
            fresh = np.ones(len(g), bool)
            fresh[1:] = g[1:] != g[:-1]
            at = fresh.nonzero()[0]
            taken = np.append(at[1:], len(g)) - at
            base = np.repeat(g[at] + size[g[at]] - taken, taken)
            slot = base + np.arange(len(g)) - np.repeat(at, taken)
            # The chosen ones move to the end of their group, those with more members behind them last.
            chosen[p] = True
            there, left = order[slot], place[p]
            displaced, left = there[~chosen[there]], left[left < base]
            order[left], place[displaced] = displaced, left
            order[slot], place[p] = p, slot
            chosen[p] = False
            fresh[1:] |= counts[1:] != counts[:-1]
            sub = fresh.nonzero()[0]
            sizes = np.append(sub[1:], len(g)) - sub
            group[p] = np.repeat(slot[sub], sizes)
            size[g[at]] -= taken
            size[slot[sub]] = sizes
        high = own - 1
        go_on = high > low
        if not go_on.all():
            high, low = high[go_on], low[go_on]
    return smaller


def _emitted(group: np.ndarray, smaller: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Second pass: each suffix met in order puts the one before it, and the chain of its smaller ones, next in their groups."""
    n = len(group) - 1
    out, free = np.full(n, -1), np.arange(n)
    out[begin] = end - 1
    placed = np.zeros(n + 1, bool)
    placed[end - 1] = placed[n] = True
    before = np.arange(-1, n - 1)
    before[begin] = -1
    k, stop = begin.copy(), end
    j = before[out[k]]
    while len(k):
        done = placed[j]
        put, step = (~done).nonzero()[0], done.nonzero()[0]
        if len(put):
            new = j[put]
            g = group[new]
            f = free[g]
            out[f] = new
            free[g] = f + 1
            placed[new] = True
            j[put] = smaller[new]
        if len(step):
            at = k[step] + 1
            k[step] = at
            ended = at == stop[step]
            if ended.any():
                left = k < stop
                j[step[~ended]] = before[out[at[~ended]]]
                k, stop, j = k[left], stop[left], j[left]
            else:
                j[step] = before[out[at]]
    return out


def suffix_arrays(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffix arrays of several texts, each at its own place; a text is symbols[begin:end] and ends in a 0 that it
    has nowhere else."""
    n = len(symbols)
    key = np.repeat(np.arange(len(begin)) * (int(symbols.max(initial=0)) + 1), end - begin) + symbols
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    del key
    group = np.full(n + 1, -1)
    group[order] = np.repeat(first, np.diff(first, append=n))
    return _emitted(group, _groups_in_descent(order, group, begin, end), begin, end)


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of a sequence of non-negative integers (the end counts as smaller than all of them)."""
    if not symbols:
        return []
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    return suffix_arrays(text, np.array([0]), np.array([len(text)]))[1:].tolist()


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram, by doubling."""
    h, width = mix(b.astype(np.uint64)), 1
    while width < GRAM:
        h = (h[:-width] * np.uint64(0xBF58476D1CE4E5B9)) ^ h[width:]
        h = h * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def stretches(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the anchor, hash of the anchor) of each stretch of a text."""
    found = []
    for base in range(0, max(1, len(raw) - WINDOW + 1), STEP):
        b = np.frombuffer(raw, np.uint8)[base : base + STEP + WINDOW - 1]
        if len(b) < WINDOW:
            break
        h = gram_hashes(b)
        low = np.uint64((1 << POSITION_BITS) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least, width = key, 1
        span = WINDOW - GRAM + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(h) - span + 1], least[span - width :])
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        found.append((first + base, np.diff(first, append=len(anchor)), anchor[first] + base, h[anchor[first]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _key(text: Column) -> list[Column]:
    """Two numbers that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def digests(parts: list[bytes]) -> np.ndarray:
    """A row of two numbers, 128 bits of hash, for each string."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


def _packed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, k1, k2 and the text as compressed bytes."""
    slim = docs.select(*keep, "k1", "k2", "text")
    schema = T.StructType([*[slim.schema[c] for c in (*keep, "k1", "k2")], T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = [squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary())], names=[*batch.schema.names[:-1], "z"])

    return slim.mapInArrow(run, schema)


def _stretch_rows(texts: DataFrame) -> DataFrame:
    """(k1, k2, m, first, run, off, anchor, c1, c2) of all stretches; c1 and c2 hash the stretch's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            who, parts, contents = [], [], []
            for k, z in enumerate(batch.column(3).to_pylist()):
                raw = opened(z)
                if len(raw) < WINDOW:
                    continue
                first, many, anchor, h = stretches(raw)
                who.append(np.full(len(first), k))
                parts.append((first, many, anchor - first, h))
                contents.append(digests([raw[f : f + m + WINDOW - 1] for f, m in zip(first.tolist(), many.tolist(), strict=True)]))
            if not who:
                continue
            who = pa.array(np.concatenate(who))
            first, many, off, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            c = np.concatenate(contents)
            columns = [*(batch.column(i).take(who) for i in range(3)), pa.array(first.astype(np.int32)), pa.array(many.astype(np.int16)), pa.array(off.astype(np.int16)), pa.array(h), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "m", "first", "run", "off", "anchor", "c1", "c2"])

    return texts.select("k1", "k2", "m", "z").mapInArrow(run, "k1 long, k2 long, m long, first int, run short, off short, anchor long, c1 long, c2 long")


def _fetch(joined: DataFrame) -> DataFrame:
    """Bytes of the wanted stretches: anchor, c1, c2, n, off, run, s."""
    names = ["anchor", "c1", "c2", "n", "off", "run"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            opened = zstandard.ZstdDecompressor().decompress
            for z, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = opened(z)
                out += [(*(w[c] for c in names), raw[w["first"] : w["first"] + w["run"] + WINDOW - 1]) for w in want]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*names, "s"])

    return joined.select("z", "want").mapInArrow(run, "anchor long, c1 long, c2 long, n long, off short, run short, s binary")


def _mask(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def repeated_windows(anchor: np.ndarray, many: np.ndarray, run: np.ndarray, s: list[bytes]) -> list[bytes]:
    """For each distinct stretch of whole anchor groups (in order of anchor), a bit per window: set if it occurs elsewhere."""
    lengths = np.array([len(x) + 1 for x in s])
    stop = np.cumsum(lengths)
    start = stop - lengths
    raw = np.frombuffer(b"\0".join(s) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + 2
    symbols[stop - 1] = 1
    last = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True))
    end = stop[last]
    symbols[end - 1] = 0
    order = suffix_arrays(symbols, np.concatenate(([0], end[:-1])), end)
    weight = np.zeros(len(raw), np.int64)  # 0: no window starts here
    ends = np.cumsum(run)
    weight[np.repeat(start - ends + run, run) + np.arange(ends[-1])] = np.repeat(np.minimum(many, 2), run)
    ranked = weight[order]
    near = np.flatnonzero((ranked[1:] > 0) & (ranked[:-1] > 0)) + 1
    window = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(WINDOW, np.uint8)), WINDOW)
    differs = np.ones(len(order), bool)
    for at in range(0, len(near), 1 << 14):
        some = near[at : at + (1 << 14)]
        differs[some] = (window[order[some]] != window[order[some - 1]]).any(axis=1)
    kind = np.cumsum(differs) - 1
    marked = np.zeros(len(raw), bool)
    marked[order] = (np.bincount(kind, ranked)[kind] > 1) & (ranked > 0)
    return [_mask(marked[b : b + m]) for b, m in zip(start.tolist(), run.tolist(), strict=True)]


def _solved(found: DataFrame) -> DataFrame:
    """(anchor, c1, c2, mask) of the stretches that hold a repeat; groups are small."""
    columns = ["anchor", "c1", "c2", "n", "run", "s"]

    def solve(a: list, c1: list, c2: list, n: list, r: list, s: list) -> pa.RecordBatch:
        masks = repeated_windows(np.array(a), np.array(n), np.array(r, np.int64), s)
        keep = [k for k, m in enumerate(masks) if any(m)]
        return pa.RecordBatch.from_arrays([*(pa.array([x[k] for k in keep], pa.int64()) for x in (a, c1, c2)), pa.array([masks[k] for k in keep], pa.binary())], names=["anchor", "c1", "c2", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in columns]
        n_bytes = 0
        for batch in batches:
            for to, col in zip(held, batch.columns, strict=True):
                to += col.to_pylist()
            n_bytes = sum(map(len, held[-1]))
            while n_bytes > BATCH:
                k, size = 0, 0
                while k < len(held[0]) and size < BATCH:
                    size += len(held[-1][k])
                    k += 1
                while k and (k == len(held[0]) or held[0][k] == held[0][k - 1]):  # the last group may go on
                    k -= 1
                if not k:
                    break
                yield solve(*(x[:k] for x in held))
                held = [x[k:] for x in held]
                n_bytes = sum(map(len, held[-1]))
        if held[0]:
            yield solve(*held)

    return found.select(*columns).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, c1 long, c2 long, mask binary")


def cells(level: int, off: int, run: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(cell, first window, end of windows, bytes of the key left and right of the anchor) of a stretch's parts."""
    width = WIDTHS[level]
    for cell in range((off - run + 1) // width, off // width + 1):
        least, most = cell * width, min((cell + 1) * width - 1, SIDE)
        yield cell, off - min(most, off), off - max(least, off - run + 1) + 1, least, WINDOW - most


def _split(found: DataFrame, level: int) -> DataFrame:
    """The stretches' parts by cell: the stretch (u0, u1, u2), the first window t, and the part as a stretch of its own."""
    names = ["u0", "u1", "u2", "t", "anchor", "c1", "c2", "n", "off", "run", "s"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, c1, c2, n, off, many, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for cell, t, stop, left, right in cells(level, off, many):
                    part, key = s[t : stop + WINDOW - 1], s[off - left : off + right]
                    one, two = digests([part])[0].tolist()
                    out.append((a, c1, c2, t, digests([key + bytes((level, cell))])[0, 0].item(), one, two, n, off - t, stop - t, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "u0 long, u1 long, u2 long, t short, anchor long, c1 long, c2 long, n long, off short, run short, s binary"
    return found.select("anchor", "c1", "c2", "n", "off", "run", "s").mapInArrow(run, schema)


def _joined_masks(parts: DataFrame) -> DataFrame:
    """Parts' masks (null: all windows), gathered by stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for those in batch.column(3).to_pylist():
                bits = np.zeros(SIDE + 1, np.uint8)
                for p in those:
                    t, n = p["t"], p["run"]
                    bits[t : t + n] = 1 if p["mask"] is None else np.unpackbits(np.frombuffer(p["mask"], np.uint8), bitorder="little")[:n]
                masks.append(_mask(bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(masks, pa.binary())], names=["anchor", "c1", "c2", "mask"])

    gathered = parts.groupBy("u0", "u1", "u2").agg(F.collect_list(F.struct("t", "run", "mask")).alias("parts"))
    return gathered.mapInArrow(run, "anchor long, c1 long, c2 long, mask binary")


def _masks(found: DataFrame, group: int, level: int = 0) -> DataFrame:
    """(anchor, c1, c2, mask) of the distinct stretches ``found``: small groups by suffix array, larger ones split first."""
    crowds = persist_table(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > group).select("anchor"), "repeats-crowds")
    if crowds.isEmpty():
        return _solved(found)
    parts = persist_table(_split(found.join(crowds, "anchor", "left_semi"), level + 1), "repeats-parts")
    kinds = parts.groupBy("anchor", "c1", "c2").agg(F.sum("n").alias("n"), F.first("off").alias("off"), F.first("run").alias("run"), F.first("s").alias("s"))
    kinds = persist_table(kinds, "repeats-kinds")
    keys = persist_table(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.max("c1").alias("c1"), F.max("c2").alias("c2")), "repeats-keys")
    whole = keys.filter("kinds = 1 and n > 1").select("anchor", "c1", "c2", F.lit(None).cast("binary").alias("mask"))
    mixed = persist_table(kinds.join(keys.filter("kinds > 1").select("anchor"), "anchor", "left_semi"), "repeats-mixed")
    masks = persist_table(whole.unionByName(_masks(mixed, group, level + 1)), "repeats-masks")
    up = _joined_masks(parts.select("u0", "u1", "u2", "t", "run", "anchor", "c1", "c2").join(masks, ["anchor", "c1", "c2"]))
    return _solved(found.join(crowds, "anchor", "left_anti")).unionByName(up)


def find_repeats(keyed: DataFrame, group: int = GROUP) -> DataFrame:
    """``keyed`` (k1, k2, text) -> k1, k2, spans: for each text with repeats, its (first, run, mask) stretches; a null
    mask means all windows of the stretch."""
    with scratch(keyed.sparkSession):
        texts = persist_table(_packed(keyed, []).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m"), F.first("z").alias("z")), "repeats-texts")
        rows = persist_table(_stretch_rows(texts), "repeats-stretches")
        mixed = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
        anchors = rows.groupBy("anchor").agg(F.sum("m").alias("n"), mixed.alias("mixed")).filter("n > 1").select("anchor", "mixed")
        # A table of its own: the join then has a plain exchange on both sides, and Spark can split a very common anchor.
        anchors = persist_table(anchors, "repeats-anchors")
        held = persist_table(rows.join(anchors, "anchor"), "repeats-held")
        distinct = held.filter("mixed").groupBy("anchor", "c1", "c2").agg(F.sum("m").alias("n"), F.min(F.struct("k1", "k2", "first", "off", "run")).alias("at"))
        want = distinct.select("at.k1", "at.k2", F.struct("anchor", "c1", "c2", "n", "at.first", "at.off", "at.run").alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("want"))
        found = persist_table(_fetch(texts.join(want, ["k1", "k2"])), "repeats-bytes")
        masks = persist_table(_masks(found, group), "repeats-masks")
        marked = held.join(masks, ["anchor", "c1", "c2"], "left").filter("not mixed or mask is not null")
        return persist_table(marked.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "run", "mask")).alias("spans")), "repeats-spans", keep=True)


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n bytes a repeated window covers."""
    change = np.zeros(n + 1, np.int32)
    for s in spans or []:
        f, m = s["first"], s["run"]
        if s["mask"] is None:
            change[f] += 1
            change[f + m - 1 + WINDOW] -= 1
        else:
            at = f + np.flatnonzero(np.unpackbits(np.frombuffer(s["mask"], np.uint8), bitorder="little")[:m])
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change)[:n] > 0


def _with_spans(docs: DataFrame, text_col: str, group: int) -> DataFrame:
    """row (all other columns), z (compressed text), spans of each document."""
    text = whole_text(text_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    keyed = docs.select(F.struct(*others).alias("row"), *_key(text), text.alias("text"))
    spans = find_repeats(keyed.select("k1", "k2", "text"), group)
    return _packed(keyed, ["row"]).join(spans, ["k1", "k2"], "left").select("row", "z", "spans")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    joined = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", group)
    row_type = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = opened(z)
                if spans:
                    gone = covered(len(raw), spans)
                    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                else:
                    left, runs = raw, 0
                out.append((len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = joined.mapInArrow(run, f"row {row_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text; an ``n_chars`` column
    follows the text."""
    joined = _with_spans(docs, text_col, group)
    schema = T.StructType([joined.schema["row"], T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = []
            for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = opened(z)
                if spans:
                    raw = np.frombuffer(raw, np.uint8)[~covered(len(raw), spans)].tobytes()
                texts.append(raw.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "kept"])

    own = {text_col: F.col("kept").alias(text_col)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return joined.mapInArrow(run, schema).select(*[own.get(c, F.col(f"row.`{c}`")) for c in docs.columns])
