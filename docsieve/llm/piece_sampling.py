"""SentencePiece encoding by forward filtering, backward sampling; lossless decoding.

The lattice of a text has an edge for every vocabulary piece that matches, and byte pieces for a character that no
piece covers. No piece runs from other characters into a space mark, so the lattice falls apart into units (space marks
and the word after them), and a unit's forward pass is made once and kept (up to a bound, then made anew). Backward
sampling walks all units of a batch side by side: each step draws an incoming edge of the current node with its
posterior probability. The draws are a hash of the row key, the unit's place in the text and the step, so a row's
segmentation is the same whatever the partitioning.

The model file holds merge ranks, not probabilities: a piece of rank r weighs (r + 10) ** -``power``.

Defined results: null and empty texts have no ids; a space mark (U+2581) in a text is spelled in bytes, so that it does
not come back as a space; equal rows get equal ids; an empty table gives none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import whole_text
from docsieve.llm.token_count import _groups

MARK, LITERAL_MARK = "▁", "\udc00"  # a mark of the text itself travels as a lone surrogate, which no valid text holds
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
POWER, MOST_EDGES = 1.0, 4_000_000


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + code + np.uint64(1)
    return h * np.uint64(0x9E3779B97F4A7C15)


def _hash_of(s: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in s:
        h = _extend(h, np.array([ord(c)], np.uint64))
    return int(h[0])


class Lattice:
    """Forward-filtered lattices of the units seen so far, as flat arrays."""

    def __init__(self, path: str, power: float = POWER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.byte0 = sp.get_piece_size(), sp.piece_to_id("<0x00>")
        self.surface: list[str] = [sp.id_to_piece(i) for i in range(self.size)]
        self.piece: dict[str, tuple[int, float]] = {}
        prefixes: dict[str, int] = {}
        weights = np.zeros(self.size)
        for i, p in enumerate(self.surface):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            rank = min(-sp.get_score(i), self.size)
            weights[i] = -power * math.log(rank + 10)
            self.piece[p] = (i, weights[i])
            for k in range(1, len(p)):
                prefixes.setdefault(p[:k], -1)
            prefixes[p] = i
        self.weights = weights
        hashes = np.array([_hash_of(x) for x in prefixes], np.uint64)
        order = np.argsort(hashes)
        # Prefixes of pieces by hash, with the piece that ends there (-1: none).
        self.prefix_hash, self.prefix_token = hashes[order], np.array(list(prefixes.values()), np.int64)[order]
        self.byte_weight = -power * math.log(self.size + 10)
        self.spelled: dict[str, int] = {}
        self.bytes_of: list[list[int]] = []
        self.clear()

    def clear(self) -> None:
        self.end_node: dict[str, int] = {}
        self.nodes = 0
        self.held, self.source, self.token = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.is_start, self.first_edge = np.zeros(0, bool), np.zeros(0, np.int32)

    def _spell(self, char: str) -> int:
        """The stand-in token of a character that is spelled in bytes."""
        if char not in self.spelled:
            raw = (MARK if char == LITERAL_MARK else char).encode("utf-8", "surrogatepass")
            self.spelled[char] = self.size + len(self.bytes_of)
            self.bytes_of.append([self.byte0 + b for b in raw])
        return self.spelled[char]

    def edges(self, units: list[str], base: int) -> tuple[np.ndarray, ...]:
        """(from, to, token, log weight, place) of all edges of the units, whose nodes are numbered from ``base``."""
        sizes = np.array([len(u) for u in units], np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        stop = np.cumsum(sizes)[owner]
        here = np.arange(len(codes))
        h, length = np.zeros(len(codes), np.uint64), 0
        source, reach, token = [], [], []
        while len(here):
            h = _extend(h, codes[here + length])
            length += 1
            at = np.minimum(np.searchsorted(self.prefix_hash, h), len(self.prefix_hash) - 1)
            known = self.prefix_hash[at] == h
            t = np.where(known, self.prefix_token[at], -1)
            if length == 1:
                for k in np.flatnonzero(t < 0).tolist():
                    source.append(here[k : k + 1])
                    reach.append(1)
                    token.append(np.array([self._spell(chr(int(codes[k])))]))
            source.append(here[t >= 0])
            token.append(t[t >= 0])
            reach.append(length)
            go = known & (here + length < stop[here])
            here, h = here[go], h[go]
        length_of = np.repeat(reach, [len(x) for x in source])
        source, token = np.concatenate(source), np.concatenate(token)
        extra = np.array([self.byte_weight * len(b) for b in self.bytes_of])
        weight = np.concatenate([self.weights, extra])[token]
        start = base + source + owner[source]
        place = source - (stop - sizes[owner])[source] + length_of
        return start, start + length_of, token, weight, place

    def add(self, units: list[str]) -> None:
        """Forward-filter new units; all their places j are done at a time, for j = 1, 2, ..."""
        base = self.nodes
        source, to, token, weight, place = self.edges(units, base)
        order = np.argsort((place << 40) | ((to - base) << 5) | (to - source))
        source, to, token, weight, place = source[order], to[order], token[order], weight[order], place[order]
        first = np.cumsum([0] + [len(u) + 1 for u in units])
        filtered = np.zeros(int(first[-1]))
        share = np.zeros(len(source))
        bounds = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x = filtered[source[a:b] - base] + weight[a:b]
            begins = np.flatnonzero(np.diff(to[a:b], prepend=-1))
            many = np.diff(begins, append=b - a)
            top = np.maximum.reduceat(x, begins)
            odds = np.exp(x - np.repeat(top, many))
            total = np.add.reduceat(odds, begins)
            filtered[to[a:b][begins] - base] = top + np.log(total)
            share[a:b] = odds / np.repeat(total, many)
        order = np.argsort(((to - base) << 5) | (31 - (to - source)))  # long pieces first: they are the likely ones
        source, to, token, share = source[order], to[order], token[order], share[order]
        begins = np.flatnonzero(np.diff(to, prepend=-1))
        many = np.diff(begins, append=len(to))
        held = np.cumsum(share)
        held -= np.repeat(held[begins] - share[begins], many)
        held[begins + many - 1] = 1.0
        is_start = np.zeros(base + int(first[-1]), bool)
        is_start[:base] = self.is_start
        is_start[base + first[:-1]] = True
        self.nodes, self.is_start = len(is_start), is_start
        self.end_node.update(zip(units, (base + first[1:] - 1).tolist(), strict=True))
        edge_of = np.full(len(is_start), -1, np.int32)
        edge_of[:base] = self.first_edge
        edge_of[to[begins]] = len(self.held) + begins
        self.first_edge = edge_of
        self.held = np.concatenate([self.held, np.minimum(held, 1.0)])
        self.source = np.concatenate([self.source, source.astype(np.int32)])
        self.token = np.concatenate([self.token, token.astype(np.int32)])

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled ids of each text; ``keys`` (uint64) seed the rows."""
        units = [UNIT.findall(MARK + t.replace(MARK, LITERAL_MARK).replace(" ", MARK)) if t else [] for t in texts]
        flat = [u for us in units for u in us]
        missing = sorted(set(flat) - self.end_node.keys())
        full = (self.nodes, len(self.held)) if len(self.held) > MOST_EDGES else None
        if missing:
            self.add(missing)
        out = self._sample(texts, units, flat, keys)
        if full and missing:  # the units kept so far stay; the new ones were for this batch
            self.nodes = full[0]
            self.held, self.source, self.token = (x[: full[1]].copy() for x in (self.held, self.source, self.token))
            self.is_start, self.first_edge = self.is_start[: full[0]].copy(), self.first_edge[: full[0]].copy()
            for u in missing:
                del self.end_node[u]
        return out

    def _sample(self, texts: list[str], units: list[list[str]], flat: list[str], keys: np.ndarray) -> list[np.ndarray]:
        sizes = np.array([len(u) for u in units], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = mix(keys[doc] + mix(place.astype(np.uint64) + np.uint64(1)))
        at = np.fromiter(map(self.end_node.__getitem__, flat), np.int64, len(flat))
        who, step, rows, steps, tokens = np.arange(len(flat)), 0, [], [], []
        while len(who):
            u = (mix(seed[who] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first_edge[at]
            late = np.flatnonzero(self.held[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[self.held[edge[late]] <= u[late]]
            rows.append(who)
            steps.append(np.full(len(who), step))
            tokens.append(self.token[edge].astype(np.int64))
            at = self.source[edge].astype(np.int64)
            go = ~self.is_start[at]
            who, at, step = who[go], at[go], step + 1
        if not rows:
            return [np.zeros(0, "<u4") for _ in texts]
        row, back, token = np.concatenate(rows), np.concatenate(steps), np.concatenate(tokens)
        order = np.argsort((row << 24) - back)
        row, token = row[order], token[order]
        if (token >= self.size).any():
            long = np.ones(len(token), np.int64)
            spelled = np.flatnonzero(token >= self.size)
            long[spelled] = [len(self.bytes_of[t - self.size]) for t in token[spelled].tolist()]
            row, first = np.repeat(row, long), np.cumsum(long) - long
            out = np.repeat(token, long)
            for k in spelled.tolist():
                out[first[k] : first[k] + long[k]] = self.bytes_of[token[k] - self.size]
            token = out
        ends = np.searchsorted(doc[row], np.arange(len(texts)), side="right")
        return np.split(token.astype("<u4"), ends[:-1])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces with marks as spaces, runs of byte pieces as UTF-8, without the first space."""
        b0, surface = self.byte0, self.surface
        if any(b0 <= i < b0 + 256 for i in ids):
            parts, k = [], 0
            while k < len(ids):
                j = k
                while j < len(ids) and b0 <= ids[j] < b0 + 256:
                    j += 1
                if j > k:
                    parts.append(bytes(i - b0 for i in ids[k:j]).decode("utf-8", "surrogatepass").replace(MARK, LITERAL_MARK))
                    k = j
                else:
                    parts.append(surface[ids[k]])
                    k += 1
            text = "".join(parts)
        else:
            text = "".join(map(surface.__getitem__, ids))
        return text.replace(MARK, " ")[1:].replace(LITERAL_MARK, MARK)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _lattice(path: str, power: float) -> Lattice:
    return Lattice(path, power)


def encode_sampled(docs: DataFrame, path: str, power: float = POWER, seed: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32, lossless (decoding the ids gives the text back), and ids if ``keep_ids``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("row_key"), whole_text(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path, power)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            texts = batch.column(2).to_pylist()
            for s in _groups([len(t) for t in texts], 2_000_000) if texts else []:
                ids = lattice.encode(texts[s], keys[s])
                same = [lattice.decode(i.tolist()) == t for i, t in zip(ids, texts[s], strict=True)]
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts[s]]
                columns = [batch.column(0)[s], *(pa.array(x, pa.int64()) for x in (n_bytes, [len(i) for i in ids], [zlib.crc32(i.tobytes()) for i in ids])), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "lossless"]
                if keep_ids:
                    columns.append(pa.array([i.astype("i4") for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type}, n_bytes long, n_tokens long, ids_crc32 long, lossless boolean" + (", ids array<int>" if keep_ids else "")
    return slim.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded rows (doc_id, ids)."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path, POWER)
        for batch in batches:
            texts = [lattice.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")
