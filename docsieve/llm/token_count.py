"""Token counts by a compiled finite-state transducer.

Two transducers work one after the other.

* Words: the tokenizer's splitting rule is a deterministic transducer over ten character classes and six states. Its
  transitions say where words start. A batch of texts is laid out as equal chunks; for every chunk the map "state before
  -> state after" is computed for all six states at once, the maps compose in a parallel prefix scan, and a second sweep
  from the now known states writes the annotations down.
* Tokens: the vocabulary's merges are compiled into a deterministic transducer over the bytes of a word. A sequence of
  tokens is what the merges give if and only if each two neighbours are. So the tokens of a prefix are known from the last
  token at every earlier place, and only places that some token may still reach over count: a state is the longest suffix
  that begins a token, with the last token and the count at each place in it. A transition carries the number of tokens
  that the byte adds (which may be none or negative); the last byte of a word has transitions of its own. Transitions are
  compiled when first needed and kept, up to ``STATES`` states and ``WORDS`` words, then compiled anew; counts do not
  depend on that. A word start leads to the first state from any other, so chunk maps need no more than the words.

The library takes no part. The vocabulary file must be a lower-casing word-end BPE (NFC, white space collapsed,
contractions split off); the driver reads it once and sends the tables to the executors.

Defined results: null counts as empty, which has no token; a null doc_id stays null; repeated rows are counted each;
an empty table gives none. Special strings inside a text count one token each, as the library takes them by default.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import whole_text

SPACE, LETTER, NUMBER, OTHER, QUOTE, ENDER, ARR, VEE, ELL, EE = range(10)
BETWEEN, WORD, RUN, QUOTED, NEEDS_E, NEEDS_L = range(6)
STARTS, STARTED_BEFORE = 1, 2  # annotations of a transition: a token starts here, or started one character earlier
CHUNK, WORDS, STATES = 256, 1_000_000, 2_000_000
END = "\u0100"  # follows the last byte of a word in the tokens' spelling, where bytes are U+0000 to U+00FF


# Lower-case forms of capitals that are newer than the tables of Python's own lower().
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
_NEW = frozenset(map(chr, NEW_CAPITALS))


def _character_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, range(0x323B0)))  # there are no letters, numbers or spaces beyond
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, points):
            table[m.start() : m.end()] = kind
    for chars, kind in (("'", QUOTE), ("stmd", ENDER), ("r", ARR), ("v", VEE), ("l", ELL), ("e", EE)):
        for c in chars:
            table[ord(c)] = kind
    return table


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and annotation by (class, state)."""
    step, note = np.zeros((10, 6), np.uint8), np.zeros((10, 6), np.uint8)
    for kind in range(10):
        fresh = {SPACE: BETWEEN, NUMBER: BETWEEN, OTHER: RUN, QUOTE: QUOTED}.get(kind, WORD)
        for state in range(6):
            to, said = fresh, STARTS * (kind != SPACE)
            letter, late = kind not in (SPACE, NUMBER, OTHER, QUOTE), state in (NEEDS_E, NEEDS_L)
            if state == WORD and letter:
                to, said = WORD, 0
            elif state == RUN and kind in (OTHER, QUOTE):
                to, said = RUN, 0
            elif state == QUOTED and kind in (OTHER, QUOTE):
                to, said = RUN, 0
            elif state == QUOTED and kind == ENDER:
                to, said = BETWEEN, 0
            elif state == QUOTED and kind in (ARR, VEE):
                to, said = NEEDS_E, 0
            elif state == QUOTED and kind == ELL:
                to, said = NEEDS_L, 0
            elif state == NEEDS_E and kind == EE or state == NEEDS_L and kind == ELL:
                to, said = BETWEEN, 0
            elif late and letter:
                to, said = WORD, STARTED_BEFORE
            elif late:
                said |= STARTED_BEFORE
            step[kind, state], note[kind, state] = to, said
    return step, note


STEP, NOTE = _compile()


def scan_states(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Annotations of every character, all chunks at a time."""
    n = len(kinds)
    laid = np.zeros(-(-n // chunk) * chunk, np.uint8)
    laid[:n] = kinds
    laid = np.ascontiguousarray(laid.reshape(-1, chunk).T)
    flat, notes = STEP.ravel(), NOTE.ravel()
    maps = np.tile(np.arange(6, dtype=np.uint8)[:, None], (1, laid.shape[1]))
    for row in laid:
        maps = flat[row * np.uint8(6) + maps]
    reach = 1
    while reach < maps.shape[1]:  # inclusive prefix scan: maps[c] becomes the map of chunks 0 to c
        maps[:, reach:] = np.take_along_axis(maps[:, reach:].copy(), maps[:, :-reach].copy(), axis=0)
        reach *= 2
    state = np.concatenate(([BETWEEN], maps[BETWEEN, :-1])).astype(np.uint8)
    said = np.empty_like(laid)
    for k, row in enumerate(laid):
        at = row * np.uint8(6) + state
        said[k] = notes[at]
        state = flat[at]
    return said.T.ravel()[:n]


def _byte_of() -> dict[str, str]:
    """The byte (as U+0000 to U+00FF) that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + k): chr(b) for k, b in enumerate(others)}


class MergeTransducer:
    """Token counts of words, from the merges alone."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {m: k for k, m in enumerate(merges)}
        made = {a + b for a, b in merges}
        self.tokens = {chr(b) + e for b in range(256) for e in ("", END)} | made
        self.begins = {t[:k] for t in self.tokens for k in range(len(t) + (not t.endswith(END)))}
        self.forget()

    def forget(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        self.number = {("", (None,), (0,)): 0}
        self.states = list(self.number)
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.lasts: list[dict[str, int]] = [{}]

    def merged(self, parts: list[str]) -> list[str]:
        """The tokens of a sequence of symbols: the first merge of the least rank, again and again."""
        while len(parts) > 1:
            rank, k = min((self.rank.get(x, len(self.rank)), k) for k, x in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fit(self, before: str | None, token: str) -> bool:
        """Whether the merges leave the token, and the one before it, as they are."""
        found = self.pairs.get((before, token))
        if found is None:
            parts = [*(before or ""), *token]
            if token.endswith(END):
                parts[-2:] = [parts[-2] + END]
            found = self.pairs[before, token] = self.merged(parts) == ([token] if before is None else [before, token])
        return found

    def _last(self, state: int, symbol: str, end: str) -> tuple[int, str]:
        """(place of its start in the state's suffix, token) of the last token after one more byte."""
        suffix, last, _ = self.states[state]
        whole = suffix + symbol + end
        for k, before in enumerate(last):
            token = whole[k:]
            if token in self.tokens and self._fit(None, token) and (before is None or self._fit(before, token)):
                return k, token
        raise ValueError("the merges leave a byte without a token")

    def _step(self, state: int, symbol: str) -> tuple[int, int]:
        suffix, last, counts = self.states[state]
        k, token = self._last(state, symbol, "")
        emits = counts[k] + 1
        whole, at = suffix + symbol, 0
        while whole[at:] not in self.begins:
            at += 1
        key = (whole[at:], (*last, token)[at:], tuple(c - emits for c in (*counts, emits)[at:]))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.lasts.append({})
        self.steps[state][symbol] = to, emits
        return to, emits

    def count(self, word: str) -> int:
        """The number of tokens of a word."""
        if len(self.states) > STATES:
            self.forget()
        symbols, state, total = word.encode("utf-8", "surrogatepass").decode("latin-1"), 0, 0
        steps = self.steps
        for c in symbols[:-1]:
            known = steps[state].get(c)
            state, emits = known or self._step(state, c)
            total += emits
        c = symbols[-1]
        emits = self.lasts[state].get(c)
        if emits is None:
            k, _ = self._last(state, c, END)
            emits = self.lasts[state][c] = self.states[state][2][k] + 1
        return total + emits


def read_vocabulary(path: str) -> tuple[list[tuple[str, str]], list[str], np.ndarray]:
    """(merges in order, special strings, character classes) of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    suffix, byte_of = found["model"]["end_of_word_suffix"], _byte_of()

    def spelt(token: str) -> str:
        ends = token.endswith(suffix)
        return "".join(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + END * ends

    return [(spelt(a), spelt(b)) for a, b in found["model"]["merges"]], [t["content"] for t in found["added_tokens"]], _character_classes()


class TokenCounter:
    """Counts of one vocabulary."""

    def __init__(self, vocabulary: tuple[list[tuple[str, str]], list[str], np.ndarray], chunk: int = CHUNK):
        merges, special, self.classes = vocabulary
        self.transducer, self.chunk = MergeTransducer(merges), chunk
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.hints = special
        self.emits: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.emits) + len(words) > WORDS:
            self.emits = {}
        for word in words:
            self.emits[word] = self.transducer.count(word)

    def counts(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for k, text in enumerate(texts):
            if any(h in text for h in self.hints):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
            else:
                parts = [text]
            for part in parts:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final-sigma rule
                    if not _NEW.isdisjoint(part):
                        part = part.translate(NEW_CAPITALS)
                pieces.append(part.lower())
                owner.append(k)
        whole = " ".join(pieces) + " "
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.classes[points]
        said = scan_states(kinds, self.chunk)
        starts = said & STARTS
        starts[:-1] |= (said[1:] & STARTED_BEFORE) >> 1
        begin = np.flatnonzero(starts)
        if not len(begin):
            return extra
        spaces = np.flatnonzero(kinds == SPACE)
        end = np.minimum(np.append(begin[1:], len(points)), spaces[np.searchsorted(spaces, begin)])
        words = [whole[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
        distinct = set(words)
        missing = distinct - self.emits.keys()
        if missing:
            self._learn(missing)
            if not distinct <= self.emits.keys():
                self._learn(distinct - self.emits.keys())
        emitted = np.fromiter(map(self.emits.__getitem__, words), np.int64, len(words))
        lengths = np.array([len(p) + 1 for p in pieces])
        piece_of = np.searchsorted(np.cumsum(lengths), begin, side="right")
        return extra + np.bincount(np.array(owner)[piece_of], emitted, len(texts)).astype(np.int64)


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(key: str, held: Broadcast) -> TokenCounter:
    """The worker process's counter, which keeps its compiled transitions from task to task."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(held.value)
    return _COUNTERS[key]


def _groups(lengths: list[int], most: int) -> Iterator[slice]:
    begin, held = 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    yield slice(begin, len(lengths))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens above ``limit``)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # as large as the vocabulary, whatever the data
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, held)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.counts(texts[s]) for s in _groups([len(t) for t in texts], 2_000_000)] if texts else []
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            n_bytes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
