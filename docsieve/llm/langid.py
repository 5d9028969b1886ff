"""Language identification with spans of mixed-language text.

Per-word scores are naive-Bayes sums over hashed character n-grams (1 to 3, with word edges) and the word itself. The
counts come from all documents of the training folds, summed by Spark by (language, feature). For a text, each word's
script (by code-point range) narrows the candidate languages to those that use that script; Viterbi over the words with
a penalty for each switch labels them; the language with the most letters is the prediction.

A word is a letter (category L) with the letters and combining marks after it, so numbers of any kind are none and
vowel signs do not cut words. Defined results: null texts and texts without a letter are ``und`` with score 0; without any training row every text is
``und``; repeated rows are predicted each; a null doc_id is not held out; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import remainder, whole_text
from docsieve.llm.token_count import _groups

FEATURES, SWITCH, CLIP, SMOOTH, SHARE = 1 << 15, 8.0, 12.0, 0.5, 0.005


def _ranges(kinds: str) -> str:
    """The code points of the given general categories, as ranges of a character class."""
    inside = np.fromiter((unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)), np.int8, 0x110000)
    edges = np.flatnonzero(np.diff(inside, prepend=0, append=0)).tolist()
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


@lru_cache(maxsize=1)
def _letters() -> tuple[re.Pattern, frozenset[str]]:
    """A word by category, and the characters because of which PLAIN would find other words."""
    points = map(chr, range(0x110000))
    odd = frozenset(c for c in points if (k := unicodedata.category(c)[0]) == "M" or k != "L" and PLAIN.match(c))
    return re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*"), odd


def words_in(text: str) -> Iterator[re.Match]:
    """A word: a letter and the letters and combining marks after it. Numbers of any kind are no letters."""
    by_category, odd = _letters()
    return (PLAIN if text.isascii() or odd.isdisjoint(text) else by_category).finditer(text)


def find(text: str) -> list[str]:
    by_category, odd = _letters()
    return (PLAIN if text.isascii() or odd.isdisjoint(text) else by_category).findall(text)


PLAIN = re.compile(r"[^\W\d_]+")
# First code points of script ranges of Unicode blocks, and the script each range belongs to.
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C00, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD800, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00, 0x20000)
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "bengali", "indic", "thai", "lao", "georgian", "hangul", "ethiopic", "latin", "greek", "other", "latin", "kana", "kana", "han", "hangul", "other", "han", "other", "hangul", "other", "han", "latin", "hebrew", "arabic", "other", "han")
NAMES = tuple(dict.fromkeys(SCRIPTS))
_OF_RANGE = np.array([NAMES.index(s) for s in SCRIPTS])


def script_of(word: str) -> int:
    return int(_OF_RANGE[np.searchsorted(SCRIPT_STARTS, ord(word[0]), side="right") - 1])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, index of the word) of all n-grams of all words."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    out, own = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64) % np.uint64(FEATURES)], [np.arange(len(words))]
    h = c * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 3):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append((mixed >> np.uint64(49))[inside])
        own.append(owner[: len(h)][inside])
    return np.concatenate(out).astype(np.int64), np.concatenate(own)


def feature_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang) -> lang, feature, n: sums over all rows; features from FEATURES on count scripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, Counter] = {}
            for text, lang in zip(texts, langs, strict=True):
                by.setdefault(lang, Counter()).update(find(text.lower()))
            for lang, seen in by.items():
                mine = total.setdefault(lang, np.zeros(FEATURES + len(NAMES), np.int64))
                if not seen:
                    continue
                words, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
                f, own = features(words)
                mine[:FEATURES] += np.bincount(f, n[own], FEATURES).astype(np.int64)
                mine[FEATURES:] += np.bincount([script_of(w) for w in words], n, len(NAMES)).astype(np.int64)
        for lang, mine in total.items():
            f = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f, pa.int32()), pa.array(mine[f], pa.int64())], names=["lang", "feature", "n"])

    slim = docs.select(whole_text("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    return slim.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities by language; its size is bounded by languages x FEATURES."""

    def __init__(self, rows: pa.Table):
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        names = lang.dictionary.to_pylist()
        self.langs = sorted(names)
        counts = np.zeros((len(names), FEATURES + len(NAMES)))
        place = np.array([self.langs.index(x) for x in names], np.int64)
        counts[place[lang.indices.to_numpy(zero_copy_only=False)], rows.column("feature").to_numpy()] = rows.column("n").to_numpy()
        grams, scripts = counts[:, :FEATURES] + SMOOTH, counts[:, FEATURES:]
        self.logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() if self.langs else np.zeros((FEATURES, 0), np.float32)
        uses = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= SHARE
        uses[:, ~uses.any(axis=0)] = True
        self.banned = np.where(uses, 0, -1e4).T.astype(np.float32)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word: at most 0, 0 for the best candidate, cut at -CLIP."""
        missing = set(words) - self.known.keys()
        if missing:
            if len(self.known) + len(missing) > 500_000:
                self.known, self.table, missing = {}, self.table[:0], set(words)
            new = list(missing)
            f, own = features(new)
            order = np.argsort(own, kind="stable")
            begins = np.searchsorted(own[order], np.arange(len(new)))
            s = np.add.reduceat(self.logp[f[order]], begins, axis=0) + self.banned[[script_of(w) for w in new]]
            s = np.maximum(s - s.max(axis=1, keepdims=True), -CLIP)
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            self.table = np.concatenate([self.table, s])
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def viterbi(emit: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Labels of all words; texts advance side by side, longest first."""
    n_lang = emit.shape[1]
    order = np.argsort(-sizes, kind="stable")
    size, begin = sizes[order], (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    stay, source = np.ones(emit.shape, bool), np.zeros(len(emit), np.int16)
    v = emit[begin[: active[0]]].astype(np.float64) if len(active) else np.zeros((0, n_lang))
    final = np.zeros(len(size), np.int64)
    for t in range(1, len(active)):
        k = active[t]
        if k < len(v):
            final[k : len(v)] = v[k:].argmax(axis=1)
            v = v[:k]
        at = begin[:k] + t
        best = v.argmax(axis=1)
        moved = v[np.arange(k), best][:, None] - penalty
        kept = v >= moved
        stay[at], source[at] = kept, best
        v = np.where(kept, v, moved) + emit[at]
    final[: len(v)] = v.argmax(axis=1)
    label = np.zeros(len(emit), np.int64)
    state = final.copy()
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        label[at] = state[:k]
        if t:
            state[:k] = np.where(stay[at, state[:k]], state[:k], source[at])
    return label


def train(docs: DataFrame) -> Model:
    """A model over all rows with a language outside the held-out fold."""
    seen = docs.filter(F.col("lang").isNotNull() & F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))
    return Model(feature_counts(seen).toArrow())  # a number for each of FEATURES and each language


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    out: list[dict] = []
    for m, k in zip(words_in(text), labels.tolist(), strict=True):
        if out and out[-1]["lang"] == langs[k]:
            out[-1]["end"] = m.end()
        else:
            out.append({"start": m.start(), "end": m.end(), "lang": langs[k]})
    return out


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with ``spans`` also the labelled spans (start, end in characters, lang)."""
    slim = docs.select("doc_id", whole_text("text").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = slim.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(texts: list[str], m: Model) -> tuple[list, list, list]:
        found = [find(t) for t in texts]
        sizes = np.array([len(w) for w in found], np.int64)
        pred, score, marked = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        some = np.flatnonzero(sizes)
        if not len(some) or not m.langs:
            return pred, score, marked
        words = [w for f in found for w in f]
        emit = m.word_scores([w.lower() for w in words])
        labels = viterbi(emit, sizes[some])
        letters = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(texts)), sizes)
        n = np.bincount(doc * len(m.langs) + labels, letters, len(texts) * len(m.langs)).reshape(len(texts), -1)
        best = n.argmax(axis=1)
        odds = np.exp(emit)
        sure = odds[np.arange(len(words)), best[doc]] / odds.sum(axis=1)
        share = np.bincount(doc, sure * letters, len(texts)) / np.maximum(np.bincount(doc, letters, len(texts)), 1)
        ends = np.cumsum(sizes)
        for k in some.tolist():
            pred[k], score[k] = m.langs[best[k]], float(min(1.0, share[k]))
            if spans:
                marked[k] = _spans(texts[k], labels[ends[k] - sizes[k] : ends[k]], m.langs)
        return pred, score, marked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score, marked = [], [], []
            for s in _groups([len(t) for t in texts], 6_000_000) if texts else []:
                for to, part in zip((pred, score, marked), label(texts[s], m), strict=True):
                    to += part
            columns, names = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            if spans:
                columns.append(pa.array(marked, span_type))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type}, lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")
    return slim.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
