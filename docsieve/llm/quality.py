"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

* Units: every white-space token gives its lower-cased core (hashed to ``WORDS`` buckets) and a mark of its shape: case,
  digits, length class, surrounding signs, whether it repeats the token before (hashed to ``SHAPES`` buckets).
* Random indexing: each bucket owns a sparse ternary index vector, drawn from its number. A unit's vector is the sum of
  the index vectors of the units up to ``WINDOW`` places away, over all documents; sums are integers, so the order of
  tasks does not matter. A task sends at most one matrix of fixed size.
* A document is the mean of its units' centred, normalised vectors. A network with one hidden layer is trained in numpy
  on at most ``MAX_LABELLED`` labelled documents (those with the smallest hash of the id); a fifth of them is kept from
  training and sets the temperature of the probabilities.

Labels, language, source and id are no inputs of a score. Defined results: null and empty texts are pooled to zeros and
scored like any other; a null doc_id is not held out; repeated label rows count once (the larger quality); without
labelled rows of both kinds every score is the share of ones seen, or 0.5; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.common import persist_table, remainder, whole_text
from docsieve.llm.token_count import _groups

WORDS, SHAPES, DIM, NONZERO, WINDOW = 8192, 1024, 64, 4, 2
BUCKETS = WORDS + SHAPES
ROWS_PER_CHUNK = 1024
MAX_LABELLED, HIDDEN, THRESHOLD, SALTS = 20_000, 32, 0.3, 64
_SIGNS, _DIGIT = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~¡¿«»…“”‘’„–—•", re.compile(r"\d")


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), np.tile(np.array([1, -1] * (NONZERO // 2)), (BUCKETS, 1))


def _shape(token: str) -> tuple[int, int]:
    before = after = digits = ""
    core = token
    if not token.isalpha():
        core = token.lstrip(_SIGNS)
        before = token[: len(token) - len(core)][:3]
        core, after = core.rstrip(_SIGNS), core[len(core.rstrip(_SIGNS)) :][:3]
        digits = "d" if _DIGIT.search(core) else ""
    low = core.lower()
    case = "l" if core == low else "u" if len(core) > 1 and core == core.upper() else "t" if core[0] != low[0] else "-"
    shape = f"{case}{digits}{min(len(core), 20) // 4}|{before}|{after}"
    return zlib.crc32(low.encode("utf-8", "surrogatepass")) % WORDS, WORDS + 2 * _shape_bucket(shape)


@lru_cache(maxsize=4096)
def _shape_bucket(shape: str) -> int:
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % (SHAPES // 2)


class Units:
    """Texts to unit buckets; remembers the tokens it has seen, up to a bound."""

    def __init__(self, most: int = 400_000):
        self.number: dict[str, int] = {}
        self.pairs, self.most = np.zeros((0, 2), np.int64), most

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all units, word and shape by turns; number of units by text)."""
        tokens = [t.split() for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = [w for t in tokens for w in t]
        missing = set(flat) - self.number.keys()
        if missing:
            if len(self.number) + len(missing) > self.most:
                self.number, self.pairs, missing = {}, np.zeros((0, 2), np.int64), set(flat)
            base = len(self.number)
            new = list(missing)
            self.number.update(zip(new, range(base, base + len(new)), strict=True))
            self.pairs = np.concatenate([self.pairs, np.array([_shape(w) for w in new], np.int64).reshape(-1, 2)])
        ids = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        out = self.pairs[ids]
        if len(ids):
            same = np.zeros(len(ids), np.int64)
            same[1:] = ids[1:] == ids[:-1]
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            same[begins[(sizes > 0)]] = 0
            out[:, 1] += same
        return out.reshape(-1), 2 * sizes


def _cooccur(units: np.ndarray, sizes: np.ndarray, total: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for away in range(1, WINDOW + 1):
        near = doc[away:] == doc[:-away]
        left, right = units[:-away][near], units[away:][near]
        for word, context in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += signs[0, k] * np.bincount(word * DIM + places[context, k], minlength=BUCKETS * DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The (BUCKETS, DIM) integer matrix of the corpus. It has a fixed size, so the driver may hold it."""
    slim = docs.select(whole_text(text_col).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, total = Units(), np.zeros(BUCKETS * DIM, np.int64)
        places, signs = index_vectors()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in _groups([len(t) for t in texts], 2_000_000):
                found, sizes = units.of(texts[s])
                if len(found):
                    _cooccur(found, sizes, total, places, signs)
        chunks = total.reshape(-1, ROWS_PER_CHUNK * DIM)
        keep = [k for k in range(len(chunks)) if chunks[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([zlib.compress(chunks[k].tobytes(), 1) for k in keep], pa.binary())], names=["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(sums), np.int64)
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["chunk", "sums"])

    schema = "chunk int, sums binary"
    # Nine chunks come from every task: they are added in SALTS places each before they meet.
    parts = slim.mapInArrow(gather, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    summed = parts.repartition("chunk", "salt").mapInArrow(add, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros((BUCKETS // ROWS_PER_CHUNK, ROWS_PER_CHUNK * DIM), np.int64)
    for row in summed.collect():  # one row per chunk, nine in all
        out[row[0]] = np.frombuffer(zlib.decompress(row[1]), np.int64)
    return out.reshape(BUCKETS, DIM)


def normalise(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.maximum(np.abs(v).sum(axis=1, keepdims=True), 1)
    seen = np.abs(v).sum(axis=1) > 0
    if seen.any():
        v[seen] -= v[seen].mean(axis=0)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pool(units: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), DIM))
    ends = np.cumsum(sizes)
    for k, (b, e) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        if e > b:
            out[k] = np.bincount(units[b:e], minlength=BUCKETS) @ vectors / (e - b) if e - b > 20_000 else vectors[units[b:e]].mean(axis=0)
    return out


class Network:
    """Two layers; probabilities are divided by a temperature in the logit."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.w1 = prior, None

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, epochs: int = 80, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        tx, ty = x[~aside], y[~aside]
        self.mean, self.scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
        z = (tx - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), 128):
                k = order[at : at + 128]
                h = np.tanh(z[k] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - ty[k]) / len(k)
                back = np.outer(d, p[2]) * (1 - h * h)
                g = [z[k].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                rate = 0.005 * (1 - epoch / epochs)
                for i in range(4):
                    m[i] = 0.9 * m[i] + 0.1 * g[i]
                    v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = p[0], p[1], p[2], float(p[3][0])
        self.temperature = 1.0
        if aside.any() and 0 < y[aside].mean() < 1:
            logits, truth = self.logit(x[aside]), y[aside]
            choices = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
            loss = [np.logaddexp(0, -(2 * truth - 1) * logits / c).mean() for c in choices]
            self.temperature = float(choices[int(np.argmin(loss))])
        return self


def pooled(docs: DataFrame, vectors: np.ndarray, keep: str) -> DataFrame:
    """Column ``keep`` and the document's pooled vector, for training."""
    slim = docs.select(F.col(keep).alias("k"), whole_text("text").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = pool(*units.of(texts), held.value) if texts else np.zeros((0, DIM))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "x"])

    return slim.mapInArrow(run, "k struct<id:bigint,y:int>, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors over all ``docs`` and the network over a bounded sample of the labels outside the held-out fold."""
    vectors = normalise(word_vectors(docs))
    known = labels.filter(F.col("quality").isin(0, 1) & (remainder("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = persist_table(sample.select(F.col("doc_id").cast("long").alias("_q_id"), "y"), "quality-sample")
    # The sample has at most ``max_labelled`` rows of two numbers, so it may be broadcast.
    taught = docs.select(F.col("doc_id").alias("_q_doc"), "text").join(F.broadcast(sample), F.col("_q_doc") == F.col("_q_id")).select(F.struct(F.col("_q_id").alias("id"), "y").alias("k"), "text")
    # One row for each labelled id, also where ``docs`` repeats it, so the sample bounds what comes to the driver.
    rows = sorted(pooled(taught, vectors, "k").groupBy("k").agg(F.min("x").alias("x")).collect())
    y = np.array([r["k"]["y"] for r in rows], float)
    if len(y) < 10 or y.min() == y.max():
        return vectors, Network(float(y.mean()) if len(y) else 0.5)
    x = np.array([r["x"] for r in rows])
    aside = np.array([zlib.crc32(b"calibrate%d" % r["k"]["id"]) % 5 == 0 for r in rows])
    return vectors, Network().fit(x, y, aside)


def score(docs: DataFrame, vectors: np.ndarray, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), _q_score and _q_predicted."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_q_score", T.DoubleType()), T.StructField("_q_predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, (v, net) = Units(), held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).field("text").to_pylist()]
            parts = [net.score(pool(*units.of(texts[s]), v)) for s in _groups([len(t) for t in texts], 2_000_000)] if texts else []
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["row", "_q_score", "_q_predicted"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    slim = docs.select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("row.doc_id"), 5) == 0, F.lit(False))
    return score(slim, *train(slim, labels)).select("row.doc_id", held_out.alias("held_out"), F.col("_q_score").alias("score"), F.col("_q_predicted").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier accepts, with all their columns."""
    return score(docs, *train(docs, labels)).filter("_q_predicted = 1").select(*[F.col(f"row.`{c}`") for c in docs.columns])
