"""Toxicity: logistic regression by FTRL-proximal over hashed words, word pairs and skip-grams.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII characters. Features are the
presence of a word, of two neighbours, and of two words with one between, hashed into ``BUCKETS``
buckets. FTRL-proximal gives each coordinate its own rate, and L1 leaves most weights at
exactly 0: scoring gathers the few that are left and ships to executors as a sparse list.

Fitting: at most ``TOXIC`` labelled documents with label 1 and ``CLEAN`` with label 0, those with
the least hash of the id, and of these, in hash order, as many as hold ``MOST_FEATURES`` features (each document at least one);
``EPOCHS`` passes in hash order. The bounds differ by class, so the bias is put back to the classes' shares among all labelled
rows: a score means the same at every size. An id with both labels counts as clean. Scores see the text alone.

Defined cases: an empty or null text scores the bias; without labels of both kinds all weights are 0 and the
bias is the share of label 1 (0 without any); null labels and null ids teach nothing; repeated rows score equal;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .store import Scratch

BUCKETS = 1 << 20
TOXIC, CLEAN = 2_500, 5_000
MOST_FEATURES = 20_000_000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 1.0, 1.0, 15.0, 0.0
LEAST_SCORE = 0.3

_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
_SALTS = [np.uint64(x) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]


def feature_arrays(words: blocks.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each occurrence, by kind of feature."""
    h, owner = words.hash, words.text_of_word()
    yield owner, (blocks.mix(h ^ _SALTS[0]) >> _SHIFT).astype(np.int64)
    for gap in (1, 2):
        if len(h) > gap:
            inside = owner[gap:] == owner[:-gap]
            joined = blocks.mix(h[:-gap] * np.uint64(3) + h[gap:] ^ _SALTS[gap])
            yield owner[:-gap][inside], (joined[inside] >> _SHIFT).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates, for 0/1 features; the bias is not shrunk."""

    def __init__(self, size: int = BUCKETS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias = [0.0, 0.0]

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def bias_weight(self) -> float:
        z, n = self.bias
        return -z * self.alpha / (self.beta + math.sqrt(n))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on the document with these (distinct) features."""
        w, b = self.weights(at), self.bias_weight()
        g = 1 / (1 + math.exp(-min(35.0, max(-35.0, w.sum() + b)))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        z, n = self.bias
        self.bias = [z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * b, n + g * g]


class Model:
    """Weights that are not 0, and the bias."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.at, self.weights, self.bias = at, weights, bias
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def scores(self, words: blocks.Words) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(BUCKETS, np.float32)
            self._dense[self.at] = self.weights
        pairs = []
        for text, bucket in feature_arrays(words):
            hit = self._dense[bucket] != 0
            pairs.append(text[hit] * BUCKETS + bucket[hit])
        once = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        total = np.bincount(once // BUCKETS, self._dense[once % BUCKETS].astype(float), len(words.n_words)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def may_teach() -> Column:
    """True where a label may teach: the crc32 of the id, as text, modulo 4 is not 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, epochs: int = EPOCHS) -> Model:
    """Chooses ids from the labels first, then fetches the features of those documents alone."""
    rows = labels.where(may_teach() & F.col("doc_id").isNotNull()).select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = [(r["doc_id"], kind) for kind, most in ((1, toxic), (0, clean)) for r in rows.where(F.col("toxic") == kind).orderBy("h", "doc_id").limit(most).collect()]
    label = dict(chosen)
    share = sum(label.values()) / max(1, len(label))
    if not 0 < share < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), 35.0 if share else -35.0)
    everywhere = {r["toxic"]: r["count"] for r in rows.where("toxic in (0, 1)").groupBy("toxic").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in blocks.word_slices(batch.column(1), blocks.NOT_ALNUM, blocks.LOWER):
                parts = [t * BUCKETS + b for t, b in feature_arrays(words)]
                once = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                where = np.searchsorted(once, np.arange(hi - lo + 1) * BUCKETS)
                lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array((once % BUCKETS).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "features"])

    wanted = docs.sparkSession.createDataFrame([(i,) for i in label], "doc_id long")
    scratch = Scratch(docs.sparkSession, "toxicity")
    found = _given(docs).join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(run, "doc_id long, features array<int>")
    kept = scratch.keep(found.withColumn("h", F.xxhash64("doc_id")).withColumn("n", F.size("features")), "features")
    sizes = kept.select("h", "doc_id", "n").toArrow()
    if not sizes.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), math.log(share / (1 - share)))
    hashes, total = sizes["h"].to_numpy(), sizes["n"].to_numpy()
    by_hash = np.lexsort((sizes["doc_id"].to_numpy(), hashes))
    last = int(hashes[by_hash][max(0, int(np.searchsorted(np.cumsum(total[by_hash]), MOST_FEATURES, "right")) - 1)])
    found = kept.where(F.col("h") <= last).select("doc_id", "features", "h").toArrow()
    scratch.drop_all_but()
    order = np.lexsort((found["doc_id"].to_numpy(), found["h"].to_numpy()))
    features = found["features"].combine_chunks()
    flat, where = features.flatten().to_numpy(), features.offsets.to_numpy() - features.offsets[0].as_py()
    ids = found["doc_id"].to_pylist()
    model = Ftrl()
    for _ in range(epochs):
        for i in order:
            model.learn(flat[where[i] : where[i + 1]].astype(np.int64), label[ids[i]])
    weights = model.weights(slice(None))
    at = np.flatnonzero(weights)
    taught = [sum(label[i] == kind for i in ids) for kind in (0, 1)]
    shift = math.log(everywhere[1] / everywhere[0]) - math.log(taught[1] / taught[0]) if all(taught) else 0.0
    return Model(at, weights[at], model.bias_weight() + shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in blocks.word_slices(batch.column(1), blocks.NOT_ALNUM, blocks.LOWER):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.scores(words))], names=["doc_id", "score"])

    return _given(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(~may_teach(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
