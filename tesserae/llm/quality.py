"""Operator 2: a supervised subword classifier, trained by numpy stochastic gradient descent.

Words, word pairs and character n-grams of a text are hashed into buckets; the learned vectors of its buckets
are averaged and a softmax layer gives the label's probability. Scoring is one narrow pass: as the output is
linear in the average, each bucket's vector is first multiplied into the output once, which leaves a table of
BUCKETS numbers to send to the executors, however large the corpus.

Training reads at most SAMPLE labelled rows (the lowest hashes of doc_id among those not held out, texts of at
most SAMPLE_BYTES), whole, until they add up to TOTAL_BYTES; these bounds are parameters. Of several texts under
one doc_id the least is taken. Everything else covers all rows.

Defined cases: null and empty texts have no features and get the score of the bias alone; very long texts are
hashed whole, piece by piece; repeated rows score alike; without labelled rows (or with one label only)
every score is the label's share, 0.5 without any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

BUCKETS = 1 << 17
DIM = 12
NGRAMS = (3, 5)
EPOCHS = 12
RATE = 0.6
SAMPLE = 3000
SAMPLE_BYTES = 200_000
TOTAL_BYTES = 100_000_000
SEED = 7
#: An odd factor for polynomial hashes modulo 2**64, and its inverse.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIXER = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time; a longer text continues behind the last gap before that.
PIECE = 1 << 20


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hasher:
    """Bucket numbers of a text's features, without a Python step per word."""

    def __init__(self, buckets: int = BUCKETS, ngrams: tuple[int, ...] = NGRAMS):
        self.buckets, self.ngrams = np.uint64(buckets - 1), ngrams
        self.up, self.down = _powers(FACTOR, 4096), _powers(INVERSE, 4096)

    def _bucket(self, h: np.ndarray, salt: int) -> np.ndarray:
        h = (h + np.uint64(salt)) * MIXER
        return ((h ^ (h >> np.uint64(32))) * MIXER >> np.uint64(29)) & self.buckets

    def __call__(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        if len(data) <= PIECE:
            return self._piece(data)
        parts, at = [], 0
        while at < len(data):
            cut = data.rfind(b" ", at + 1, at + PIECE) if at + PIECE < len(data) else len(data)
            cut = cut if cut > at else min(at + PIECE, len(data))
            parts.append(self._piece(data[at:cut]))
            at = cut
        return np.concatenate(parts)

    def _piece(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(b" " + data + b" ", np.uint8)
        n = len(b)
        if n > len(self.up):
            self.up, self.down = _powers(FACTOR, 2 * n), _powers(INVERSE, 2 * n)
        b = np.where(b <= 32, np.uint8(32), b)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        gap = b == 32
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        if not len(starts):
            return np.zeros(0, np.int64)
        words = (sums[ends] - sums[starts]) * self.down[starts]
        # a word after itself is one feature, whichever word it is
        pairs = np.where(words[1:] == words[:-1], np.uint64(0), words[:-1] * FACTOR + words[1:])
        out = [self._bucket(words, 1), self._bucket(pairs, 2)]
        for k in self.ngrams:
            if n > k:
                out.append(self._bucket((sums[k:] - sums[:-k]) * self.down[: n + 1 - k], 2 + k))
        return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """score(text) = softmax(mean of vectors @ output + bias), label 1."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def table(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of the two logits, and the bias's difference."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


class Bags:
    """Bucket numbers and shares of many texts in two long arrays, which go back to the system whole when done."""

    def __init__(self):
        self.ids, self.shares, self.ends = np.empty(1 << 20, np.int32), np.empty(1 << 20, np.float32), [0]

    def add(self, features: np.ndarray) -> None:
        ids, counts = np.unique(features, return_counts=True)
        a, b = self.ends[-1], self.ends[-1] + len(ids)
        while b > len(self.ids):
            self.ids, self.shares = (np.concatenate([x, np.empty_like(x)]) for x in (self.ids, self.shares))
        self.ids[a:b], self.shares[a:b] = ids, counts / max(1, counts.sum())
        self.ends.append(b)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i >= len(self):
            raise IndexError(i)
        return self.ids[self.ends[i] : self.ends[i + 1]], self.shares[self.ends[i] : self.ends[i + 1]]


def train(texts: list[str], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    hasher = Hasher(buckets)
    vectors = (rng.random((buckets, dim), np.float32) - 0.5) / dim
    output = np.zeros((dim, 2))
    share = (sum(labels) + 1) / (len(labels) + 2) if labels else 0.5
    bias = np.array([0.0, np.log(share / (1 - share))])
    if len(set(labels)) < 2:
        return Model(vectors, output, bias)
    bags = Bags()
    for t in texts:
        bags.add(hasher(t))
    y = np.array(labels)
    # the rarer label's rows weigh more while the vectors are learned; the bias is set right at the end
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bias[:] = 0
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - done / steps)
            done += 1
            ids, share_of = bags[i]
            if not len(ids):
                continue
            mean = share_of @ vectors[ids]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= min(weight[i], 4.0)
            back = output @ p
            output -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # a mean over many buckets moves each a little; the step is scaled by the bag's spread
            vectors[ids] -= (lr * share_of[:, None] / (share_of @ share_of)) * back[None, :].astype(np.float32) * 0.1
    model = Model(vectors, output, bias)
    u, b = model.table()
    margins = np.array([(float(s @ u[i]) if len(i) else 0.0) + b for i, s in bags])
    model.output, model.bias = _calibrated(model, margins, y)
    return model


def _calibrated(model: Model, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and shift of the margin by logistic regression on the unweighted rows (Newton steps, damped)."""
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * margins + shift, -30, 30)))
        g = np.array([((p - y) * margins).mean() + 1e-3 * (scale - 1), (p - y).mean()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * margins**2).mean() + 1e-3, (w * margins).mean()], [(w * margins).mean(), w.mean()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        scale, shift = scale - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    scale = max(scale, 1e-3)
    diff = float(model.bias[1] - model.bias[0])
    return model.output * scale, np.array([0.0, diff * scale + shift])


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """(text, label) of the sample; doc_id chooses rows only."""
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= sample_bytes)
    rows = rows.join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min(F.struct("bytes", "text")).alias("least"), F.min("label").alias("label"))
    # at most `sample` rows: their running sum in the order of the hashes
    so_far = F.sum("least.bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= total_bytes).select("least.text", "label")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((*model.table(), len(model.vectors)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, bias, buckets = shared.value
        hasher = Hasher(buckets)
        for batch in batches:
            scores = [_score(u, bias, hasher, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, f"{id_col} long, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((*model.table(), len(model.vectors)))

    def run(batches: Iterator[pa.RecordBatch], at: int = docs.columns.index(text_col)) -> Iterator[pa.RecordBatch]:
        u, bias, buckets = shared.value
        hasher = Hasher(buckets)
        for batch in batches:
            yield batch.filter(pa.array([_score(u, bias, hasher, t) >= least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _score(u: np.ndarray, bias: float, hasher: Hasher, text: str | None) -> float:
    ids = hasher(text) if text else ()
    margin = (float(u[ids].mean(dtype=np.float64)) if len(ids) else 0.0) + bias
    return 1 / (1 + float(np.exp(-np.clip(margin, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    rows = sorted(training_rows(docs, labels, label, sample).collect())  # at most `sample` rows and TOTAL_BYTES; sorted, so reruns agree
    return train([r[0] for r in rows], [r[1] for r in rows])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
