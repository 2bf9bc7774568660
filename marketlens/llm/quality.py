"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are one- and two-word n-grams of lower-cased words and of word shapes (a word with
every run of capitals, small letters or digits reduced to one sign), hashed into a table of
fixed size. Shards of the labelled sample are trained apart, their weights averaged by the
number of examples; the average has the size of the table whatever the input. A text's
score is the logistic function of the dot product of weights and feature frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, Words, gram_hashes, mix64, slices

BITS = 18
# Bound of the labelled sample and number of shards it is trained in.
SAMPLE_ROWS = 20_000
SHARDS = 6
EPOCHS = 2
THRESHOLD = 0.7
# Frequencies of a text sum to this.
SCALE = 12.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.2, 1.0

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("x")
_CLASS[ord("A") : ord("Z") + 1] = ord("X")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("x")


def _shape_hashes(words: Words) -> np.ndarray:
    """One hash per word: of the signs of its bytes, runs of one sign counted once."""
    signs = _CLASS[words.data[words.inside]]
    lengths = words.end - words.start
    heads = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1], out=heads[1:])
    keep = np.empty(len(signs), bool)
    keep[1:] = signs[1:] != signs[:-1]
    keep[heads] = True
    # a Horner-like sum over the kept signs: their rank within the word gives the power
    rank = np.cumsum(keep) - 1
    rank -= np.repeat(rank[heads], lengths)
    powers = np.multiply.accumulate(np.full(int(rank.max()) + 2, np.uint64(0x9E3779B97F4A7C15)))
    values = np.where(keep, (signs.astype(np.uint64) + np.uint64(1)) * powers[rank], np.uint64(0))
    return mix64(np.add.reduceat(values, heads))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, table place) of every feature of every text in a column."""
    words = Words(column)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shapes = _shape_hashes(words)
    words.data = LOWER[words.data]
    plain = words.hashes()
    rows, places = [], []
    for seed, hashes in ((1, plain), (2, shapes)):
        for n in (1, 2):
            grams = gram_hashes(hashes, n, seed)
            if len(grams):
                within = words.row[: len(grams)] == words.row[n - 1 :]
                rows.append(words.row[: len(grams)][within])
                places.append((grams >> np.uint64(64 - BITS)).astype(np.int64)[within])
    return np.concatenate(rows), np.concatenate(places)


class Ftrl:
    """Follow-the-regularised-leader for logistic loss, one place more for the intercept."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        error = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label
        g = error * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _train_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        for part in slices(batch, "text"):
            rows, places = features(part.column("text"))
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
            labels = part.column("label").to_numpy(zero_copy_only=False)
            keys = part.column("key").to_numpy(zero_copy_only=False)
            for r in range(part.num_rows):
                at, count = np.unique(places[order[ends[r] : ends[r + 1]]], return_counts=True)
                x = np.append(count * (SCALE / max(1, count.sum())), 1.0).astype(np.float32)
                examples.append((keys[r], float(labels[r]), np.append(at, 1 << BITS).astype(np.int32), x))
    if not examples:
        return
    examples.sort(key=lambda e: (e[0], e[1]))
    model = Ftrl()
    for _ in range(EPOCHS):
        for _, label, at, x in examples:
            model.learn(at, x, label)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    at = at if len(at) else np.array([1 << BITS])
    yield pa.RecordBatch.from_pydict(
        {"place": pa.array(at, pa.int64()), "w": pa.array(w[at] * len(examples)), "n": pa.array([float(len(examples))] + [0.0] * (len(at) - 1))}
    )


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from at most ``sample_rows`` labelled documents, drawn by a hash of the id.

    Ids labelled more than once take the majority, ties count as good; null labels and ids
    take no part; every row of a drawn id is an example. No labelled rows: all weights are 0
    and every score is 0.5.
    """
    drawn = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label"))
        .withColumn("key", F.xxhash64(F.col("_id").cast("string"), F.lit("ftrl")))
        .orderBy("key", "_id")
        .limit(sample_rows)
    )
    sample = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "_id")
    shards = sample.select("text", "label", "key").repartition(SHARDS, "key")
    parts = shards.mapInArrow(_train_shard, "place long, w double, n double")
    found = parts.groupBy("place").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()  # at most a table
    weights = np.zeros((1 << BITS) + 1)
    weights[found["place"].to_numpy(np.int64)] = found["w"].to_numpy() / max(1.0, found["n"].sum())
    return weights


def score(documents: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document, or its columns in ``keep``) and ``score`` in 0 to 1; null and empty texts get the intercept's score."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct("*")
    packed = documents.select(row.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        w = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows, places = features(part.column("text"))
                total = np.bincount(rows, weights=w[places], minlength=part.num_rows)
                count = np.bincount(rows, minlength=part.num_rows)
                logit = w[-1] + total * SCALE / np.maximum(1, count)
                out = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out)], names=["row", "score"])

    schema = packed.select("row").withColumn("score", F.lit(0.0)).schema
    return packed.mapInArrow(run, schema)
