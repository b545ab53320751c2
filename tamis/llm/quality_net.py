"""Quality of whole texts: random-indexing word vectors, pooled for each document, and a two-layer network with calibrated probabilities.

Tokens are runs of letters (any byte from 128 counts as one), of digits, or of other characters that are not white space; case matters.

1. A token falls into one of 2**BUCKET_BITS buckets by its hash. A bucket's index vector is sparse: NONZERO of DIMENSIONS places are
   1 or -1, by a seeded generator, so that no table of them is passed around.
2. A bucket's word vector is the sum of the index vectors of the tokens up to WINDOW places before and after each of its occurrences, over
   all documents, scaled to length 1. Sums are whole numbers, so that they don't depend on how rows lie in tasks. A task passes on
   one row for each bucket that it saw; all sums together are 2**BUCKET_BITS rows, whatever the input's size.
3. A document's features are the mean of its tokens' vectors and, for each dimension, their standard deviation.
4. The network (tanh, then a logistic output) is trained on the driver on a bounded sample of labelled rows: TRAIN_DOCS at most,
   chosen by a hash of their id. A part of them is left out, for the end of training and for the temperature that divides the logit.

A null text counts as empty; a text without tokens has features of 0 and so a score. An id with several texts or labels counts once in
the sample, with the greatest label. Without labels of both values every score is their smoothed mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash52, materialise, release_memory, text_chunks
from .wordscan import _powers, mix

BUCKET_BITS = 16
DIMENSIONS = 64
NONZERO = 4
WINDOW = 2
#: Bound of the fit: labelled documents, and every so many-th of them that only ends training and sets the temperature.
TRAIN_DOCS = 20_000
CALIBRATE = 5
HIDDEN = 32
EPOCHS = 80
PATIENCE = 12
BATCH = 128
RATE = 0.003
DECAY = 0.0005
CUT = 0.3

_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' tokens one after another, and where each text's begin."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    start = np.flatnonzero(change[:-1])
    end = np.append(start[1:], len(data))
    word = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[word], end[word]
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    values = mix((sums[end] - sums[start]) * down[start])
    return (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(start, offsets)


def index_vectors() -> np.ndarray:
    """The index vector of each bucket."""
    draw = np.random.default_rng(20)
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.int8)
    places = draw.random(out.shape).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, draw.integers(0, 2, places.shape, np.int8) * 2 - 1, 1)
    return out


def contexts(bucket: np.ndarray, first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each token the sum of its neighbours' index vectors; neighbours are in the same text."""
    own = index[bucket]
    out = np.zeros(own.shape, np.int8)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for d in range(1, min(WINDOW, len(bucket) - 1) + 1):
        same = (text[d:] == text[:-d])[:, None]
        out[d:] += own[:-d] * same
        out[:-d] += own[d:] * same
    return out


def _sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    sums = np.zeros(index.shape, np.int64)
    for batch in batches:
        for piece in text_chunks(batch, "text"):
            bucket, first = tokens(piece.column("text"))
            if len(bucket):
                order = np.argsort(bucket.astype(np.uint16), kind="stable")  # BUCKET_BITS bits
                begins = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                sums[bucket[order[begins]]] += np.add.reduceat(contexts(bucket, first, index)[order].astype(np.int32), begins, axis=0)
    seen = np.flatnonzero(sums.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(sums[seen, j]) for j in range(DIMENSIONS))], ["bucket", *(f"d{j}" for j in range(DIMENSIONS))])
    release_memory()


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The vector of each bucket, of length 1, or 0 where nothing was near."""
    names = [f"d{j}" for j in range(DIMENSIONS)]
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_sum_contexts, "bucket bigint, " + ", ".join(f"{n} bigint" for n in names))
    found = rows.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS))
    if found.num_rows:
        out[found.column("bucket").to_numpy()] = np.stack([found.column(n).to_numpy() for n in names], axis=1)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text, from its distinct buckets and how often it has them."""
    bucket, first = tokens(column)
    count = np.diff(first)
    keys, times = np.unique(np.repeat(np.arange(len(count)), count) << BUCKET_BITS | bucket, return_counts=True)
    begins = np.searchsorted(keys >> BUCKET_BITS, np.arange(len(count) + 1))
    own = vectors[keys & ((1 << BUCKET_BITS) - 1)]
    squares, weights = own * own, times.astype(np.float32)
    out = np.zeros((len(count), 2 * DIMENSIONS))
    for i in np.flatnonzero(count):
        a, b = begins[i], begins[i + 1]
        mean, square = weights[a:b] @ own[a:b] / np.float64(count[i]), weights[a:b] @ squares[a:b] / np.float64(count[i])
        out[i, :DIMENSIONS], out[i, DIMENSIONS:] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Network:
    """Two layers over standardised features; scores are logistic of the logit over the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.shift) / self.scale @ self.inner + self.inner_bias)
        return hidden @ self.outer + self.outer_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(features) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def loss(logits: np.ndarray, label: np.ndarray) -> float:
    """Mean negative log-likelihood."""
    return float(np.mean(np.logaddexp(0, logits) - label * logits))


def gradients(net: Network, features: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of the loss, by inner, inner_bias, outer, outer_bias."""
    x = (features - net.shift) / net.scale
    hidden = np.tanh(x @ net.inner + net.inner_bias)
    off = (sigmoid(hidden @ net.outer + net.outer_bias) - label) / len(label)
    back = off[:, None] * net.outer * (1 - hidden * hidden)
    return [x.T @ back, back.sum(0), hidden.T @ off, off.sum()]


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of logits for which the labels are likeliest, by repeated narrowing of a range of its logarithm."""
    low, high = np.log(0.05), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        if loss(logits / np.exp(a), label) < loss(logits / np.exp(b), label):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def train(features: np.ndarray, label: np.ndarray, aside: np.ndarray) -> Network:
    """Adam over shuffled batches of rows that are not aside; the weights that were best for those aside are kept."""
    draw = np.random.default_rng(7)
    x, y = features[~aside], label[~aside]
    scale = x.std(0)
    width = features.shape[1]
    net = Network(x.mean(0), np.where(scale > 1e-9, scale, 1), draw.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(()))
    weights = [net.inner, net.inner_bias, net.outer, net.outer_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    best, kept, waited, t = np.inf, [w.copy() for w in weights], 0, 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for a in range(0, len(y), BATCH):
            at = order[a : a + BATCH]
            t += 1
            for w, g, m, v in zip(weights, gradients(net, x[at], y[at]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + DECAY * w)
        now = loss(net.logits(features[aside]), label[aside])
        if now < best:
            best, kept, waited = now, [w.copy() for w in weights], 0
        else:
            waited += 1
            if waited >= PATIENCE:
                break
    net.inner, net.inner_bias, net.outer, net.outer_bias = kept
    net.temperature = temperature(net.logits(features[aside]), label[aside])
    return net


def sample(docs: DataFrame, labels: DataFrame, training: Column, vectors, id_col: str, text_col: str, label_col: str, train_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label, and the hash of the id of the labelled rows that are learned from, train_docs at most, in a fixed order."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), training.alias("training")).where("training")
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("h", hash52("quality", F.col("id")))
    chosen = known.groupBy(F.col("h") % train_docs).agg(F.min(F.struct("h", "id", "label")).alias("c")).select("c.*")
    chosen = materialise(chosen, "quality-sample")
    # At most train_docs rows, so that they may be broadcast.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id").select("h", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_chunks(batch, "text"):
                features = pooled(piece.column("text"), vectors.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([piece.column("h"), piece.column("label"), pa.array([f.tobytes() for f in features], pa.binary())], ["h", "label", "features"])

    found = rows.mapInArrow(run, "h bigint, label int, features binary").groupBy("h").agg(F.max("label").alias("label"), F.min("features").alias("features")).orderBy("h").toArrow()
    features = np.array([np.frombuffer(f, np.float32) for f in found.column("features").to_pylist()]).reshape(found.num_rows, 2 * DIMENSIONS).astype(np.float64)
    return features, found.column("label").to_numpy().astype(np.float64), found.column("h").to_numpy()


@dataclass
class Model:
    """Word vectors and the network, or without one the score that every text gets."""

    vectors: np.ndarray
    network: Network | None
    mean: float


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """Vectors from all texts of docs, the network from labels where training holds."""
    vectors = word_vectors(docs, text_col)
    features, label, h = sample(docs, labels, training, docs.sparkSession.sparkContext.broadcast(vectors), id_col, text_col, label_col, train_docs)
    aside = h // train_docs % CALIBRATE == 0
    usable = all(0 < part.sum() < len(part) for part in (label[aside], label[~aside]))
    return Model(vectors, train(features, label, aside) if usable else None, float((label.sum() + 1) / (len(label) + 2)))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, cut: float = CUT) -> DataFrame:
    """The columns named in keep (all, if None) with score and predicted, 1 where the score is cut or more; columns of those names are replaced."""
    base = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in base)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for piece in text_chunks(batch, "__text"):
                found = own.network.scores(pooled(piece.column("__text"), own.vectors)) if own.network else np.full(piece.num_rows, own.mean)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in base), pa.array(found), pa.array((found >= cut).astype(np.int32))], [*base, "score", "predicted"])

    source = docs.select(*(F.col(f"`{c}`") for c in base), F.col(f"`{text_col}`").alias("__text"))
    return source.mapInArrow(run, f"{fields}, score double, predicted int")
