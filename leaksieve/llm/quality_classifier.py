"""Quality of texts: random-indexing word vectors, pooled per document, and a two-layer network.

Every token (a run of letters and digits, or of other signs) falls into one of ``BUCKETS`` by its hash.
A bucket has a fixed sparse index vector of +1 and -1; its context vector is the sum of the index
vectors of its neighbours within ``WINDOW`` places in the sample's texts, scaled to length one. A document is
the mean of its tokens' context and index vectors, with its length and the share of different tokens. A
two-layer network in numpy learns the label from that; a temperature fitted on a part of the sample
that the network did not see makes its outputs probabilities.

Only the fit uses a bounded sample (``FIT_ROWS``); the model is some megabytes, broadcast, and scores
every whole text in one pass without a shuffle.

Defined results: a null, empty or blank text has a score like any other, from zero vectors; without
labels every score is 0.5, and with labels of one kind that label; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leaksieve.llm.arrays import blocks, buffers, mix, tokens
from leaksieve.llm.samples import labelled_sample, remainder
from leaksieve.llm.shared import free_name, python_ready, tidy

BUCKETS, SIZE, NONZERO, WINDOW = 1 << 15, 32, 4, 2
FIT_ROWS = 6000
HIDDEN, EPOCHS, BATCH, RATE = 32, 60, 64, 3e-3


def _index_vectors() -> np.ndarray:
    vectors = np.zeros((BUCKETS, SIZE), np.float32)
    rows = np.arange(BUCKETS)
    for k in range(NONZERO):
        draw = mix(rows.astype(np.uint64) * np.uint64(NONZERO) + np.uint64(k))
        np.add.at(vectors, (rows, (draw % np.uint64(SIZE)).astype(np.int64)), np.where(draw >> np.uint64(63), 1, -1).astype(np.float32))
    return vectors


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def context_vectors(column: pa.Array) -> np.ndarray:
    """Context and index vector of each bucket, side by side."""
    index = _index_vectors()
    context = np.zeros((BUCKETS, SIZE))
    data, offsets = buffers(column)
    for first, last in blocks(offsets):
        hashes, begin = tokens(data, offsets[first:last + 1])
        bucket, text = _buckets(hashes), np.repeat(np.arange(last - first), np.diff(begin))
        for k in range(1, WINDOW + 1):
            same = text[k:] == text[:-k]
            # Pairs of neighbours, summed by (word, neighbour) before vectors are added.
            pairs = np.concatenate([bucket[k:][same] * BUCKETS + bucket[:-k][same], bucket[:-k][same] * BUCKETS + bucket[k:][same]])
            pairs, n = np.unique(pairs, return_counts=True)
            np.add.at(context, pairs // BUCKETS, index[pairs % BUCKETS] * n[:, None])
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return np.hstack([context / np.maximum(length, 1e-9), index / np.sqrt(NONZERO)]).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of features per text."""
    data, offsets = buffers(column)
    rows = [np.zeros((0, 2 * SIZE + 2))]
    for first, last in blocks(offsets):
        hashes, begin = tokens(data, offsets[first:last + 1])
        bucket, counts = _buckets(hashes), np.diff(begin)
        sums, different = np.zeros((last - first, 2 * SIZE)), np.zeros(last - first)
        # Each different token of a text is looked up once and weighted by how often it occurs.
        keys, n = np.unique(np.repeat(np.arange(last - first), counts) * BUCKETS + bucket, return_counts=True)
        text = keys // BUCKETS
        if len(keys):
            starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            sums[text[starts]] = np.add.reduceat(vectors[keys % BUCKETS] * n[:, None].astype(np.float32), starts, axis=0)
            different[text[starts]] = np.diff(np.append(starts, len(keys)))
        whole = np.maximum(counts, 1)
        rows.append(np.column_stack([sums / whole[:, None], np.log1p(counts) / 8, different / whole]))
    return np.concatenate(rows)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((features - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return _sigmoid(self.logits(features) / self.temperature)


def fit_network(features: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss; a fifth of the rows is kept back for the temperature."""
    if len(np.unique(labels)) < 2:
        return Network(np.zeros(1), np.ones(1), [], 1.0, float(labels[0]) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    cut = max(1, len(order) // 5)
    held, used = order[:cut], order[cut:]
    if len(np.unique(labels[used])) < 2:
        used = order
    mean, scale = features[used].mean(0), features[used].std(0) + 1e-6
    x, y = (features[used] - mean) / scale, labels[used].astype(float)
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            pre = x[batch] @ w[0] + w[1]
            hidden = np.maximum(pre, 0)
            error = (_sigmoid(hidden @ w[2] + w[3][0]) - y[batch]) / len(batch)
            back = np.outer(error, w[2]) * (pre > 0)
            grads = [x[batch].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], np.array([error.sum()])]
            step += 1
            for p, g, a, b in zip(w, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, w, 1.0)
    logits, y = net.logits(features[held]), labels[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    losses = [np.mean(np.logaddexp(0, np.where(y == 1, -logits, logits) / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


def _score(model):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors, net = model.value
        for part in parts:
            yield pa.array(net.scores(pooled(part, vectors)))
    return run


def fit_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = FIT_ROWS):
    """The model as a broadcast variable; ``learn_from`` says of which label rows' ``doc_id`` it may learn."""
    sample = labelled_sample(docs, labels, "quality", learn_from, rows)
    texts = sample.column("text").combine_chunks()
    vectors = context_vectors(texts)
    net = fit_network(pooled(texts, vectors), sample.column("label").to_numpy())
    return python_ready(docs).sparkSession.sparkContext.broadcast((vectors, net))


def quality_score(model, text: str = "text") -> Column:
    """The score of a text column: an Arrow function over batches."""
    return F.arrow_udf(tidy(_score(model)), "double", F.ArrowUDFType.SCALAR_ITER)(F.col(text).cast("string"))


def classify_quality(docs: DataFrame, labels: DataFrame, divisor: int = 3, left_out: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; labels of ids with that remainder are not learned from."""
    model = fit_quality(docs, labels, remainder(divisor) != left_out)
    scored = docs.select("doc_id", F.coalesce(remainder(divisor) == left_out, F.lit(False)).alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_by_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``at_least``."""
    model, score = fit_quality(docs, labels, learn_from), free_name(docs, "_score")
    return docs.withColumn(score, quality_score(model)).where(F.col(score) >= at_least).drop(score)
