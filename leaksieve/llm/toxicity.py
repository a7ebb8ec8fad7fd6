"""Toxicity of texts: bags of subwords, averaged and classified by a linear softmax.

A text's features are the character n-grams (``GRAMS``) of its words with a mark at either end of a word, each
hashed to one of ``BUCKETS`` vectors. Their mean, weighted by how few of the sample's texts hold them, goes
through one linear layer and a softmax over two classes; vectors and layer are trained together in numpy. A
misspelt word shares most n-grams, and so most of its vector, with the word it stands for.

Only the fit uses a bounded sample (``FIT_ROWS``). As everything up to the softmax is linear, a bucket's
share of the difference of the two outputs is one number: the broadcast model is a megabyte, and
scoring is one pass over every whole text without a shuffle.

Defined results: a null, empty or blank text has no features and gets the score of the bias alone;
without labels every score is 0.5, and with labels of one kind that label; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leaksieve.llm.arrays import blocks, buffers
from leaksieve.llm.samples import labelled_sample, remainder
from leaksieve.llm.shared import python_ready, tidy

GRAMS = (3, 4)
BITS, SIZE = 17, 8
BUCKETS = 1 << BITS
FIT_ROWS = 8000
EPOCHS, BATCH, RATE = 6, 64, 1.0

# Simple lower case of the code points below 0x590; white space becomes the mark.
_SPACES = "".join(chr(c) for c in range(0x590) if chr(c).isspace())
_FOLDED = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x590)], np.uint32)
_FOLDED[[ord(c) for c in _SPACES]] = 0


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of consecutive texts, lower-cased, with a mark (0) before each and at the end; the marks' places."""
    raw = data[int(offsets[0]):int(offsets[-1])]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - offsets[0]]
    low = points < len(_FOLDED)
    points = np.where(low, _FOLDED[np.where(low, points, 0)], points)
    marks = begins + np.arange(len(begins))
    out = np.zeros(len(points) + len(begins), np.uint32)
    place = np.ones(len(out), bool)
    place[marks] = False
    out[place] = points
    return out, marks


def gram_buckets(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the places where one begins, and its bucket. Marks are first or last in it only."""
    letter = points != 0
    codes = points.astype(np.uint64)
    rolled, inner = codes.copy(), None
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            return
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1:]
        if n == 2:
            continue
        inner = letter[1:-1] if n == 3 else inner[:-1] & letter[n - 2:-1]
        if n in GRAMS:
            at = np.flatnonzero(inner)
            mixed = (rolled[at] ^ (rolled[at] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            yield at, (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def gram_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different buckets of each text with their share of its n-grams, as (row starts, buckets, shares)."""
    data, offsets = buffers(column)
    sizes, buckets, shares = [], [], []
    for first, last in blocks(offsets):
        points, marks = code_points(data, offsets[first:last + 1])
        keys = [np.searchsorted(marks, at, side="right") - 1 << BITS | bucket for at, bucket in gram_buckets(points)]
        keys, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        text = keys >> BITS
        total = np.bincount(text, n, last - first)
        sizes.append(np.bincount(text, minlength=last - first))
        buckets.append((keys & BUCKETS - 1).astype(np.int32))
        shares.append((n / total[text]).astype(np.float32))
    if not sizes:
        return np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(buckets), np.concatenate(shares)


@dataclass
class Subwords:
    """The weight of each bucket in the mean, its share of the logit (the weight included), and the bias."""

    weights: np.ndarray
    shares: np.ndarray
    bias: float


def fit_subwords(column: pa.Array, labels: np.ndarray, seed: int = 11) -> Subwords:
    if len(np.unique(labels)) < 2:
        certain = 0.0 if not len(labels) else 60.0 if labels[0] else -60.0
        return Subwords(np.ones(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), certain)
    starts, buckets, shares = gram_bags(column)
    texts = len(labels)
    held_by = np.bincount(buckets, minlength=BUCKETS)
    weights = (np.clip(np.log((texts + 1) / (held_by + 1)) / np.log(texts + 1), 0, 1) ** 2).astype(np.float32)
    sizes = np.diff(starts)
    shares = shares * weights[buckets]
    whole = np.maximum(np.bincount(np.repeat(np.arange(texts), sizes), shares, texts), 1e-9)
    shares = (shares / np.repeat(whole, sizes)).astype(np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (BUCKETS, SIZE)).astype(np.float32)
    layer, bias = rng.normal(0, 1, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    squares = [np.full_like(p, 1e-6) for p in (vectors, layer, bias)]
    wanted = np.eye(2, dtype=np.float32)[labels.astype(int)]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(texts), -(-texts // BATCH)):
            own = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch])
            used, column_of = np.unique(buckets[own], return_inverse=True)
            bags = np.zeros((len(batch), len(used)), np.float32)
            bags[np.repeat(np.arange(len(batch)), sizes[batch]), column_of] = shares[own]
            mean = bags @ vectors[used]
            out = mean @ layer + bias
            out = np.exp(out - out.max(1, keepdims=True))
            error = out / out.sum(1, keepdims=True) - wanted[batch]
            steps = bags.T @ (error @ layer.T), mean.T @ error, error.sum(0)
            squares[0][used] += steps[0] ** 2
            vectors[used] -= rate * steps[0] / np.sqrt(squares[0][used])
            for p, g, s in zip((layer, bias), steps[1:], squares[1:]):
                s += g * g
                p -= rate * g / np.sqrt(s)
    toxic = layer[:, 1] - layer[:, 0]
    return Subwords(weights, weights * (vectors @ toxic).astype(np.float32), float(bias[1] - bias[0]))


def logits(column: pa.Array, model: Subwords) -> np.ndarray:
    data, offsets = buffers(column)
    found = []
    for first, last in blocks(offsets):
        points, marks = code_points(data, offsets[first:last + 1])
        total, whole = np.zeros(last - first), np.zeros(last - first)
        for at, bucket in gram_buckets(points):
            edges = np.searchsorted(at, marks)
            for sums, values in ((total, model.shares), (whole, model.weights)):
                sums += np.diff(np.concatenate([[0.0], np.cumsum(values[bucket], dtype=np.float64)])[edges])
        found.append(total / np.maximum(whole, 1e-9) + model.bias)
    return np.concatenate(found) if found else np.zeros(0)


def _score(model):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(0.5 * (1 + np.tanh(0.5 * np.clip(logits(part, model.value), -60, 60))))
    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = FIT_ROWS):
    """The model as a broadcast variable; ``learn_from`` says of which label rows' ``doc_id`` it may learn."""
    sample = labelled_sample(docs, labels, "toxic", learn_from, rows)
    model = fit_subwords(sample.column("text").combine_chunks(), sample.column("label").to_numpy())
    return python_ready(docs).sparkSession.sparkContext.broadcast(model)


def classify_toxicity(docs: DataFrame, labels: DataFrame, divisor: int = 5, left_out: int = 0) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; labels of ids with that remainder are not learned from."""
    model = fit_toxicity(docs, labels, remainder(divisor) != left_out)
    score = F.arrow_udf(tidy(_score(model)), "double", F.ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string"))
    scored = docs.select("doc_id", F.coalesce(remainder(divisor) == left_out, F.lit(False)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
