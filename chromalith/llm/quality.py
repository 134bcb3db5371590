"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and hashed character n-grams (3 to 5 bytes, the
blank next to a word counting as its boundary), with a softmax over two classes on top; trained by numpy
stochastic gradient descent on a bounded sample of labelled rows (parameters max_docs and max_bytes). As the
output is linear in the average, scoring folds vectors and softmax weights into one number for each bucket, so
that a score is a mean of looked-up numbers and every byte of every text is read.

Every document also has one feature of its own kind, so that empty and null texts have a learned score. No other
column than the text is read. Repeated rows score alike; an empty table gives no rows; without usable labels
all scores are 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalith.llm import _text
from chromalith.llm._train import fold, learn_from, training_sample

BITS = 18
COUNT_BITS = 13
MOST = (1 << COUNT_BITS) - 1
U32 = np.uint32
IDENTITY = np.arange(256, dtype=np.uint8)


class Folded(NamedTuple):
    """Vectors and softmax weights in one number for each bucket, and the difference of the biases."""

    table: np.ndarray
    bias: float


@dataclass
class Model:
    vectors: np.ndarray  # buckets + 1 (the document's own feature) x dim
    weights: np.ndarray  # 2 x dim
    bias: np.ndarray  # 2

    def folded(self) -> Folded:
        return Folded((self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def buckets(data: np.ndarray, offsets: np.ndarray):
    """(byte position, bucket) of the words, character n-grams and word patterns of a chunk.

    A pattern says which of a word and its four predecessors are equal; it stands for the hashed word n-grams
    that would otherwise each be seen once.
    """
    yield from _text.features(data, offsets, IDENTITY, _text.SPACE, (3, 4, 5), BITS)
    words = _text.Words(data, offsets, IDENTITY)
    h, n = words.hashes, len(words.hashes)
    start = np.repeat(words.first[:-1], np.diff(words.first))
    pattern = np.zeros(n, U32)
    for k in range(1, 5):
        equal = np.zeros(n, bool)
        equal[k:] = (h[k:] == h[:-k]) & (np.arange(k, n) - k >= start[k:])
        pattern |= equal.astype(U32) << U32(k - 1)
    yield words.starts, (pattern + U32(1)) * U32(0x9E3779B1) >> U32(32 - BITS)


def scores_of(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for _, data, offsets in _text.chunks(texts):
        total = np.full(len(offsets) - 1, float(table[-1]))
        count = np.ones(len(offsets) - 1)
        for at, bucket in buckets(data, offsets):
            bounds = np.searchsorted(at, offsets)
            sums = np.concatenate(([0.0], np.cumsum(table[bucket], dtype=np.float64)))
            total += sums[bounds[1:]] - sums[bounds[:-1]]
            count += np.diff(bounds)
        out.append(1 / (1 + np.exp(-np.clip(total / count + bias, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def packed_features(texts: pa.Array) -> list[np.ndarray]:
    """For each document its distinct buckets and how often each occurs, in 32 bits: bucket << 13 | count."""
    out = []
    for _, data, offsets in _text.chunks(texts):
        found = [(bucket, np.searchsorted(at, offsets)) for at, bucket in buckets(data, offsets)]
        for d in range(len(offsets) - 1):
            own = np.concatenate([*(bucket[b[d] : b[d + 1]] for bucket, b in found), [1 << BITS]]).astype(np.uint32)
            u, c = np.unique(own, return_counts=True)
            out.append(u << U32(COUNT_BITS) | np.minimum(c, MOST).astype(np.uint32))
    return out


def train(texts: pa.Array, y: np.ndarray, dim: int = 12, epochs: int = 4, rate: float = 4.0, seed: int = 0) -> Model:
    """A feature counts MOST times in a document at most."""
    rng = np.random.default_rng(seed)
    rows = (1 << BITS) + 1
    vectors = rng.uniform(-1 / dim, 1 / dim, (rows, dim)).astype(np.float32)
    weights, bias = np.zeros((2, dim)), np.zeros(2)
    features = packed_features(texts)
    # buckets of one document only say nothing about others
    seen = np.zeros(rows, np.int64)
    for f in features:
        seen[f >> U32(COUNT_BITS)] += 1
    vectors[seen < 2] = 0
    steps, done = max(1, epochs * len(features)), 0
    for _ in range(epochs):
        for d in rng.permutation(len(features)):
            lr = rate * (1 - done / steps)
            done += 1
            u = features[d] >> U32(COUNT_BITS)
            share = (features[d] & U32(MOST)).astype(np.float32)
            share /= share.sum()
            known = seen[u] >= 2
            u, share = u[known], share[known]
            mean = share @ vectors[u]
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            back = p @ weights
            weights -= lr * 0.1 * np.outer(p, mean)
            bias -= lr * 0.02 * p
            vectors[u] -= (lr * share[:, None] * back[None, :]).astype(np.float32)
    return Model(vectors, weights, bias)


def _fold_in(texts: pa.Array, y: np.ndarray) -> dict:
    table, bias = train(texts, y).folded()
    return {"scores": table.tobytes(), "bias": bias}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_docs: int = 5000, max_bytes: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.1) -> Folded:
    """Train on at most max_docs labelled documents with at most max_bytes of text that `learn` allows, none of them
    longer than max_share of these bytes."""
    found = learn_from(training_sample(docs, labels, label, learn, max_docs, max_bytes, id_col, text_col, max_share), _fold_in, "scores binary, bias double")
    return Folded(np.frombuffer(found["scores"], np.float32), found["bias"])


def score(docs: DataFrame, model: Folded, text_col: str = "text", keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """The columns `keep` (all by default) and `into`, the likelihood of class 1; `into` must be none of them. The model
    is a table of 2**18 numbers."""
    table, bias = model
    names = docs.columns if keep is None else keep
    if into in names:
        raise ValueError(f"{into} is a column of the table; name another with `into`")
    schema = docs.select(*[F.col(f"`{n}`") for n in names]).schema

    def run(batches):
        for batch in batches:
            found = scores_of(batch.column(0), table, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], [*batch.schema.names[1:], "score"])
        _text.give_back()

    kinds = ", ".join(f"`_{i}` {f.dataType.simpleString()}" for i, f in enumerate(schema))
    out = docs.select(F.col(f"`{text_col}`").alias("_t"), *[F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names)]).mapInArrow(run, f"{kinds}, score double")
    return out.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)], F.col("score").alias(into))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5, out_fold: int = 0) -> DataFrame:
    """id_col, held_out, score, predicted for every document; rows of the fold out_fold are not learnt from."""
    model = fit(docs, labels, fold(F.col(id_col), folds) != out_fold, id_col=id_col, text_col=text_col)
    out = score(docs, model, text_col, [id_col])
    return out.select(id_col, (fold(F.col(id_col), folds) == out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
