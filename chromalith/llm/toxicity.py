"""Toxicity by multiple-instance learning.

A sentence's probability is a logistic function of its hashed words and character n-grams (4, 5 and 6 bytes); a document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only document labels are learnt from, by numpy gradient steps on a bounded sample
(parameters max_docs and max_bytes); sentences at or above `sentence_threshold` are then the offending ones.

Sentences end at . ! ? or a line's end; words are runs of other than ASCII blanks and punctuation, A-Z
lower-cased. A text without words (null and empty ones) has no sentence and the score 0. Only the text is read.
Repeated rows score alike; an empty table gives no rows; without usable labels all scores are near 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalith.llm import _text
from chromalith.llm._train import fold, learn_from, training_sample

BITS = 18
#: Lengths of n-grams in bytes, chosen by cross-validation within the learning folds.
SIZES = (4, 5, 6)
NARROW, WIDE = 14, 40  # bits of a sentence's number beside a bucket
GAPS = _text.SPACE.copy()
GAPS[[b for b in range(128) if not chr(b).isalnum()]] = True
ENDS = np.zeros(256, bool)
ENDS[[*b".!?\n"]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class Sentences:
    """Sentences of a chunk that have words: bytes [begin, end); those of document d are first[d] to first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        bounds = np.unique(np.concatenate((offsets, np.flatnonzero(ENDS[data]) + 1)))
        self.features = list(_text.features(data, offsets, _text.LOWER, GAPS, SIZES, BITS))
        has = np.diff(np.searchsorted(self.features[0][0], bounds)) > 0
        self.begin, self.end = bounds[:-1][has], bounds[1:][has]
        self.first = np.searchsorted(self.begin, offsets)

    def logits(self, model: Model) -> np.ndarray:
        """Each feature counts once in a sentence, however often it is repeated there."""
        pairs = []
        for at, bucket in self.features:
            told = model.weights[bucket] > 0
            of = np.searchsorted(self.begin, at[told], "right") - 1
            pairs.append(of.astype(np.int64) << BITS | bucket[told])
        pairs = np.unique(np.concatenate(pairs))
        return np.bincount(pairs >> BITS, model.weights[pairs & ((1 << BITS) - 1)], len(self.begin)) + model.bias


def _pairs(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each document its distinct pairs of bucket and sentence (numbered from 0), as bucket << shift | sentence with
    shift NARROW, in 32 bits; a document of more sentences than that holds has 64 bits and the shift WIDE."""
    for _, data, offsets in _text.chunks(texts):
        s = Sentences(data, offsets)
        at, bucket = (np.concatenate(x) for x in zip(*s.features, strict=True))
        of = np.searchsorted(s.begin, at, "right") - 1
        doc = np.searchsorted(s.first, of, "right") - 1
        order = np.argsort(doc, kind="stable")
        of, bucket, doc = of[order], bucket[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            kind, shift = (np.uint32, NARROW) if s.first[d + 1] - s.first[d] <= 1 << NARROW else (np.uint64, WIDE)
            yield np.unique(bucket[a:b].astype(kind) << kind(shift) | (of[a:b] - s.first[d]).astype(kind))


def _apart(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets in order, sentences) of a document's pairs."""
    kind = pairs.dtype.type
    shift = NARROW if kind is np.uint32 else WIDE
    return (pairs >> kind(shift)).astype(np.int64), (pairs & kind((1 << shift) - 1)).astype(np.int64)


def train(texts: pa.Array, y: np.ndarray, epochs: int = 6, rate: float = 0.4, decay: float = 1e-5, min_docs: int = 4, seed: int = 0) -> Model:
    # buckets of few documents say nothing about others: they are counted first, so that only the others are held
    df = np.zeros(1 << BITS, np.int64)
    for pairs in _pairs(texts):
        df[np.unique(_apart(pairs)[0])] += 1
    docs = [pairs[df[_apart(pairs)[0]] >= min_docs] for pairs in _pairs(texts)]
    balance = max(1.0, float(np.sum(y == 0)) / max(1, np.sum(y == 1)))  # both classes weigh alike
    weights, seen, bias, seen_bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3), -4.0, 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            if not len(docs[d]):
                continue
            bucket, of = _apart(docs[d])
            new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            u, inverse = bucket[new], np.cumsum(new) - 1
            w = weights[u]
            z = np.bincount(of, w[inverse]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
            # of -log P(y): the noisy-or hands the gradient to the sentences that explain the label
            g = p if not y[d] else -balance * none * p / max(1 - none, 1e-9)
            gw = np.bincount(inverse, g[of]) + decay * w
            seen[u] += gw * gw
            # no feature speaks against toxicity: a sentence is as bad as its worst part, however long it is
            weights[u] = np.maximum(0, w - rate * gw / np.sqrt(seen[u]))
            gb = g.sum()
            seen_bias += gb * gb
            bias -= rate * gb / np.sqrt(seen_bias)
    weights[weights < 0.01] = 0
    return Model(weights.astype(np.float32), float(bias))


def _weights(texts: pa.Array, y: np.ndarray) -> dict:
    model = train(texts, y)
    return {"weights": model.weights.tobytes(), "bias": model.bias}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", max_docs: int = 5000, max_bytes: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.1) -> Model:
    """Train on at most max_docs labelled documents with at most max_bytes of text that `learn` allows, none of them
    longer than max_share of these bytes."""
    found = learn_from(training_sample(docs, labels, label, learn, max_docs, max_bytes, id_col, text_col, max_share), _weights, "weights binary, bias double")
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sentence_threshold: float = 0.5) -> DataFrame:
    """id_col, score and `offending`: the spans [start, end) in code points and scores of offending sentences."""

    def run(batches):
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            found, spans = [], []
            for _, data, offsets in _text.chunks(batch.column(1)):
                s = Sentences(data, offsets)
                z = s.logits(model)
                none = np.concatenate(([0.0], np.cumsum(np.logaddexp(0, z))))
                found.append(1 - np.exp(none[s.first[:-1]] - none[s.first[1:]]))
                mine: list[list] = [[] for _ in range(len(offsets) - 1)]
                bad = np.flatnonzero(z >= np.log(sentence_threshold / (1 - sentence_threshold)))
                if len(bad):
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    for k, d in zip(bad, np.searchsorted(s.first, bad, "right") - 1, strict=True):
                        a, b = points[[s.begin[k], s.end[k]]] - points[offsets[d]]
                        mine[d].append({"start": int(a), "end": int(b), "score": float(1 / (1 + np.exp(-z[k])))})
                spans += mine
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else [], pa.float64()), pa.array(spans, pa.list_(span))], ["k", "score", "offending"])
        _text.give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"k {kind}, score double, offending array<struct<start: bigint, end: bigint, score: double>>")
    return out.withColumnRenamed("k", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, folds: int = 3, out_fold: int = 1) -> DataFrame:
    """id_col, held_out, score, predicted, offending for every document; rows of the fold out_fold are not learnt from."""
    model = fit(docs, labels, fold(F.col(id_col), folds) != out_fold, id_col=id_col, text_col=text_col)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, (fold(F.col(id_col), folds) == out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
