"""Bounded training samples of labelled documents, learnt from in one task on an executor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.llm._text import give_back


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo folds; a null identifier is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_docs: int, max_bytes: int, id_col: str, text_col: str, max_share: float = 0.1) -> DataFrame:
    """(place, text, y) of at most max_docs labelled documents and max_bytes of text, whole texts in hash order. Texts longer than
    max_share of max_bytes aren't drawn, so that no one text fills the sample; 1 draws all that fit.

    The identifiers are drawn from the labels alone and the texts by their lengths, so only the sample's texts move. An
    identifier that is labelled both ways isn't learnt from; one labelled twice alike counts once.
    """
    ids = labels.filter(learn & F.col(f"`{label}`").isNotNull()).select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y"))
    ids = ids.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2 and k is not null").select("k", "y")
    ids = ids.orderBy(F.xxhash64("k"), "k").limit(max_docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), text.alias("text")).join(F.broadcast(ids), "k").filter(F.octet_length("text") <= int(max_bytes * max_share))
    place = F.struct(F.xxhash64("k").alias("h"), F.col("k").alias("k"), F.xxhash64("text").alias("t"), F.octet_length("text").cast("long").alias("n"))
    # the places alone, at most max_docs of them, say where the sample ends
    first = rows.select(place.alias("place")).orderBy("place").limit(max_docs)
    first = first.withColumn("upto", F.sum("place.n").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    end = first.filter(F.col("upto") <= max_bytes).agg(F.max("place").alias("place"), F.count(F.lit(1)).alias("n")).first()
    rows = rows.select(place.alias("place"), "text", "y")
    if not end["n"]:
        return rows.limit(0)
    last = end["place"]
    upto = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).alias("k"), F.lit(last["t"]).alias("t"), F.lit(last["n"]).alias("n"))
    return rows.filter(F.col("place") <= upto).orderBy("place").limit(end["n"])


def learn_from(sample: DataFrame, train: Callable[[pa.ChunkedArray, np.ndarray], dict], schema: str) -> Row:
    """The row that `train` makes of the sample's texts and labels, in one task: the sample is bounded, and what comes
    back to the driver is the model alone."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        texts = pa.chunked_array([b.column("text") for b in held], pa.string())
        y = np.concatenate([b.column("y").to_numpy() for b in held]).astype(np.int64) if held else np.zeros(0, np.int64)
        found = train(texts, y)
        del held, texts
        give_back()
        yield pa.RecordBatch.from_pylist([{n: found[n] for n in names}])

    found = sample.repartition(1).sortWithinPartitions("place").select("text", "y").mapInArrow(run, schema).first()
    # of an empty sample no task comes about
    return found or Row(**train(pa.chunked_array([], pa.string()), np.zeros(0, np.int64)))
