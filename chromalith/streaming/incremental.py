"""Incremental forms of the associative sums: the reference data is batch, these are our own addition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_matrix(contacts: DataFrame, bin_size: int) -> DataFrame:
    """Upper-triangle sums of a stream of contacts, for update mode; both triangles follow by contacts.symmetric."""
    a, b = (F.floor(F.col(c) / bin_size).cast("int") for c in ("coord1", "coord2"))
    return contacts.filter("chr1 = chr2 and coord1 != coord2").groupBy("cell_id", F.col("chr1").alias("chrom"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum("count").alias("v"))


def windowed_votes(events: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Votes and their sum by tumbling window and type; windows close once the watermark has passed them."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
