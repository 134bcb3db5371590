"""Boundary votes of a stream, each cell once for each bin and window, in state on disk that the watermark clears.

Repeated votes are dropped in one state, with an entry for each cell of a (window, chrom, bin); the rest are counted in another, with a
number for each (window, chrom, bin). Once the watermark has passed a window's end its numbers are given out and both states are
cleared. Rows that come after that are late and count no more. A query that is started again from its checkpoint goes on with the
state that it had.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalith.functions.vectors import shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "start timestamp, end timestamp, chrom string, b int, votes long"


def timed(votes: DataFrame, window: str = "1 hour") -> DataFrame:
    """The window w of each of votes (ts timestamp, chrom, cell_id, b), rows without one of these left out."""
    whole = votes.filter("ts is not null and chrom is not null and cell_id is not null and b is not null")
    return whole.select(F.window("ts", window).alias("w"), "chrom", F.col("b").cast("int").alias("b"), "cell_id")


def windowed(votes: DataFrame, window: str = "1 hour") -> DataFrame:
    """The same with the window's start and end in ms."""
    return timed(votes, window).select(F.unix_millis("w.start").alias("start"), F.unix_millis("w.end").alias("end"), "chrom", "b", "cell_id")


def vote_stream(votes: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """start, end, chrom, b, votes of every window of a stream, once it is over; to be written in append mode, under rocksdb()."""
    rows = timed(votes.withWatermark("ts", lateness), window).dropDuplicates(["w", "chrom", "b", "cell_id"])
    return rows.groupBy("w", "chrom", "b").agg(F.count(F.lit(1)).alias("votes")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chrom", "b", "votes")


def votes_so_far(votes: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Runs a stream over what there is now and reads what it has given out: the windows that are over by the watermark."""
    spark = votes.sparkSession
    out = shared_path(spark, "votes")
    with rocksdb(spark):
        q = vote_stream(votes, window, lateness).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "votes-state"))
        q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(out)


def vote_batch(votes: DataFrame, window: str = "1 hour") -> DataFrame:
    """The same of a table, no row being late."""
    at = lambda c: F.timestamp_millis(c).alias(c)
    return windowed(votes, window).select(at("start"), at("end"), "chrom", "b", "cell_id").distinct().groupBy("start", "end", "chrom", "b").agg(F.count(F.lit(1)).alias("votes"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on disk for the streams that are started in the block."""
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    held = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
