"""A/B compartments: bins, coarsening, the A state by GC, scores, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.functions.columns import argmax

GRAPH = ("cell_id", "chrom")


def chrom_bins(sizes: DataFrame, bin_size: int) -> DataFrame:
    """ceil(size / bin) bins of each chromosome, the last clipped to its size."""
    k = sizes.filter("size > 0").select("chrom", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / bin_size).cast("int") - 1)).alias("bin"))
    start = F.col("bin").cast("long") * bin_size
    return k.select("chrom", "bin", start.alias("start"), F.least(start + bin_size, F.col("size").cast("long")).alias("end"))


def positional_gc(gc: DataFrame) -> DataFrame:
    """The k-th row of a chromosome, by start and end, belongs to its k-th bin."""
    return gc.select("chrom", (F.row_number().over(W.partitionBy("chrom").orderBy("start", "end")) - 1).alias("bin"), "gc")


def coarsen(proba: DataFrame, bins: DataFrame, gc: DataFrame, factor: int) -> DataFrame:
    """Groups of `factor` bins of each sequence: start, end, mean probabilities and mean GC; sequences are cut to the
    bins that have coordinates and GC."""
    rows = proba.join(bins, ["chrom", "bin"]).join(positional_gc(gc), ["chrom", "bin"])
    p = rows.select(*GRAPH, F.floor(F.col("bin") / factor).cast("int").alias("g"), "start", "end", "gc", "proba")
    n = 2
    return p.groupBy(*GRAPH, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("gc").alias("gc"), F.array(*[F.avg(F.col("proba")[i]) for i in range(n)]).alias("proba"))


def a_state(coarse: DataFrame) -> DataFrame:
    """The state of highest mean GC among bins whose likeliest state it is, by sequence; the lower one of equals."""
    hard = coarse.select(*GRAPH, "gc", argmax(F.col("proba")).alias("s"))
    means = [F.coalesce(F.avg(F.when(F.col("s") == k, F.col("gc"))), F.lit(-1e9)) for k in range(2)]
    return hard.groupBy(*GRAPH).agg(argmax(F.array(*means)).alias("a"))


def scores(coarse: DataFrame) -> DataFrame:
    """p(A) - p(B) of every coarse bin, two states."""
    p = F.col("proba")
    return coarse.join(a_state(coarse), list(GRAPH)).select(*GRAPH, "start", "end", F.when(F.col("a") == 0, p[0] - p[1]).otherwise(p[1] - p[0]).alias("score"))


def consensus(scores: DataFrame, digits: int | None = 5) -> DataFrame:
    """Mean over cells by interval, of scores as they are written (five digits)."""
    s = F.col("score") if digits is None else F.round("score", digits)
    return scores.groupBy("chrom", "start", "end").agg(F.avg(s).alias("score"))


def cluster_consensus(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    return scores.join(clusters.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "chrom", "start", "end").agg(F.avg("score").alias("score"))
