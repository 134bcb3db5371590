"""Runs, boundaries, votes, windows of counts: ordered operations as windows, range joins as bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAPH = ("cell_id", "chrom")


def boundaries(labels: DataFrame) -> DataFrame:
    """(.., bin) where the next bin has another label."""
    w = W.partitionBy(*GRAPH).orderBy("bin")
    return labels.withColumn("_n", F.lead("label").over(w)).filter("_n is not null and _n != label").select(*GRAPH, "bin")


def run_length(labels: DataFrame, bin_size: int | None = None) -> DataFrame:
    """Runs of equal labels as inclusive bins; with bin_size also as [start, end) in base pairs, end = (last + 1) * bin."""
    w = W.partitionBy(*GRAPH).orderBy("bin")
    new = F.when(F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)
    runs = labels.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(*GRAPH, "run").agg(F.first("label").alias("label"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin")).drop("run")
    if bin_size:
        out = out.withColumns({"start": F.col("first_bin").cast("long") * bin_size, "end": (F.col("last_bin") + 1).cast("long") * bin_size})
    return out


def vote_fractions(votes: DataFrame, cells: DataFrame, n_bins: DataFrame) -> DataFrame:
    """Share of cells voting for each boundary bin. votes: chrom, cell_id, b; cells: chrom, k (number of cells, those
    without boundaries included); n_bins: chrom, n_bins. Bins outside 0 <= b < n_bins - 1 don't count."""
    ok = votes.join(n_bins, "chrom").filter("b >= 0 and b < n_bins - 1")
    one = ok.select("chrom", "b", "cell_id").distinct().groupBy("chrom", "b").agg(F.count(F.lit(1)).alias("votes"))
    return one.join(cells, "chrom").select("chrom", "b", "votes", (F.col("votes") / F.col("k")).alias("frac"))


def vote_track(fractions: DataFrame, n_bins: DataFrame, bin_size: int) -> DataFrame:
    """The vote fraction of every bin as a bedGraph, zeros included."""
    bins = n_bins.select("chrom", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("b"))
    out = bins.join(fractions.select("chrom", "b", "frac"), ["chrom", "b"], "left")
    return out.select("chrom", (F.col("b").cast("long") * bin_size).alias("start"), ((F.col("b") + 1).cast("long") * bin_size).alias("end"), F.coalesce("frac", F.lit(0.0)).alias("value"))


def consensus_peaks(fractions: DataFrame, vote: float, min_sep: int) -> DataFrame:
    """Greedy choice by fraction, larger bin first on ties, of bins at least min_sep apart. A chromosome's bins are
    few (genome length / bin size), so its fold is one row."""
    rows = fractions.filter(F.col("frac") >= vote).groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("frac", "b")), asc=False).alias("peaks"))
    none = F.expr("cast(array() as array<int>)")
    far = lambda acc, b: F.forall(acc, lambda c: F.abs(c - b) >= min_sep)
    pick = F.aggregate("peaks", none, lambda acc, p: F.when(far(acc, p["b"]), F.concat(acc, F.array(p["b"].cast("int")))).otherwise(acc))
    return rows.select("chrom", F.explode(F.sort_array(pick)).alias("b"))


def consensus_intervals(peaks: DataFrame, n_bins: DataFrame, bin_size: int) -> DataFrame:
    """Intervals between consensus boundaries: (previous + 1 .. b), the tail up to n_bins - 1, in base pairs."""
    w = W.partitionBy("chrom").orderBy("b")
    head = peaks.select("chrom", (F.lag("b", 1, -1).over(w) + 1).alias("a"), "b")
    last = n_bins.join(peaks.groupBy("chrom").agg(F.max("b").alias("m")), "chrom", "left")
    tail = last.select("chrom", F.coalesce(F.col("m") + 1, F.lit(0)).alias("a"), (F.col("n_bins") - 1).alias("b")).filter("a <= b")
    return head.unionByName(tail).select("chrom", (F.col("a").cast("long") * bin_size).alias("start"), ((F.col("b") + 1).cast("long") * bin_size).alias("end"))


def window_counts(centers: DataFrame, points: DataFrame, half: int) -> DataFrame:
    """Points within [center - half, center + half] for every row of centers (chrom, center, ...). Each centre looks into the
    two or three buckets of width 2 * half + 1 that its window touches; an equi-join and an exact filter do the rest."""
    width = 2 * half + 1
    names = centers.columns
    keyed = centers.withColumn("_b", F.explode(F.sequence(F.floor((F.col("center") - half) / width), F.floor((F.col("center") + half) / width))))
    pts = points.select("chrom", "mid", F.floor(F.col("mid") / width).alias("_b"))
    hits = keyed.join(pts, ["chrom", "_b"]).filter((F.col("mid") >= F.col("center") - half) & (F.col("mid") <= F.col("center") + half))
    counts = hits.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return centers.join(counts, names, "left").select(*names, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def midpoints(bed: DataFrame) -> DataFrame:
    return bed.select("chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("mid"))


def two_means(counts: DataFrame, keys: tuple[str, ...] = GRAPH) -> DataFrame:
    """The threshold of the best split of each group's n into two clusters (least squares over all cuts), with the least
    n of the upper cluster; a group of equal values keeps all."""
    c = counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("m"))
    w = W.partitionBy(*keys).orderBy("n")
    every, upto = W.partitionBy(*keys), w.rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumns({"m0": F.coalesce(F.sum("m").over(upto), F.lit(0)), "s0": F.coalesce(F.sum(F.col("m") * F.col("n")).over(upto), F.lit(0)), "mm": F.sum("m").over(every), "ss": F.sum(F.col("m") * F.col("n")).over(every)})
    # least squares: the between-cluster sum is largest
    gain = F.when(F.col("m0") > 0, F.col("s0") * F.col("s0") / F.col("m0") + (F.col("ss") - F.col("s0")) * (F.col("ss") - F.col("s0")) / (F.col("mm") - F.col("m0"))).otherwise(F.lit(-1.0))
    return c.withColumn("gain", gain).groupBy(*keys).agg(F.max_by("n", F.struct("gain", -F.col("n"))).alias("threshold"))


def keep_enriched(counts: DataFrame, keys: tuple[str, ...] = GRAPH) -> DataFrame:
    return counts.join(two_means(counts, keys), list(keys)).filter("n >= threshold").drop("threshold")
