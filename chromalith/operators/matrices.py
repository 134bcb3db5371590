"""Normalisation and linear algebra over long-form matrices; only tables of a fixed size reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.operators.segments import fixed_sign, moments
from chromalith.operators.svd import cell_embedding

GRAPH = ("cell_id", "chrom")


def mean_total(matrix: DataFrame) -> DataFrame:
    """The mean over cells of whole-cell totals, the coverage target."""
    return matrix.groupBy("cell_id").agg(F.sum("v").alias("t")).agg(F.avg("t").alias("target"))


def scale_to_target(matrix: DataFrame) -> DataFrame:
    """Every chromosome matrix scaled to the mean whole-cell total; sums of 0 or less stay."""
    total = F.sum("v").over(W.partitionBy(*GRAPH))
    out = matrix.withColumn("_t", total).join(F.broadcast(mean_total(matrix)), how="cross")
    return out.select(*GRAPH, "i", "j", F.when(F.col("_t") > 0, F.col("v") / F.col("_t") * F.col("target")).otherwise(F.col("v")).alias("v"))


def sqrt_vc(matrix: DataFrame, symmetric: bool = False) -> DataFrame:
    """E = A + A', then v / sqrt(d_i d_j), sums of 0 as 1. symmetric: A is known to be so and has each entry once, then E is
    twice A without a sum; else both orientations come from one scan.

    E is symmetric, so the sum of column j is that of row j: laid out by matrix, both sums are windows over the same rows, without a
    join or a further shuffle.
    """
    v = F.col("v").cast("double")
    if symmetric:
        e = matrix.select(*GRAPH, "i", "j", (2 * v).alias("v"))
    else:
        ends = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
        both = matrix.select(*GRAPH, v.alias("v"), F.explode(ends).alias("e")).select(*GRAPH, "e.i", "e.j", "v")
        e = both.groupBy(*GRAPH, "i", "j").agg(F.sum("v").alias("v"))
    own = lambda k: F.sum("v").over(W.partitionBy(*GRAPH, k))
    sums = e.repartition(*GRAPH).withColumns({"di": own("i"), "dj": own("j")})
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    return sums.select(*GRAPH, "i", "j", (F.col("v") / F.sqrt(one("di") * one("dj"))).alias("v"))


def normalized(matrix: DataFrame, scale: bool = True, remove_diagonal: bool = True, vc: bool = True, symmetric: bool = False) -> DataFrame:
    out = scale_to_target(matrix) if scale else matrix
    out = out.filter("i != j and v != 0") if remove_diagonal else out
    return sqrt_vc(out, symmetric) if vc else out


def upper_features(matrix: DataFrame) -> DataFrame:
    """Entries above the diagonal as sparse features keyed by (chrom, i, j)."""
    return matrix.filter("i < j").select(*GRAPH, "i", "j", F.col("v").cast("double").alias("v"))


def cell_status(cells: DataFrame, matrix: DataFrame, chroms: list[str], allow_missing: bool = False, masked: list[str] | None = None) -> DataFrame:
    """ok, skip_missing_chrom, skip_empty_or_broken or skip_mask_missing for every cell, with its total and used chromosomes.
    masked: the chromosomes that have a feature mask; all by default."""
    have = matrix.filter(F.col("chrom").isin(*chroms)).groupBy(*GRAPH).agg(F.sum("v").alias("t"))
    s = have.groupBy("cell_id").agg(F.sum("t").alias("total_contacts"), F.array_join(F.sort_array(F.collect_set("chrom")), ",").alias("used_chroms"), F.countDistinct("chrom").alias("n"))
    out = cells.select("cell_id").distinct().join(s, "cell_id", "left")
    status = F.when(F.coalesce("total_contacts", F.lit(0)) <= 0, "skip_empty_or_broken").when((F.col("n") < len(chroms)) & F.lit(not allow_missing), "skip_missing_chrom")
    if masked is not None:
        status = status.when(F.exists(F.split("used_chroms", ","), lambda c: ~c.isin(*masked)) if masked else F.lit(True), "skip_mask_missing")
    status = status.otherwise("ok")
    return out.select("cell_id", status.alias("status"), F.coalesce("total_contacts", F.lit(0)).alias("total_contacts"), F.coalesce("used_chroms", F.lit("")).alias("used_chroms"))


def gram(features: DataFrame, per_chrom: bool = True) -> DataFrame:
    """Inner products of cells, (chrom, c1, c2, g), by a self-join on the feature."""
    keys = ["chrom", "i", "j"]
    a, b = (features.select(*keys, F.col("cell_id").alias(c), F.col("v").alias(f"v{c}")) for c in ("c1", "c2"))
    group = (["chrom"] if per_chrom else []) + ["c1", "c2"]
    return a.join(b, keys).filter("c1 <= c2").groupBy(*group).agg(F.sum(F.col("vc1") * F.col("vc2")).alias("g"))


def svd_embedding(features: DataFrame, dim_chrom: int = 50, dim: int = 50) -> DataFrame:
    """Uncentred SVD of each chromosome's features, left vectors side by side, then SVD of these times its values; see svd."""
    return cell_embedding(features, dim_chrom, dim)


def standard_scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std, constant columns only centred."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    out = rows.join(F.broadcast(stats), how="cross")
    sd = lambda c: F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))
    return out.select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - F.col(f"m_{c}")) / sd(c)).alias(c) for c in columns])


def pca(rows: DataFrame, n: int, column: str = "x") -> DataFrame:
    """Centred principal components of an array column, signs fixed; moments are summed by partition."""
    dim = len(rows.first()[column])
    _, mean, cov = moments(rows.select(F.col(column).alias("z")), dim)
    axes = fixed_sign(np.linalg.eigh(cov)[1][:, ::-1])[:, :n]
    at = lambda k: F.aggregate(F.zip_with(F.col(column), F.array(*[F.lit(float(v)) for v in axes[:, k]]), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) - F.lit(float(mean @ axes[:, k]))
    return rows.withColumn("pc", F.array(*[at(k) for k in range(n)]))


def kmeans(rows: DataFrame, k: int, column: str = "x", seed: int = 42) -> DataFrame:
    """Cluster numbers by the library's k-means; labels are arbitrary."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data).transform(data).drop("_v")
