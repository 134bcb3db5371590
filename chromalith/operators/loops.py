"""Loops: predictions as intervals and their evaluation with a tolerance on the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalith.functions.columns import sigmoid


def to_bedpe(scored: DataFrame, resolution: int, threshold: float = 0.7) -> DataFrame:
    """Pairs (cell_id, chrom, src, dst, logit) whose sigmoid exceeds the threshold, as intervals."""
    p = scored.withColumn("score", sigmoid(F.col("logit"))).filter(F.col("score") > threshold)
    a, b = (F.col(c).cast("long") * resolution for c in ("src", "dst"))
    return p.select("cell_id", F.col("chrom").alias("chrom1"), a.alias("start1"), (a + resolution).alias("end1"), F.col("chrom").alias("chrom2"), b.alias("start2"), (b + resolution).alias("end2"), "score", "logit", F.col("src").alias("bin1"), F.col("dst").alias("bin2"))


def as_points(bedpe: DataFrame) -> DataFrame:
    """Predictions as the evaluator reads them: x1 and y1 are the interval starts."""
    return bedpe.select("cell_id", "chrom1", F.col("start1").alias("x1"), F.col("start2").alias("y1"))


def intra_by_distance(loops: DataFrame, resolution: int, low: int = 2, high: int = 100) -> DataFrame:
    """Within one chromosome, at a bin distance of low..high; bins by floor."""
    same = loops.filter("chrom1 = chrom2") if "chrom2" in loops.columns else loops
    return same.filter(F.abs(F.floor(F.col("y1") / resolution) - F.floor(F.col("x1") / resolution)).between(low, high))


def slack_expand(points: DataFrame, slack_bins: int, resolution: int) -> DataFrame:
    """All copies of the points shifted by up to slack_bins on either axis, without negative coordinates: a range join
    becomes an equi-join."""
    d = F.sequence(F.lit(-slack_bins), F.lit(slack_bins))
    keys = [c for c in points.columns if c not in ("x1", "y1")]
    moved = points.select(*keys, "x1", "y1", F.explode(d).alias("dx")).select(*keys, (F.col("x1") + F.col("dx") * resolution).alias("x1"), "y1", F.explode(d).alias("dy"))
    return moved.select(*keys, "x1", (F.col("y1") + F.col("dy") * resolution).alias("y1")).filter("x1 >= 0 and y1 >= 0").distinct()


def loop_coverage(graphs: DataFrame, found: DataFrame) -> DataFrame:
    """n_graphs, n_used (with a reference loop at least) and their share, 0 without graphs; both by (cell_id, chrom)."""
    key = ["cell_id", "chrom"]
    hit = found.select(*key).distinct().withColumn("_h", F.lit(1))
    out = graphs.select(*key).distinct().join(hit, key, "left").agg(F.count(F.lit(1)).alias("n_graphs"), F.count("_h").alias("n_used"))
    return out.withColumn("coverage", F.col("n_used") / F.greatest("n_graphs", F.lit(1)))


def evaluate(pred: DataFrame, refs: DataFrame, resolution: int = 10_000, slack: int = 20_000, cells: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 of every cell against shared references (chrom1, x1, y1), all cells at once.

    The few references are expanded for precision; for recall each cell's predictions are. Points off the grid of the
    other side never match. Without references the figures are 0, and so they are for the cells of `cells` (cell_id)
    that have no predictions.
    """
    sb = round(slack / resolution)
    point = ["chrom1", "x1", "y1"]
    refs = refs.select(*point).distinct()
    pred = pred.select("cell_id", *point).distinct()
    n_ref = refs.agg(F.count(F.lit(1)).alias("n_ref"))
    near = slack_expand(refs, sb, resolution)
    hit = pred.join(near.withColumn("_h", F.lit(1)), point, "left").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_pred"), F.count("_h").alias("hit_pred"))
    found = slack_expand(pred, sb, resolution).join(refs, point, "left_semi").groupBy("cell_id").agg(F.count(F.lit(1)).alias("hit_ref"))
    if cells is not None:
        hit = cells.select("cell_id").unionByName(pred.select("cell_id")).distinct().join(hit, "cell_id", "left").na.fill(0, ["n_pred", "hit_pred"])
    out = hit.join(found, "cell_id", "left").join(n_ref, how="cross").na.fill(0, ["hit_ref"])
    p = F.when(F.col("n_pred") > 0, F.col("hit_pred") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("n_ref") > 0, F.col("hit_ref") / F.col("n_ref")).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1).select("cell_id", "n_pred", "n_ref", "precision", "recall", "f1")
