"""Sinks. Tables are partitioned by their keys, so that re-runs overwrite what they write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_matrices(matrix: DataFrame, path: str, overwrite: bool = True) -> None:
    """Long-form matrices by cell. Rows without an index or a value are left out; indices that aren't whole numbers or values that aren't
    numbers are an error, and so is a matrix without rows, or an existing table if overwrite is off."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    for name, kinds in (("i", whole), ("j", whole), ("v", T.NumericType)):
        if not isinstance(kind := matrix.schema[name].dataType, kinds):
            raise TypeError(f"{name} is {kind.simpleString()}")
    rows = matrix.dropna(subset=["i", "j", "v"])
    if rows.isEmpty():
        raise ValueError("no matrix to write")
    rows.repartition("cell_id").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("cell_id").parquet(path)


def write_by_cell(df: DataFrame, path: str) -> None:
    """Per-cell tables; only the cells at hand are replaced."""
    df.repartition("cell_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_id").parquet(path)


def write_bed(df: DataFrame, path: str, columns: tuple[str, ...] = ("chrom", "start", "end")) -> None:
    """Tab-separated without header, ordered by chromosome (as text) and start."""
    df.select(*columns).orderBy("chrom", "start").write.mode("overwrite").csv(path, sep="\t", header=False)


def write_bedgraph(track: DataFrame, path: str) -> None:
    write_bed(track, path, ("chrom", "start", "end", "value"))


def write_compartments(scores: DataFrame, path: str) -> None:
    """chrom, start, end, score with five digits, by cell."""
    rows = scores.withColumn("score", F.format_string("%.5f", "score"))
    rows.repartition("cell_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_id").csv(path, sep="\t", header=True)


def write_loops(loops: DataFrame, path: str) -> None:
    write_by_cell(loops, path)


def write_dna_bins(bins: DataFrame, path: str, array: bool = False) -> None:
    """Bin records, one a line; array: one JSON array a chromosome, whose length then bounds a row."""
    if not array:
        bins.write.mode("overwrite").json(path)
        return
    names = sorted(bins.columns, key=lambda c: c != "bin")
    whole = bins.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("records"))
    whole.select("chrom", F.to_json("records").alias("value")).write.mode("overwrite").partitionBy("chrom").text(path)


def write_table(df: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """A tab-separated table with a header, in order: metadata, metrics, logs of cells."""
    df.orderBy(*order).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_config(spark: SparkSession, path: str, **values) -> None:
    """Settings as one JSON object."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_manifest(names: DataFrame, path: str) -> None:
    names.select("file").orderBy("file").coalesce(1).write.mode("overwrite").text(path)
