"""Singular vectors from sparse products of a fixed width, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalith.functions import vectors
from chromalith.operators import matrices, svd


def _entries(spark, x, chroms):
    rows = [(f"c{i:03d}", c, 0, k + 1, float(x[i, k])) for c, (a, b) in chroms.items() for i in range(len(x)) for k in range(a, b) if x[i, k]]
    return spark.createDataFrame(rows, "cell_id string, chrom string, i int, j int, v double").repartition(4)


def test_more_cells_than_the_width_in_many_blocks(spark, monkeypatch):
    """150 cells, of which each chromosome has vectors of width 64 in blocks of some 1,000 entries; one cell lacks a chromosome."""
    monkeypatch.setattr(svd, "BLOCK", 1000)
    rng = np.random.default_rng(0)
    n, f = 150, 120
    # values that fall, as those of contact maps do, and one chromosome of low rank
    x = (rng.random((n, 40)) * 0.7 ** np.arange(40)) @ rng.random((40, f)) * (rng.random((n, f)) < 0.6)
    x[:, 80:] = rng.random((n, 3)) @ rng.random((3, 40))
    x[5, 80:] = 0
    chroms = {"chr1": (0, 80), "chr2": (80, f)}
    entries = _entries(spark, x, chroms)
    u = {(r.chrom, r.cell_id): r.u for r in svd.left_vectors(entries, 6).collect()}
    sides = []
    for c, (a, b) in chroms.items():
        want = np.linalg.svd(x[:, a:b], full_matrices=False)[0][:, : 6 if c == "chr1" else 3]
        got = np.array([u.get((c, f"c{i:03d}"), [0.0] * want.shape[1]) for i in range(n)])
        assert got.shape == want.shape and np.abs(want @ want.T @ got - got).max() < 1e-4 and np.allclose(got.T @ got, np.eye(want.shape[1]))
        sides.append(want)
    z = np.array([r.emb for r in matrices.svd_embedding(entries, 6, 4).orderBy("cell_id").collect()])
    left, values, _ = np.linalg.svd(np.concatenate(sides, 1), full_matrices=False)
    assert z.shape == (n, 4) and np.allclose(np.sort(np.linalg.norm(z, axis=0)), np.sort(values[:4]), atol=1e-4)
    assert (z[np.abs(z).argmax(0), np.arange(4)] > 0).all()
    with pytest.raises(ValueError, match="at most 64"):
        svd.left_vectors(entries, 65)


def test_sums_of_vectors_in_a_tree(spark):
    x = np.random.default_rng(1).random((500, 7))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(37)
    assert np.allclose(vectors.tree_sum(df, 4).first()["v"], x.sum(0)) and vectors.tree_sum(df.filter("false")).first() is None
    table = vectors.written(df, "t")
    assert table.count() == 500
    vectors.dropped(table)
    assert not spark._jvm.org.apache.hadoop.fs.Path(table._written).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(table._written))
    assert vectors.first_row(spark.range(3).agg(F.sum("id").alias("s")))["s"] == 3
