"""Hand-worked cases for contact lists, matrices and features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalith.operators import contacts, features, graphs, matrices

FENDS = [("f1", "chr1", 150), ("f2", "chr1", 950), ("f3", "chr1", 250), ("f4", "chrX", 100), ("f5", "chr2", 100)]
ADJ = ["f1,f2,3", "f2,f1,2", "f1,f3,x", "f1,f1,4", "f1,f4,1", "f1,f5,1", "f1,f9,1", "f1,f3,2"]


@pytest.fixture(scope="module")
def golden(spark):
    adj = spark.createDataFrame([("c", *a.split(",")) for a in ADJ], "cell_id string, fend1 string, fend2 string, count string")
    fends = spark.createDataFrame(FENDS, "fend string, chr string, coord long")
    return contacts.filter_contacts(contacts.map_fends(contacts.numeric_counts(adj), fends))


def sizes(spark, n=1000):
    return spark.createDataFrame([("chr1", n)], "chrom string, size long")


def test_filter_and_merge(golden):
    assert sorted(tuple(r) for r in golden.select("chr1", "coord1", "coord2", "count").collect()) == [("chr1", 150, 250, 2), ("chr1", 150, 950, 5)]
    assert contacts.cell_totals(golden).first()["total"] == 7
    assert contacts.quality_cells(golden, 8).count() == 0 and contacts.quality_cells(golden, 7).count() == 2


@pytest.mark.parametrize(("bin_size", "want"), [(200, {(0, 4): 5, (4, 0): 5, (0, 1): 2, (1, 0): 2}), (500, {(0, 0): 4, (0, 1): 5, (1, 0): 5})])
def test_binning(spark, golden, bin_size, want):
    m = contacts.bin_contacts(golden, sizes(spark), bin_size)
    assert {(r.i, r.j): r.v for r in m.collect()} == want


def test_bins_of_divisible_size(spark):
    n = lambda mode: sizes(spark, 2_000_000).select(contacts.n_bins(F.col("size"), 20_000, mode)).first()[0]
    assert (n("matrix"), n("sequence")) == (101, 100)


def test_degree_profile(spark, golden):
    m = contacts.bin_contacts(golden, sizes(spark), 200)
    d = contacts.dims(m, sizes(spark), 200)
    raw = {r.bin: tuple(r)[3:] for r in features.ldp_raw(m, d).collect()}
    assert raw == {0: (7, 3.5, 2, 5, 1.5), 1: (2, 7, 7, 7, 0), 4: (5, 7, 7, 7, 0), 2: (0,) * 5, 3: (0,) * 5, 5: (0,) * 5}
    norm = {r.bin: tuple(r)[3:] for r in features.ldp(m, d).collect()}
    assert norm[0] == pytest.approx((1, 0.723308, 0.528321, 0.861654, 1), abs=1e-6)
    assert norm[1] == pytest.approx((0.528321, 1, 1, 1, 0), abs=1e-6)
    assert all(0 <= x <= 1 for v in norm.values() for x in v)


def test_sqrt_vc_ignores_scale(spark, golden):
    m = contacts.bin_contacts(golden, sizes(spark), 200)
    a = sorted(tuple(r) for r in matrices.sqrt_vc(m).collect())
    b = sorted(tuple(r) for r in matrices.sqrt_vc(m.withColumn("v", F.col("v") * 10)).collect())
    assert [x[:4] for x in a] == [x[:4] for x in b] and [x[4] for x in a] == pytest.approx([x[4] for x in b])


def test_candidates(spark):
    d = spark.createDataFrame([("c", "chr1", 4), ("d", "chr1", 2), ("e", "chr1", 0)], "cell_id string, chrom string, n_bins int")
    assert sorted((r.cell_id, r.src, r.dst) for r in graphs.candidate_pairs(d, 2, 20).collect()) == [("c", 0, 2), ("c", 0, 3), ("c", 1, 3)]


def test_negatives_avoid_positives(spark):
    pos = spark.createDataFrame([("c", "chr1", i, i + 1 + i % 7) for i in range(40)], "cell_id string, chrom string, src int, dst int")
    d = spark.createDataFrame([("c", "chr1", 50)], "cell_id string, chrom string, n_bins int")
    neg = {(r.src, r.dst) for r in graphs.mixed_negatives(pos, d).collect()}
    assert len(neg) == 40 and not neg & {(r.src, r.dst) for r in pos.collect()} and all(0 <= a < b < 50 for a, b in neg)


@pytest.mark.parametrize("band", [(1, None), (2, 3), (1, 5), (3, 4), (5, 100), (1, 1)])
def test_drawn_pairs_are_the_band_without_the_excluded(spark, band):
    """With a quota beyond the room every free pair comes, once; within it exactly the quota comes."""
    low, high = band
    cells = [(f"c{n}", "chr1", n) for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 16, 23]]
    dims = spark.createDataFrame(cells, "cell_id string, chrom string, n_bins int")
    pos = spark.createDataFrame([(c, "chr1", i, (i * 3 + k) % 29) for c, _, n in cells for i in range(n) for k in (1, 2)], "cell_id string, chrom string, src int, dst int")
    hit = {(r.cell_id, r.src, r.dst) for r in pos.collect()}
    free = {c: {(i, j) for i in range(n) for j in range(i + low, n if high is None else min(n, i + high + 1)) if (c, i, j) not in hit} for c, _, n in cells}
    for need in (10_000, 4):
        got = graphs.drawn_pairs(dims.withColumn("need", F.lit(need)), pos, low, high).collect()
        assert len(got) == len({(r.cell_id, r.src, r.dst) for r in got})
        for c in free:
            own = {(r.src, r.dst) for r in got if r.cell_id == c}
            assert own <= free[c] and len(own) == min(need, len(free[c]))


def test_draws_are_few_and_spread(spark):
    """A quota in a large band makes no more rows than quota, excluded pairs and the rim of the square; draws are spread."""
    dims = spark.createDataFrame([("c", "chr1", 20_000, 500)], "cell_id string, chrom string, n_bins int, need long")
    pos = spark.createDataFrame([("c", "chr1", i, i + 7) for i in range(100)], "cell_id string, chrom string, src int, dst int")
    got = graphs.drawn_pairs(dims, pos, 5, 100)
    rows = got.collect()
    assert len(rows) == 500 and len({r.dst - r.src for r in rows}) > 85 and len({r.src // 2000 for r in rows}) == 10
    room = 96 * 20_000 - sum(range(5, 101))
    side = int(np.ceil(room**0.5))
    assert spark.range(side).select(graphs.shuffled_place(F.col("id") * side + 3, F.lit(side).cast("bigint"), F.lit("c")).alias("p")).distinct().count() == side
    again = graphs.drawn_pairs(dims, pos, 5, 100, seed=1).collect()
    assert set(again) != set(rows) and set(graphs.drawn_pairs(dims, pos, 5, 100).collect()) == set(rows)


def test_mixed_negatives_of_dense_graphs(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, j) for i in range(100) for j in range(i + 1, 100)]
    pick = [pairs[k] for k in rng.permutation(len(pairs))[:2400]]
    pos = spark.createDataFrame([("c", "chr1", i, j) for i, j in pick] + [("full", "chr1", i, j) for i in range(6) for j in range(i + 1, 6)], "cell_id string, chrom string, src int, dst int")
    d = spark.createDataFrame([("c", "chr1", 100), ("full", "chr1", 6)], "cell_id string, chrom string, n_bins int")
    neg = {(r.cell_id, r.src, r.dst) for r in graphs.mixed_negatives(pos, d).collect()}
    assert len(neg) == 2400 and not {(i, j) for _, i, j in neg} & set(pick) and {c for c, _, _ in neg} == {"c"}
    free_near = sum(j - i >= 5 for i, j in pairs) - sum(j - i >= 5 for i, j in pick)
    assert sum(j - i >= 5 for _, i, j in neg) >= min(int(2400 * 0.7), free_near)


def test_canonical_is_a_filter(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (5, 4)], "src int, dst int")
    assert [tuple(r) for r in graphs.canonical_edges(e).collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in graphs.normalized_edges(e).collect()) == [(1, 2), (4, 5)]


def test_split_files(spark):
    files = spark.createDataFrame([(f"{c}_{k}", c) for c in [f"a{i}" for i in range(5)] + ["x"] for k in "12"], "file string, cell_id string")
    labels = spark.createDataFrame([(f"a{i}", "A") for i in range(5)], "cell_id string, cell_type string")
    got = graphs.split_files(files, labels, 0.5).collect()
    assert len(got) == 12 and {r.split for r in got if r.cell_id == "x"} == {"train"}
    assert len({r.cell_id for r in got if r.split == "val"}) == 2 and all(len({r.split for r in got if r.cell_id == c}) == 1 for c in ("a0", "a1", "a2"))
    for some in (None, labels.limit(0)):
        assert graphs.split_counts(graphs.split_files(files, some, 0.5)).first().asDict() == {"n_total_files": 12, "n_train_files": 6, "n_val_files": 6, "n_total_cells": 6, "n_train_cells": 3, "n_val_cells": 3}


def test_stored_negatives_serve_validation(spark):
    pos = spark.createDataFrame([("c", "chr1", i, i + 1) for i in range(20)], "cell_id string, chrom string, src int, dst int")
    d = spark.createDataFrame([("c", "chr1", 30)], "cell_id string, chrom string, n_bins int")
    kept = spark.createDataFrame([("c", "chr1", 1, 9), ("c", "chr1", 2, 30)], "cell_id string, chrom string, src int, dst int")
    assert [tuple(r)[2:] for r in graphs.negatives_for("val", pos, d, kept).select("cell_id", "chrom", "src", "dst").collect()] == [(1, 9)]
    assert graphs.negatives_for("train", pos, d, kept).count() == 20 == graphs.negatives_for("val", pos, d).count()


def test_loop_groups(spark):
    df = spark.createDataFrame([("Sst",), ("MG",), ("ODC",), ("other",)], "t string")
    assert [r[0] for r in df.select(graphs.loop_group(F.col("t"))).collect()] == ["Neuron", "MG", "ODC", None]


def test_merge_features_checks_bins(spark):
    f = spark.createDataFrame([("c", "chr1", 0, [1.0]), ("c", "chr1", 1, [2.0])], "cell_id string, chrom string, bin int, feat array<double>")
    e = spark.createDataFrame([("chr1", 1, [5.0])], "chrom string, bin int, emb array<double>")
    with pytest.raises(ValueError):
        features.merge_features(f, e, 1)
    assert features.merge_features(f, e, 1, strict=False).first()["feat"] == [1.0, 5.0]


def test_checks_of_shapes_are_parts_of_the_plan(spark):
    key = "cell_id string, chrom string, bin int, feat array<double>"
    shared = spark.createDataFrame([("chr1", b, [5.0 + b]) for b in (1, 2)], "chrom string, bin int, emb array<double>")
    good = [("c", "chr1", 0, [1.0]), ("c", "chr1", 1, [2.0])]
    out = features.checked_features(spark.createDataFrame(good, key), shared, 1)
    assert sorted(tuple(r) for r in out.collect()) == [("c", "chr1", 0, [1.0, 6.0]), ("c", "chr1", 1, [2.0, 7.0])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2  # each table is read once
    bad = {"2 rows, 2": None, "1 rows, 2 shared": [("d", "chr1", 0, [1.0])], "no shared row for bin 7": [("d", "chr1", 0, [1.0]), ("d", "chr1", 7, [1.0])], "no shared row for bin 0": [("d", "chr2", 0, [1.0])]}
    for text, rows in bad.items():
        if rows:
            with pytest.raises(Exception, match=f"features of d chr[12]: {text}"):
                features.checked_features(spark.createDataFrame(good + rows, key), shared, 1).collect()
    with pytest.raises(Exception, match="more than one row of bin 0"):
        features.checked_features(spark.createDataFrame([good[0], good[0]], key), shared, 1).collect()


def test_checks_of_graph_assembly(spark):
    from chromalith.operators import model

    key = "cell_id string, chrom string, bin int, feat array<double>"
    good = [("c", "chr1", b, [float(b), 1.0]) for b in range(3)]
    edges = spark.createDataFrame([("c", "chr1", 0, 2), ("c", "chr1", 2, 0)], "cell_id string, chrom string, src int, dst int")
    dims = spark.createDataFrame([("c", "chr1", 3)], "cell_id string, chrom string, n_bins int")
    row = model.graph_rows(spark.createDataFrame(good, key), edges, dims).first()
    assert (row.x, row.src, row.dst) == ([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]], [0], [2])
    cases = [(good[:2], "2 feature rows, 3 bins"), ([*good[:2], good[1]], "missing or comes twice"), ([*good[:2], ("c", "chr1", 2, [1.0])], "different lengths"), ([("c", "chr2", 0, [1.0])], "no number of bins")]
    for rows, text in cases:
        with pytest.raises(Exception, match=f"graph of c chr[12]: .*{text}"):
            model.graph_rows(spark.createDataFrame(rows, key), edges, dims).collect()
    with pytest.raises(Exception, match="an edge leads outside"):
        model.graph_rows(spark.createDataFrame(good, key), edges.withColumn("dst", F.lit(3)), dims).collect()
    assert model.graph_rows(spark.createDataFrame(good[:2], key), edges).count() == 1


def test_svd_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((6, 12))
    rows = [(f"c{i}", "chr1", 0, k + 1, float(x[i, k])) for i in range(6) for k in range(12)]
    z = matrices.svd_embedding(spark.createDataFrame(rows, "cell_id string, chrom string, i int, j int, v double"), 3, 2)
    got = np.array([r.emb for r in z.orderBy("cell_id").collect()])
    u = np.linalg.svd(x, full_matrices=False)[0][:, :3]
    # the vectors lie in the span of the leading left vectors and are orthonormal, as their values are all 1
    assert got.shape == (6, 2) and np.allclose(u @ u.T @ got, got) and np.allclose(got.T @ got, np.eye(2))


def test_no_nested_loops(spark):
    from chromalith.operators import intervals, loops

    pts = spark.range(100).selectExpr("'chr1' as chrom", "id * 10 as mid")
    centers = spark.range(20).selectExpr("'chr1' as chrom", "id * 50 as center")
    pred = spark.range(50).selectExpr("'c' as cell_id", "'chr1' as chrom1", "id * 10000 as x1", "id * 20000 as y1")
    near = loops.slack_expand(pred, 2, 10_000)
    for df in (intervals.window_counts(centers, pts, 25), near.join(pred.drop("cell_id"), ["chrom1", "x1", "y1"], "left_semi")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.center: r.n for r in intervals.window_counts(centers, pts, 25).collect()}
    assert got == {c * 50: sum(abs(m * 10 - c * 50) <= 25 for m in range(100)) for c in range(20)}
