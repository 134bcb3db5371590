"""Hand-worked cases and brute-force comparisons for intervals, loops, metrics, sequences, models."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalith.functions.columns import half_even
from chromalith.functions.tape import Var, beside, gradients
from chromalith.operators import compartments, intervals, loops, metrics, model, segments, training


def test_loop_slack(spark):
    ref = spark.createDataFrame([("chr1", 100000, 300000), ("chr1", 500000, 900000)], "chrom1 string, x1 long, y1 long")
    pred = [(110000, 290000), (500000, 900000), (1000000, 1300000), (105000, 300000)]
    r = loops.evaluate(spark.createDataFrame([("c", "chr1", *p) for p in pred], "cell_id string, chrom1 string, x1 long, y1 long"), ref).first()
    assert (r.precision, r.recall) == (0.5, 1.0) and r.f1 == pytest.approx(2 / 3)


def test_auc_ap_ties(spark):
    s = spark.createDataFrame([("g", 0.9, 1), ("g", 0.8, 0), ("g", 0.7, 1), ("g", 0.7, 0)], "graph string, score double, y int")
    assert metrics.auc(s).first()["auc"] == 0.625 and metrics.average_precision(s).first()["ap"] == 0.75
    assert metrics.auc(s.withColumn("score", -F.col("score"))).first()["auc"] == 0.375


def test_consensus(spark):
    votes = spark.createDataFrame([("k", c, b) for c, bs in (("a", (2, 5)), ("b", (2, 6)), ("c", (5, 9))) for b in bs], "chrom string, cell_id string, b int")
    n = spark.createDataFrame([("k", 10)], "chrom string, n_bins int")
    k = spark.createDataFrame([("k", 3)], "chrom string, k int")
    peaks = intervals.consensus_peaks(intervals.vote_fractions(votes, k, n), 0.3, 3)
    assert sorted(r.b for r in peaks.collect()) == [2, 5]
    assert sorted((r.start, r.end) for r in intervals.consensus_intervals(peaks, n, 10_000).collect()) == [(0, 30000), (30000, 60000), (60000, 100000)]


def test_runs(spark):
    lab = spark.createDataFrame([("c", "k", i, v) for i, v in enumerate([3, 3, 1, 1, 1, 0])], "cell_id string, chrom string, bin int, label int")
    assert sorted(r.bin for r in intervals.boundaries(lab).collect()) == [1, 4]
    assert sorted((r.first_bin, r.last_bin) for r in intervals.run_length(lab).collect()) == [(0, 1), (2, 4), (5, 5)]


def test_two_means(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 2, 9, 10)], "chrom string, n long")
    assert intervals.two_means(df, ("chrom",)).first()["threshold"] == 9
    assert intervals.keep_enriched(spark.createDataFrame([("k", 4), ("k", 4)], "chrom string, n long"), ("chrom",)).count() == 2


def test_coarsen_and_state(spark):
    bins = compartments.chrom_bins(spark.createDataFrame([("k", 25000)], "chrom string, size long"), 10_000)
    gc = bins.select("chrom", "start", "end", F.element_at(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.3)), F.col("bin") + 1).alias("gc"))
    p = spark.createDataFrame([("c", "k", i, [v, 1 - v]) for i, v in enumerate((0.9, 0.7, 0.2))], "cell_id string, chrom string, bin int, proba array<double>")
    out = sorted((r.start, r.end, round(r.score, 6)) for r in compartments.scores(compartments.coarsen(p, bins, gc, 2)).collect())
    assert out == [(0, 20000, 0.6), (20000, 25000, -0.6)]


def test_half_even(spark):
    assert [r[0] for r in spark.createDataFrame([(2.5,), (1.5,), (0.5,)], "x double").select(half_even(F.col("x"))).collect()] == [2, 2, 0]
    assert round(50 / 20) == 2


def test_assignment_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        for _ in range(20):
            c = rng.random((n, m))
            got = sum(c[i, j] for i, j in metrics.assignment(c))
            k = min(n, m)
            best = min(sum(c[i, j] for i, j in zip(r, q, strict=True)) for r in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k))
            assert got == pytest.approx(best)


def test_clustering_metrics(spark):
    p = spark.createDataFrame(list(zip([0, 0, 1, 1], [1, 1, 0, 1], strict=True)), "pred int, true int")
    assert metrics.hungarian_accuracy(p) == 0.75
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "pred int, true int")
    assert metrics.ari(same).first()["ari"] == 1 and metrics.ami(same) == pytest.approx(1) and metrics.information(same).first()["nmi"] == pytest.approx(1)


def test_chain_clusters_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 15):
        x = rng.random((n, 3))
        for k in {1, max(1, n // 3), n}:
            groups = [[i] for i in range(n)]
            while len(groups) > k:
                cost = []
                for a, b in zip(groups, groups[1:], strict=False):
                    d = x[a].mean(0) - x[b].mean(0)
                    cost.append(len(a) * len(b) / (len(a) + len(b)) * (d @ d))
                i = int(np.argmin(cost))
                groups[i : i + 2] = [groups[i] + groups[i + 1]]
            lab = segments.chain_clusters(x, k)
            assert [list(np.flatnonzero(lab == c)) for c in range(lab.max() + 1)] == groups


def test_posterior_brute_force():
    rng = np.random.default_rng(3)
    m = segments.Hmm(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), np.array([[0.0], [1.0]]), np.ones((2, 1)), np.zeros(1), np.ones(1), np.eye(1))
    x = rng.random((6, 1))
    p, moves, ll = m.posterior(x)
    b = np.exp(m.log_density(x))
    total, want = 0.0, np.zeros((6, 2))
    for path in itertools.product((0, 1), repeat=6):
        w = m.start[path[0]] * b[0, path[0]]
        for t in range(1, 6):
            w *= m.trans[path[t - 1], path[t]] * b[t, path[t]]
        total += w
        for t in range(6):
            want[t, path[t]] += w
    assert np.allclose(p, want / total) and ll == pytest.approx(np.log(total)) and moves.sum() == pytest.approx(5)


def test_hmm_fit_improves(spark):
    rng = np.random.default_rng(4)
    rows = [(c, "k", i, [float(v) for v in rng.normal(3 * ((i // 10) % 2), 1, 2)]) for c in "ab" for i in range(60)]
    z = spark.createDataFrame(rows, "cell_id string, chrom string, bin int, z array<double>")
    m = segments.fit_hmm(z, n_iter=8)
    assert all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:], strict=False))
    hard = {(r.cell_id, r.bin): int(np.argmax(r.proba)) for r in segments.hmm_posterior(z, m).collect()}
    first = np.mean([hard[("a", i)] == (i // 10) % 2 for i in range(60)])
    assert max(first, 1 - first) > 0.9


def test_tape_against_differences():
    rng = np.random.default_rng(5)
    w = rng.normal(size=(3, 4))

    def loss(a):
        v = Var(a)
        h = (Var(rng_x) @ v).relu()
        s = beside(h.rows(np.array([0, 1, 1])), h.rows(np.array([2, 0, 2]))).segment_sum(np.array([0, 0, 1]), 2)
        return ((s.exp() * s.power(2.0)).sum(1).softplus().mean() + -h.cols(1, 3).mean(), v)

    rng_x = rng.normal(size=(3, 3)) * 0.3
    out, v = loss(w)
    gradients(out)
    num = np.zeros_like(w)
    for i in np.ndindex(w.shape):
        d = np.zeros_like(w)
        d[i] = 1e-6
        num[i] = (loss(w + d)[0].value - loss(w - d)[0].value) / 2e-6
    assert np.allclose(v.grad, num, atol=1e-5)


def _tiny_graphs(spark, n=3):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(n):
        e = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 12, (30, 2)).tolist() if a != b})
        rows.append((f"c{c}", "chr1", rng.random((12, 4)).tolist(), [a for a, _ in e], [b for _, b in e]))
    return spark.createDataFrame(rows, "cell_id string, chrom string, x array<array<double>>, src array<int>, dst array<int>")


def test_training_lowers_the_loss(spark):
    cfg = model.ModelConfig(4, 8, 4, target_dim=3, loop_dim=4)
    p = model.init_params(cfg)
    t = training.train(_tiny_graphs(spark), p, training.TrainConfig(epochs=6, rate=2e-2, dropout=0.0))
    assert t.history[-1]["train"] < t.history[0]["train"]
    frozen = training.train(_tiny_graphs(spark), p, training.TrainConfig(epochs=1, frozen=("gcn",)))
    assert np.array_equal(frozen.params["gcn1.w"], p["gcn1.w"]) and not np.array_equal(frozen.params["recon1.w"], p["recon1.w"])
    again = model.load_params(model.dump_params(p))
    assert all(np.allclose(again[k], p[k]) for k in p)


def test_silhouette_brute_force(spark):
    rng = np.random.default_rng(7)
    x, c = rng.random((30, 3)), [i % 3 for i in range(29)] + [9]
    df = spark.createDataFrame([(i, c[i], x[i].tolist()) for i in range(30)], "id long, cluster int, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    vals = []
    for i in range(30):
        own = [j for j in range(30) if c[j] == c[i] and j != i]
        if not own:
            vals.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(30) if c[j] == k]].mean() for k in set(c) - {c[i]})
        vals.append((b - a) / max(a, b))
    assert metrics.silhouette(df, block=7).first()[0] == pytest.approx(np.mean(vals))


def test_silhouette_passes_over_far_clusters(spark):
    """Far clusters are settled by the distances of their means; the values are those of all pairs."""
    rng = np.random.default_rng(3)
    n, k = 240, 12
    c = rng.integers(0, k, n)
    x = rng.normal(size=(k, 3))[c] * 20 + rng.normal(size=(n, 3))
    df = spark.createDataFrame([(i, f"k{c[i]}", x[i].tolist()) for i in range(n)], "id long, cluster string, x array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = np.array([[d[i, c == g].sum() / max(1, (c == g).sum() - (g == c[i])) for g in range(k)] for i in range(n)])
    a = means[np.arange(n), c]
    means[np.arange(n), c] = np.inf
    b = means.min(1)
    got = {r.id: r for r in metrics.silhouette_points(df, block=17).collect()}
    assert len(got) == n
    for i in range(n):
        assert (got[i].a, got[i].b, got[i].silhouette) == pytest.approx((a[i], b[i], (b[i] - a[i]) / max(a[i], b[i])))
    met = sum(r.met for r in got.values())
    assert met < n * n / 3
    assert sum(r.met for r in metrics.silhouette_points(df, most_centres=1).collect()) == n * n
    one = spark.createDataFrame([(1, 1, [0.0]), (2, 1, [1.0])], "id long, cluster int, x array<double>")
    assert np.isnan(metrics.silhouette(one).first()[0]) and metrics.silhouette(one.filter("false")).first()[0] is None


def test_metrics_of_degenerate_groups(spark):
    none = spark.createDataFrame([("g", 0.9, 0), ("g", 0.8, 0), ("h", 0.5, 1)], "graph string, score double, y int")
    assert {r.graph: r.ap for r in metrics.average_precision(none).collect()} == {"g": 0.0, "h": 1.0}
    one = spark.createDataFrame([(1, 1)], "pred int, true int")
    assert metrics.ari(one).first()["ari"] == 1.0 and metrics.ami(one) == 1.0
    apart = spark.createDataFrame([(i, 9 - i) for i in range(4)], "pred int, true int")
    assert metrics.ari(apart).first()["ari"] == 1.0
    whole = metrics.clustering_metrics(spark.createDataFrame([(i % 2, i % 3) for i in range(12)], "pred int, true int")).first().asDict()
    assert {"ari", "nmi", "v_measure", "ami", "hungarian_acc", "homogeneity", "completeness"} <= set(whole)
    got = metrics.mean_summary(spark.createDataFrame([("a", 1.0, 0.5), ("b", float(0), 0.25)], "graph string, auc double, ap double")).first()
    assert tuple(got) == (0.5, 0.375, 2)


def test_expected_information_against_all_overlaps():
    from math import comb, log

    for x, y, n in ((3, 4, 10), (50, 60, 200), (199, 3, 200), (1, 1, 2), (7, 7, 7)):
        want = sum(k / n * log(n * k / (x * y)) * comb(y, k) * comb(n - y, x - k) / comb(n, x) for k in range(max(1, x + y - n), min(x, y) + 1))
        assert metrics.expected_information(x, y, n) == pytest.approx(want, abs=1e-12)


def test_loop_figures_of_cells_without_predictions(spark):
    ref = spark.createDataFrame([("chr1", 100000, 300000)], "chrom1 string, x1 long, y1 long")
    pred = spark.createDataFrame([("c", "chr1", 100000, 300000)], "cell_id string, chrom1 string, x1 long, y1 long")
    cells = spark.createDataFrame([("c",), ("d",)], "cell_id string")
    got = {r.cell_id: tuple(r)[1:] for r in loops.evaluate(pred, ref, cells=cells).collect()}
    assert got == {"c": (1, 1, 1.0, 1.0, 1.0), "d": (0, 1, 0.0, 0.0, 0.0)}


def test_near_share_of_training_negatives():
    rng = np.random.default_rng(0)
    for n, want in ((2000, 500), (300, 100)):
        a, b = training._negatives(rng, n, {(0, 5)}, want)
        near = int(((b - a >= 5) & (b - a <= 100)).sum())
        assert len(a) == want and (a < b).all() and len(set(zip(a.tolist(), b.tolist(), strict=True))) == want
        # uniform pairs are near too where the graph is short
        assert int(want * 0.7) <= near < want
    assert len(training._negatives(rng, 3, {(0, 1)}, 9)[0]) == 2
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60)]
    taken = {pairs[k] for k in rng.permutation(len(pairs))[:1000]}
    for want in (500, 770, 5000):  # of 770 that are free
        a, b = training._negatives(rng, 60, taken, want)
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        assert len(a) == len(got) == min(want, 770) and not got & taken and (a < b).all()


def test_checkpoints_go_on_where_they_stopped(spark):
    cfg = model.ModelConfig(4, 8, 4, target_dim=3, loop_dim=4)
    p, g = model.init_params(cfg), _tiny_graphs(spark, 2)
    at = training.TrainConfig(epochs=2, rate=1e-2)
    whole = training.train(g, p, training.TrainConfig(epochs=4, rate=1e-2))
    half = training.load_trained(training.dump_trained(training.train(g, p, at)))
    rest = training.train(g, p, at, resume=half)
    assert [round(h["train"], 9) for h in rest.history] == [round(h["train"], 9) for h in whole.history]
    assert all(np.allclose(rest.params[k], whole.params[k]) for k in p)
    again = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in model.params_table(spark, p).collect()}
    assert all(np.array_equal(again[k], p[k]) for k in p) and model.load_params(training.dump_trained(whole)).keys() == p.keys()


def test_stored_negatives_in_validation(spark):
    p = model.init_params(model.ModelConfig(4, 8, 4, target_dim=3, loop_dim=4))
    g = _tiny_graphs(spark, 2)
    stored = g.withColumns({"neg_src": F.array(F.lit(0), F.lit(1)), "neg_dst": F.array(F.lit(11), F.lit(99))})
    losses = {training._pass(d, p, training.TrainConfig(seed=s), 0, False)[0] for s in (1, 2) for d in (stored,)}
    assert len(losses) == 1 and training._pass(g, p, training.TrainConfig(seed=1), 0, False)[0] not in losses
    s = model.score_edges(g, p, spark.createDataFrame([("c0", "chr1", 0, 11)], "cell_id string, chrom string, src int, dst int")).collect()
    assert {r.cell_id for r in s} == {"c0"} and sum(r.y == 0 for r in s) == 1 and sum(r.y for r in s) == len(g.filter("cell_id = 'c0'").first()["src"])
    weighted = training.weighted_total(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), training.FINETUNE)
    assert spark.range(1).select(weighted).first()[0] == pytest.approx(0.2 + 1.2)


def test_small_helpers(spark):
    from chromalith.functions import columns as C
    from chromalith.operators import features, graphs

    df = spark.createDataFrame([("c", "chr1", 2, 3, 0.5, 0.0)], "cell_id string, chrom string, src int, dst int, score double, logit double")
    key = C.edge_key(F.col("src"), F.col("dst"), F.lit(10))
    assert df.select(key, *C.edge_of_key(key, F.lit(10))).first()[0:3] == (23, 2, 3)
    assert tuple(loops.as_points(loops.to_bedpe(df.withColumn("logit", F.lit(3.0)), 10, 0.5)).first()) == ("c", "chr1", 20, 30)
    assert df.select(features.vector(F.col("src"))).first()[0] == [2]
    dims = spark.createDataFrame([("c", "chr1", 3)], "cell_id string, chrom string, n_bins int")
    assert graphs.within_nodes(df, dims).count() == 0 and graphs.within_nodes(df, dims.withColumn("n_bins", F.lit(4))).count() == 1
    split = spark.createDataFrame([("c", "val")], "cell_id string, split string")
    assert graphs.in_split(df, split, "val").count() == 1 and graphs.in_split(df, split, "train").count() == 0
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "k string, position int, v int")
    from chromalith.sources.readers import last_by_position

    assert [r.v for r in last_by_position(rows, "k").collect()] == [6]
    bins = spark.createDataFrame([("chr1", 1, "ACG"), ("chr1", 2, "")], "chrom string, bin int, sequence string")
    emb = features.sequence_embedding(bins, lambda: lambda texts: [[len(t), 1] for t in texts], 2)
    assert sorted((r.bin, list(r.emb)) for r in emb.collect()) == [(1, [3.0, 1.0]), (2, [0.0, 1.0])]
    with pytest.raises(Exception, match="other than 3"):
        features.sequence_embedding(bins, lambda: lambda texts: [[1, 1] for _ in texts], 3).collect()


def test_reference_loops_on_graph_rows(spark):
    g = _tiny_graphs(spark, 3)  # 12 bins each
    refs = spark.createDataFrame([("c0", "chr1", 2, 7), ("c0", "chr1", 7, 2), ("c0", "chr1", 3, 3), ("c0", "chr1", 4, 12), ("c1", "chr1", 0, 11), ("x", "chr1", 0, 1)], "cell_id string, chrom string, i long, j long")
    neg = spark.createDataFrame([("c0", "chr1", 1, 9), ("c0", "chr1", 5, 40)], "cell_id string, chrom string, src int, dst int")
    rows = {r.cell_id: r for r in training.with_loops(g, refs, neg).collect()}
    assert {c: (r.loop_src, r.loop_dst, r.loop_neg_src, r.loop_neg_dst) for c, r in rows.items()} == {"c0": ([2], [7], [1], [9]), "c1": ([0], [11], [], []), "c2": ([], [], [], [])}
    assert rows["c2"].x == next(r.x for r in g.collect() if r.cell_id == "c2")
    targets = training.with_targets(g, spark.createDataFrame([("c1", [1.0, 0.0, 2.0])], "cell_id string, emb array<double>"))
    assert {r.cell_id: r.target for r in targets.collect()} == {"c0": None, "c1": [1.0, 0.0, 2.0], "c2": None}


def test_finetuning_lowers_the_loops_loss_and_logs_its_parts(spark):
    p = model.init_params(model.ModelConfig(4, 8, 4, target_dim=3, loop_dim=4))
    refs = spark.createDataFrame([(f"c{c}", "chr1", i, i + 4) for c in (0, 1) for i in range(6)], "cell_id string, chrom string, i int, j int")
    g = training.with_targets(training.with_loops(_tiny_graphs(spark, 3), refs), spark.createDataFrame([("c1", [1.0, 0.0, 2.0])], "cell_id string, emb array<double>"))
    cfg = training.TrainConfig(epochs=8, rate=2e-2, dropout=0.0, w_recon=0.2, w_cosine=0.6, w_loop=1.5, frozen=("norm", "gcn"), cosine_from=2)
    t = training.train(g, p, cfg, validation=g)
    h = t.history
    assert h[-1]["train_loop_pos"] + h[-1]["train_loop_neg"] < h[0]["train_loop_pos"] + h[0]["train_loop_neg"]
    assert all(x["train_loop_coverage"] == x["val_loop_coverage"] == pytest.approx(2 / 3) for x in h)
    assert [x["train_cosine"] > 0 for x in h] == [False] * 2 + [True] * 6
    for x in h:  # the total is the weighted sum of the means
        want = 0.2 * (x["train_pos"] + x["train_neg"]) + 0.6 * x["train_cosine"] + 1.5 * x["train_loop_coverage"] * (x["train_loop_pos"] + x["train_loop_neg"])
        assert x["train"] == pytest.approx(want)
    assert np.array_equal(t.params["gcn1.w"], p["gcn1.w"]) and not np.array_equal(t.params["loop1.w"], p["loop1.w"])
    before = [dict(x) for x in t.history]
    first, second = (training.train(g, p, cfg, resume=t) for _ in range(2))
    assert t.history == before and len(first.history) == 16
    assert all(x[k] == pytest.approx(y[k]) for x, y in zip(first.history, second.history, strict=True) for k in x)


def test_gradients_do_not_depend_on_partitions(spark):
    p = model.init_params(model.ModelConfig(4, 8, 4, target_dim=3, loop_dim=4))
    g = _tiny_graphs(spark, 5)
    one, many = (training._pass(g.repartition(k), p, training.TrainConfig(), 0, True) for k in (1, 9))
    assert one[1] == many[1] == 5 and one[0] == pytest.approx(many[0]) and one[2].keys() == p.keys()
    assert all(np.allclose(one[2][k], many[2][k]) for k in p)
    assert training._pass(g.filter("false"), p, training.TrainConfig(), 0, True)[1] == 0


def test_token_pooling_in_batches_by_length(spark):
    from chromalith.operators import features

    code = {"A": 1, "C": 2, "G": 3, "T": 4}

    def make_model():
        def forward(ids, lengths):
            assert (ids != 0).sum(1).tolist() == lengths.tolist() and (ids.size <= 40 or len(ids) == 1)
            return np.stack([np.cumsum(ids, 1), ids], 2)  # a vector knows what came before it

        return lambda texts: [[code[c] for c in t] for t in texts], forward

    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in [1, 2, 3, 5, 8, 13, 21, 60, 0, 3, 3, 7, 7, 7]]
    bins = spark.createDataFrame([("chr1", k, t) for k, t in enumerate(texts)] + [("chr1", 99, None)], "chrom string, bin long, sequence string")
    for pool, at in (("first", 0), ("last", -1)):
        for parts in (1, 5):
            got = {r.bin: list(r.emb) for r in features.token_embedding(bins.repartition(parts), make_model, 2, pool, max_tokens=40).collect()}
            assert got.pop(99) == [0.0, 0.0] and len(got) == len(texts)
            for k, t in enumerate(texts):
                ids = [code[c] for c in t]
                assert got[k] == ([float(np.cumsum(ids)[at]), float(ids[at])] if ids else [0.0, 0.0])
    with pytest.raises(ValueError, match="neither"):
        features.token_embedding(bins, make_model, 2, "mean")
    with pytest.raises(Exception, match="not 3 numbers"):
        features.token_embedding(bins, make_model, 3, max_tokens=40).collect()


def test_messages_by_matrix_or_by_sums():
    """A dense graph's messages are one product, a sparse one's are summed by their end; both as the plain sum has them, gradients too."""
    rng = np.random.default_rng(3)
    for n, m in ((6, 30), (60, 20)):
        src, dst, w, at, up = rng.integers(0, n, m), rng.integers(0, n, m), rng.random(m), rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
        out, back = np.zeros((n, 2)), np.zeros((n, 2))
        np.add.at(out, dst, w[:, None] * at[src])
        np.add.at(back, src, w[:, None] * up[dst])
        x = Var(at)
        got = x.spread(src, dst, w)
        gradients((got * up).sum())
        assert np.allclose(got.value, out) and np.allclose(x.grad, back)


def test_few_tasks_are_summed_in_one_shuffle(spark):
    from chromalith.functions.vectors import tree_sum

    v = spark.createDataFrame([([1.0, float(k)],) for k in range(8)], "v array<double>").repartition(8)
    count = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Exchange")
    assert tree_sum(v.repartitionByRange(8, F.col("v")), tasks=8).first()["v"] == [8.0, 28.0]
    assert count(tree_sum(v, tasks=8)) < count(tree_sum(v, tasks=17)) == count(tree_sum(v))


def test_negatives_of_a_graph_given_as_rows():
    """What is taken may be an array of rows; the draw is that of the set of pairs."""
    taken = {(i, i + 5) for i in range(30)} | {(i, i + 1) for i in range(30)}
    draws = [training._negatives(np.random.default_rng(2), 90, t, 60) for t in (taken, np.array(sorted(taken)))]
    assert all((a == b).all() for a, b in zip(*draws, strict=True)) and len(draws[0][0]) == 60
