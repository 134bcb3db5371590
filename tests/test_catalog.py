"""A few registered queries against their SQL on the smallest tables."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["contacts_filtered", "matrix_inspect", "ldp_norm", "loop_slack_pr", "auc", "vote_frac", "run_length_tlds", "two_means_threshold"])
def test_against_sql(spark, name):
    from chromalith.plans import catalog
    from chromalith.plans.views import TABLES
    from verify import plain

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(cols).collect())
    want = Counter(tuple(map(plain, r)) for r in db.sql(catalog.ORACLE[name]).select(*cols).fetchall())
    assert got == want and got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_train_step_takes_every_graph(spark, monkeypatch):
    from chromalith.operators import training
    from chromalith.plans import catalog

    seen, train = [], training.train

    def short(graphs, params, cfg):
        seen.append((graphs.select("cell_id", "chrom").collect(), cfg))
        return train(graphs.limit(2), params, training.TrainConfig(epochs=1))

    monkeypatch.setattr(training, "train", short)
    assert catalog.QUERIES["train_step"](spark, SF).count() == 1
    graphs, cfg = seen[0]
    assert sorted(graphs) == sorted(catalog._graphs(spark, SF).select("cell_id", "chrom").collect()) and cfg == training.TrainConfig()


def test_hmm_posterior_is_of_a_model_that_settled(spark, monkeypatch):
    from chromalith.operators import segments
    from chromalith.plans import catalog

    models, fit = [], segments.fit_hmm
    monkeypatch.setattr(segments, "fit_hmm", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    assert catalog.QUERIES["hmm_posterior"](spark, SF).count() > 0
    h = models[0].history
    assert len(h) == 100 or h[-1] - h[-2] < 1e-2


def test_consensus_intervals_of_real_peaks(spark):
    from chromalith.plans import catalog
    from chromalith.plans.views import view

    votes, cells, n_bins = {}, {}, {}
    for r in view(spark, SF, "v_votes").collect():
        votes.setdefault((r.chrom, r.b), set()).add(r.cell_id)
        cells.setdefault(r.chrom, set()).add(r.cell_id)
        n_bins[r.chrom] = max(n_bins.get(r.chrom, 0), r.b + 1)
    want = []
    for chrom, n in n_bins.items():
        peaks = []
        for frac, b in sorted(((len(v) / len(cells[chrom]), b) for (c, b), v in votes.items() if c == chrom and 0 <= b < n - 1), reverse=True):
            if frac >= 0.04 and all(abs(b - x) >= 3 for x in peaks):
                peaks.append(b)
        ends = sorted(peaks) + [n - 1] * (not peaks or max(peaks) < n - 1)
        want += [(chrom, (a + 1) * 10_000, (b + 1) * 10_000) for a, b in zip([-1, *ends], ends)]
    got = catalog.QUERIES["vote_consensus_intervals"](spark, SF).select("chrom", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > len(n_bins)
