"""Sequential numpy operators, one (cell, chromosome) sequence at a time in applyInPandas: domain segmentation and hidden
Markov models. A sequence is bounded by the genome (25,000 bins at 10 kb)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardized(x: np.ndarray) -> np.ndarray:
    """Population standard deviation; constant columns are only centred."""
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s > 0, s, 1.0)


def fixed_sign(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive."""
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def principal(x: np.ndarray, n: int) -> np.ndarray:
    c = x - x.mean(axis=0)
    _, vectors = np.linalg.eigh(c.T @ c)
    return c @ fixed_sign(vectors[:, ::-1][:, :n])


def chain_clusters(x: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """Agglomerative clustering along a chain: only neighbours merge, until k contiguous segments are left.

    A heap holds the cost of each neighbouring pair; entries of merged segments are skipped. Equal costs: the lower index.
    """
    n = len(x)
    begin, end = list(range(n)), list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    total = [x[i].astype(float) for i in range(n)]
    version = [0] * n

    def cost(a: int, b: int) -> float:
        if linkage == "ward":
            na, nb = end[a] - begin[a], end[b] - begin[b]
            d = total[a] / na - total[b] / nb
            return float(np.sqrt(2.0 * na * nb / (na + nb) * (d @ d)))
        p, q = x[begin[a] : end[a]], x[begin[b] : end[b]]
        d = np.sqrt(np.maximum(0, (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T))
        return float({"average": d.mean, "complete": d.max, "single": d.min}[linkage]())

    heap = [(cost(i, i + 1), i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    left = n
    while left > k and heap:
        _, a, va, vb = heapq.heappop(heap)
        b = after[a]
        if version[a] != va or b < 0 or version[b] != vb or begin[a] < 0:
            continue
        end[a], total[a] = end[b], total[a] + total[b]
        after[a] = after[b]
        version[a] += 1
        version[b] = -1
        begin[b] = -1
        left -= 1
        if after[a] >= 0:
            before[after[a]] = a
            heapq.heappush(heap, (cost(a, after[a]), a, version[a], version[after[a]]))
        if before[a] >= 0:
            heapq.heappush(heap, (cost(before[a], a), before[a], version[before[a]], version[a]))
    labels, at, c = np.zeros(n, int), 0, 0
    while at >= 0:
        labels[begin[at] : end[at]] = c
        at, c = after[at], c + 1
    return labels


def segment(z: np.ndarray, avg_size: int = 20, linkage: str = "ward", use_pca: bool = True, pca_n: int = 10) -> np.ndarray:
    z = np.asarray(z, float)
    n = len(z)
    if n <= 1:
        return np.zeros(n, int)
    x = principal(z, pca_n) if use_pca and z.shape[1] > pca_n else z
    k = min(n, max(1, int(round(n / max(1, avg_size)))))
    return chain_clusters(standardized(x), k, linkage)


def hac_segments(z: DataFrame, avg_size: int = 20, linkage: str = "ward", use_pca: bool = True, pca_n: int = 10) -> DataFrame:
    """(cell_id, chrom, bin, label) of contiguous domains of each sequence of z (cell_id, chrom, bin, z)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        label = segment(np.stack(rows["z"].to_numpy()), avg_size, linkage, use_pca, pca_n)
        return pd.DataFrame({"cell_id": rows["cell_id"], "chrom": rows["chrom"], "bin": rows["bin"].astype("int32"), "label": label.astype("int32")})

    return z.select("cell_id", "chrom", "bin", "z").groupBy("cell_id", "chrom").applyInPandas(run, "cell_id string, chrom string, bin int, label int")


@dataclass
class Hmm:
    """Gaussian HMM with diagonal covariances, over scaled and rotated observations."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    history: list[float] = field(default_factory=list)

    def observe(self, z: np.ndarray) -> np.ndarray:
        return ((z - self.mean) / self.scale) @ self.axes

    def log_density(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.means[None]
        return -0.5 * (np.log(2 * np.pi * self.variances).sum(1)[None] + (d * d / self.variances[None]).sum(2))

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """State probabilities, expected transitions, log likelihood, by scaled forward and backward passes."""
        log_b = self.log_density(x)
        top = log_b.max(1)
        b = np.exp(log_b - top[:, None])
        n, s = b.shape
        f, back, c = np.zeros((n, s)), np.ones((n, s)), np.zeros(n)
        f[0] = self.start * b[0]
        c[0] = max(f[0].sum(), 1e-300)
        f[0] /= c[0]
        for t in range(1, n):
            f[t] = (f[t - 1] @ self.trans) * b[t]
            c[t] = max(f[t].sum(), 1e-300)
            f[t] /= c[t]
        moves = np.zeros((s, s))
        for t in range(n - 2, -1, -1):
            ahead = b[t + 1] * back[t + 1] / c[t + 1]
            moves += f[t][:, None] * self.trans * ahead[None]
            back[t] = self.trans @ ahead
        p = f * back
        return p / p.sum(1, keepdims=True), moves, float(np.log(c).sum() + top.sum())


def moments(z: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of the z vectors; each partition sends one row of dim**2 sums."""

    def run(parts):
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf["z"].to_numpy()).astype(float)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = z.select("z").mapInPandas(run, "n long, s array<double>, ss array<double>").filter("n > 0")
    add = lambda c: F.posexplode(c).alias("k", "v")
    n = parts.agg(F.sum("n")).first()[0]
    s = {r["k"]: r["v"] for r in parts.select(add("s")).groupBy("k").agg(F.sum("v").alias("v")).collect()}
    ss = {r["k"]: r["v"] for r in parts.select(add("ss")).groupBy("k").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([s[k] for k in range(dim)]) / n
    return n, mean, np.array([ss[k] for k in range(dim * dim)]).reshape(dim, dim) / n - np.outer(mean, mean)


def fit_hmm(z: DataFrame, n_states: int = 2, n_iter: int = 100, tol: float = 1e-2, standardize: bool = True, pca_dim: int | None = None, max_seqs: int = 12_000, seed: int = 0) -> Hmm:
    """Baum-Welch: the E step runs by sequence and sends sums of fixed size, the M step is the driver's.

    At most max_seqs sequences, by hash, are learnt from. States start on either side of the first axis.
    """
    keys = z.select("cell_id", "chrom").distinct().orderBy(F.xxhash64("cell_id", "chrom", F.lit(seed)), "cell_id", "chrom").limit(max_seqs)
    rows = z.select("cell_id", "chrom", "bin", "z").join(keys, ["cell_id", "chrom"], "left_semi")
    # laid out by sequence once: the cached layout spares every E step its shuffle and sort
    rows = rows.repartition("cell_id", "chrom").sortWithinPartitions("cell_id", "chrom", "bin").persist()
    dim = len(rows.first()["z"])
    _, mean, cov = moments(rows, dim)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(sd > 0, sd, 1.0) if standardize else np.ones(dim)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    vectors = fixed_sign(vectors[:, ::-1])
    axes = vectors[:, :pca_dim] if pca_dim else np.eye(dim)
    spread = axes.T @ (cov / np.outer(scale, scale)) @ axes
    lead = vectors[:, 0] @ axes * np.sqrt(max(values[-1], 1e-12))
    d = axes.shape[1]
    model = Hmm(np.full(n_states, 1 / n_states), np.full((n_states, n_states), 0.1 / max(1, n_states - 1)), np.outer(np.linspace(-1, 1, n_states), lead), np.tile(np.maximum(np.diag(spread), 1e-3), (n_states, 1)), mean, scale, axes)
    np.fill_diagonal(model.trans, 0.9 if n_states > 1 else 1.0)

    size = n_states + n_states**2 + n_states + 2 * n_states * d + 1
    for _ in range(n_iter):

        sums = rows.groupBy("cell_id", "chrom").applyInPandas(_e_step(model), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        s = np.zeros(size)
        for r in sums:
            s[r["k"]] = r["v"]
        a, b = n_states, n_states + n_states**2
        start, moves, weight = s[:a], s[a:b].reshape(n_states, n_states), s[b : b + n_states]
        first = s[b + n_states : b + n_states + n_states * d].reshape(n_states, d)
        second = s[b + n_states + n_states * d : -1].reshape(n_states, d)
        w = np.maximum(weight, 1e-10)[:, None]
        means = first / w
        model = Hmm(start / start.sum(), (moves + 1e-10) / (moves + 1e-10).sum(1, keepdims=True), means, np.maximum(second / w - means**2, 1e-3), mean, scale, axes, [*model.history, float(s[-1])])
        if len(model.history) > 1 and model.history[-1] - model.history[-2] < tol:
            break
    rows.unpersist()
    return model


def _e_step(model: Hmm):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = model.observe(np.stack(pdf.sort_values("bin")["z"].to_numpy()).astype(float))
        p, moves, ll = model.posterior(x)
        stats = np.concatenate((p[0], moves.ravel(), p.sum(0), (p.T @ x).ravel(), (p.T @ (x * x)).ravel(), [ll]))
        return pd.DataFrame({"k": np.arange(len(stats)), "v": stats})

    return run


def hmm_posterior(z: DataFrame, model: Hmm) -> DataFrame:
    """(cell_id, chrom, bin, proba) for every bin of every sequence."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        p, _, _ = model.posterior(model.observe(np.stack(rows["z"].to_numpy()).astype(float)))
        return pd.DataFrame({"cell_id": rows["cell_id"], "chrom": rows["chrom"], "bin": rows["bin"].astype("int32"), "proba": list(p)})

    return z.select("cell_id", "chrom", "bin", "z").groupBy("cell_id", "chrom").applyInPandas(run, "cell_id string, chrom string, bin int, proba array<double>")
