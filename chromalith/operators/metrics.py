"""Rank, contingency and distance metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.functions.vectors import numbers


TILE = 1 << 22


def auc(scores: DataFrame, key: str = "graph") -> DataFrame:
    """ROC-AUC of each group with half credit for ties, NaN for a group of one class: scores are first counted by value, so equal scores shuffle once."""
    c = scores.groupBy(key, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("p"))
    w = W.partitionBy(key).orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("p")).over(w), F.lit(0)))
    s = c.groupBy(key).agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2)).alias("u"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return s.select(key, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg"))).otherwise(F.lit(float("nan"))).alias("auc"))


def average_precision(scores: DataFrame, key: str = "graph") -> DataFrame:
    """Sum of precision times the step in recall over distinct thresholds, without interpolation; 0 without positives."""
    c = scores.groupBy(key, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("p"))
    w = W.partitionBy(key).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumns({"tp": F.sum("p").over(w), "seen": F.sum("n").over(w)})
    return c.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p")), F.lit(0.0)).alias("ap"))


def mean_summary(per_graph: DataFrame, columns: tuple[str, ...] = ("auc", "ap")) -> DataFrame:
    """Unweighted means over graphs, NaN without any."""
    return per_graph.agg(*[F.coalesce(F.avg(c), F.lit(float("nan"))).alias(f"mean_{c}") for c in columns], F.count(F.lit(1)).alias("n_graphs"))


def confusion(pairs: DataFrame, n_classes: int | None = None) -> DataFrame:
    """(pred, true, n); with n_classes every cell of the square is given."""
    c = pairs.groupBy("pred", "true").agg(F.count(F.lit(1)).alias("n"))
    if n_classes is None:
        return c
    side = F.sequence(F.lit(0), F.lit(n_classes - 1))
    full = pairs.sparkSession.range(1).select(F.explode(side).alias("pred")).select("pred", F.explode(side).alias("true"))
    return full.join(c, ["pred", "true"], "left").na.fill(0, ["n"])


def _margins(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = confusion(pairs)
    return c, c.groupBy("pred").agg(F.sum("n").alias("n")), c.groupBy("true").agg(F.sum("n").alias("n"))


def ari(pairs: DataFrame) -> DataFrame:
    """Adjusted Rand index, 1 where chance leaves no room: one row, one class on either side, all rows apart."""
    c, a, b = _margins(pairs)
    pairs2 = lambda d, name: d.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name), F.sum("n").alias(f"t{name}"))
    s = pairs2(c, "ij").join(pairs2(a, "a"), how="cross").join(pairs2(b, "b"), how="cross")
    expected = F.coalesce(F.try_divide(F.col("a") * F.col("b"), F.col("tij") * (F.col("tij") - 1) / 2), F.lit(0.0))
    top = (F.col("a") + F.col("b")) / 2
    return s.select(F.coalesce(F.try_divide(F.col("ij") - expected, top - expected), F.lit(1.0)).alias("ari"))


def information(pairs: DataFrame) -> DataFrame:
    """nmi (arithmetic mean, equal to V), homogeneity, completeness; natural logarithms."""
    c, a, b = _margins(pairs)
    total = c.agg(F.sum("n").alias("t"))
    h = lambda d, name: d.join(total, how="cross").agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias(name))
    mi = c.join(a.withColumnRenamed("n", "na"), "pred").join(b.withColumnRenamed("n", "nb"), "true").join(total, how="cross")
    mi = mi.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    s = mi.join(h(a, "hp"), how="cross").join(h(b, "ht"), how="cross")
    part = lambda x: F.when(F.col(x) > 0, F.col("mi") / F.col(x)).otherwise(F.lit(1.0))
    return s.select(F.when(F.col("hp") + F.col("ht") > 0, 2 * F.col("mi") / (F.col("hp") + F.col("ht"))).otherwise(F.lit(1.0)).alias("nmi"), part("ht").alias("homogeneity"), part("hp").alias("completeness"))


def contingency(pairs: DataFrame) -> np.ndarray:
    """The table of classes on the driver: classes squared, whatever the number of rows."""
    rows = confusion(pairs).collect()
    p, t = sorted({r["pred"] for r in rows}), sorted({r["true"] for r in rows})
    m = np.zeros((len(p), len(t)), np.int64)
    for r in rows:
        m[p.index(r["pred"]), t.index(r["true"])] = r["n"]
    return m


def expected_information(x: int, y: int, n: int) -> float:
    """What classes of x and y of n rows add to the mutual information by chance (hypergeometric). Overlaps further than 40
    standard deviations from the mean add nothing that a double can hold, so the work grows with the root of n."""
    mean = x * y / n
    reach = 40 * math.sqrt(mean * (n - x) * (n - y) / (n * max(1, n - 1))) + 40
    low, high = max(1, x + y - n, math.floor(mean - reach)), min(x, y, math.ceil(mean + reach))
    if low > high:
        return 0.0
    lg = math.lgamma
    first = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(low + 1) - lg(x - low + 1) - lg(y - low + 1) - lg(n - x - y + low + 1)
    k = np.arange(low, high + 1, dtype=float)
    step = np.log((x - k[:-1]) * (y - k[:-1])) - np.log(k[1:] * (n - x - y + k[1:]))
    log_p = first + np.concatenate(([0.0], np.cumsum(step)))
    return float((k / n * np.log(n * k / (x * y)) * np.exp(log_p)).sum())


def ami(pairs: DataFrame) -> float:
    """Adjusted for the mutual information expected by chance."""
    m = contingency(pairs)
    n, a, b = int(m.sum()), m.sum(1), m.sum(0)
    if len(a) == len(b) == 1 or n == 0:
        return 1.0
    h = lambda x: -sum(v / n * math.log(v / n) for v in x if v)
    mi = sum(m[i, j] / n * math.log(n * m[i, j] / (a[i] * b[j])) for i in range(len(a)) for j in range(len(b)) if m[i, j])
    emi = sum(expected_information(int(x), int(y), n) for x in a for y in b)
    gap = (h(a) + h(b)) / 2 - emi
    return (mi - emi) / (gap if abs(gap) > 1e-15 else math.copysign(1e-15, gap))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest matching of rows to columns (shortest augmenting paths with potentials)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, col, base = row, -1, 0.0
        while True:
            reach = base + c[i] - u[i] - v
            better = ~done & (reach < dist)
            dist[better], prev[better] = reach[better], col
            col = int(np.where(done, np.inf, dist).argmin())
            base = dist[col]
            done[col] = True
            if match[col] < 0:
                break
            i = match[col]
        for k in np.flatnonzero(done):
            if match[k] >= 0 and k != col:
                u[match[k]] += base - dist[k]
            v[k] += dist[k] - base
        u[row] += base
        while col >= 0:
            p = prev[col]
            match[col] = row if p < 0 else match[p]
            col = p
    pairs = [(int(match[k]), k) for k in range(m) if match[k] >= 0]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def hungarian_accuracy(pairs: DataFrame) -> float:
    m = contingency(pairs)
    return sum(int(m[i, j]) for i, j in assignment(-m.astype(float))) / max(1, int(m.sum()))


def _centres(pts: DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters, their means, mean squared distances from these, and sizes."""
    one = pts.select("cluster", F.posexplode("x").alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = one.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("m"), F.sum("s").alias("s"), F.max("n").alias("n")).orderBy("cluster").collect()
    return [r["cluster"] for r in rows], np.array([[e["m"] for e in r["m"]] for r in rows]), np.array([r["s"] for r in rows]), np.array([r["n"] for r in rows])


def silhouette_points(points: DataFrame, block: int = 20_000, most_centres: int = 4_000_000) -> DataFrame:
    """id, cluster, a, b, silhouette, met for points (id, cluster, x): the Euclidean silhouette of every point and the number of points
    that it was held against. NaN for fewer than two clusters; a singleton counts 0.

    A point's mean distance to a cluster is at least its distance d to the cluster's mean, and at most the root of d**2 and the
    cluster's variance. Only clusters whose lower bound is not above the least upper bound can be the nearest, so a point meets
    these and its own alone; sums over them are exact. Points and clusters are dealt in blocks of `block` points. Means are sent
    with the tasks if they have at most most_centres numbers; beyond that nothing is passed over.
    """
    pts = points.select("id", "cluster", "x")
    names, means, spread, sizes = _centres(pts)
    parts = [max(1, math.ceil(n / block)) for n in sizes]
    bounded = means.size <= most_centres

    def candidates(batches):
        own = {c: k for k, c in enumerate(names)}
        for b in batches:
            x = numbers(b.column("x"))
            if not len(x):
                continue
            at = np.array([own[c] for c in b.column("cluster").to_pylist()])
            wanted = np.ones((len(x), len(names)), bool)
            if bounded:
                low = np.empty(wanted.shape)
                for k, m in enumerate(means):
                    low[:, k] = np.sqrt(((x - m) ** 2).sum(1))
                high = np.sqrt(low * low + spread)
                high[np.arange(len(x)), at] = np.inf
                wanted = low <= high.min(1, keepdims=True) * (1 + 1e-9) + 1e-12
            wanted[np.arange(len(x)), at] = True
            i, k = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([b.column(n).take(pa.array(i)) for n in ("id", "cluster", "x")] + [pa.array(k, pa.int32())], ["id", "cluster", "x", "k"])

    kind = dict(pts.dtypes)
    x = pts.withColumn("x", F.col("x").cast("array<double>"))
    left = x.mapInArrow(candidates, f"id {kind['id']}, cluster {kind['cluster']}, x array<double>, k int")
    many = left.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("p")).collect()
    rows = {r["k"]: r["p"] for r in many}
    count = lambda of: F.element_at(F.array(*[F.lit(int(of(k))) for k in range(len(names))] or [F.lit(1)]), F.col("k") + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    p_of, q_of = count(lambda k: rows.get(k, 1)), count(lambda k: parts[k])
    left = left.select("*", F.pmod(F.xxhash64("id"), p_of).cast("int").alias("p"), every(q_of).alias("q"))
    number = F.element_at(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.sequence(F.lit(0), F.lit(len(names) - 1))), F.col("cluster")) if names else F.lit(0)
    right = x.withColumn("k", number).select("k", "x", F.pmod(F.xxhash64("id"), q_of).cast("int").alias("q"), every(p_of).alias("p"))

    def distances(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return a.select(["id", "cluster", "k"]).slice(0, 0).append_column("s", pa.array([], pa.float64())).append_column("m", pa.array([], pa.int64()))
        x, y = numbers(a["x"]), numbers(b["x"])
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        rows = max(1, TILE // len(y))  # at once: a block's distances are never held together
        s = [np.sqrt(np.maximum(0, xx[i : i + rows, None] + yy[None] - 2 * x[i : i + rows] @ y.T)).sum(1) for i in range(0, len(x), rows)]
        return a.select(["id", "cluster", "k"]).append_column("s", pa.array(np.concatenate(s))).append_column("m", pa.array(np.full(len(x), len(y))))

    keys = ("k", "q", "p")
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: distances(a, b), f"id {kind['id']}, cluster {kind['cluster']}, k int, s double, m bigint")
    sums = sums.groupBy("id", "cluster", "k").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    own = F.col("k") == number
    per = sums.groupBy("id", "cluster").agg(F.max(F.when(own, F.col("s") / F.greatest(F.col("m") - 1, F.lit(1)))).alias("a"), F.max(F.when(own, F.col("m"))).alias("n"), F.min(F.when(~own, F.col("s") / F.col("m"))).alias("b"), F.sum("m").alias("met"))
    value = F.when(F.col("b").isNull(), F.lit(float("nan"))).when(F.col("n") == 1, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select("id", "cluster", "a", "b", value.alias("silhouette"), "met")


def silhouette(points: DataFrame, block: int = 20_000) -> DataFrame:
    """The mean silhouette of (id, cluster, x), see silhouette_points."""
    return silhouette_points(points, block).agg(F.avg("silhouette").alias("silhouette"))


def clustering_metrics(pairs: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """All metrics as one row."""
    out = ari(pairs).join(information(pairs), how="cross").withColumn("v_measure", F.col("nmi"))
    out = out.withColumns({"ami": F.lit(ami(pairs)), "hungarian_acc": F.lit(hungarian_accuracy(pairs))})
    return out.join(silhouette(points), how="cross") if points is not None else out
