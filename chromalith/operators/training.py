"""Losses and synchronous data-parallel training: gradients of each graph on the executors, summed there, one Adam step on
the driver. Parameters and gradients have a fixed size, whatever the number of graphs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalith.functions.columns import cosine_similarity, softplus
from chromalith.functions.tape import Var, gradients
from chromalith.functions.vectors import first_row, tree_sum
from chromalith.operators.model import Net, Params, _graph


@dataclass
class TrainConfig:
    epochs: int = 150
    rate: float = 1e-3
    clip: float = 5.0
    seed: int = 42
    dropout: float = 0.2
    w_recon: float = 1.0
    w_cosine: float = 1.0
    w_loop: float = 0.0
    neg_ratio: float = 1.0
    cosine_from: int = 0
    frozen: tuple[str, ...] = ()


FINETUNE = TrainConfig(epochs=100, rate=1e-4, w_recon=0.2, w_cosine=0.6, w_loop=1.5)


def bce_losses(scores: DataFrame) -> DataFrame:
    """Per graph: mean losses of positive (y = 1) and negative logits and their sum; an empty side counts 0."""
    x, y = F.col("logit"), F.col("y")
    pos, neg = F.avg(F.when(y == 1, softplus(-x))), F.avg(F.when(y == 0, softplus(x)))
    out = scores.groupBy("cell_id", "chrom").agg(F.coalesce(pos, F.lit(0.0)).alias("pos"), F.coalesce(neg, F.lit(0.0)).alias("neg"))
    return out.withColumn("total", F.col("pos") + F.col("neg"))


def cosine_loss(pred: Column, target: Column) -> Column:
    """1 - cosine similarity; 0 without a target."""
    return F.coalesce(1 - cosine_similarity(pred, target), F.lit(0.0))


def weighted_total(recon: Column, cosine: Column, loop: Column, cfg: TrainConfig) -> Column:
    return cfg.w_recon * recon + cfg.w_cosine * cosine + (cfg.w_loop * F.coalesce(loop, F.lit(0.0)) if cfg.w_loop > 0 else F.lit(0.0))


def _free_pairs(n: int, taken: np.ndarray, low: int, top: int) -> np.ndarray:
    """All pairs i < j below n at a distance of low..top whose numbers i * n + j are not taken."""
    steps = np.arange(low, top + 1)
    a = np.concatenate([np.arange(n - d) for d in steps]) if len(steps) else np.zeros(0, int)
    b = a + np.repeat(steps, n - steps)
    pairs = a * n + b
    return pairs[~np.isin(pairs, taken)]


def _negatives(rng, n: int, taken: set[tuple[int, int]] | np.ndarray, want: int, low: int = 5, high: int = 100, share: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that are not taken (a set of pairs, or an array of rows): int(want * share) at a distance of low..high, then others drawn uniformly;
    fewer only if no more are free. Pairs are drawn and those that are taken rejected; where taken and wanted ones are over half of a
    band, it is no larger than twice these, so its free pairs are listed and drawn from."""
    i, j = np.array(sorted(taken) if isinstance(taken, set) else taken, int).reshape(-1, 2).T
    taken, out = np.unique((i * n + j)[(j >= 0) & (j < n)]), np.zeros(0, int)
    for a, b, quota in ((low, min(high, n - 1), int(want * share)), (1, n - 1, want)):
        room = (b - a + 1) * (2 * n - a - b) // 2 if b >= a else 0
        need = quota - len(out)
        if room <= 0 or need <= 0:
            continue
        if 2 * (need + len(taken) + len(out)) > room:
            free = _free_pairs(n, np.concatenate((taken, out)), a, b)
            out = np.concatenate((out, free[rng.permutation(len(free))[:need]]))
            continue
        while need > 0:
            i = rng.integers(0, n, max(3 * need, 200))
            j = i + rng.integers(a, b + 1, len(i))
            drawn = (i * n + j)[j < n]
            _, first = np.unique(drawn, return_index=True)
            drawn = drawn[np.sort(first)]  # each pair once, in the order of drawing
            out = np.concatenate((out, drawn[~np.isin(drawn, taken) & ~np.isin(drawn, out)][:need]))
            need = quota - len(out)
    out = np.sort(out)
    return out // n, out % n


def _drawn(row, name: str, learn: bool, rng, n: int, src: np.ndarray, dst: np.ndarray, cfg: TrainConfig) -> tuple[np.ndarray, np.ndarray]:
    """Negatives for positive pairs: in validation those stored with the graph (columns <name>_src and <name>_dst, ends
    below n), else drawn."""
    if not learn and row.get(f"{name}_src") is not None:
        a, b = np.asarray(row[f"{name}_src"], int), np.asarray(row[f"{name}_dst"], int)
        ok = (a < n) & (b < n)
        return a[ok], b[ok]
    return _negatives(rng, n, np.stack([src, dst], 1), int(len(src) * cfg.neg_ratio))


#: What a pass sums beside the loss: the parts of the loss, and the number of graphs that have each.
PARTS = ("pos", "neg", "cosine", "loop_pos", "loop_neg", "n_cosine", "n_loops")


def graph_loss(net: Net, row, cfg: TrainConfig, rng, dropout: float, learn: bool = True, epoch: int = 0, parts: dict[str, float] | None = None) -> Var:
    """The weighted loss of a graph; its parts are put into `parts`."""
    x, src, dst = _graph(row)
    z, g = net.encode(x, src, dst, dropout, rng)
    a, b = _drawn(row, "neg", learn, rng, len(x), src, dst, cfg)
    found = dict.fromkeys(PARTS, 0.0)

    def bce(name: str, head, i, j, k, m) -> Var:
        pos, neg = (-head(z, i, j)).softplus().mean(), head(z, k, m).softplus().mean()
        found[f"{name}pos"], found[f"{name}neg"] = float(pos.value), float(neg.value)
        return pos + neg

    loss = bce("", net.recon, src, dst, a, b) * cfg.w_recon
    target = row.get("target")
    if target is not None and len(target) and epoch >= cfg.cosine_from:
        t, p = np.asarray(target, float)[None], net.project(g)
        norm = lambda v: np.maximum(np.sqrt((v * v).sum()), 1e-8)
        square = (p * p).sum()
        cos = (p * t).sum() * square.power(-0.5) * (1 / norm(t)) if square.value > 1e-16 else Var(0.0)
        found |= {"cosine": 1 - float(cos.value), "n_cosine": 1}
        loss = loss + (-cos + 1.0) * cfg.w_cosine
    if cfg.w_loop > 0 and row.get("loop_src") is not None and len(row["loop_src"]):
        i, j = np.asarray(row["loop_src"], int), np.asarray(row["loop_dst"], int)
        ok = (i < len(x)) & (j < len(x))
        i, j = i[ok], j[ok]
        if len(i):
            found["n_loops"] = 1
            a, b = _drawn(row, "loop_neg", learn, rng, len(x), i, j, cfg)
            loss = loss + bce("loop_", net.loop, i, j, a, b) * cfg.w_loop
    if parts is not None:
        parts.update(found)
    return loss


def with_loops(graphs: DataFrame, loops: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """Graph rows with loop_src and loop_dst, the reference loops (cell_id, chrom, i, j) of each graph whose ends are bins of it, each once
    and with the lower end first; empty where there are none. negatives (cell_id, chrom, src, dst) are stored beside
    them as loop_neg_src and loop_neg_dst, for validation. A graph's loops are bounded by its chromosome."""
    key, n = ["cell_id", "chrom"], F.size("x")

    def listed(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias(name))

    def ends(out: DataFrame, name: str) -> DataFrame:
        inside = F.filter(F.coalesce(name, F.expr("cast(array() as array<struct<a: int, b: int>>)")), lambda p: (p["a"] >= 0) & (p["b"] < n))
        return out.withColumn(name, inside).withColumns({f"{name}_src": F.transform(name, lambda p: p["a"]), f"{name}_dst": F.transform(name, lambda p: p["b"])}).drop(name)

    int_ = lambda c: c.cast("int")
    pairs = loops.filter("i != j").select(*key, int_(F.least("i", "j")).alias("a"), int_(F.greatest("i", "j")).alias("b"))
    out = ends(graphs.join(listed(pairs, "loop"), key, "left"), "loop")
    if negatives is None:
        return out
    kept = negatives.select(*key, int_(F.col("src")).alias("a"), int_(F.col("dst")).alias("b"))
    return ends(out.join(listed(kept, "loop_neg"), key, "left"), "loop_neg")


def with_targets(graphs: DataFrame, targets: DataFrame) -> DataFrame:
    """Graph rows with the embedding (cell_id, emb) of their cell as target, null for cells without one."""
    return graphs.join(targets.select("cell_id", F.col("emb").alias("target")), "cell_id", "left")


@dataclass
class Trained:
    params: Params
    best: Params
    history: list[dict[str, float]] = field(default_factory=list)
    moments: tuple[Params, Params] | None = None


def dump_trained(t: Trained) -> str:
    """A checkpoint as JSON: last and best parameters, the optimizer's moments, the history."""
    flat = lambda p: {k: {"shape": list(v.shape), "values": v.ravel().tolist()} for k, v in p.items()}
    return json.dumps({"model_state": flat(t.params), "best": flat(t.best), "moments": [flat(m) for m in t.moments] if t.moments else None, "history": t.history})


def load_trained(text: str) -> Trained:
    """What dump_trained wrote, to go on from by train(..., resume=...)."""
    d = json.loads(text)
    full = lambda p: {k: np.array(v["values"]).reshape(v["shape"]) for k, v in p.items()}
    return Trained(full(d["model_state"]), full(d["best"]), d["history"], tuple(full(m) for m in d["moments"]) if d["moments"] else None)


def _pass(graphs: DataFrame, params: Params, cfg: TrainConfig, epoch: int, learn: bool, tasks: int | None = None) -> tuple[float, int, Params, dict[str, float]]:
    """Sum of the losses, number of graphs, mean gradient and sums of PARTS. A task gives one vector: its sums and, in learning, its
    gradient laid end to end; vectors are summed in a tree, and one comes to the driver. tasks: the number of partitions of graphs, if known."""
    names = sorted(params) if learn else []

    def run(batches):
        total = np.zeros(2 + len(PARTS) + sum(params[k].size for k in names))
        for pdf in batches:
            for _, r in pdf.iterrows():
                rng = np.random.default_rng([cfg.seed, epoch + 1 if learn else 0, *map(ord, f"{r['cell_id']}/{r['chrom']}")])
                net, parts = Net(params), {}
                loss = graph_loss(net, r, cfg, rng, cfg.dropout if learn else 0.0, learn, epoch, parts)
                own = [np.array([float(loss.value), 1.0, *(parts[p] for p in PARTS)])]
                if learn:
                    gradients(loss)
                    grads = [v if v is not None else np.zeros_like(params[k]) for k, v in ((k, net.p[k].grad) for k in names)]
                    norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                    own += [g.ravel() * min(1.0, cfg.clip / (norm + 1e-6)) for g in grads]
                total += np.concatenate(own)
        if total[1]:
            yield pd.DataFrame({"v": [total.tolist()]})

    found = first_row(tree_sum(graphs.mapInPandas(run, "v array<double>"), tasks=tasks))
    v = np.array(found["v"]) if found else np.zeros(2 + len(PARTS) + sum(params[k].size for k in names))
    n, at, grads = int(v[1]), 2 + len(PARTS), {}
    for k in names:
        grads[k] = v[at : at + params[k].size].reshape(params[k].shape) / max(1, n)
        at += params[k].size
    return float(v[0]), n, grads, dict(zip(PARTS, v[2 : 2 + len(PARTS)].tolist(), strict=True))


def _log(prefix: str, loss: float, n: int, parts: dict[str, float]) -> dict[str, float]:
    """Means by graph; of the loops' parts by graph that has loops, whose share is the coverage."""
    loops = max(1, parts["n_loops"])
    means = {"pos": parts["pos"] / max(1, n), "neg": parts["neg"] / max(1, n), "cosine": parts["cosine"] / max(1, n), "loop_pos": parts["loop_pos"] / loops, "loop_neg": parts["loop_neg"] / loops, "loop_coverage": parts["n_loops"] / max(1, n)}
    return {prefix: loss / max(1, n), **{f"{prefix}_{k}": v for k, v in means.items()}}


def train(graphs: DataFrame, params: Params, cfg: TrainConfig, validation: DataFrame | None = None, resume: Trained | None = None) -> Trained:
    """Adam over graphs (cell_id, chrom, x, src, dst[, target, loop_src, loop_dst]); keeps the last and the best parameters. The history has
    a row for each epoch, see _log. Validation graphs may bring stored negatives (neg_src, neg_dst, loop_neg_src, loop_neg_dst). resume is
    gone on from and stays as it is."""
    params = {k: v.copy() for k, v in (resume.params if resume else params).items()}
    m, v = resume.moments if resume and resume.moments else ({k: np.zeros_like(x) for k, x in params.items()}, {k: np.zeros_like(x) for k, x in params.items()})
    m, v = dict(m), dict(v)
    out = Trained(resume.params, resume.best, [dict(h) for h in resume.history]) if resume else Trained(params, params)
    lowest = min([h.get("val", h["train"]) for h in out.history], default=np.inf)
    # graphs are small and their passes long: they are dealt to all cores, whatever their bytes
    tasks = graphs.sparkSession.sparkContext.defaultParallelism
    graphs = graphs.repartition(tasks).persist()
    first = len(out.history)
    for epoch in range(first, first + cfg.epochs):
        loss, n, grads, parts = _pass(graphs, params, cfg, epoch, True, tasks)
        t = epoch + 1
        for k, g in grads.items():
            if any(k.startswith(f) for f in cfg.frozen):
                continue
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - cfg.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        log = {"epoch": epoch, **_log("train", loss, n, parts)}
        if validation is not None:
            val, k, _, parts = _pass(validation, params, cfg, epoch, False)
            log |= _log("val", val, k, parts)
        out.history.append(log)
        if log.get("val", log["train"]) < lowest:
            lowest, out.best = log.get("val", log["train"]), dict(params)
    graphs.unpersist()
    out.params, out.moments = params, (m, v)
    return out
