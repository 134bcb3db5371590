"""Graph autoencoder with global modulation: three graph convolutions, attention pooling, scale and shift of the nodes by the
pooled vector, a decoder for edges, a projection for alignment, a loop head.

A graph is one (cell, chromosome), so a forward pass is one call of applyInPandas; parameters are small arrays that travel with
the function. Edges go from the lower to the higher bin only, weights are not used, self loops are added and messages
are scaled by the square roots of in-degrees.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalith.functions.tape import Var, beside

GRAPH = ["cell_id", "chrom"]
Params = dict[str, np.ndarray]


@dataclass
class ModelConfig:
    """Layer sizes: fixed values."""

    in_dim: int
    hidden_dim: int = 128
    z_dim: int = 32
    dropout: float = 0.2
    recon_hidden: int = 64
    target_dim: int = 50
    proj_hidden: int = 64
    film_hidden: int = 64
    loop_dim: int = 32
    loop_hidden: int = 64


def init_params(cfg: ModelConfig, seed: int = 42) -> Params:
    rng = np.random.default_rng(seed)
    z = cfg.z_dim
    layers = {
        "gcn1": (cfg.in_dim, cfg.hidden_dim), "gcn2": (cfg.hidden_dim, cfg.hidden_dim), "gcn3": (cfg.hidden_dim, z),
        "gate": (z, 1), "film1": (z, cfg.film_hidden), "film2": (cfg.film_hidden, 2 * z),
        "recon1": (2 * z, cfg.recon_hidden), "recon2": (cfg.recon_hidden, 1),
        "proj1": (z, cfg.proj_hidden), "proj2": (cfg.proj_hidden, cfg.target_dim),
        "lproj1": (z, cfg.loop_hidden), "lproj2": (cfg.loop_hidden, cfg.loop_dim),
        "loop1": (2 * cfg.loop_dim, cfg.loop_hidden), "loop2": (cfg.loop_hidden, 1),
    }
    out: Params = {"norm.w": np.ones(cfg.in_dim), "norm.b": np.zeros(cfg.in_dim)}
    for name, (a, b) in layers.items():
        out[f"{name}.w"] = rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        out[f"{name}.b"] = np.zeros(b)
    return out


def dump_params(params: Params) -> str:
    return json.dumps({k: {"shape": list(v.shape), "values": v.ravel().tolist()} for k, v in params.items()})


def load_params(text: str) -> Params:
    """A plain dictionary of parameters, or one under state_dict or model_state."""
    d = json.loads(text)
    d = d.get("state_dict") or d.get("model_state") or d
    return {k: np.array(v["values"]).reshape(v["shape"]) for k, v in d.items()}


def params_table(spark, params: Params) -> DataFrame:
    return spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in params.items()], "name string, shape array<int>, values array<double>")


class Net:
    """The model over parameters that may be differentiated."""

    def __init__(self, params: Params):
        self.p = {k: Var(v) for k, v in params.items()}

    def linear(self, x: Var, name: str) -> Var:
        return x @ self.p[f"{name}.w"] + self.p[f"{name}.b"]

    def mlp(self, x: Var, a: str, b: str) -> Var:
        return self.linear(self.linear(x, a).relu(), b)

    def encode(self, x: np.ndarray, src: np.ndarray, dst: np.ndarray, dropout: float = 0.0, rng=None) -> tuple[Var, Var]:
        """Node vectors after modulation, and the graph's vector (1 row)."""
        n = len(x)
        src, dst = np.concatenate((src, np.arange(n))), np.concatenate((dst, np.arange(n)))
        root = np.bincount(dst, minlength=n) ** -0.5
        weight = root[src] * root[dst]
        conv = lambda h, name: (h @ self.p[f"{name}.w"]).spread(src, dst, weight) + self.p[f"{name}.b"]
        c = x - x.mean(1, keepdims=True)
        h = Var(c / np.sqrt((c * c).mean(1, keepdims=True) + 1e-5)) * self.p["norm.w"] + self.p["norm.b"]
        h = conv(h, "gcn1").relu()
        if dropout and rng is not None:
            h = h * ((rng.random(h.value.shape) >= dropout) / (1 - dropout))
        z = conv(conv(h, "gcn2").relu(), "gcn3")
        gate = self.linear(z, "gate")
        e = (gate + -gate.value.max()).exp()
        share = e * e.sum().power(-1.0)
        g = (share * z).sum(0)
        g = Var(g.value[None], (g,), lambda d: (d[0],))
        film = self.mlp(g, "film1", "film2")
        k = z.value.shape[1]
        return z * (film.cols(0, k) + 1.0) + film.cols(k, 2 * k), g

    def recon(self, z: Var, src: np.ndarray, dst: np.ndarray) -> Var:
        return self.mlp(beside(z.rows(src), z.rows(dst)), "recon1", "recon2").sum(1)

    def loop(self, z: Var, src: np.ndarray, dst: np.ndarray) -> Var:
        y = self.mlp(z, "lproj1", "lproj2")
        return self.mlp(beside(y.rows(src), y.rows(dst)), "loop1", "loop2").sum(1)

    def project(self, g: Var) -> Var:
        return self.mlp(g, "proj1", "proj2")


def graph_rows(nodes: DataFrame, edges: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """One row for each graph: feats in the order of bins, src and dst of canonical edges. Node and edge counts of a
    graph are bounded by its chromosome.

    dims (cell_id, chrom, n_bins): the shapes are checked as the rows are made, without a job or scan of its own: a graph whose bins are not
    0 .. n_bins - 1, each once, whose feats differ in length, or whose edges lead outside fails whatever reads it, by name.
    """
    n = nodes.groupBy(*GRAPH).agg(F.sort_array(F.collect_list(F.struct("bin", "feat"))).alias("rows"))
    e = edges.filter("src < dst").groupBy(*GRAPH).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"))
    none = F.expr("cast(array() as array<int>)")
    out = n.join(e, GRAPH, "left").select(*GRAPH, "rows", F.transform("rows", lambda s: s["feat"]).alias("x"), *[F.coalesce(F.col("e")[c], none).alias(c) for c in ("src", "dst")])
    if dims is not None:
        # a graph of dims without any feature row has none to be told by
        out = out.join(dims.select(*GRAPH, "n_bins"), GRAPH, "left")
        size, text = F.size("rows"), lambda c: c.cast("string")
        out_of_place = F.exists(F.transform("rows", lambda s, i: s["bin"] != i), lambda b: b)
        uneven = F.size(F.array_distinct(F.transform("x", lambda v: F.coalesce(F.size(v), F.lit(-1))))) > 1
        what = (
            F.when(F.col("n_bins").isNull(), F.lit("no number of bins"))
            .when(size != F.col("n_bins"), F.concat(text(size), F.lit(" feature rows, "), text(F.col("n_bins")), F.lit(" bins")))
            .when(out_of_place, F.lit("a bin is missing or comes twice"))
            .when(uneven, F.lit("feature rows of different lengths"))
            .when((F.coalesce(F.array_max("dst"), F.lit(-1)) >= F.col("n_bins")) | (F.coalesce(F.array_min("src"), F.lit(0)) < 0), F.lit("an edge leads outside"))
        )
        name = F.concat_ws(" ", F.lit("graph of"), *GRAPH)
        kind = out.schema["x"].dataType
        out = out.withColumn("x", F.when(what.isNotNull(), F.raise_error(F.concat(name, F.lit(": "), what)).cast(kind)).otherwise(F.col("x")))
    return out.select(*GRAPH, "x", "src", "dst")


def _graph(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack([np.asarray(v, float) for v in row["x"]]), np.asarray(row["src"], int), np.asarray(row["dst"], int)


def encode_graphs(graphs: DataFrame, params: Params) -> DataFrame:
    """(cell_id, chrom, z, g): z has a vector for each bin."""

    def run(batches):
        net = Net(params)
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                z, g = net.encode(*_graph(r))
                rows.append((r["cell_id"], r["chrom"], z.value.tolist(), g.value[0].tolist()))
            yield pd.DataFrame(rows, columns=["cell_id", "chrom", "z", "g"])

    return graphs.mapInPandas(run, "cell_id string, chrom string, z array<array<double>>, g array<double>")


def node_vectors(encoded: DataFrame) -> DataFrame:
    return encoded.select(*GRAPH, F.posexplode("z").alias("bin", "z"))


def cell_embeddings(encoded: DataFrame, agg: str = "mean", min_graphs: int = 1) -> DataFrame:
    """Mean (or sum) of a cell's graph vectors, its number of graphs, and its chromosomes joined by commas."""
    dims = encoded.select("cell_id", "chrom", F.posexplode("g").alias("k", "v"))
    per = dims.groupBy("cell_id", "k").agg((F.sum("v") if agg == "sum" else F.avg("v")).alias("v"))
    emb = per.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("emb"))
    info = encoded.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_graphs"), F.array_join(F.sort_array(F.collect_set("chrom")), ",").alias("chroms"))
    return emb.join(info.filter(F.col("n_graphs") >= min_graphs), "cell_id")


def score_pairs(graphs: DataFrame, params: Params, head: str = "loop", mode: str = "full", low: int = 2, high: int = 20) -> DataFrame:
    """Logits of candidate pairs (all in a distance band, or the graph's own edges in it)."""

    def run(batches):
        net = Net(params)
        for pdf in batches:
            for _, r in pdf.iterrows():
                x, src, dst = _graph(r)
                n = len(x)
                if mode == "full":
                    a = np.repeat(np.arange(n), high - low + 1)
                    b = a + np.tile(np.arange(low, high + 1), n)
                    ok = b < n
                else:
                    a, b = src, dst
                    ok = (np.abs(b - a) >= low) & (np.abs(b - a) <= high)
                a, b = a[ok], b[ok]
                z, _ = net.encode(x, src, dst)
                logit = (net.loop if head == "loop" else net.recon)(z, a, b).value
                yield pd.DataFrame({"cell_id": r["cell_id"], "chrom": r["chrom"], "src": a.astype("int32"), "dst": b.astype("int32"), "logit": logit})

    return graphs.mapInPandas(run, "cell_id string, chrom string, src int, dst int, logit double")


def score_edges(graphs: DataFrame, params: Params, negatives: DataFrame) -> DataFrame:
    """Reconstruction logits of the graphs' own edges (y = 1) and of given negatives (y = 0); graphs without negatives are
    left out."""
    neg = negatives.groupBy(*GRAPH).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("n"))
    rows = graphs.join(neg, list(GRAPH)).select("*", F.transform("n", lambda s: s["src"]).alias("neg_src"), F.transform("n", lambda s: s["dst"]).alias("neg_dst")).drop("n")

    def run(batches):
        net = Net(params)
        for pdf in batches:
            for _, r in pdf.iterrows():
                x, src, dst = _graph(r)
                a, b = np.concatenate((src, np.asarray(r["neg_src"], int))), np.concatenate((dst, np.asarray(r["neg_dst"], int)))
                z, _ = net.encode(x, src, dst)
                y = (np.arange(len(a)) < len(src)).astype("int32")
                yield pd.DataFrame({"cell_id": r["cell_id"], "chrom": r["chrom"], "src": a.astype("int32"), "dst": b.astype("int32"), "y": y, "logit": net.recon(z, a, b).value})

    return rows.mapInPandas(run, "cell_id string, chrom string, src int, dst int, y int, logit double")


def gcn_one_hop(nodes: DataFrame, edges: DataFrame, value: str = "x") -> DataFrame:
    """One propagation step without weights, declared: sum over in-neighbours and self of x / sqrt(d_in(u) d_in(v))."""
    key = [*GRAPH, "bin"]
    e = edges.filter("src < dst").select(*GRAPH, "src", "dst")
    deg = e.groupBy(*GRAPH, F.col("dst").alias("bin")).agg(F.count(F.lit(1)).alias("d"))
    v = nodes.join(deg, key, "left").select(*key, (F.coalesce("d", F.lit(0)) + 1).cast("double").alias("d"), F.col(value).alias("_x"))
    s = v.select(*GRAPH, F.col("bin").alias("src"), (F.col("_x") / F.sqrt("d")).alias("m"))
    got = e.join(s, [*GRAPH, "src"]).groupBy(*GRAPH, F.col("dst").alias("bin")).agg(F.sum("m").alias("m"))
    return v.join(got, key, "left").select(*key, (F.coalesce("m", F.lit(0.0)) / F.sqrt("d") + F.col("_x") / F.col("d")).alias(value))
