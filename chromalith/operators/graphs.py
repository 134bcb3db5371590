"""Edges: canonical forms, distance bands, candidates, reference loops, negatives, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPH = ("cell_id", "chrom")
# fixed values: cell types of the three loop groups
LOOP_GROUPS = {
    "Neuron": ("L23", "L4", "L5", "L6", "Ndnf", "Vip", "Pvalb", "Sst"),
    "MG": ("MG",),
    "ODC": ("ODC",),
}


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Self loops and the lower triangle are dropped, not swapped."""
    return edges.filter("src < dst")


def normalized_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges with src < dst."""
    keys = [c for c in GRAPH if c in edges.columns]
    return edges.filter("src != dst").select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def within_nodes(edges: DataFrame, dims: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    keys = [c for c in GRAPH if c in edges.columns and c in dims.columns]
    return edges.join(dims, keys).filter((F.col(src) < F.col("n_bins")) & (F.col(dst) < F.col("n_bins"))).drop("n_bins")


def by_distance(edges: DataFrame, low: int, high: int, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.filter(F.abs(F.col(dst) - F.col(src)).between(low, high))


def candidate_pairs(dims: DataFrame, low: int = 2, high: int = 20) -> DataFrame:
    """All i < j with low <= j - i <= high below n_bins: generated, never joined."""
    starts = dims.filter(F.col("n_bins") > low).select("*", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1 - low)).alias("src"))
    ends = F.sequence(F.col("src") + low, F.least(F.col("src") + high, F.col("n_bins") - 1))
    return starts.select(*[c for c in dims.columns if c != "n_bins"], "src", F.explode(ends).alias("dst"))


def loop_group(cell_type: Column, other: str | None = None) -> Column:
    """The reference group of a cell type; training leaves others without one, evaluation takes them as `other`."""
    out = F.lit(other)
    for group, types in LOOP_GROUPS.items():
        out = F.when(cell_type.isin(*types), F.lit(group)).otherwise(out)
    return out


def reference_loops(graphs: DataFrame, refs: DataFrame) -> DataFrame:
    """Loops of each graph (cell_id, chrom, n_bins[, group]) from refs (chrom, i, j[, group]), both ends in range."""
    on = ["chrom"] + (["group"] if "group" in graphs.columns and "group" in refs.columns else [])
    return graphs.join(refs, on).filter((F.col("i") < F.col("n_bins")) & (F.col("j") < F.col("n_bins"))).select("cell_id", "chrom", "i", "j")


def pair_rank(i: Column, j: Column, seed: int = 0) -> Column:
    """A number below 2**31 - 1 that looks random, by integer arithmetic that any SQL engine repeats."""
    m = 2147483647
    a = (i.cast("long") * 48271 + j.cast("long") * 69621 + 1 + seed) % m
    return ((a * 16807) % m * 48271 + j.cast("long")) % m


def near_negatives(positives: DataFrame, dims: DataFrame, ratio: float = 1.0, share: float = 0.7, low: int = 5, high: int = 100, seed: int = 0) -> DataFrame:
    """Pairs at a distance of low..high that are no positives, int(int(pos * ratio) * share) of each graph, by hash rank.

    A threshold on the rank would need no window, but the quota is exact, so the rank is windowed by graph.
    """
    from pyspark.sql import Window as W

    quota = positives.groupBy(*GRAPH).agg(F.floor(F.floor(F.count(F.lit(1)) * ratio) * share).cast("int").alias("quota"))
    free = candidate_pairs(dims, low, high).join(positives.select(*GRAPH, "src", "dst"), [*GRAPH, "src", "dst"], "left_anti")
    rank = F.row_number().over(W.partitionBy(*GRAPH).orderBy(pair_rank(F.col("src"), F.col("dst"), seed), "src", "dst"))
    return free.withColumn("_rank", rank).join(quota, list(GRAPH)).filter("_rank <= quota").drop("_rank", "quota")


def _triangle(rows: Column, at: Column) -> tuple[Column, Column]:
    """The at-th cell (row, column) of a triangle whose rows have rows, rows - 1, ..., 1 cells. Rows are paired, the longest with the
    shortest, so the pairs are equally long and whole-number division finds the place."""
    odd = rows % 2
    width = rows + 1 - odd
    q, r = F.floor(at / width), at % width
    first = r < rows - q
    return F.when(first, q).otherwise(rows - 1 + odd - q), F.when(first, r).otherwise(r - rows + q)


def shuffled_place(k: Column, side: Column, *salt: Column, rounds: int = 4) -> Column:
    """A bijection of 0 .. side**2 - 1 that looks random: each round adds a hash of one digit to the other, modulo side."""
    x, y = F.floor(k / side), k % side
    for n in range(rounds):
        x, y = y, F.pmod(x + F.pmod(F.xxhash64(*salt, y, F.lit(n)), side), side)
    return x * side + y


def drawn_pairs(quota: DataFrame, excluded: DataFrame, low: int = 1, high: int | None = None, seed: int = 0) -> DataFrame:
    """Draws without replacement: of each graph (cell_id, chrom, n_bins, need) `need` pairs i < j below n_bins at a distance of low..high
    that are not in excluded (cell_id, chrom, src, dst), or all such pairs if they are fewer.

    The pairs are numbered and the numbers drawn by a bijection, so none comes twice, and no more draws are made than the quota, the
    excluded pairs in the band, and what the bijection's square has beyond the band: as many as there are positives, not as the
    band has pairs. The pairs are decoded from their numbers; excluded ones are skipped, and the first `need` are kept.
    """
    from pyspark.sql import Window as W

    key = [*GRAPH, "src", "dst"]
    out = excluded.select(*[F.col(c) for c in key]).filter("src < dst")
    band = F.col("dst") - F.col("src")
    in_band = out.filter(band >= low if high is None else band.between(low, high))
    taken = in_band.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("taken"))
    g = quota.filter("need > 0").join(taken, list(GRAPH), "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    n = F.col("n_bins").cast("bigint")
    top = n - 1 if high is None else F.least(F.lit(high).cast("bigint"), n - 1)
    g = g.withColumns({"n": n, "wide": F.greatest(top - low + 1, F.lit(0).cast("bigint"))})  # distances there are
    # bins from which every distance is possible come first, then the triangle at the end
    g = g.withColumns({"full": (F.col("n") - low - F.col("wide") + 1) * F.col("wide"), "rest": F.col("wide") - 1})
    g = g.withColumn("room", F.col("full") + F.greatest(F.col("rest"), F.lit(0)) * (F.col("rest") + 1) / 2).withColumn("room", F.col("room").cast("bigint")).filter("wide > 0 and room > 0")
    g = g.withColumn("side", F.ceil(F.sqrt(F.col("room").cast("double"))).cast("bigint"))
    square = F.col("side") * F.col("side")
    g = g.withColumn("draws", F.least(square, F.col("need") + F.col("taken") + square - F.col("room")))
    draws = g.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("draws") - 1)))
    draws = draws.withColumn("at", shuffled_place(F.col("k"), F.col("side"), F.col("cell_id"), F.col("chrom"), F.lit(seed))).filter("at < room")
    row, column = _triangle(F.col("rest"), F.col("at") - F.col("full"))
    plain = F.col("at") < F.col("full")
    src = F.when(plain, F.floor(F.col("at") / F.col("wide"))).otherwise(F.floor(F.col("full") / F.col("wide")) + row)
    step = F.when(plain, F.col("at") % F.col("wide")).otherwise(column)
    pairs = draws.withColumn("src", src.cast("int")).select(*GRAPH, "need", "k", "src", (F.col("src") + low + step).cast("int").alias("dst"))
    free = pairs.join(out, key, "left_anti")
    rank = F.row_number().over(W.partitionBy(*GRAPH).orderBy("k"))
    return free.withColumn("_rank", rank).filter("_rank <= need").select(*key)


def mixed_negatives(positives: DataFrame, dims: DataFrame, ratio: float = 1.0, share: float = 0.7, low: int = 5, high: int = 100, seed: int = 0) -> DataFrame:
    """Negatives (cell_id, chrom, src, dst), int(positives * ratio) of each graph: int(that * share) drawn at a distance of low..high, the
    others from all pairs i < j; none of them is positive or comes twice. A graph has fewer only if it has no more free pairs."""
    want = positives.groupBy(*GRAPH).agg(F.floor(F.count(F.lit(1)) * ratio).cast("long").alias("want")).join(dims.select(*GRAPH, "n_bins"), list(GRAPH))
    near = drawn_pairs(want.select(*GRAPH, "n_bins", F.floor(F.col("want") * share).cast("long").alias("need")), positives, low, high, seed)
    got = near.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("got"))
    need = want.join(got, list(GRAPH), "left").select(*GRAPH, "n_bins", (F.col("want") - F.coalesce("got", F.lit(0))).alias("need"))
    key = [*GRAPH, "src", "dst"]
    far = drawn_pairs(need, positives.select(*key).unionByName(near), seed=seed + 1)
    return near.unionByName(far)


def split_by_hash(labels: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """The declarative variant: within each type the first round(n * ratio) cells by hash validate."""
    from pyspark.sql import Window as W

    w = W.partitionBy("cell_type")
    rank = F.row_number().over(w.orderBy(F.md5(F.concat("cell_id", F.lit(f":{seed}"))), "cell_id"))
    n = F.count(F.lit(1)).over(w)
    return labels.select("cell_id", "cell_type", F.when(rank <= F.bround(n * val_ratio), "val").otherwise("train").alias("split"))


def split_files(files: DataFrame, labels: DataFrame | None = None, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """file, cell_id, split: all files of a cell go the same way. With labels each type is split on its own and cells of
    unknown type train; without known cells all are split as one."""
    cells = files.select("cell_id").distinct()
    if labels is not None:
        cells = cells.join(labels.select("cell_id", "cell_type").distinct(), "cell_id", "left")
    if labels is None or cells.filter("cell_type is not null").isEmpty():
        cells = cells.select("cell_id").withColumn("cell_type", F.lit(""))
    known = split_by_hash(cells.filter("cell_type is not null"), val_ratio, seed).select("cell_id", "split")
    return files.join(known, "cell_id", "left").select("file", "cell_id", F.coalesce("split", F.lit("train")).alias("split"))


def split_counts(split: DataFrame) -> DataFrame:
    """One row: files and cells in all and in each part of a split (file, cell_id, split)."""
    part = lambda p: F.col("split") == p
    files = [F.count(F.lit(1)).alias("n_total_files"), *[F.count(F.when(part(p), 1)).alias(f"n_{p}_files") for p in ("train", "val")]]
    cells = [F.countDistinct("cell_id").alias("n_total_cells"), *[F.countDistinct(F.when(part(p), F.col("cell_id"))).alias(f"n_{p}_cells") for p in ("train", "val")]]
    return split.agg(*files, *cells)


def negatives_for(part: str, positives: DataFrame, dims: DataFrame, stored: DataFrame | None = None, **sampling) -> DataFrame:
    """Negatives of the graphs of a part of the split: in training drawn anew, elsewhere the stored ones, if there are any,
    whose ends lie in the graph."""
    if part != "train" and stored is not None:
        return within_nodes(stored.select(*GRAPH, "src", "dst"), dims)
    return within_nodes(mixed_negatives(positives, dims, **sampling), dims)


def in_split(graphs: DataFrame, split: DataFrame, part: str) -> DataFrame:
    return graphs.join(split.filter(F.col("split") == part).select("cell_id"), "cell_id", "left_semi")
