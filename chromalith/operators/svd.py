"""Singular vectors of sparse matrices by a randomised range finder with power iterations.

The matrices are one for each chromosome, cells by features, given by their entries. A pass multiplies by the transpose and by the
matrix, both as sums of vectors of a fixed width: entries meet the cells' vectors in blocks of cells, then the features' vectors in blocks of
features, and every block's memory is bounded by its number of entries. Cells' vectors are made orthonormal by QR of small blocks: each block gives its
triangle, triangles are stacked and factored again. What reaches the driver are triangles and squares of the width, some for each chromosome;
nothing has the size of cells by cells or of features by features.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalith.functions.vectors import FAN, dropped, lists, numbers, tree_sum, written

WIDTH = 64
BLOCK = 500_000
CHUNK = 1 << 15
ROWS = "chrom string, kind string, cell_id string, y array<double>"


def _signs(f: np.ndarray, seed: int) -> np.ndarray:
    """A row of WIDTH random signs for each feature: the bits of a hash of it."""
    h = f.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    h ^= h >> np.uint64(31)
    return ((h[:, None] >> np.arange(WIDTH, dtype=np.uint64)) & np.uint64(1)).astype(float) * 2 - 1


def _sums(at: np.ndarray, n: int, rows, width: int) -> np.ndarray:
    """Sums by place of what rows(a, b) gives for the entries a..b, a chunk at a time."""
    out = np.zeros((n, width))
    for a in range(0, len(at), CHUNK):
        np.add.at(out, at[a : a + CHUNK], rows(a, a + CHUNK))
    return out


def _found(names: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and where each row's is."""
    return np.unique(np.asarray(names.to_pylist(), object) if pa.types.is_string(names.type) else names.to_numpy(), return_inverse=True)


def _table(chrom: str, kind: str, cells, y: np.ndarray) -> pa.Table:
    n = len(y)
    return pa.table({"chrom": pa.array([chrom] * n, pa.string()), "kind": pa.array([kind] * n, pa.string()), "cell_id": pa.array(list(cells), pa.string()), "y": lists(y)})


def _settled(parts: DataFrame, blocks: int) -> DataFrame:
    """Of partial rows (chrom, kind, cell_id, y): the sums by cell, the triangle of each block of cells, and the sum of the squares."""

    def add(t: pa.Table) -> pa.Table:
        chrom, kind, y = t["chrom"][0].as_py(), t["kind"][0].as_py(), numbers(t["y"])
        if kind == "t":
            return _table(chrom, "t", [None], y.sum(0)[None])
        cells, at = _found(t["cell_id"])
        total = _sums(at, len(cells), lambda a, b: y[a:b], y.shape[1])
        return pa.concat_tables([_table(chrom, "y", cells, total), _table(chrom, "r", [None], np.linalg.qr(total, "r").ravel()[None])])

    block = F.when(F.col("kind") == "t", -1).otherwise(F.pmod(F.xxhash64("cell_id"), F.lit(blocks)))
    return parts.groupBy("chrom", "kind", block.alias("_b")).applyInArrow(lambda t: add(t), ROWS)


def _small(table: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """For each chromosome the triangle of all cells' vectors, and the features' square, if the table has one."""

    def stack(t: pa.Table) -> pa.Table:
        chrom, kind, y = t["chrom"][0].as_py(), t["kind"][0].as_py(), [v for v in t["y"].to_pylist()]
        if kind == "t":
            return _table(chrom, "t", [None], np.array(y).sum(0)[None])
        # a block of fewer rows than columns has a short triangle
        return _table(chrom, "r", [None], np.linalg.qr(np.concatenate([np.array(v).reshape(-1, WIDTH) for v in y]), "r").ravel()[None])

    some = table.filter("kind != 'y'").withColumn("_part", F.pmod(F.xxhash64("y"), F.lit(FAN)))
    rows = some.groupBy("chrom", "kind", "_part").applyInArrow(lambda t: stack(t), ROWS).collect()
    triangles: dict[str, list] = {}
    squares: dict[str, np.ndarray] = {}
    for r in rows:
        if r["kind"] == "t":
            squares[r["chrom"]] = squares.get(r["chrom"], 0) + np.array(r["y"]).reshape(int(math.isqrt(len(r["y"]))), -1)
        else:
            triangles.setdefault(r["chrom"], []).append(np.array(r["y"]).reshape(-1, WIDTH))
    return {c: np.linalg.qr(np.concatenate(v), "r") for c, v in triangles.items()}, squares


def _turn(triangle: np.ndarray) -> np.ndarray:
    """What makes vectors with this triangle orthonormal; directions that they do not have are left out."""
    _, s, v = np.linalg.svd(triangle)
    keep = s > 1e-12 * max(s[0], 1e-300)
    return v[: len(s)][keep].T / s[keep]


def _features(turns: dict[str, np.ndarray]):
    """A block's share of the transposed product, its cells' vectors turned into orthonormal ones."""

    def share(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        if not rows.num_rows or not vectors.num_rows:
            return pa.table({"chrom": pa.array([], pa.string()), "f": pa.array([], pa.int64()), "z": pa.array([], pa.list_(pa.float64()))})
        chrom = rows["chrom"][0].as_py()
        q = numbers(vectors["y"]) @ turns[chrom]
        place = {c: k for k, c in enumerate(vectors["cell_id"].to_pylist())}
        of, v = np.array([place[c] for c in rows["cell_id"].to_pylist()]), rows["v"].to_numpy()
        f, at = _found(rows["f"])
        z = np.zeros((len(f), WIDTH))
        z[:, : q.shape[1]] = _sums(at, len(f), lambda a, b: v[a:b, None] * q[of[a:b]], q.shape[1])
        return pa.table({"chrom": pa.array([chrom] * len(f), pa.string()), "f": pa.array(f), "z": lists(z)})

    return lambda rows, vectors: share(rows, vectors)


def _cells(rows: pa.Table, vectors: pa.Table) -> pa.Table:
    """A block's share of the product with its features' sums, and of the square of these."""
    if not rows.num_rows or not vectors.num_rows:
        return _table("", "y", [], np.zeros((0, WIDTH)))
    chrom = rows["chrom"][0].as_py()
    f, at = _found(vectors["f"])
    part = numbers(vectors["z"])
    z = _sums(at, len(f), lambda a, b: part[a:b], WIDTH)
    of, v = np.searchsorted(f, rows["f"].to_numpy()), rows["v"].to_numpy()
    names, at = _found(rows["cell_id"])
    y = _sums(at, len(names), lambda a, b: v[a:b, None] * z[of[a:b]], WIDTH)
    return pa.concat_tables([_table(chrom, "y", names, y), _table(chrom, "t", [None], (z.T @ z).ravel()[None])])


def left_vectors(entries: DataFrame, rank: int, tolerance: float = 1e-10, rounds: int = 30, seed: int = 0) -> DataFrame:
    """(chrom, cell_id, u): the `rank` leading left singular vectors of each chromosome's matrix, fewer where it has fewer, of entries
    (cell_id, chrom, i, j, v). Rounds go on until no value changes by more than tolerance."""
    if rank > WIDTH:
        raise ValueError(f"at most {WIDTH} vectors a chromosome")
    x = written(entries.select("chrom", "cell_id", F.shiftleft(F.col("i").cast("bigint"), 32).bitwiseOR(F.col("j").cast("bigint")).alias("f"), F.col("v").cast("double").alias("v")), "svd-entries")
    sizes = x.groupBy("chrom").count().collect()
    blocks = max(1, math.ceil(max((r["count"] for r in sizes), default=0) / BLOCK))
    by_cell = x.withColumn("_b", F.pmod(F.xxhash64("cell_id"), F.lit(blocks)))
    by_feature = x.withColumn("_b", F.pmod(F.xxhash64("f"), F.lit(blocks)))

    def start(t: pa.Table) -> pa.Table:
        f, v = t["f"].to_numpy(), t["v"].to_numpy()
        cells, at = _found(t["cell_id"])
        return _table(t["chrom"][0].as_py(), "y", cells, _sums(at, len(cells), lambda a, b: v[a:b, None] * _signs(f[a:b], seed), WIDTH))

    table = written(_settled(by_cell.groupBy("chrom", "_b").applyInArrow(lambda t: start(t), ROWS), blocks), "svd-y")
    triangles, _ = _small(table)
    values: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        turns = {c: _turn(r) for c, r in triangles.items()}

        own = table.filter("kind = 'y'").withColumn("_b", F.pmod(F.xxhash64("cell_id"), F.lit(blocks)))
        z = by_cell.groupBy("chrom", "_b").cogroup(own.groupBy("chrom", "_b")).applyInArrow(_features(turns), "chrom string, f bigint, z array<double>")
        z = z.withColumn("_b", F.pmod(F.xxhash64("f"), F.lit(blocks)))
        y = by_feature.groupBy("chrom", "_b").cogroup(z.groupBy("chrom", "_b")).applyInArrow(lambda rows, vectors: _cells(rows, vectors), ROWS)
        further = written(_settled(y, blocks), "svd-y")
        triangles, squares = _small(further)
        before, values, vectors = values, {}, {}
        for c, t in squares.items():
            n = turns[c].shape[1]
            low, axes = np.linalg.eigh(t[:n, :n])
            values[c], vectors[c] = low[::-1], turns[c] @ axes[:, ::-1]
        near = lambda a, b: len(a) == len(b) and np.abs(a - b)[:rank].max(initial=0) <= tolerance * max(a[0], 1e-300)
        # all directions that there are have been found, or the values stand
        if all(turns[c].shape[1] < WIDTH or (c in before and near(before[c], values[c])) for c in values):
            dropped(further)
            break
        dropped(table)
        table = further
    chosen = {c: vectors[c][:, :rank][:, values[c][:rank] > 1e-9 * max(values[c][0], 1e-300)] for c in values}

    def turned(batches):
        for b in batches:
            chrom = b.column("chrom").to_pylist()
            y = numbers(b.column("y"))
            yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("cell_id"), pa.array([(v @ chosen[c]).tolist() for c, v in zip(chrom, y, strict=True)], pa.list_(pa.float64()))], ["chrom", "cell_id", "u"])

    out = written(table.filter("kind = 'y'").select("chrom", "cell_id", "y").mapInArrow(turned, "chrom string, cell_id string, u array<double>"), "svd-u")
    dropped(table)
    dropped(x)
    return out


def cell_embedding(features: DataFrame, dim_chrom: int = 50, dim: int = 50) -> DataFrame:
    """(cell_id, emb): the left vectors of all chromosomes side by side, zeros where a cell lacks one, times the leading right
    vectors of that table. The square that gives these has the chromosomes' vectors as its sides, whatever the number of cells; of each
    column the largest entry is positive."""
    n_cells = features.select("cell_id").distinct().count()
    u = left_vectors(features, max(1, min(dim_chrom, n_cells - 1)))
    width = {r["chrom"]: r["n"] for r in u.groupBy("chrom").agg(F.max(F.size("u")).alias("n")).collect()}
    at, total = {}, 0
    for c in sorted(width):
        at[c], total = total, total + width[c]
    if not total:
        raise ValueError("no chromosome has usable features")
    n = max(1, min(dim, n_cells - 1, total - 1))

    def row(parts: pa.Table) -> np.ndarray:
        x = np.zeros(total)
        for c, v in zip(parts["chrom"].to_pylist(), parts["u"].to_pylist(), strict=True):
            x[at[c] : at[c] + len(v)] = v
        return x

    x = u.groupBy("cell_id").applyInArrow(lambda t: pa.table({"cell_id": t["cell_id"][:1], "x": lists(row(t)[None])}), "cell_id string, x array<double>")
    x = written(x, "svd-x")

    def squares(batches):
        for b in batches:
            v = numbers(b.column(0))
            yield pa.RecordBatch.from_arrays([lists((v.T @ v).ravel()[None])], ["s"])

    square = np.array(tree_sum(x.select("x").mapInArrow(squares, "s array<double>")).first()["s"]).reshape(total, total)
    axes = np.linalg.eigh(square)[1][:, ::-1][:, :n]

    def project(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), lists(numbers(b.column("x")) @ axes)], ["cell_id", "emb"])

    out = written(x.mapInArrow(project, "cell_id string, emb array<double>"), "svd-emb")
    dropped(x)
    dropped(u)
    tops = out.select(F.posexplode("emb").alias("k", "v")).groupBy("k").agg(F.max_by("v", F.struct(F.abs("v"), "v")).alias("v")).collect()
    signs = F.array(*[F.lit(-1.0 if r["v"] < 0 else 1.0) for r in sorted(tops, key=lambda r: r["k"])])
    return out.select("cell_id", F.zip_with("emb", signs, lambda a, b: a * b).alias("emb"))
