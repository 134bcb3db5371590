"""Contact matrices from npz archives as a data source: a partition for each matrix, of which only its members are opened.

    register(spark)
    spark.read.format("contact_npz").load("hdfs://.../cells")

A matrix is a dense array `<chrom>`, or parts `<chrom>__data` with `__indices` and `__indptr` (rows, or columns if `__format` says csc) or
with `__row` and `__col`; `__shape` may be absent. Filters on cell_id and chrom are pushed to the names of archives and members; they
can also be given as the options `cells` and `chroms`. register() turns on the session setting that hands filters to Python sources. Files are opened by
Arrow's file systems, so a path can be in any store that these know. Arrays of objects are refused.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from chromalith import schemas

ROWS = 1 << 20


@dataclass
class Matrix(InputPartition):
    path: str
    cell: str
    chrom: str
    members: tuple[str, ...]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _archives(path: str) -> list[str]:
    """The archive itself, or those in a folder, in the form that _store reads."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.path.endswith(".npz"))
    return [f"{path.rstrip('/')}/{n.rsplit('/', 1)[-1]}" for n in names]


def _opened(path: str) -> zipfile.ZipFile:
    store, at = _store(path)
    return zipfile.ZipFile(store.open_input_file(at))


def _members(path: str) -> dict[str, tuple[str, ...]]:
    """Chromosome to its members, by the archive's directory alone."""
    with _opened(path) as z:
        names = [n.removesuffix(".npy") for n in z.namelist()]
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(n.partition("__")[0], []).append(n)
    return {c: tuple(sorted(m)) for c, m in out.items()}


def entries(parts: dict[str, np.ndarray], chrom: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of a matrix in any of its encodings; of a dense one the entries that are not 0."""
    if chrom in parts:
        a = parts[chrom]
        if a.ndim != 2:
            raise ValueError(f"{chrom} has {a.ndim} dimensions")
        i, j = np.nonzero(a)
        return i, j, a[i, j]
    get = lambda name: parts.get(f"{chrom}__{name}")
    data, kind = get("data"), get("format")
    if data is None:
        raise ValueError(f"{chrom} has no data among {sorted(parts)}")
    kind = "" if kind is None else (lambda v: v.decode() if isinstance(v, bytes) else str(v))(kind.item())
    if get("indptr") is not None and get("indices") is not None and kind in ("", "csr", "csc"):
        ptr = get("indptr")
        long, short = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), get("indices")
        return (short, long, data) if kind == "csc" else (long, short, data)
    if get("row") is not None and get("col") is not None and kind in ("", "coo"):
        return get("row"), get("col"), data
    raise ValueError(f"{chrom} is in no known encoding: {kind or 'no format'}, {sorted(parts)}")


class Reader(DataSourceReader):
    def __init__(self, path: str, cells: set[str] | None, chroms: set[str] | None):
        self.path, self.cells, self.chroms = path, cells, chroms

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("cell_id", "chrom"):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = "cells" if name == "cell_id" else "chroms"
                now = getattr(self, held)
                setattr(self, held, wanted if now is None else now & wanted)
            else:
                yield f

    def partitions(self) -> list[Matrix]:
        cell = lambda p: p.rsplit("/", 1)[-1].removesuffix(".npz")
        files = [p for p in _archives(self.path) if self.cells is None or cell(p) in self.cells]
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(_members, files))
        out = [Matrix(p, cell(p), c, m) for p, by in zip(files, found, strict=True) for c, m in by.items() if self.chroms is None or c in self.chroms]
        return out or [Matrix("", "", "", ())]

    def read(self, partition: Matrix) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _opened(partition.path) as z:
            parts = {n: np.lib.format.read_array(io.BytesIO(z.read(f"{n}.npy")), allow_pickle=False) for n in partition.members}
        i, j, v = entries(parts, partition.chrom)
        if not len(i) == len(j) == len(v):
            raise ValueError(f"{partition.path}, {partition.chrom}: {len(i)} rows, {len(j)} columns, {len(v)} values")
        for a in range(0, len(i), ROWS):
            n = len(i[a : a + ROWS])
            columns = [pa.array([partition.cell] * n), pa.array([partition.chrom] * n), pa.array(i[a : a + ROWS].astype(np.int32)), pa.array(j[a : a + ROWS].astype(np.int32)), pa.array(v[a : a + ROWS].astype(float))]
            yield pa.RecordBatch.from_arrays(columns, ["cell_id", "chrom", "i", "j", "v"])


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contact_npz"

    def schema(self) -> str:
        return schemas.MATRIX

    def reader(self, schema) -> Reader:
        named = lambda o: {x.strip() for x in self.options[o].split(",")} if self.options.get(o) else None
        return Reader(self.options["path"], named("cells"), named("chroms"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
