"""Vector compression by product codes: Elkan's form of Lloyd's iteration on each part of the vectors.

Components become integers floor(4096 x); a vector is cut into `parts` equal consecutive parts, and each part position has
a codebook of its own. A round is one pass over a stored table whose rows keep, for every part, its entry, an upper bound
of the distance to it and one lower bound for each entry of the codebook. Before a pass bounds are shifted by how far
entries have moved. An entry is passed over only if it is strictly farther: the upper bound is below its lower bound, or
twice the upper bound is below its distance from the present entry. Bounds are whole numbers, upper ones rounded up and
lower ones down, so nothing hangs on floating point; what they do not settle is computed in integers, ties going to the lower index. Every
task adds one row with its sums, so a round reads the table once; codebooks are the only thing that comes to the driver, and their size
is fixed by the parameters. The table of each round is written to the shared folder, so a lost executor costs its tasks of one round.

Vectors that are null or hold null or non-finite components are dropped, and so are those of another length than that with the smallest
identifier. A length that the parts do not divide is filled with zeros. Entries start from the rows with the smallest identifiers,
null ones last, equal ones in the order of their vectors; where there are fewer rows, codebooks are shorter. Repeated rows
each count and each return. An empty table gives no rows. Components too large for 64-bit distances are an error. Null labels
are one label. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalith.llm._store import release, settings, stored
from chromalith.llm._text import give_back

SCALE = 4096
FAR = np.int64(1) << np.int64(60)


@dataclass
class Codes:
    """rows: id, label, code (array<int>), error, tried (distances computed); books: part, entry, component."""

    rows: DataFrame
    books: np.ndarray


def root(d: np.ndarray) -> np.ndarray:
    """The whole part of the square root, exact."""
    s = np.sqrt(d.astype(np.float64)).astype(np.int64)
    s -= s * s > d
    s += (s + 1) * (s + 1) <= d
    return s


def root_up(d: np.ndarray) -> np.ndarray:
    s = root(d)
    return s + (s * s < d)


def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, exact: bool = False) -> tuple[int, np.ndarray | None]:
    """Move parts x (n, width) to their nearest entries, in place. Returns the number of distances computed and, if exact, the
    squared distances to the entries."""
    between = root(square(book[:, None], book[None]))
    k = len(book)
    nearest = (between + np.eye(k, dtype=np.int64) * FAR).min(1) if k > 1 else np.array([FAR])
    at = np.flatnonzero(2 * upper >= nearest[code])
    a, xs = code[at], x[at]
    best = square(xs, book[a])
    u, tried = root_up(best), len(at)
    lower[at, a] = root(best)
    for c in range(k):
        open_ = np.flatnonzero((a != c) & (u >= lower[at, c]) & (2 * u >= between[a, c]))
        if not len(open_):
            continue
        d = square(xs[open_], book[c])
        tried += len(open_)
        lower[at[open_], c] = root(d)
        win = (d < best[open_]) | ((d == best[open_]) & (c < a[open_]))
        to = open_[win]
        a[to], best[to], u[to] = c, d[win], root_up(d[win])
    code[at], upper[at] = a, u
    return tried, square(x, book[code]) if exact else None


def integers(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(id, label, x) of the vectors that are kept, x being array<bigint> filled up to a multiple of parts; and the part's width."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & finite)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    n = first[0] if first else 0
    width = -(-n // parts)
    most = math.isqrt((1 << 61) // (4 * max(1, width)))
    whole = lambda c: F.floor(c.cast("double") * scale)
    fits = F.forall("v", lambda c: F.abs(c.cast("double") * scale) <= most)
    x = F.concat(F.transform("v", whole), F.array_repeat(F.lit(0).cast("bigint"), width * parts - n))
    x = F.when(fits, x).otherwise(F.raise_error(F.lit(f"a component times {scale} exceeds {most}")).cast("array<bigint>"))
    return rows.filter(F.size("v") == n).select("id", "label", x.alias("x")), width


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, exact: bool) -> DataFrame:
    """One pass. moved: how far each entry has moved since the bounds were made, rounded up; None at the start."""
    parts, k, width = books.shape
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = f"id {kinds['id']}, label {kinds['label']}, x array<bigint>, code array<int>, upper array<bigint>, lower array<bigint>, tried bigint, error bigint, sums array<bigint>"
    lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * (a[0].size if len(a) else 0)), pa.array(a.ravel(), kind))

    def run(batches):
        sums = np.zeros((parts, k, width + 1), np.int64)
        types, seen = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            flat = lambda name, size: b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, size)  # noqa: B023, E731
            x = flat("x", parts * width).reshape(n, parts, width)
            if moved is None:
                code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), FAR // 4), np.zeros((n, parts, k), np.int64)
                tried = np.zeros(n, np.int64)
            else:
                code, upper, lower = flat("code", parts).astype(np.int64), flat("upper", parts).copy(), flat("lower", parts * k).reshape(n, parts, k).copy()
                tried = b.column("tried").to_numpy(zero_copy_only=False).copy()
                upper += moved[np.arange(parts), code]
                lower = np.maximum(lower - moved, 0)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                count, d = assign(x[:, p], code[:, p], upper[:, p], lower[:, p], books[p], exact)
                tried[0] += count  # of the batch, kept with its first row
                error += d if exact else 0
                np.add.at(sums[p, :, :width], code[:, p], x[:, p])
                sums[p, :, width] += np.bincount(code[:, p], minlength=k)
            types, seen = (b.column("id").type, b.column("label").type), seen + n
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("x"), lists(code, pa.int32()), lists(upper, pa.int64()), lists(lower.reshape(n, -1), pa.int64()), pa.array(tried), pa.array(error), none],
                ["id", "label", "x", "code", "upper", "lower", "tried", "error", "sums"],
            )
        if seen:
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, types[0]), pa.nulls(1, types[1]), pa.nulls(1, long), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, long), pa.nulls(1, long), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), lists(sums.reshape(1, -1), pa.int64())],
                ["id", "label", "x", "code", "upper", "lower", "tried", "error", "sums"],
            )
        give_back()

    with settings(state.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="4096", spark__sql__execution__arrow__maxBytesPerBatch="16m"):
        return stored(state.mapInArrow(run, schema), "codes-round")


def _updated(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """Entries at the floors of their parts' means; unused ones stay."""
    parts, k, width = books.shape
    got = state.filter("sums is not null").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(parts * k * (width + 1), np.int64)
    for r in got:
        sums[r["at"]] = r["s"]
    sums = sums.reshape(books.shape[0], k, width + 1)
    n = sums[..., width:]
    return np.where(n > 0, sums[..., :width] // np.maximum(n, 1), books)


def encode(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> Codes:
    """Codes of all vectors by codebooks of `entries` entries after `rounds` rounds; the rows are a stored table."""
    state, width = integers(vectors, id_col, label_col, vector_col, parts, scale)
    start = [r["x"] for r in state.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    if not start:
        kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
        return Codes(state.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code array<int>, error bigint, tried bigint"), books)
    moved = before = None
    for n in range(rounds + 1):
        state = _round(state, books, moved, exact=n == rounds)
        if before is not None:
            release(before)
        if n < rounds:
            new = _updated(books, state)
            moved, books = root_up(square(new, books)), new
        before, state = state, state.filter("sums is null").select("id", "label", "x", "code", "upper", "lower", "tried", "error")
    return Codes(state.select("id", "label", "code", "error", "tried"), books)


def hex_code(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", **how) -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 for every vector that is kept. Errors are summed by label once and
    handed back by a join of their size."""
    found = encode(vectors, id_col, label_col, vector_col, **how)
    by_label = stored(found.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    rows = found.rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return rows.select(F.col("id").alias(id_col), hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(books_digest(found.books)).alias("codebooks_sha256"))


def code_table_sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8, scale: int = SCALE) -> str:
    """The plain iteration over the view `embeddings`: every part against every entry of its codebook, in every round."""
    dist = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, width + 1))
    mean = ", ".join(f"((sum(x[{i}]) - ((sum(x[{i}]) % count(*) + count(*)) % count(*))) // count(*))::bigint" for i in range(1, width + 1))
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} as materialized (select r, p, any_value(x) as x, arg_min(e, (d, e)) as e, min(d) as d from (select r, parts.p, e, x, {dist} as d from parts join b{n} on parts.p = b{n}.p) group by r, p)")
        if n < rounds:
            steps.append(f"b{n + 1} as materialized (select b{n}.p, b{n}.e, coalesce(m, c) as c from b{n} left join (select p, e, [{mean}] as m from a{n} group by p, e) u on b{n}.p = u.p and b{n}.e = u.e)")
    return f"""
        with kept as materialized (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        parts as materialized (select r, vec_id, p, v[p * {width} + 1:p * {width} + {width}] as x from (select *, unnest(range(0, {parts})) as p from kept)),
        b0 as materialized (select p, e, x as c from (select p, x, row_number() over (partition by p order by vec_id, r) - 1 as e from parts) where e < {entries}),
        {", ".join(steps)},
        s as (select r, string_agg(printf('%02x', e::int), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by r),
        l as (select label, sum(error)::bigint as label_error from s join kept using (r) group by label),
        g as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})
        select vec_id, code, error, label_error, codebooks_sha256 from s join kept using (r) join l on kept.label is not distinct from l.label, g"""
