"""Node features: local degree profile, sequence bins, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.functions.columns import with_chr

PROFILE = ("deg", "nb_mean", "nb_min", "nb_max", "nb_std")


def node_degree(matrix: DataFrame) -> DataFrame:
    """Weighted degree of the nodes that have entries, the diagonal included."""
    return matrix.groupBy("cell_id", "chrom", F.col("i").alias("bin")).agg(F.sum("v").cast("double").alias("deg"))


def all_nodes(dims: DataFrame) -> DataFrame:
    return dims.select("cell_id", "chrom", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))


def ldp_raw(matrix: DataFrame, dims: DataFrame) -> DataFrame:
    """deg and mean, min, max, population std of the neighbours' degrees, unweighted; zeros for isolated nodes.

    The matrix is symmetric, so each node's degree goes along its own row to its neighbours: one scan and no join with itself.
    """
    key = ["cell_id", "chrom", "bin"]
    row = W.partitionBy("cell_id", "chrom", "i")
    # the genome bounds a matrix; laid out by matrix, neither rows nor columns are shuffled again
    sent = matrix.repartition("cell_id", "chrom").select("cell_id", "chrom", F.col("j").alias("bin"), "v", F.sum("v").over(row).cast("double").alias("nd"))
    prof = sent.groupBy(*key).agg(F.sum("v").cast("double").alias("deg"), F.avg("nd").alias("nb_mean"), F.min("nd").alias("nb_min"), F.max("nd").alias("nb_max"), F.stddev_pop("nd").alias("nb_std"))
    return all_nodes(dims).join(prof, key, "left").na.fill(0.0, list(PROFILE)).select(*key, *PROFILE)


def min_max(df: DataFrame, columns: tuple[str, ...] = PROFILE) -> DataFrame:
    """log1p, then scaled to 0..1 within each matrix over all its bins; a constant column becomes 0."""
    w = W.partitionBy("cell_id", "chrom")
    out = df.select("cell_id", "chrom", "bin", *[F.log1p(c).alias(c) for c in columns])
    low, high = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    scaled = lambda c: (F.col(c) - low(c)) / F.when(high(c) == low(c), 1.0).otherwise(high(c) - low(c))
    return out.select("cell_id", "chrom", "bin", *[scaled(c).alias(c) for c in columns])


def ldp(matrix: DataFrame, dims: DataFrame, normalize: bool = True) -> DataFrame:
    raw = ldp_raw(matrix, dims)
    return min_max(raw) if normalize else raw


def as_features(df: DataFrame, columns: tuple[str, ...] = PROFILE) -> DataFrame:
    return df.select("cell_id", "chrom", "bin", F.array(*[F.col(c).cast("float") for c in columns]).alias("feat"))


def dna_bins(sequences: DataFrame, bin_size: int) -> DataFrame:
    """Fixed-width slices of (chrom, sequence): bin from 1, the last one short."""
    n = F.length("sequence")
    k = F.explode(F.sequence(F.lit(0), F.ceil(n / bin_size).cast("int") - 1))
    rows = sequences.filter("length(sequence) > 0").select("chrom", "sequence", n.cast("long").alias("n"), k.alias("k"))
    start = F.col("k").cast("long") * bin_size
    return rows.select("chrom", (F.col("k") + 1).alias("bin"), F.substring(F.col("sequence"), (start + 1).cast("int"), F.lit(bin_size)).alias("sequence"), start.alias("start"), F.least(start + bin_size, F.col("n")).alias("end"))


def sequences_by_chrom(records: DataFrame, include: list[str] | None = None, exclude: tuple[str, ...] = ("chrX", "chrY", "chrM")) -> DataFrame:
    """chrom (chr prefix) and the sequences of its records (chrom, position, sequence) in the order of position, chromosomes
    in the order of their names."""
    named = records.select(with_chr(F.col("chrom")).alias("chrom"), "position", "sequence")
    plain = lambda names: [n if n.startswith("chr") else f"chr{n}" for n in names]
    named = named.filter(~F.col("chrom").isin(*plain(exclude))) if exclude else named
    named = named.filter(F.col("chrom").isin(*plain(include))) if include else named
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "sequence"))), lambda s: s["sequence"])
    return named.groupBy("chrom").agg(listed.alias("sequences")).orderBy("chrom")


def gc_content(bins: DataFrame) -> DataFrame:
    """Share of G and C among A, C, G, T; 0 without any."""
    letters = lambda s: F.length(F.col("sequence")) - F.length(F.translate("sequence", s, ""))
    base = letters("ACGTacgt")
    return bins.select("chrom", "bin", "start", "end", F.when(base > 0, letters("GCgc") / base).otherwise(0.0).alias("gc"))


def kmer_embedding(bins: DataFrame, k: int = 3) -> DataFrame:
    """An offline stand-in for a sequence model: relative frequencies of the 4**k k-mers in ACGT order."""
    import itertools

    kmers = ["".join(x) for x in itertools.product("ACGT", repeat=k)]
    counts = [F.regexp_count(F.upper("sequence"), F.lit(f"(?={m})")) for m in kmers]
    rows = bins.select("chrom", "bin", F.array(*counts).alias("c"))
    total = F.aggregate("c", F.lit(0), lambda a, x: a + x)
    return rows.select("chrom", "bin", F.transform("c", lambda x: (x / F.greatest(total, F.lit(1))).cast("float")).alias("emb"))


def sequence_embedding(bins: DataFrame, make_model, dim: int) -> DataFrame:
    """Embeds bins by a pluggable model: make_model() is called once in each worker and gives a function from a list
    of sequences to rows of `dim` numbers."""
    import pyarrow as pa

    def run(batches):
        model = make_model()
        for b in batches:
            rows = [[float(v) for v in r] for r in model(b.column(2).to_pylist())]
            if any(len(r) != dim for r in rows):
                raise ValueError(f"the model's rows have other than {dim} numbers")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float32()))], ["chrom", "bin", "emb"])

    return bins.select("chrom", F.col("bin").cast("int").alias("bin"), "sequence").mapInArrow(run, "chrom string, bin int, emb array<float>")


def token_embedding(bins: DataFrame, make_model, dim: int, pool: str = "last", max_tokens: int = 1 << 16) -> DataFrame:
    """Embeds bins by a model over tokens and takes the vector of the first or last token.

    make_model() is called once for a task and gives two functions: from a list of sequences to lists of token numbers, and from an
    array of token numbers (sequences x longest, filled with 0) and their lengths to vectors (sequences x longest x dim). Sequences are dealt
    out by length and then by hash, so that a task's are alike; of a task's batch the shortest go first, as many at once as have
    max_tokens tokens with their filling (one sequence may have more). What a sequence's vector is doesn't depend on its
    neighbours, if the model keeps filling apart. A sequence without tokens has zeros.
    """
    import numpy as np
    import pyarrow as pa

    if pool not in ("first", "last"):
        raise ValueError(f"pool is {pool!r}, neither 'first' nor 'last'")

    def run(batches):
        tokenize, forward = make_model()
        for b in batches:
            tokens = [list(t) for t in tokenize(b.column(2).to_pylist())]
            lengths = np.array([len(t) for t in tokens], int)
            out = np.zeros((len(tokens), dim), np.float32)
            order = np.argsort(lengths, kind="stable")
            order = order[lengths[order] > 0]
            while len(order):
                # sorted by length, so the last of a batch says how wide it is
                wide = lengths[order] * np.arange(1, len(order) + 1)
                n = max(1, int(np.searchsorted(wide, max_tokens, "right")))
                some, order = order[:n], order[n:]
                ids = np.zeros((n, lengths[some[-1]]), np.int64)
                for row, i in enumerate(some):
                    ids[row, : lengths[i]] = tokens[i]
                vectors = np.asarray(forward(ids, lengths[some]))
                if vectors.shape != (*ids.shape, dim):
                    raise ValueError(f"the model gives {vectors.shape} for {ids.shape} tokens, not {dim} numbers for each")
                out[some] = vectors[np.arange(n), 0 if pool == "first" else lengths[some] - 1]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], ["chrom", "bin", "emb"])

    rows = bins.select("chrom", F.col("bin").cast("int").alias("bin"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    rows = rows.repartitionByRange(F.length("sequence"), F.xxhash64("chrom", "bin"))
    return rows.mapInArrow(run, "chrom string, bin int, emb array<float>")


def merge_features(features: DataFrame, shared: DataFrame, first_bin: int = 0, strict: bool = True) -> DataFrame:
    """[feat, emb] for every node: features by (cell_id, chrom, bin), shared rows by (chrom, bin) for all cells.

    strict: a chromosome without shared rows, or with another number of bins, is an error.
    """
    emb = shared.select("chrom", (F.col("bin") - first_bin).alias("bin"), F.col("emb").alias("_e"))
    if strict:
        have = features.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n"))
        want = emb.groupBy("chrom").agg(F.count(F.lit(1)).alias("m"))
        odd = have.join(want, "chrom", "left").filter("m is null or m != n").limit(1).collect()
        if odd:
            raise ValueError(f"feature rows of {odd[0]['chrom']}: {odd[0]['n']} and {odd[0]['m']}")
    return features.join(emb, ["chrom", "bin"]).select("cell_id", "chrom", "bin", F.concat("feat", "_e").alias("feat"))


def checked_features(features: DataFrame, shared: DataFrame, first_bin: int = 0) -> DataFrame:
    """merge_features whose check is a part of the plan: no job of its own and no further scan, and whatever writes the result fails,
    naming cell and chromosome, where a chromosome has no shared rows or another number of bins, or a bin has none or two."""
    emb = shared.select("chrom", (F.col("bin") - first_bin).alias("bin"), F.col("emb").alias("_e"))
    emb = emb.withColumn("_m", F.count(F.lit(1)).over(W.partitionBy("chrom")))
    own = features.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("cell_id", "chrom")))
    joined = own.join(emb, ["chrom", "bin"], "left").withColumn("_again", F.count(F.lit(1)).over(W.partitionBy("cell_id", "chrom", "bin")))
    where = F.concat_ws(" ", F.lit("features of"), "cell_id", "chrom")
    what = F.when(F.col("_m").isNull(), F.concat(F.lit("no shared row for bin "), F.col("bin").cast("string"))).when(F.col("_m") != F.col("_n"), F.concat(F.col("_n").cast("string"), F.lit(" rows, "), F.col("_m").cast("string"), F.lit(" shared ones"))).when(F.col("_again") > 1, F.concat(F.lit("more than one row of bin "), F.col("bin").cast("string")))
    feat = F.when(what.isNotNull(), F.raise_error(F.concat(where, F.lit(": "), what)).cast(features.schema["feat"].dataType)).otherwise(F.concat("feat", "_e"))
    return joined.select("cell_id", "chrom", "bin", feat.alias("feat"))


def spread(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """Elements of an array column as columns."""
    return df.select(*[c for c in df.columns if c != array], *[F.element_at(array, i + 1).alias(n) for i, n in enumerate(names)])


def vector(c: Column) -> Column:
    """A scalar as a vector of one element."""
    return F.array(c)
