"""Contact lists: mapping, filters, merging, binning into symmetric matrices.

Everything is declared on DataFrames: filters reach the scan, dictionaries are joined by size, and the only shuffles
are the two sums (equal contacts, matrix entries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEX_CHROMS = ("chrX", "chrY")


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows with equal keys that with the highest position, as filling a dictionary would leave it."""
    names = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*names), position).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in names])


def numeric_counts(adj: DataFrame, count: str = "count") -> DataFrame:
    """Rows whose count is digits only, as a long."""
    return adj.filter(F.col(count).rlike("^[0-9]+$")).withColumn(count, F.col(count).cast("long"))


def map_fends(adj: DataFrame, fends: DataFrame) -> DataFrame:
    """Both ends by inner lookup in the fragment dictionary; unknown fragments drop the row."""
    one = fends.select(F.col("fend").alias("fend1"), F.col("chr").alias("chr1"), F.col("coord").cast("long").alias("coord1"))
    two = fends.select(F.col("fend").alias("fend2"), F.col("chr").alias("chr2"), F.col("coord").cast("long").alias("coord2"))
    return adj.join(one, "fend1").join(two, "fend2").drop("fend1", "fend2")


def cis_ordered(contacts: DataFrame, drop: tuple[str, ...] = SEX_CHROMS) -> DataFrame:
    """Without the dropped chromosomes, across-chromosome rows and self contacts; the smaller coordinate first."""
    kept = contacts.filter(~F.col("chr1").isin(*drop) & ~F.col("chr2").isin(*drop) & (F.col("chr1") == F.col("chr2")) & (F.col("coord1") != F.col("coord2")))
    return kept.withColumns({"coord1": F.least("coord1", "coord2"), "coord2": F.greatest("coord1", "coord2")})


def merge_duplicates(contacts: DataFrame, count: str = "count") -> DataFrame:
    return contacts.groupBy("cell_id", "chr1", "coord1", "chr2", "coord2").agg(F.sum(count).alias(count))


def filter_contacts(contacts: DataFrame, drop: tuple[str, ...] = SEX_CHROMS) -> DataFrame:
    return merge_duplicates(cis_ordered(contacts, drop))


def cell_totals(contacts: DataFrame, count: str = "count") -> DataFrame:
    return contacts.groupBy("cell_id").agg(F.sum(count).alias("total"))


def quality_cells(contacts: DataFrame, min_total: int = 2000, count: str = "count") -> DataFrame:
    """Rows of cells with at least min_total contacts; 0 lets all pass."""
    if min_total <= 0:
        return contacts
    good = cell_totals(contacts, count).filter(F.col("total") >= min_total).select("cell_id")
    return contacts.join(good, "cell_id", "left_semi")


def n_bins(size, bin_size: int, mode: str = "matrix"):
    """Bins of a chromosome: size // bin + 1 for matrices, the ceiling for sequence bins."""
    whole = F.floor(size / bin_size)
    return (whole + 1 if mode == "matrix" else F.ceil(size / bin_size)).cast("int")


def bin_contacts(contacts: DataFrame, sizes: DataFrame, bin_size: int, keep_diagonal: bool = True) -> DataFrame:
    """Symmetric entries (cell_id, chrom, i, j, v) with both triangles; a contact within a bin counts twice there.

    Contacts on unknown chromosomes or beyond the chromosome's bins are dropped.
    """
    binned = contacts.select("cell_id", F.col("chr1").alias("chrom"), F.floor(F.col("coord1") / bin_size).cast("int").alias("a"), F.floor(F.col("coord2") / bin_size).cast("int").alias("b"), "count")
    known = sizes.select("chrom", n_bins(F.col("size"), bin_size).alias("n_bins"))
    binned = binned.join(known, "chrom").filter((F.col("a") < F.col("n_bins")) & (F.col("b") < F.col("n_bins")))
    if not keep_diagonal:
        binned = binned.filter("a != b")
    # the upper triangle is summed first: half the rows are shuffled
    upper = binned.groupBy("cell_id", "chrom", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("count").alias("v"))
    return symmetric(upper)


def symmetric(upper: DataFrame) -> DataFrame:
    """(a <= b, v) to both triangles, the diagonal twice its value."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), (2 * F.col("v")).alias("v")))).otherwise(
        F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), F.col("v")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), F.col("v")))
    )
    return upper.select("cell_id", "chrom", F.explode(both).alias("e")).select("cell_id", "chrom", "e.i", "e.j", "e.v").filter("v != 0")


def symmetrize_pixels(pixels: DataFrame, drop: tuple[str, ...] = ("chrX", "chrY", "chrM")) -> DataFrame:
    """A pixel table (cell_id, chrom, bin1, bin2, count) to symmetric entries without diagonal."""
    kept = pixels.filter(~F.col("chrom").isin(*drop) & (F.col("bin1") != F.col("bin2")) & (F.col("count") != 0))
    ends = F.array(F.struct(F.col("bin1").alias("i"), F.col("bin2").alias("j")), F.struct(F.col("bin2").alias("i"), F.col("bin1").alias("j")))
    return kept.select("cell_id", "chrom", F.explode(ends).alias("e"), F.col("count").alias("v")).select("cell_id", "chrom", "e.i", "e.j", "v")


def without_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.filter("i != j and v != 0")


def dims(matrix: DataFrame, sizes: DataFrame, bin_size: int) -> DataFrame:
    """(cell_id, chrom, n_bins) of the matrices that have an entry."""
    return matrix.select("cell_id", "chrom").distinct().join(sizes.select("chrom", n_bins(F.col("size"), bin_size).alias("n_bins")), "chrom").select("cell_id", "chrom", "n_bins")


def matrix_shapes(matrix: DataFrame, dims: DataFrame) -> DataFrame:
    """n_rows, n_cols and stored entries of each matrix of dims (cell_id, chrom, n_bins), also of those without entries."""
    nnz = matrix.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("nnz"))
    return dims.join(nnz, ["cell_id", "chrom"], "left").select("cell_id", "chrom", F.col("n_bins").alias("n_rows"), F.col("n_bins").alias("n_cols"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


def inspect_matrix(matrix: DataFrame) -> DataFrame:
    """Stored entries, total and diagonal of each matrix."""
    return matrix.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("nnz"), F.sum("v").alias("total"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0)).alias("diagonal"))


def label_index(labels: DataFrame) -> DataFrame:
    """y: the place of the cell type among all sorted types of the table, also those that no cell keeps; the last row of a
    cell wins if `position` is given."""
    types = labels.select("cell_type").distinct().withColumn("y", F.row_number().over(W.orderBy("cell_type")) - 1)
    rows = last_wins(labels, "cell_id", "position") if "position" in labels.columns else labels
    return rows.join(types, "cell_type").select("cell_id", "cell_type", "y")


def label_counts(labels: DataFrame) -> DataFrame:
    """Cells of each type."""
    return labels.groupBy("cell_type").agg(F.countDistinct("cell_id").alias("n_cells"))


def embeddings_with_labels(embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    """Embeddings (cell_id, position, ...) that have a label, with cell_type and y, in the order of position; none is an
    error."""
    out = embeddings.join(label_index(labels), "cell_id")
    if out.isEmpty():
        raise ValueError("no embedding has a label: do the cells' names agree?")
    return out.orderBy("position")


def attach_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join with -1 and 'unknown' for cells without a label."""
    y = label_index(labels)
    return cells.join(y, "cell_id", "left").withColumns({"cell_type": F.coalesce("cell_type", F.lit("unknown")), "y": F.coalesce("y", F.lit(-1))})
