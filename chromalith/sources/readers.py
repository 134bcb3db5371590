"""Readers of the text and array formats; keys come from file names as columns. All are DataFrame readers, none collects."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith import schemas
from chromalith.functions.columns import cell_name, with_chr
from chromalith.operators.contacts import label_index
from chromalith.sources.archives import entries

PATH = "_metadata.file_path"


def fends(spark: SparkSession, path: str) -> DataFrame:
    """fend, chr, coord without header; the last line of a fragment wins."""
    raw = spark.read.csv(path, sep="\t", schema="fend string, chr string, coord string", nullValue="\u0000", emptyValue="")
    lines = raw.select("fend", with_chr(F.col("chr")).alias("chr"), F.col("coord").cast("long").alias("coord"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    return lines.groupBy("fend").agg(F.max_by(F.struct("chr", "coord"), "at").alias("r")).select("fend", "r.chr", "r.coord")


def raw_contacts(spark: SparkSession, pattern: str) -> DataFrame:
    """`<base>/<cell>/adj` files with a header; empty strings stay. cell_id is the folder."""
    df = spark.read.csv(pattern, sep="\t", header=True, nullValue="\u0000", emptyValue="", inferSchema=False)
    return df.select(F.regexp_extract(F.col(PATH), r"([^/]+)/[^/]+$", 1).alias("cell_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("fend1", "fend2", "count")])


def mcool_cell_id(name: Column) -> Column:
    """The fourth to sixth parts of a name, split at underscores; fewer parts are an error."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 6, F.array_join(F.slice(parts, 4, 3), "_")).otherwise(F.raise_error(F.concat(F.lit("fewer than six parts: "), name)))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """A pixel table (cell_id, chrom, bin1, bin2, count) in Parquet, standing in for multi-resolution files."""
    return spark.read.parquet(path)


def chrom_sizes(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, prefix: bool = True, lax: bool = False) -> DataFrame:
    """chrom and size from blank-separated lines; comments, short lines and sizes that are no integers are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter((F.trim("value") != "") & (F.lit(lax) | ~F.ltrim("value").startswith("#"))).select(parts.alias("p")).filter("size(p) >= 2")
    chrom = F.col("p")[0]
    out = rows.select((chrom if lax or not prefix else with_chr(chrom)).alias("chrom"), F.expr("try_cast(p[1] as bigint)").alias("size")).filter("size is not null")
    if include:
        out = out.filter(F.col("chrom").isin(include))
    if exclude:
        out = out.filter(~F.col("chrom").isin(exclude))
    return out


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom (chr prefix) and the upper-case sequence of every record; a record is what follows a `>` line."""
    rows = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return rows.select(with_chr(head).alias("chrom"), F.upper(body).alias("sequence"))


def pick_chroms(sequences: DataFrame, names: list[str]) -> DataFrame:
    """The sequences (chrom with prefix) of the named chromosomes, `1` and `chr1` naming the same; an unknown one is an error."""
    asked = sequences.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string").select("asked", with_chr(F.col("asked")).alias("chrom"))
    found = asked.join(sequences, "chrom", "left")
    lost = F.raise_error(F.concat(F.lit("no sequence of "), F.col("asked")))
    return found.select(F.when(F.col("sequence").isNull(), lost).otherwise(F.col("chrom")).alias("chrom"), "sequence")


def dna_bin_json(spark: SparkSession, path: str) -> DataFrame:
    """Bin records: files of one JSON array each, in one line or many, or of one record a line."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    records = spark.read.option("mode", "FAILFAST").schema(schemas.DNA_BINS)
    return records.option("multiLine", first is not None and first[0] == "[").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File names, one a line, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("file")).filter("file != '' and not startswith(file, '#')")


def graph_files(spark: SparkSession, present: DataFrame, names: DataFrame | None = None, manifest_path: str | None = None) -> DataFrame:
    """The files to use, sorted: those of a list or of a manifest (not both), else the graph files that are present. One that
    isn't present, or none at all, is an error."""
    if names is not None and manifest_path is not None:
        raise ValueError("a list of files and a manifest exclude each other")
    wanted = names if names is not None else manifest(spark, manifest_path) if manifest_path else present.filter(F.endswith("file", F.lit(".pt")))
    wanted = wanted.select("file")
    if wanted.isEmpty():
        raise ValueError("no graph files are found or selected")
    lost = [r[0] for r in missing_files(wanted, present).orderBy("file").limit(5).collect()]
    if lost:
        raise FileNotFoundError(f"missing files, for example {lost}")
    return wanted.orderBy("file")


def missing_files(names: DataFrame, present: DataFrame) -> DataFrame:
    return names.join(present, "file", "left_anti")


def labels(spark: SparkSession, path: str, cell_col: str = "cell_id") -> DataFrame:
    """cell_id, cell_type, y. cell_col: the older tables' names of the key (file_name, cell_nm)."""
    df = spark.read.csv(path, sep="\t", header=True)
    lost = {cell_col, "cell_type"} - set(df.columns)
    if lost:
        raise ValueError(f"label table without {sorted(lost)}")
    return label_index(df.select(F.col(cell_col).alias("cell_id"), "cell_type", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("position")))


def _split_lines(spark: SparkSession, path: str, pattern: str = r"\s+|,") -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), pattern).alias("p"))


def reference_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """Six columns without header; another number is an error."""
    names = ["chrom1", "x1", "x2", "chrom2", "y1", "y2"]
    rows = _split_lines(spark, path, r"\s+")
    ok = F.when(F.size("p") == 6, F.col("p")).otherwise(F.raise_error(F.lit("a reference loop has other than six columns")))
    rows = rows.select(ok.alias("p"))
    return rows.select(*[(F.col("p")[i] if n.startswith("chrom") else F.col("p")[i].cast("long")).alias(n) for i, n in enumerate(names)])


def _headed(spark: SparkSession, path: str, need: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows with fields p, header h and file, headers) of text files parted by blanks or commas; the line that has all names
    of `need` is a file's header, and a file without one is an error."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+|,").alias("p"), F.col(PATH).alias("file"))
    head = F.forall(F.array(*[F.lit(n) for n in need]), lambda n: F.array_contains("p", n))
    heads = rows.filter(head).groupBy("file").agg(F.first("p").alias("h"))
    lost = F.raise_error(F.concat(F.lit(f"columns {', '.join(need)} are missing in "), F.col("file")))
    rows = rows.filter(~head).join(heads, "file", "left").select("file", "p", F.when(F.col("h").isNull(), lost).otherwise(F.col("h")).alias("h"))
    return rows, heads


def _field(name: str) -> Column:
    return F.get("p", (F.array_position("h", name) - 1).cast("int"))


def predicted_loops(spark: SparkSession, path: str, ignore: tuple[str, ...] = ("f1", "score", "metric")) -> DataFrame:
    """Predictions with a header, parted by blanks or commas, from files whose names have none of the ignored words; cell_id is
    the file's stem."""
    names = ("chrom1", "x1", "x2", "chrom2", "y1", "y2")
    rows, _ = _headed(spark, path, names)
    rows = rows.withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1))
    for word in ignore:
        rows = rows.filter(~F.lower("name").contains(word))
    return rows.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("cell_id"), *[(_field(n) if n.startswith("chrom") else _field(n).cast("long")).alias(n) for n in names])


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end of a BED file; further columns are ignored."""
    return _split_lines(spark, path, r"\t").select(F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("start"), F.col("p")[2].cast("long").alias("end"))


def gc_table(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, gc in that order, from Parquet or from text parted by blanks or commas; without a gc column the last one
    is taken."""
    need = ("chrom", "start", "end")
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        if lost := set(need) - set(df.columns):
            raise ValueError(f"GC table without {sorted(lost)}")
        df = df.select("chrom", "start", "end", F.col("gc" if "gc" in df.columns else df.columns[-1]).alias("gc"))
    else:
        rows, _ = _headed(spark, path, need)
        df = rows.select(*[_field(n).alias(n) for n in need], F.when(F.array_contains("h", "gc"), _field("gc")).otherwise(F.get("p", F.size("h") - 1)).alias("gc"))
    return df.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("gc").cast("double").alias("gc")).orderBy("chrom", "start", "end")


def target_embeddings(spark: SparkSession, names_path: str, array_path: str) -> DataFrame:
    """cell_id, position and emb of a file of cell names and an .npy array with a row for each. Names are a line each, blank
    lines and those that begin with cell_name aside; in .csv and .tsv files they are the column cell_name, else the first,
    below a header. Another number of names than of rows is an error."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    kind = names_path.rsplit(".", 1)[-1]
    if kind in ("csv", "tsv"):
        mark = "," if kind == "csv" else "\t"
        at = F.greatest(F.array_position(F.split(F.get(lines, F.lit(0)), mark), "cell_name").cast("int"), F.lit(1))
        cells = F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.split_part(x, F.lit(mark), at))
    else:
        cells = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: ~F.lower(x).startswith("cell_name"))
    names = spark.read.text(names_path, wholetext=True).select(F.posexplode(cells).alias("position", "cell_id"))

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                a = np.load(io.BytesIO(content), allow_pickle=False).astype("float32")
                yield pd.DataFrame({"position": np.arange(len(a), dtype="int32"), "emb": list(a)})

    rows = spark.read.format("binaryFile").load(array_path).select("content").mapInPandas(run, "position int, emb array<float>")
    differ = F.raise_error(F.lit("the numbers of names and of embeddings differ"))
    both = names.join(rows, "position", "full_outer")
    return both.select(F.when(F.col("cell_id").isNull() | F.col("emb").isNull(), differ).otherwise(F.col("cell_id")).alias("cell_id"), "position", "emb")


def matrices_npz(spark: SparkSession, path: str) -> DataFrame:
    """Long-form entries from npz archives, read whole and decoded without pickles; see archives for the encodings, and for a source that
    opens single matrices."""

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                cell = r["path"].rsplit("/", 1)[-1].removesuffix(".npz")
                with np.load(io.BytesIO(r["content"]), allow_pickle=False) as z:
                    for chrom in sorted({k.partition("__")[0] for k in z.files}):
                        i, j, v = entries({k: z[k] for k in z.files if k.partition("__")[0] == chrom}, chrom)
                        yield pd.DataFrame({"cell_id": cell, "chrom": chrom, "i": i.astype("int32"), "j": j.astype("int32"), "v": v.astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schemas.MATRIX)


def z_npz(spark: SparkSession, path: str) -> DataFrame:
    """Node vectors from `<cell>.<chrom>.z.npz`: the array z, else the first one; it must be 2-D."""

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                with np.load(io.BytesIO(r["content"]), allow_pickle=False) as f:
                    z = f["z" if "z" in f.files else f.files[0]]
                if z.ndim != 2:
                    raise ValueError(f"{r['path']}: z has {z.ndim} dimensions")
                yield pd.DataFrame({"cell_id": r["cell_id"], "chrom": r["chrom"], "bin": np.arange(len(z), dtype="int32"), "z": list(z.astype("float32"))})

    cell, chrom = z_keys(F.regexp_extract("path", r"([^/]+)$", 1))
    return spark.read.format("binaryFile").load(path).select("path", "content", cell.alias("cell_id"), chrom.alias("chrom")).mapInPandas(run, schemas.Z)


def graph_keys(name: Column, dots: bool = False, strict: bool = True) -> tuple[Column, Column]:
    """(cell, chrom) of `<cell>_chr<k>.pt`, the last `_chr` splitting; dots: those of the cell become underscores."""
    pattern = r"^(.*)_chr([^/]+?)(?:\.pt)?$"
    ok = name.rlike(pattern)
    cell = F.regexp_extract(name, pattern, 1)
    cell = F.replace(cell, F.lit("."), F.lit("_")) if dots else cell
    lost = lambda: F.raise_error(F.concat(F.lit("no chromosome in "), name)) if strict else F.lit("unknown")
    return F.when(ok, cell).otherwise(lost()), F.when(ok, F.concat(F.lit("chr"), F.regexp_extract(name, pattern, 2))).otherwise(lost())


def z_keys(name: Column) -> tuple[Column, Column]:
    """(cell, chrom) of `<cell>.chr<k>.z.npz` or `<cell>_chr<k>.npz`; dots and blanks of the cell become underscores, and another
    name is an error."""
    pattern = r"^(.+)[._](chr[^.]+)(?:\.z)?\.npz$"
    lost = F.raise_error(F.concat(F.lit("no cell and chromosome in "), name))
    part = lambda k: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k)).otherwise(lost)
    return cell_name(part(1)), part(2)


def cells_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("cell_id", "chrom").distinct().join(b.select("cell_id", "chrom").distinct(), ["cell_id", "chrom"], "left_semi")


def last_by_position(df: DataFrame, key: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.col("position").desc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
