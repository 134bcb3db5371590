"""Sequences as blocks: no row holds more than a line of the file, and none that is made more than a bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.functions.columns import with_chr

BLOCK = 1 << 16


def fasta_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """record, chrom (chr prefix), start, sequence: upper-case pieces of at most `block` letters of every record, with their offsets.

    Lines are numbered within the split of the file that they were read from. A line's record is the last header before it, in its
    split or else in one of the splits before; its offset is the sum of the lines since, in the same two steps. So
    windows are over the lines of one split, and over a row for each split of a file. Records without letters have no pieces.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(at.alias("at"), "value").select("at.*", "value")
    head = F.startswith("value", F.lit(">"))
    body = F.upper(F.regexp_replace("value", r"\s+", ""))
    lines = lines.select("file", "split", "n", F.when(head, F.struct(F.col("n").alias("n"), F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("name"))).alias("head"), F.when(~head, body).otherwise("").alias("body"))
    own = W.partitionBy("file", "split").orderBy("n")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumns({"length": F.length("body").cast("bigint"), "record": F.last("head", ignorenulls=True).over(upto)})
    since = W.partitionBy("file", "split", "record").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("length").over(since), F.lit(0).cast("bigint")))
    # of each split: its last header, the letters behind it, and all its letters if it has no header
    whole = lines.groupBy("file", "split").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("n"))).alias("last"))
    behind = placed.join(whole, ["file", "split"]).filter(F.col("record").eqNullSafe(F.col("last"))).groupBy("file", "split").agg(F.sum("length").alias("tail"))
    splits = whole.join(behind, ["file", "split"], "left").withColumn("tail", F.coalesce("tail", F.lit(0).cast("bigint")))
    before = W.partitionBy("file").orderBy("split")
    splits = splits.withColumn("open", F.last("last", ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1)))
    run = F.count("last").over(before.rowsBetween(W.unboundedPreceding, 0))  # splits since the same header
    splits = splits.withColumn("run", run)
    carried = F.sum("tail").over(W.partitionBy("file", "run").orderBy("split").rowsBetween(W.unboundedPreceding, 0))
    splits = splits.withColumn("upto", carried)
    splits = splits.select("file", "split", "open", F.coalesce(F.lag("upto").over(before), F.lit(0).cast("bigint")).alias("carried"))
    found = placed.filter("length > 0").join(splits, ["file", "split"])
    first = F.col("record").isNull()
    found = found.select("file", F.when(first, F.col("open")).otherwise(F.col("record")).alias("head"), F.when(first, F.col("start") + F.col("carried")).otherwise(F.col("start")).alias("start"), "body").filter("head is not null")
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.length("body") / block).cast("int") - 1))
    found = found.select("file", "head", "start", "body", piece.alias("k"))
    record = F.struct("file", "head.n")
    return found.select(record.alias("record"), with_chr(F.col("head.name")).alias("chrom"), (F.col("start") + F.col("k").cast("bigint") * block).alias("start"), F.substring(F.col("body"), F.col("k") * block + 1, F.lit(block)).alias("sequence"))


def bins_of_blocks(blocks: DataFrame, bin_size: int) -> DataFrame:
    """chrom, bin (from 1), sequence, start, end: fixed-width slices put together from pieces; what features.dna_bins gives of whole
    sequences. A row has one bin at most."""
    last = F.col("start") + F.length("sequence") - 1
    k = F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(last / bin_size)))
    parts = blocks.select("record", "chrom", "start", "sequence", k.alias("k"))
    low = F.greatest(F.col("k") * bin_size, F.col("start"))
    high = F.least((F.col("k") + 1) * bin_size, F.col("start") + F.length("sequence"))
    cut = F.substring(F.col("sequence"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    parts = parts.select("record", "chrom", "k", low.alias("at"), cut.alias("part"))
    whole = parts.groupBy("record", "chrom", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]), "").alias("sequence"))
    start = F.col("k") * bin_size
    return whole.select("chrom", (F.col("k") + 1).cast("int").alias("bin"), "sequence", start.alias("start"), (start + F.length("sequence")).alias("end"))
