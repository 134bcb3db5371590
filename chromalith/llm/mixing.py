"""Mixing sources to target weights.

Every document gets a hash-random key and belongs to a range of keys within its source. Sums of sizes by range
are prefix-summed to find the range in which a source's budget ends; only the documents of that one range are
sorted to find the document at which to cut. All other documents are decided by comparing keys, so no source
is ever sorted in one task. A budget of more than the source repeats it in whole epochs, then cuts.

Size is the number of words ([^\\x20\\x09-\\x0D]+; null: 0). Sources are ordered by code point, null last, and
weigh 1, 2, 3, repeating; a null source is a source. Ties of key are broken by identifier, then by size, then by the
place of the row in its file. The document at the cut is taken in part, to the exact budget. Rows of one identifier
share a key: they are summed as one before the cut is sought, and the cut among them falls in one file. Documents without words
take nothing. An empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.llm._store import located, places, release, stored

MAX_EPOCHS = 3
RANGE_CHARS = 3  # 4,096 ranges of keys for each source
BLANKS = "[\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text: blanks become spaces, runs of which are counted by what follows them."""
    flat = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.regexp_count(flat, F.lit(" [^ ]")).cast("long")


def mix_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from source, source_size: shares by weight, capped at max_epochs times the
    size, the excess given to the others by weight until none is above its cap. One row for each source."""
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_fill = W.orderBy("fill", F.col("source").isNull(), F.col("source").cast("binary"))
    upto = by_fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = sizes.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("fill", F.col("cap") / F.col("w"))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("passed", F.coalesce(F.sum("w").over(upto), F.lit(0)))
    s = s.withColumn("all", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    # the level at which sources from this one on are filled in proportion; a source is capped if that exceeds its own
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / (F.col("all_w") - F.col("passed")))
    s = s.withColumn("open", F.col("fill") >= F.col("level"))
    s = s.withColumn("final", F.min(F.when(F.col("open"), F.struct("fill", "level"))).over(every)["level"])
    share = F.when(F.col("open"), F.col("w") * F.col("final")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", share.cast("double").alias("target"))


def located_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """id, source, size, key and the locator (file, row) of every document, with the whole document as doc."""
    read = F.struct("*")
    rows = docs.select(read.alias("doc"), *places(docs))
    rows = rows.withColumns({"id": F.col("doc")[id_col], "source": F.col("doc")[source_col], "size": n_words(F.col("doc")[text_col])})
    return rows.withColumn("key", mix_key(F.col("id"), seed))


def _of(source: str) -> Column:
    return F.col(source).eqNullSafe(F.col("s2"))


def cuts_of(rows: DataFrame, max_epochs: int) -> DataFrame:
    """For each source: source_size, target, epochs, rest, and of the document at the cut `cut` (key, id, size), `spot`
    (file, row) and `part`, the words taken of it. rows: id, source, size, key, file, row, stored."""
    reach = F.substring("key", 1, RANGE_CHARS)
    sums = stored(rows.groupBy("source", reach.alias("reach")).agg(F.sum("size").alias("sum")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), max_epochs)
    goal = goal.withColumn("budget", F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs))
    size = F.col("source_size")
    goal = goal.withColumn("epochs", F.when(size > 0, F.floor(F.col("budget") / size)).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("rest", F.col("budget") - F.col("epochs") * size), "mix-goal")
    here = W.partitionBy("source").orderBy("reach").rowsBetween(W.unboundedPreceding, 0)
    ranges = sums.withColumn("upto", F.sum("sum").over(here)).join(goal.filter("rest > 0").select(F.col("source").alias("s2"), "rest"), _of("source"))
    cut_range = ranges.filter("upto >= rest and upto - sum < rest").select("s2", "reach", F.col("rest") - F.col("upto") + F.col("sum"))
    cut_range = cut_range.toDF("s2", "r2", "left")
    # equal rows of the range are one row with their number, then the one group with the cut is looked at file by file
    near = rows.select("source", "key", "id", "size", "file", "row").join(cut_range, _of("source") & (reach == F.col("r2")))
    same = near.groupBy("s2", "left", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    inside = W.partitionBy("s2").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    same = same.withColumn("sum", F.col("n") * F.col("size")).withColumn("upto", F.sum("sum").over(inside))
    group = same.filter("upto >= left and upto - sum < left").select("s2", F.struct("key", "id", "size").alias("cut"), (F.col("left") - F.col("upto") + F.col("sum")).alias("left"))
    group = stored(group, "mix-groups")
    tied = rows.select("source", F.struct("key", "id", "size").alias("at"), "file", "row").join(group, _of("source") & F.col("at").eqNullSafe(F.col("cut")))
    # the place of the document at the cut among the tied ones, from 1, and the words taken of it
    nth = F.expr("(left + cut.size - 1) div cut.size")
    files = tied.groupBy("s2", "cut", "left", "file").agg(F.count(F.lit(1)).alias("n")).withColumn("nth", nth)
    files = files.withColumn("upto", F.sum("n").over(W.partitionBy("s2").orderBy("file").rowsBetween(W.unboundedPreceding, 0)))
    files = files.filter("upto >= nth and upto - n < nth").select(F.col("s2").alias("s3"), F.col("file").alias("f3"), (F.col("nth") - F.col("upto") + F.col("n")).alias("nth"))
    last = tied.join(files, F.col("s2").eqNullSafe(F.col("s3")) & (F.col("file") == F.col("f3")))
    last = last.withColumn("k", F.row_number().over(W.partitionBy("s2").orderBy("row"))).filter("k = nth")
    part = F.expr("left - ((left + cut.size - 1) div cut.size - 1) * cut.size")
    cut = last.select("s2", "cut", F.struct("file", "row").alias("spot"), part.alias("part"))
    return stored(goal.join(cut, _of("source"), "left").drop("s2"), "mix-cuts")


def taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with source_size, target and taken; cuts has a row for each source and is joined by its size."""
    c = cuts.withColumnRenamed("source", "s2")
    place = F.struct(F.struct("key", "id", "size").alias("cut"), F.struct("file", "row").alias("spot"))
    end = F.struct("cut", "spot")
    extra = F.when(F.col("rest") == 0, 0).when(place < end, F.col("size")).when(place == end, F.col("part")).otherwise(0)
    return rows.join(c, _of("source")).withColumn("taken", F.col("epochs") * F.col("size") + extra)


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, max_epochs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents as located_rows, a stored row for each without the document, the cut of each source)."""
    whole = located_rows(located(docs, docs.columns), id_col, text_col, source_col, seed)
    rows = stored(whole.drop("doc"), "mix-rows")
    return whole, rows, cuts_of(rows, max_epochs)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """id_col, size, source_size, target, taken for every document."""
    names = list(dict.fromkeys((id_col, text_col, source_col)))
    _, rows, cuts = plan(docs.select(*[F.col(f"`{n}`") for n in names]), id_col, text_col, source_col, seed, max_epochs)
    return taken(rows, cuts).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: every document once for each epoch that takes it, with all its columns; a last copy that
    is taken in part has the words that fit and no more."""
    whole, rows, cuts = plan(docs, id_col, text_col, source_col, seed, max_epochs)
    release(rows)
    out = taken(whole, cuts).filter("taken > 0")
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    text = F.col("doc")[text_col]
    text = F.when(words >= F.col("size"), text).otherwise(_first_words(text, words))
    return out.select(*[(text if n == text_col else F.col("doc")[n]).alias(n) for n in docs.columns])


def _first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, BLANKS), lambda w: w != ""), F.lit(1), F.greatest(n, F.lit(1)).cast("int")), " ")
