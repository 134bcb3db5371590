"""Exact dedup by stateful streaming: DataFrame operations only.

A stream of (digest, stable identifier, content locator) rows is aggregated into keyed state without expiry, on
disk (RocksDB): for each digest the identifier and locator of the row that stays, and the number of rows. Every
micro-batch appends the changed keys to a table; a key's last row is the one with the highest count. Rows that
hit a digest seen elsewhere are then checked in full: their normalised text against the text that the locator
of the staying row points to. Digests whose texts differ are regrouped by the whole text.

The normalised text has every character of [\\x20\\x09-\\x0D] deleted; a null text counts as empty. Of equal
texts the one with the most code points in the original stays, then the smallest identifier, then the first
locator. Null identifiers sort first; rows repeated in full are still rows of their own. An empty table gives
no rows. `exact_dedup` reads the identifier and the text only, `keep_first` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalith.llm._store import delete, located, places, scratch_path, settings, stored, write

BLANKS = " \t\n\x0b\x0c\r"
HOT_PARTS = 1000
BATCH_BYTES = 1 << 28
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest_rows(docs: DataFrame, id_col: str, text_col: str, digest=None) -> DataFrame:
    """One row per document: digest, id, n_chars and the locator (file, row in it) of its text."""
    norm = normalised(F.col(f"`{text_col}`"))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (digest or (lambda c: F.sha2(c, 256)))(norm).alias("digest"),
        *([F.sha2(norm, 256).alias("text_sha256")] if digest else []),
        F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("n_chars"),
        *places(docs),
    )


def rank(prefix: str = "") -> Column:
    """Its minimum belongs to the row that stays."""
    return F.struct((-F.col(f"{prefix}n_chars")).alias("less"), F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}file").alias("file"), F.col(f"{prefix}row").alias("row"))


def stream_state(rows: DataFrame, batch_bytes: int) -> tuple[DataFrame, DataFrame]:
    """A stored table of digest rows, and the final keyed state over it: digest, keep (id, file, row), group_size.

    Micro-batches take files of digest rows up to batch_bytes. State partitions are many and mostly small, so RocksDB must
    not allocate its files ahead: with 211 partitions that alone took some 850 MB of local disk.
    """
    spark = rows.sparkSession
    source = scratch_path(spark, "dedup-rows")
    write(rows, source)
    target, at = scratch_path(spark, "dedup-state"), scratch_path(spark, "dedup-stream")
    state_store = {
        "spark__sql__streaming__stateStore__providerClass": ROCKSDB,
        "spark__sql__streaming__stateStore__rocksdb__allowFAllocate": "false",
        # an executor holds many partitions' states: their buffers share one bound, and each is closed when its task has committed
        "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true",
        "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": "128",
        "spark__sql__streaming__stateStore__unloadOnCommit": "true",
    }
    with settings(spark, **state_store):
        stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", batch_bytes).parquet(source)
        state = stream.groupBy("digest").agg(F.min(rank()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", at)
            # a batch that is run again writes the same folder again
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    table = spark.read.schema(rows.schema).parquet(source)
    table._scratch = source
    empty = spark.createDataFrame([], state.schema)
    if not query.lastProgress:
        return table, empty
    batches = spark.read.schema(state.schema).parquet(f"{target}/batch=*")
    last = batches.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("s"))
    final = stored(last.select("digest", "s.keep", "s.group_size"), "dedup-final")
    for path in (target, at):
        delete(spark, path)
    return table, final


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, digest=None) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256, file, row.

    digest: a function from the normalised text to the key of the state, SHA-256 by default.
    """
    docs = located(docs, [id_col, text_col])
    rows, state = stream_state(digest_rows(docs, id_col, text_col, digest), batch_bytes)
    rows = rows if digest else rows.withColumn("text_sha256", F.col("digest"))
    # hits: all rows of groups of two or more; a group's rows are spread over parts of about HOT_PARTS rows
    parts = lambda size: F.ceil(size / HOT_PARTS).cast("int")
    groups = state.filter("group_size > 1")
    marked = rows.join(state, "digest")
    hit = marked.filter("group_size > 1").select("file", "row", "digest", F.pmod(F.xxhash64("file", "row"), parts(F.col("group_size"))).cast("int").alias("part"))
    texts = docs.select(*places(docs), normalised(F.col(f"`{text_col}`")).alias("norm"))
    mine = texts.join(hit, ["file", "row"])
    kept_text = texts.join(groups.select(F.col("keep.file").alias("file"), F.col("keep.row").alias("row"), "digest", parts(F.col("group_size")).alias("parts")), ["file", "row"])
    kept_text = kept_text.select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("norm").alias("kept_norm"))
    differ = stored(mine.join(kept_text, ["digest", "part"]).filter(F.col("norm") != F.col("kept_norm")).select("digest").distinct(), "dedup-differ")
    good = marked.select("id", "text_sha256", "file", "row", "keep", "group_size")
    if not differ.isEmpty():  # digests shared by unequal texts: these rows are grouped by their whole texts
        odd = rows.join(differ, "digest", "left_semi").join(texts, ["file", "row"])
        whole = odd.groupBy("norm").agg(F.min(rank()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        good = marked.join(differ, "digest", "left_anti").select(good.columns).unionByName(odd.join(whole, "norm").select(good.columns))
    return good.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        ((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        "file",
        "row",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    docs = located(docs, docs.columns)
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select("file", "row")
    whole = docs.select(F.struct("*").alias("doc"), *places(docs))
    return whole.join(kept, ["file", "row"], "left_semi").select("doc.*")
