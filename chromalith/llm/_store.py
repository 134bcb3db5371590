"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chromalith-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chromalith/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for as long as the block runs; names have `__` for the dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    held = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet; what it was shuffled from is dropped once it is written."""
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def places(docs: DataFrame) -> tuple[Column, Column]:
    """The file that a row was read from and its number there, whatever columns docs has of its own."""
    at = docs.metadataColumn("_metadata")
    return at["file_path"].alias("file"), at["row_index"].alias("row")


def located(docs: DataFrame, columns: list[str], name: str = "located") -> DataFrame:
    """docs itself if its rows have places, else a stored copy of the columns, which has them."""
    try:
        docs.select(*places(docs)).schema  # noqa: B018
        return docs
    except AnalysisException as e:
        if "UNRESOLVED" not in (e.getCondition() or ""):
            raise
        return stored(docs.select(*[F.col(f"`{c}`") for c in columns]), name)


def release(*tables: DataFrame) -> None:
    """Delete stored tables: for when all that was made of them has been written itself."""
    for t in tables:
        delete(t.sparkSession, t._scratch)


def bound_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Bound the Arrow batches that Python workers hold, by rows and bytes: whole texts may be long. Plans read these
    settings when they run, so they stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
