"""Sums of dense vectors in a tree of partial sums, and tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 16


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix, one row for each list; all lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows, float).ravel()))


def tree_sum(vectors: DataFrame, fan: int = FAN, tasks: int | None = None) -> DataFrame:
    """The sum of the one column of vectors (array<double>, all equally long, none null), as one row; none of an empty table. Every task
    sums its own rows, then `fan` tasks each sum what a part of the tasks gave, then one sums these: no task reads more than fan rows or the
    share of its part. tasks: the number of tasks of vectors, each of which has one row at most; up to fan of them go to the last task at once."""
    name = vectors.columns[0]

    def add(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = numbers(b.column(0)).sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists(total[None])], [name])

    kind = f"{name} array<double>"
    # in the order of the tasks, so that sums of a table dealt out alike are alike to the last bit
    own = (vectors if tasks else vectors.mapInArrow(add, kind)).withColumn("_task", F.spark_partition_id())
    if tasks and tasks <= fan:
        return own.repartition(1).sortWithinPartitions("_task").select(name).mapInArrow(add, kind)
    some = own.repartition(fan, F.col("_task") % fan).sortWithinPartitions("_task").select(name).mapInArrow(add, kind).withColumn("_task", F.spark_partition_id())
    return some.repartition(1).sortWithinPartitions("_task").select(name).mapInArrow(add, kind)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in the block go once it has run."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def first_row(df: DataFrame):
    """df.first(), its shuffle files removed afterwards: for loops of many jobs."""
    with _cleaned(df.sparkSession):
        return df.first()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; in one process a folder of our own serves if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chromalith-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/chromalith/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts lineage; dropped() deletes it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(table: DataFrame) -> None:
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table._written)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
