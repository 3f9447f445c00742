"""Tables in the folder that a cluster's executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Spark deletes the shuffle files of a write when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; on a local master where it is unset, as in tests, a folder under /tmp."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not set_dir and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(set_dir or "/tmp/checkpoints")
    return set_dir or "/tmp/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: later jobs don't repeat the work, and a lost executor loses nothing.

    The table stays until dropped() takes it, or the cluster cleans the folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt to tasks by some keys, or evenly, for work that is far larger than the rows it starts from.

    A small table is one task, and shuffles of small rows are joined into a few: their sizes say nothing of what is done with each row.
    """
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and nothing needs any more."""
    for table in tables:
        delete(table.sparkSession, table.stored_path)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables in a folder, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(n for n in names if exists(spark, f"{path}/{n}/_SUCCESS"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table, or no rows where there is none; columns that it lacks are null.  A folder that is no readable table is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.parquet(path)
    return spark.createDataFrame([], schema).unionByName(found.select(*(c for c in schema.names if c in found.columns)), allowMissingColumns=True)
