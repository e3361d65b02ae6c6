"""Where intermediate tables go, so that a lost executor never costs more than the stage it ran.

The folder is the one that the cluster names in spark.checkpoint.dir; only a local session without that setting (a test, a
notebook) gets a folder under /tmp/checkpoints.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files go when the query that made them has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes it the folder of checkpoint(). A cluster without one is an error: executors share no /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/curaspark"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/curaspark-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def cleaned_up(spark: SparkSession):
    """Queries run inside leave no shuffle files behind: for those whose results are written."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Spark settings for the queries that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and the optimiser sees true sizes."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with cleaned_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of this module that nothing reads any more."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def write_bytes_fs(uri: str):
    """pyarrow's file system and path for a folder's address (local, HDFS or an object store)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
