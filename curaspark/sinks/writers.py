"""Sinks. URLs lose credentials before any of them; a folder appears whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark.functions import urls


def _clean(value: Column, kind: T.DataType, is_url: bool) -> Column:
    if isinstance(kind, T.StringType):
        return urls.redacted(value) if is_url else value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_clean(value[f.name], f.dataType, f.name.lower().endswith(("url", "urls"))).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType, is_url))
    return value


def redact(df: DataFrame) -> DataFrame:
    """All strings under a name that ends in url(s), however deep, without their secret parameters."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType, f.name.lower().endswith(("url", "urls"))).alias(f.name) for f in df.schema.fields])


def publish(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes beside the target, then renames: readers see the old folder or the whole new one, and a failed write changes nothing."""
    spark = df.sparkSession
    stage, old = f"{path}.{uuid.uuid4().hex[:8]}.stage", f"{path}.{uuid.uuid4().hex[:8]}.old"
    redact(df).write.format(kind).save(stage)
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(to)
    if had and not fs.rename(to, jvm.org.apache.hadoop.fs.Path(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(stage), to):
        if had:
            fs.rename(jvm.org.apache.hadoop.fs.Path(old), to)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def append_journal(rows: DataFrame, path: str, revision: int) -> None:
    rows.withColumn("revision", F.lit(revision).cast("long")).write.mode("append").parquet(path)
