"""Parquet and JSON inputs with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): records that do not fit the schema are failures, not errors."""
    spec = T._parse_datatype_string(schema).add("_corrupt", "string")
    raw = spark.read.schema(spec).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multi_line).json(path)
    failures = raw.where("_corrupt is not null").select(F.lit("parse").alias("stage"), F.lit("invalid_record").alias("code"), F.left("_corrupt", F.lit(300)).alias("message"), F.input_file_name().alias("source_url"))
    return raw.where("_corrupt is null").drop("_corrupt"), failures
