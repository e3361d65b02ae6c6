"""Delivery as one transaction: a data source whose manifest is written last.

Tasks write Parquet parts into a folder of their own version; when all have ended, the driver checks the invariants and
replaces the manifest in one step. Readers see what the manifest names, so until then, and if a task or a check fails, the
version before stays whole; an aborted version's parts are deleted. Speculative or repeated attempts leave files that no
manifest names. Reading takes one partition a part; a part that is missing or damaged is a failure row, if asked for.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

MANIFEST, VERSION = "manifest.json", 1
FAILURES = "part string, code string, message string"


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (a local path, HDFS or an object store) and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def manifest(uri: str) -> dict | None:
    """What was delivered last: version, parts with their rows, rows, counts and schema; null before the first delivery."""
    files, path = _files(uri.rstrip("/"))
    if files.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{path}/{MANIFEST}") as f:
        found = json.loads(f.read())
    if found.get("schema_version") != VERSION:
        raise ValueError(f"manifest of schema version {found.get('schema_version')}")
    return found


def _put(uri: str, content: dict) -> None:
    files, path = _files(uri)
    beside = f"{path}/.{MANIFEST}-{uuid.uuid4().hex[:12]}"
    with files.open_output_stream(beside) as f:
        f.write(json.dumps(content, ensure_ascii=False, sort_keys=True).encode())
    files.move(beside, f"{path}/{MANIFEST}")


@dataclass
class Part(WriterCommitMessage):
    file: str = ""
    rows: int = 0
    counts: dict = field(default_factory=dict)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema):
        self.uri, self.count_by = options["path"].rstrip("/"), options.get("count_by")
        self.expected = int(options["expected"]) if "expected" in options else None
        self.version, self.schema = uuid.uuid4().hex[:12], to_arrow_schema(schema)

    def write(self, iterator) -> Part:
        files, path = _files(self.uri)
        task = TaskContext.get()
        part = Part(f"v-{self.version}/part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet")
        files.create_dir(f"{path}/v-{self.version}")
        counts: Counter = Counter()
        with files.open_output_stream(f"{path}/{part.file}") as out, pq.ParquetWriter(out, self.schema) as writer:
            for batch in iterator:
                writer.write_batch(batch.cast(self.schema))
                part.rows += batch.num_rows
                if self.count_by:
                    counts.update(str(x) for x in batch.column(self.count_by).to_pylist())
        part.counts = dict(counts)
        return part

    def commit(self, messages) -> None:
        parts = [m for m in messages if m is not None]
        counts: Counter = Counter()
        for p in parts:
            counts.update(p.counts)
        rows = sum(p.rows for p in parts)
        if self.expected is not None and rows != self.expected:
            self.abort(messages)
            raise ValueError(f"{rows} rows were written where {self.expected} were expected")
        _put(self.uri, {"schema_version": VERSION, "version": self.version, "rows": rows, "counts": dict(counts), "parts": [{"file": p.file, "rows": p.rows} for p in parts if p.rows], "schema": from_arrow_schema(self.schema).json()})

    def abort(self, messages) -> None:
        files, path = _files(self.uri)
        if files.get_file_info(f"{path}/v-{self.version}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/v-{self.version}")


@dataclass
class _Named(InputPartition):
    file: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.uri, self.failures, self.schema = options["path"].rstrip("/"), options.get("failures") == "true", to_arrow_schema(schema)

    def partitions(self):
        found = manifest(self.uri)
        return [_Named(p["file"], p["rows"]) for p in found["parts"]] if found else []

    def read(self, partition):
        if partition is None:  # an empty delivery
            return
        files, path = _files(self.uri)
        try:
            with files.open_input_file(f"{path}/{partition.file}") as f:
                source = pq.ParquetFile(f)
                if source.metadata.num_rows != partition.rows:
                    raise ValueError(f"{source.metadata.num_rows} rows, the manifest has {partition.rows}")
                if not self.failures:
                    yield from (b.cast(self.schema) for b in source.iter_batches(10_000))
        except (OSError, ValueError, pa.ArrowException) as e:
            if not self.failures:
                raise
            yield pa.RecordBatch.from_pylist([{"part": partition.file, "code": type(e).__name__, "message": str(e).split("'")[0][:300]}], self.schema)


class Delivery(DataSource):
    """format("curaspark_delivery"): options path; writing: count_by, expected; reading: failures ("true": what cannot be read)."""

    @classmethod
    def name(cls) -> str:
        return "curaspark_delivery"

    def schema(self):
        if self.options.get("failures") == "true":
            return FAILURES
        found = manifest(self.options["path"])
        if found is None:
            raise ValueError(f"nothing was delivered to {self.options['path']}")
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(found["schema"]))

    def reader(self, schema):
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema)


def deliver(df: DataFrame, path: str, key: str, count_by: str | None = None) -> dict:
    """Replaces what is at path by df, if key has neither nulls nor repeats; returns the manifest. df is read twice."""
    spark = df.sparkSession
    spark.dataSource.register(Delivery)
    bad = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][0]!r} is null or repeated")
    writer = df.write.format("curaspark_delivery").mode("append").option("path", path).option("expected", df.count())
    (writer.option("count_by", count_by) if count_by else writer).save()
    return manifest(path)


def delivered(spark: SparkSession, path: str, failures: bool = False) -> DataFrame:
    """What was delivered last; with failures, the parts that cannot be read."""
    spark.dataSource.register(Delivery)
    return spark.read.format("curaspark_delivery").option("failures", str(failures).lower()).load(path)


def compact(spark: SparkSession, path: str, key: str, parts: int = 1, count_by: str | None = None) -> dict:
    """Delivers the same rows in fewer parts, then deletes the version before; counts must not change."""
    before = manifest(path)
    after = deliver(delivered(spark, path).coalesce(parts), path, key, count_by)
    if (after["rows"], after["counts"]) != (before["rows"], before["counts"] if count_by else after["counts"]):
        raise ValueError("compaction changed what is delivered")
    files, folder = _files(path.rstrip("/"))
    files.delete_dir(f"{folder}/v-{before['version']}")
    return after
