"""Progress events as streams: running counters, deliver-once outcomes, latest states; and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.session import shared_folder

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        reader, folder = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()  # a table of one file
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counter_columns() -> list[Column]:
    """What a progress display shows of a task; the last value is a snapshot, never a sum."""
    return [
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == "error").alias("n_failed"),
        F.count_if(F.col("event_type") == "purchase").alias("n_completed"),
        F.max("event_id").alias("last_event"),
        F.max_by("value", "event_id").alias("last_value"),
    ]


def counters(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """Works on batches and, in update or complete mode, on streams."""
    return stream.groupBy(key).agg(*counter_columns())


def once(stream: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Each key once; state is dropped when the watermark has passed it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


# Extensions beyond the selection engine's needs: event-time windows.
def tumbling(stream: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    w = F.window("ts", size)
    return stream.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, size: str = "2 days", slide: str = "1 day", delay: str = "1 hour") -> DataFrame:
    w = F.window("ts", size, slide)
    return stream.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", delay).groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], failures: list[str], checkpoint: str, mode: str = "update"):
    """Each micro-batch to the sink; a sink that fails is noted and never stops the stream."""

    def safe(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception as e:
            failures.append(f"batch {number}: {type(e).__name__}")
            batch.write.mode("overwrite").parquet(f"{checkpoint}/failed/batch={number}")  # its rows, to be delivered again

    return stream.writeStream.outputMode(mode).foreachBatch(safe).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its output, a table in the shared folder.

    Each batch has a folder of its own, which a repeated batch overwrites; in complete mode the last batch is the output.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)
