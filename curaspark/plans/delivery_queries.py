"""What was delivered, read back by its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.operators import selection
from curaspark.plans.binding import ALLOCATED, scored
from curaspark.session import shared_folder
from curaspark.sinks import delivery


def delivered_selection(spark: SparkSession, d: str) -> DataFrame:
    """The selected candidates, delivered as a transaction, compacted and read back."""
    path = shared_folder(spark, "delivery")
    chosen = selection.allocate(scored(spark, d)).where("selected").select("candidate_id", "item_id", "image_type", F.col("slot").cast("long").alias("slot"))
    delivery.deliver(chosen, path, "candidate_id", "image_type")
    delivery.compact(spark, path, "candidate_id", 2, "image_type")
    return delivery.delivered(spark, path)


QUERIES = {"delivered_selection": delivered_selection}
ORACLE_SQL = {"delivered_selection": f"WITH {ALLOCATED} SELECT candidate_id, item_id, image_type, slot FROM alloc WHERE selected"}
