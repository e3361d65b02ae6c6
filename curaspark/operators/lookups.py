"""Look-ups of releases, works and related works in a frozen database, in order, with one budget an item that all steps share.

A release costs a call, and one more for its page where the answer names no work. Then the works, those given and those of
the releases, by id: a call each, and one more for the page of a work without screenshots. Then what the works are related
to, one hop, by work, kind of relation and id, each once: a call each. A step sees what the steps before it have spent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 16
OUT = ["item_id", "stage", "place", "id", "found", "by_page", "relation_of", "relation_type"]


def _spent(rows: DataFrame, order: list[str], budget: int) -> DataFrame:
    """rows (item_id, before, cost) with place, and at: what was spent before each; those that the budget reaches."""
    w = Window.partitionBy("item_id").orderBy(*order)
    earlier = F.coalesce(F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"place": F.row_number().over(w), "at": F.col("before") + earlier}).where(F.col("at") < budget)


def _after(rows: DataFrame, budget: int, name: str) -> DataFrame:
    return rows.groupBy("item_id").agg(F.least(F.lit(budget), F.max(F.col("at") + F.col("cost"))).cast("long").alias(name))


def looked_up(wanted: DataFrame, releases: DataFrame, works: DataFrame, pages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """OUT rows: what is asked for each item, in order within its stage; found: the database knows it; by_page: its page was asked too.

    wanted: item_id, place, id (r... or v..., repeats count once). releases: id, works (array of ids). works: id,
    screenshots (long), relations (array of struct id, type). pages: id, works (array), what a page names when the database does not.
    """
    none = F.array().cast("array<string>")
    first = wanted.where("item_id is not null and id is not null").groupBy("item_id", "id").agg(F.min("place").alias("first"))
    r = first.where("id like 'r%'").join(releases.select("id", F.col("works").alias("named")), "id", "left")
    r = r.withColumns({"found": F.col("named").isNotNull(), "before": F.lit(0).cast("long"), "cost": F.when(F.size(F.coalesce("named", none)) > 0, 1).otherwise(2)})
    r = _spent(r, ["first", "id"], budget).withColumn("by_page", (F.col("cost") == 2) & (F.col("at") + 1 < budget))
    r = r.join(pages.select("id", F.col("works").alias("shown")), "id", "left")
    linked = F.when(F.col("cost") == 1, F.col("named")).when(F.col("by_page"), F.coalesce("shown", none)).otherwise(none)
    stage_r = r.select("item_id", F.lit("release").alias("stage"), "place", "id", "found", "by_page", F.lit(None).cast("string").alias("relation_of"), F.lit(None).cast("string").alias("relation_type"))
    ids = first.where("id like 'v%'").select("item_id", "id").unionByName(r.select("item_id", F.explode(linked).alias("id"))).distinct()
    w = ids.join(_after(r, budget, "spent"), "item_id", "left").join(works, "id", "left")
    w = w.withColumns({"before": F.coalesce("spent", F.lit(0)), "found": F.col("screenshots").isNotNull(), "cost": F.when(F.coalesce("screenshots", F.lit(0)) > 0, 1).otherwise(2)})
    w = _spent(w, ["id"], budget).withColumn("by_page", (F.col("cost") == 2) & (F.col("at") + 1 < budget))
    stage_w = w.select("item_id", F.lit("work").alias("stage"), "place", "id", "found", "by_page", F.lit(None).cast("string").alias("relation_of"), F.lit(None).cast("string").alias("relation_type"))
    x = w.select("item_id", F.col("id").alias("relation_of"), F.inline("relations")).where("id is not null").withColumn("order", F.struct("relation_of", "type", "id"))
    x = x.groupBy("item_id", "id").agg(F.min("order").alias("order")).join(w.select("item_id", "id"), ["item_id", "id"], "left_anti")
    x = x.join(_after(w, budget, "before"), "item_id").withColumn("cost", F.lit(1))
    x = _spent(x, ["order"], budget).join(works.select("id", F.lit(True).alias("known")), "id", "left")
    stage_x = x.select("item_id", F.lit("relation").alias("stage"), "place", "id", F.coalesce("known", F.lit(False)).alias("found"), F.lit(False).alias("by_page"), F.col("order.relation_of").alias("relation_of"), F.col("order.type").alias("relation_type"))
    return stage_r.unionByName(stage_w).unionByName(stage_x).select(*OUT)
