"""Acceptance metrics, each report one aggregate; ratios are null where nothing was to be measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
GATES = {"rows": 300, "items": 30, "precision": 0.95, "bad_rate": 0.02, "retention": 0.99}


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def metrics() -> list[Column]:
    """Over item_id, selected (boolean) and label (A to D or null)."""
    s, good, bad = F.col("selected"), F.col("label").isin("A", "B"), F.col("label").isin("C", "D")
    labelled = F.count_if(s & F.col("label").isNotNull())
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label").isNull()).alias("unlabeled"),
        _ratio(F.count_if(s & (F.col("label") == "A")), labelled).alias("a_precision"),
        _ratio(F.count_if(s & bad), labelled).alias("bad_rate"),
        _ratio(F.count_if(s & good), F.count_if(good)).alias("retention"),
    ]


def report(rows: DataFrame) -> DataFrame:
    out = rows.agg(F.count_distinct("item_id").alias("n_items"), *metrics())
    ok = (F.col("a_precision") >= GATES["precision"]) & (F.col("bad_rate") <= GATES["bad_rate"]) & (F.col("retention") >= GATES["retention"])
    enough = (F.col("n_rows") >= GATES["rows"]) & (F.col("n_items") >= GATES["items"]) & (F.col("unlabeled") == 0)
    return out.withColumn("status", F.when(~enough, "insufficient_annotations").when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed"))


def per_item(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item_id").agg(*metrics())


def state_counts(rows: DataFrame) -> DataFrame:
    """One row: candidates, selected, unselected and invalid ones, and those downloaded."""
    status = F.col("curation_status")
    return rows.agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(status == s).alias(s) for s in ("selected", "unselected", "invalid")], F.count_if(F.col("download_status") == "downloaded").alias("downloaded"))


def group_accuracy(rows: DataFrame) -> DataFrame:
    """Share of duplicate groups with a best member in which one is selected and no blurry one is."""
    s = F.col("selected")
    by_group = rows.groupBy("group_id").agg(F.bool_or(F.col("clarity") == "best").alias("has"), (F.bool_or(s & (F.col("clarity") == "best")) & ~F.bool_or(s & (F.col("clarity") == "blurry"))).alias("ok"))
    return by_group.agg(_ratio(F.count_if(F.col("has") & F.col("ok")), F.count_if(F.col("has"))).alias("accuracy"), F.count_if("has").alias("n_groups"))


def recall_error(expected: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: recall of the expected (1 if none is) and the share of selected ones that were not expected."""
    e, s = expected.select(*keys).distinct().withColumn("e", F.lit(1)), selected.select(*keys).distinct().withColumn("s", F.lit(1))
    both = e.join(s, keys, "full")
    hit, n_e, n_s = F.count_if(F.col("e").isNotNull() & F.col("s").isNotNull()), F.count("e"), F.count("s")
    return both.agg(F.coalesce(_ratio(hit, n_e), F.lit(1.0)).alias("recall"), F.coalesce(_ratio(n_s - hit, n_s), F.lit(0.0)).alias("error"))
