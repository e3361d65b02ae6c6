"""Merging what several collectors, runs and retries found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inherit_evidence(candidates: DataFrame, seeds: DataFrame, keys: list[str], order: str, evidence: str, same: Column) -> DataFrame:
    """Adds inherited: the evidence of the first seed (by order) on the same keys that `same` confirms (aliases c and s).

    Seeds only give and candidates only take, so nothing passes on a second time.
    """
    pairs = candidates.alias("c").join(seeds.alias("s"), [F.col(f"c.{k}") == F.col(f"s.{k}") for k in keys]).where(same & (F.col("c.id") != F.col("s.id")))
    first = pairs.groupBy(F.col("c.id").alias("id")).agg(F.min_by(F.col(f"s.{evidence}"), F.col(f"s.{order}")).alias("inherited"))
    return candidates.join(first, "id", "left")


def merge_results(a: DataFrame, b: DataFrame, key: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """Two collectors' rows by key: scalars of the first that has them, arrays united in order, each element once."""
    left = a.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in scalars + arrays])
    right = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in scalars + arrays])
    none = lambda c: F.coalesce(F.col(c), F.array().cast(a.schema[c[2:]].dataType))
    return left.join(right, key, "full").select(
        key, *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in scalars], *[F.array_distinct(F.concat(none(f"a_{c}"), none(f"b_{c}"))).alias(c) for c in arrays]
    )


def prefer_reusable(rows: DataFrame, key: str, reusable: Column, newest: Column) -> DataFrame:
    """Of each key's earlier rows one that can be used again, else the newest."""
    w = Window.partitionBy(key).orderBy(F.desc(reusable), F.desc(newest))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def retry_delta(existing: DataFrame, retried: DataFrame, key: str, asset: str) -> DataFrame:
    """Existing rows win unless their asset is missing and the retried row has one; new keys are added."""
    columns = [c for c in existing.columns if c != key]
    a = existing.select(key, F.struct(*columns).alias("a"))
    b = retried.select(key, F.struct(*columns).alias("b"))
    take = F.col("a").isNull() | (F.col(f"a.{asset}").isNull() & F.col(f"b.{asset}").isNotNull())
    out = a.join(b, key, "full").select(key, F.when(take, F.col("b")).otherwise(F.col("a")).alias("x"))
    return out.select(key, *[F.col(f"x.{c}") for c in columns])


def one_hop(items: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """(item, work, related): works linked to items and, exactly one step on, works related to those that are not linked themselves."""
    linked = items.join(links, "item").select("item", "work")
    near = linked.join(relations, linked["work"] == relations["src"]).select("item", F.col("dst").alias("work"))
    more = near.distinct().join(linked, ["item", "work"], "left_anti")
    return linked.distinct().withColumn("related", F.lit(False)).unionByName(more.withColumn("related", F.lit(True)))


def binding(works: DataFrame) -> DataFrame:
    """(item, work, title_match) to binding: the one linked work is confirmed; of several the only title match, the rest reference."""
    w = Window.partitionBy("item")
    n, hits = F.count(F.lit(1)).over(w), F.sum(F.col("title_match").cast("int")).over(w)
    state = F.when(n == 1, "confirmed").when((hits == 1) & F.col("title_match"), "confirmed").when(hits == 1, "reference").otherwise("uncertain")
    return works.withColumn("binding", state)


def within_budget(calls: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """Marks the calls of each key that its budget allows; repeated requests are answered from the first and cost nothing."""
    first = F.row_number().over(Window.partitionBy(key, "request").orderBy(order)) == 1
    marked = calls.withColumn("fresh", first)
    used = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("allowed", ~F.col("fresh") | (used <= budget))


def sticky_outcome(calls: DataFrame, key: str, order: str) -> DataFrame:
    """One row per request: its first outcome stands, failures included, so that paid look-ups are never repeated."""
    return calls.groupBy(key).agg(F.min_by("outcome", order).alias("outcome"), F.count(F.lit(1)).alias("asked"))


def catalog_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("active"), F.desc("created_at"), F.desc("task_id"))


def store_screenshots(props: Column) -> Column:
    """Screenshots of a store page's data-props JSON: the best size each, full before standard before thumbnail, in order."""
    shape = "struct<screenshots:array<struct<full:string,standard:string,thumbnail:string,altText:string>>>"
    shots = F.from_json(props, F.lit(shape))["screenshots"]
    return F.array_distinct(F.array_compact(F.transform(shots, lambda s: F.regexp_replace(F.coalesce(s["full"], s["standard"], s["thumbnail"]), r"\?.*$", ""))))
