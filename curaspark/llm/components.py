"""Connected components over DataFrames of links, by alternating large-star and small-star steps.

Every step turns each node's links towards the smallest node that it sees; the links become stars after a number of
rounds that grows with the logarithm of the longest path. Each round ends as a table in the shared folder, and so do the
least neighbours that a step joins: a hub's links are then a plain exchange, which Spark splits where it is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.storage import drop, materialize, new_path


class _Rounds:
    """Tables of which only the last of each kind is still needed."""

    def __init__(self, spark):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, kind: str) -> DataFrame:
        last, path = self.paths.get(kind), new_path(self.spark, kind)
        out = materialize(df, kind, path)
        self.paths[kind] = path
        if last:
            drop(self.spark, last)
        return out


def _large_star(edges: DataFrame, rounds: _Rounds) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = rounds.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rounds: _Rounds) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = rounds.table(down.groupBy("u").agg(F.min("v").alias("m")), "below")
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end of a link has that link only, to a node that is no larger end itself."""
    if edges.groupBy("u").count().where("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("u").alias("centre")), F.col("v") == F.col("centre"), "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (u, v: long) but the roots: root is the smallest node reachable.

    Links of a node with itself, repeated and reversed links change nothing; nulls are dropped.
    """
    rounds = _Rounds(edges.sparkSession)
    current = rounds.table(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(current):
        turned = rounds.table(_large_star(current, rounds).distinct(), "turned")
        current = rounds.table(_small_star(turned, rounds).distinct(), "links")
    for kind in rounds.paths.keys() - {"links"}:
        drop(rounds.spark, rounds.paths[kind])
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
