"""Keyed merges, lookups and comparisons of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are one key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def union_first(parts: list[DataFrame], keys: list[str], within: str, limit: int | None = None) -> DataFrame:
    """Ordered union: of equal keys the row of the earliest part (then of least `within`) stays."""
    all_rows = None
    for i, part in enumerate(parts):
        numbered = part.withColumn("part", F.lit(i))
        all_rows = numbered if all_rows is None else all_rows.unionByName(numbered)
    out = first_wins(all_rows, keys, [F.asc("part"), F.asc(within)])
    return out.orderBy("part", within).limit(limit) if limit else out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new: the new row wins. One shuffle on the keys."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_wins(both, keys, [F.desc("__new")]).drop("__new")


def latest(rows: DataFrame, key: str, revision: str, tie: str) -> DataFrame:
    """The row of the greatest revision of each key; of equal ones that of the least tie. Map-side combined."""
    columns = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*columns), F.struct(F.col(revision), -F.col(tie)))
    return rows.groupBy(key).agg(best.alias("b")).select(key, *[F.col(f"b.{c}") for c in columns])


def merge_failures(rows: DataFrame, keys: list[str], order: str, rest: list[str]) -> DataFrame:
    """One row per failure: occurrences summed, other fields of the first record."""
    return rows.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"), *[F.min_by(c, order).alias(c) for c in rest])


def known_item(rows: DataFrame, known: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Adds known_id: the least id of a known row with the first key that matches."""
    hits = []
    for k in keys:
        side = known.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(id_col).alias(f"hit_{k}"))
        rows = rows.join(side, k, "left")
        hits.append(f"hit_{k}")
    return rows.withColumn("known_id", F.coalesce(*hits)).drop(*hits)


def compare_runs(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison: status added, removed, changed or same, and each column before and after."""
    a = old.select(F.col(key), *[F.col(c).alias(f"{c}_old") for c in columns], F.lit(True).alias("__a"))
    b = new.select(F.col(key), *[F.col(c).alias(f"{c}_new") for c in columns], F.lit(True).alias("__b"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new"))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(same, "same").otherwise("changed")
    return a.join(b, key, "full").withColumn("status", status).drop("__a", "__b")


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows either side has alone."""
    left, right = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right"))
    return left.join(right, F.lit(True), "inner")


def hamming_join(rows: DataFrame, group: str, key: str, hash_hex: str, distance: int) -> DataFrame:
    """Pairs (a < b) of a group whose 16-digit hex hashes differ in at most `distance` bits.

    By the pigeonhole principle two such hashes agree in one of distance + 1 bands of bits: an equi-join on (group, band,
    bits), then the exact distance. Rows of equal hashes pair with each other: reduce them first where they are many.
    """
    from curaspark.functions.hashing import hamming_hex

    bands = distance + 1
    bits = F.concat(*[F.lpad(F.bin(F.conv(F.substring(hash_hex, at, 8), 16, 10).cast("long")), 32, "0") for at in (1, 9)])
    cuts = [round(i * 64 / bands) for i in range(bands + 1)]
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.substring(bits, lo + 1, hi - lo).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]))
    spread = rows.select(group, key, hash_hex, band.alias("x")).select(group, key, hash_hex, "x.band", "x.bits")
    a, b = spread.alias("a"), spread.alias("b")
    close = hamming_hex(F.col(f"a.{hash_hex}"), F.col(f"b.{hash_hex}"))
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (close <= distance)
    return a.join(b, on).select(F.col(f"a.{group}"), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), close.alias("distance")).distinct()


def bounded_reach(edges: DataFrame, roots: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """(root, node, level, parent): breadth first to a depth, each node once per root by its least parent.

    budget: pages of one root at most, in order of (level, node). The loop runs `depth` times over DataFrames; each
    level is cut off in the checkpoint folder if the session has one.
    """
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("level"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent"))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        step = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("level"), "parent")
        if step.sparkSession.sparkContext.getCheckpointDir():
            step = step.checkpoint()
        seen = seen.unionByName(step)
        frontier = step
    if budget is None:
        return seen
    return seen.withColumn("rn", F.row_number().over(Window.partitionBy("root").orderBy("level", "node"))).where(F.col("rn") <= budget).drop("rn")


def re_key_collisions(rows: DataFrame, id_col: str, group: str) -> DataFrame:
    """Ids that several groups share get a new id in all groups but the first."""
    rank = F.dense_rank().over(Window.partitionBy(id_col).orderBy(group))
    return rows.withColumn("new_id", F.when(rank == 1, F.col(id_col).cast("string")).otherwise(F.substring(F.sha2(F.concat_ws("\0", F.col(group).cast("string"), F.col(id_col).cast("string")), 256), 1, 16)))


def collision_suffix(rows: DataFrame, name: str, order: list[Column], out: str = "unique_name") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    return rows.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))
