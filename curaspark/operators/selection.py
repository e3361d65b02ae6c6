"""Scoring, ranking, group-local deduplication and capped allocation of candidates.

Columns that are read, where a candidate has them: item_id, candidate_id, image_type, source_type, width, height, detail,
published_at, fetched_at, x_photo, auto_select, entity_match, fallback_only, localized, sha256. Every order ends in
the unique candidate_id. Groups are windows over item_id, so one shuffle serves ranking, dedup and caps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark import config
from curaspark.functions import text
from curaspark.operators.classify import DEFAULT_TRUST, rules


def relevance(match_values: Column, explicit_need: Column, source_type: Column) -> Column:
    """Mean of the match signals that are present, else a default by source."""
    present = F.filter(match_values, lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0))
    default = rules((explicit_need & (source_type == "official_site"), 0.65), (source_type.isin("official_site", "official_x"), 1.0), otherwise=0.25)
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).otherwise(default)  # least() skips nulls


def score(candidates: DataFrame, weights: dict | None = None, penalty: float | None = None) -> DataFrame:
    """Adds relevance, freshness, trust, quality, type_score and total (0 to 100, 6 places).

    Reads base_relevance and type_match besides the columns above; a null type_match is that of no type.
    """
    w = weights or config.DEFAULTS["scoring"]
    cut = config.DEFAULTS["image_types"]["fallback_penalty"] if penalty is None else penalty
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    typed = F.coalesce(F.col("type_match"), F.lit(0.5))
    match = F.when(F.col("fallback_only"), F.greatest(F.lit(0.0), unit(typed) - cut)).otherwise(unit(typed))
    rel = F.when(F.col("type_match").isNotNull(), unit(0.55 * F.col("base_relevance") + 0.45 * match)).otherwise(F.col("base_relevance"))
    newest = F.max("fetched_at").over(Window.partitionBy("item_id"))
    fresh = F.when(F.col("image_type").isin("game_cg", "gameplay_screenshot"), 0.5).otherwise(text.freshness(F.col("published_at"), newest))
    trust = unit(F.coalesce(F.col("officiality"), rules(*[(F.col("source_type") == k, v) for k, v in DEFAULT_TRUST.items()], otherwise=0.0)))
    size = F.when((F.col("width") > 0) & (F.col("height") > 0), unit(F.least(F.col("width") / 1280.0, F.col("height") / 720.0))).otherwise(0.5)
    quality = F.when(F.col("detail").isNotNull(), 0.7 * size + 0.3 * unit(F.col("detail"))).otherwise(size)
    total = 100 * (w["relevance"] * F.col("relevance") + w["freshness"] * F.col("freshness") + w["source_trust"] * F.col("trust") + w["quality"] * F.col("quality"))
    # penalties are parts of the total score too; both are 0 unless an overlay sets them
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double") if c in candidates.columns else F.lit(0.0)
    if w.get("duplicate_penalty") or w.get("risk_penalty"):
        total = total - 100 * (w.get("duplicate_penalty", 0.0) * flag("duplicate") + w.get("risk_penalty", 0.0) * flag("risk"))
    out = candidates.withColumns({"relevance": rel, "freshness": fresh, "trust": trust, "quality": quality, "type_score": match})
    # the nudge makes halves round up whatever the order of summing
    return out.withColumn("total", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)) + 1e-9, 6))


def pixels() -> Column:
    return F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0))


def rank_order() -> list[Column]:
    return [F.desc("total"), F.desc("trust"), F.desc(F.coalesce("detail", F.lit(0.0))), F.desc(pixels()), F.asc("candidate_id")]


def rank(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*rank_order())))


def representative_order() -> list[Column]:
    area = F.least(F.coalesce("width", F.lit(0)), F.lit(1280)) * F.least(F.coalesce("height", F.lit(0)), F.lit(720))
    return [F.desc("x_photo"), F.desc("auto_select"), F.desc(F.coalesce("entity_match", F.lit(False))), F.desc(F.coalesce("detail", F.lit(0.0))), F.desc(area), F.desc("total"), F.asc("candidate_id")]


def exact_duplicates(scored: DataFrame, hash_col: str = "sha256") -> DataFrame:
    """Adds duplicate_of: the group's first candidate with the same hash in representative order, or null."""
    w = Window.partitionBy("item_id", hash_col).orderBy(*representative_order())
    first = F.first("candidate_id").over(w)
    return scored.withColumn("duplicate_of", F.when(F.col(hash_col).isNotNull() & (first != F.col("candidate_id")), first))


def leaders(rows: DataFrame, group: str, key: str, order: str, parts: list[str], distance: int, hot: int = 10_000) -> DataFrame:
    """Greedy leader dedup of each group in an order: (group, key) of those that are within `distance` bits of no earlier leader.

    parts: long columns that together hold the hash. Not transitive: only leaders suppress. The fold is native; the
    number of leaders bounds its cost, so groups of equal hashes are reduced to their first row before it. A group of
    more than `hot` distinct hashes runs as a pandas fold of numpy comparisons with the leaders.
    """
    first = F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("k")))
    distinct = rows.groupBy(group, *parts).agg(first.alias("f")).select(group, *parts, "f.o", "f.k")
    near = lambda a, x: sum((F.bit_count(a[p].bitwiseXOR(x[p])) for p in parts[1:]), F.bit_count(a[parts[0]].bitwiseXOR(x[parts[0]]))) <= distance
    packed = distinct.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("o", "k", *parts))).alias("xs"))
    kind = packed.schema["xs"].dataType.simpleString()
    folded = F.aggregate("xs", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda a: near(a, x)), acc).otherwise(F.array_append(acc, x)))
    small = packed.where(F.size("xs") <= hot).select(group, F.explode(folded).alias("x")).select(group, F.col("x.k").alias(key))

    def fold(pdf):
        import numpy as np

        pdf = pdf.sort_values(["o", "k"])
        values = pdf[parts].to_numpy(np.int64)
        kept: list[int] = []
        held = np.empty_like(values)
        for i, v in enumerate(values):
            if not kept or np.bitwise_count(held[: len(kept)] ^ v).sum(axis=1).min() > distance:
                held[len(kept)] = v
                kept.append(i)
        return pdf.iloc[kept][[group, "k"]].rename(columns={"k": key})

    big = packed.where(F.size("xs") > hot).select(group, F.inline("xs"))
    spec = f"{group} {rows.schema[group].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}"
    return small.unionByName(big.groupBy(group).applyInPandas(fold, spec))


def allocate(scored: DataFrame, limits: dict | None = None, cap: int | None = None, minimum: float | None = None) -> DataFrame:
    """Adds selected and slot: type limits and the cap of each item, as two stacked windows.

    X photos come first and have no type limit, but count towards that of their type's other candidates; localized
    screenshots have the item's cap. Where an item has a candidate that is no
    fallback, its fallbacks are out. Rows with auto_select false, a type limit of 0 or a total under the minimum never count.
    """
    s = config.DEFAULTS["selection"]
    limits, cap, minimum = limits or s["type_limits"], cap or s["per_item_max"], s["minimum_score"] if minimum is None else minimum
    by_type = rules(*[(F.col("image_type") == k, v) for k, v in limits.items()], otherwise=cap)
    limit = rules((F.col("x_photo"), cap), (F.col("localized") & (F.col("image_type") == "gameplay_screenshot"), cap), otherwise=by_type)
    order = [F.desc("x_photo"), F.desc(F.col("localized").cast("int")), F.asc(F.col("image_type") == "background_art"), F.desc("total"), F.desc("trust"), F.desc(pixels()), F.asc("candidate_id")]
    eligible = F.col("auto_select") & (limit > 0) & (F.col("total").isNull() | (F.col("total") >= minimum))
    item = Window.partitionBy("item_id")
    out = scored.withColumn("eligible", eligible)
    preferred = F.max(F.col("eligible") & ~F.col("fallback_only")).over(item)
    out = out.withColumn("in_play", F.col("eligible") & (~F.col("fallback_only") | ~preferred))
    out = out.withColumn("type_rank", F.row_number().over(Window.partitionBy("item_id", "image_type", "in_play").orderBy(*order)))
    out = out.withColumn("within", F.col("in_play") & (F.col("x_photo") | (F.col("type_rank") <= limit)))
    out = out.withColumn("slot", F.row_number().over(Window.partitionBy("item_id", "within").orderBy(*order)))
    return out.withColumn("selected", F.col("within") & (F.col("slot") <= cap)).drop("eligible", "in_play", "type_rank", "within")


def shortfall(items: DataFrame, selected: DataFrame, minimum: int | None = None) -> DataFrame:
    """One row: how many selections are missing over all items, those without any included."""
    low = config.DEFAULTS["selection"]["min_images"] if minimum is None else minimum
    n = selected.where("selected").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.join(n, "item_id", "left").agg(F.coalesce(F.sum(F.greatest(F.lit(0), low - F.coalesce("n", F.lit(0)))), F.lit(0)).cast("long").alias("shortfall"))


def number_names(rows: DataFrame, group: str, order: list[Column], out: str = "number") -> DataFrame:
    """Two-digit positions within a group, as export names have them."""
    return rows.withColumn(out, F.lpad(F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("string"), 2, "0"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)


def round_robin(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows, taking one of each group in turn."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return turn.orderBy("turn", group).limit(n)
