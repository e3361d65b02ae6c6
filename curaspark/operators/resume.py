"""State that is carried over: established identities, what a resumed run has to do, derived values that are reset, moved assets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signals that an earlier decision derived, those that a snapshot restores, and failures that a download explains.
DERIVED = [
    "localization_qualified", "localization_rank_priority", "image_type_supporting_signals", "type_match", "auto_select", "fallback_only", "entity_match", "entity_match_confidence", "entity_match_evidence",
    "entity_conflict", "official_domain_match", "source_tier", "source_is_official", "source_linked", "candidate_status", "quality_eligible", "duplicate_of", "duplicate_kind", "duplicate_reason", "possible_duplicate_of",
]
RESTORED = ["gallery_path", "gallery_evidence_source", "gallery_evidence_from", "media_variant_of", "root_source_url", "parent_source_url"]
SNAPSHOT, DOWNLOAD_FAILED = "gallery_recovery_original", "download_failed"

ESTABLISHED = "item_id long, kind string, work_id string"


def established(proofs: DataFrame, known: DataFrame) -> DataFrame:
    """(item_id, kind, work_id): the identity of an item in each database. What is known stays; else the first confirmed and linked proof.

    proofs: item_id, kind, place, work_id, confirmed, linked. known: item_id, kind, work_id.
    """
    first = proofs.where("confirmed and linked and work_id is not null").groupBy("item_id", "kind").agg(F.min_by("work_id", F.struct("place", "work_id")).alias("found"))
    return first.join(known.groupBy("item_id", "kind").agg(F.min("work_id").alias("had")), ["item_id", "kind"], "full").select("item_id", "kind", F.coalesce("had", "found").alias("work_id"))


def established_stream(proofs: DataFrame) -> DataFrame:
    """The same over a stream of proofs: an identity that a batch has established is never replaced, and is sent once.

    The state of a key is one text. Within a batch the least place counts.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for pdf in frames:
            fit = pdf[pdf["confirmed"] & pdf["linked"] & pdf["work_id"].notna()]
            for place, work in zip(fit["place"], fit["work_id"], strict=True):
                best = min(best, (place, work)) if best else (place, work)
        if best:
            state.update((best[1],))
            yield pd.DataFrame({"item_id": [key[0]], "kind": [key[1]], "work_id": [best[1]]})

    return proofs.groupBy("item_id", "kind").applyInPandasWithState(fold, ESTABLISHED, "work_id string", "append", "NoTimeout")


def resumption(items: DataFrame, completed: DataFrame, candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """(item_id, action): skip what is complete, reopen what has assets to fetch again, run the rest; unrecoverable items lack the media to do so.

    candidates: item_id, needs_download. failures: item_id, code. An item whose downloads failed and that has no
    candidates cannot be repaired by itself.
    """
    media = candidates.groupBy("item_id").agg(F.max("needs_download").alias("repair"))
    lost = failures.where(F.col("code") == DOWNLOAD_FAILED).select("item_id", F.lit(True).alias("lost")).distinct()
    done = completed.select("item_id", F.lit(True).alias("done")).distinct()
    out = items.select("item_id").join(done, "item_id", "left").join(media, "item_id", "left").join(lost, "item_id", "left")
    repair, is_lost, is_done = (F.coalesce(c, F.lit(False)) for c in ("repair", F.col("lost") & F.col("repair").isNull(), "done"))
    return out.select("item_id", F.when(repair, "reopen").when(is_lost, "unrecoverable").when(is_done, "skip").otherwise("run").alias("action"))


def reset_signals(signals: Column) -> Column:
    """A map of texts without what was derived; members that a recovery changed come back from its snapshot (JSON), or go."""
    snapshot = F.from_json(F.try_element_at(signals, F.lit(SNAPSHOT)), F.lit("signals map<string,string>"))["signals"]
    had = F.map_contains_key(signals, SNAPSHOT)
    kept = F.map_filter(signals, lambda k, v: ~k.isin([*DERIVED, SNAPSHOT]) & ~(had & k.isin(RESTORED)))
    back = F.map_filter(F.coalesce(snapshot, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(RESTORED) & v.isNotNull())
    return F.when(F.coalesce(had, F.lit(False)), F.map_concat(kept, back)).otherwise(kept)


def rebased(column: Column, kind: T.DataType, old: str, new: str) -> Column:
    """A column of any nested type whose texts that are paths under `old` lie under `new`; paths with '..' below it stay."""
    if isinstance(kind, T.StringType):
        root = old.rstrip("/")
        below = F.substr(column, F.lit(len(root) + 2))
        # an empty or dotted part is no step of a path
        parts = F.filter(F.split(below, "/"), lambda p: ~p.isin("", "."))
        inside = (column == root) | F.startswith(column, F.lit(root + "/"))
        moved = F.array_join(F.concat(F.array(F.lit(new.rstrip("/"))), F.when(column == root, F.array().cast("array<string>")).otherwise(parts)), "/")
        return F.when(inside & ~F.array_contains(parts, ".."), moved).otherwise(column)
    if isinstance(kind, T.StructType):
        fields = F.struct(*[rebased(column[f.name], f.dataType, old, new).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: rebased(x, kind.elementType, old, new))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda k, v: rebased(v, kind.valueType, old, new))
    return column


def rebase(rows: DataFrame, old: str, new: str) -> DataFrame:
    """All texts of all columns, however deep, rebased; names of map entries stay."""
    return rows.select(*[rebased(F.col(f"`{f.name}`"), f.dataType, old, new).alias(f.name) for f in rows.schema.fields])


def recovered(path: Column, root: str) -> Column:
    """Where a recorded asset lies under root (a task's raw folder), or null: no '..'; publishing folders beside root lead back into it."""
    parent = root.rstrip("/").rsplit("/", 1)[0]
    work = f"{parent}/.work/"
    suffix = F.split(F.substr(path, F.lit(len(work) + 1)), "/")
    staged = F.when(F.regexp_like(suffix[0], F.lit("^publish-[A-Za-z0-9_-]+$")) & (F.size(suffix) >= 2), F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice(suffix, F.lit(2), F.greatest(F.size(suffix) - 1, F.lit(0))), "/")))
    whole = F.when(F.startswith(path, F.lit(work)), staged).when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    confined = F.startswith(whole, F.lit(root.rstrip("/") + "/")) & ~F.array_contains(F.split(path, "/"), "..")
    return F.when(F.coalesce((path != "") & confined, F.lit(False)), whole)


def recover(rows: DataFrame, path_col: str, hash_col: str, root: str, assets: DataFrame) -> DataFrame:
    """Adds asset: the recovered path if assets (path, sha256) has it, with the expected hash where one is known."""
    found = rows.withColumn("__path", recovered(F.col(path_col), root))
    there = assets.select(F.col("path").alias("__path"), F.col("sha256").alias("__sha"))
    fits = F.col("__sha").isNotNull() & (F.col(hash_col).isNull() | (F.col(hash_col) == F.col("__sha")))
    return found.join(there, "__path", "left").withColumn("asset", F.when(fits, F.col("__path"))).drop("__path", "__sha")
