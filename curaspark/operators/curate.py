"""Curation: typed candidates with their evidence, through decision, trust, linking, quality and entity, to dedup and allocation.

Every candidate comes back with its status and the reasons for it; nothing is dropped. One join with the items, then
windows over the item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark import config
from curaspark.functions import text
from curaspark.operators import classify, evidence, image_need, image_types, near, selection
from curaspark.session import written

# What an item's text asks for, in order of the requirements.
ANNOUNCING = r"贺图|賀圖|纪念图|紀念圖|应援图|應援圖|倒计时图|倒計時圖|周年|週年|commemorative|celebration|anniversary"
SELLING = r"周边|周邊|商品|グッズ|goods|shop|merchandise"
NEW_CG = r"cg\s*(?:公开|公開|更新|追加|新增)|新\s*cg|(?:特殊)?(?:场景|場景|事件|イベント|シーン)\s*cg|画面公开|畫面公開|游戏截图公开|遊戲截圖公開|gallery\s*更新|ギャラリー更新"
RELEASING = r"发售|発売|预约|預約|登陆steam|登录steam|上架steam|steam上线|steam上線"
STRICT_TIERS = ["official_brand_page", "official_store"]
STRONG_EVIDENCE = ["entity_name_in_context", "page_context", "steam_app_id_match", "explicit_entity_signal", "official_news_linked_goods"]
SURE = 0.8


def requirements(text: Column, event: Column, need: Column) -> Column:
    """The kinds of images that an item asks for, in order; text: lower-cased title, body and keywords."""
    has = lambda pattern: F.regexp_like(text, F.lit(pattern))
    found = F.array_compact(F.array(
        F.when(has(ANNOUNCING), "announcement"), F.when((event == "goods") | has(SELLING), "goods"),
        F.when(has(NEW_CG), "cg"), F.when((event == "release") | has(RELEASING), "release"),
    ))
    default = F.when(need == "explicit_new_image", F.array(F.lit("generic"))).otherwise(F.array(F.lit("unknown")))
    return F.when(F.size(found) > 0, found).otherwise(default)


def marks(*cases: tuple[Column, object]) -> Column:
    """The values of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in cases]))


def decided(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Adds has_item, kept, auto_select, fallback_only, type_match, tier, officiality, reasons, reviews and failures.

    candidates: item_id, candidate_id, image_type, type_confidence, source_type, source_url, image_url, page_official, width,
    height, x_photo, animated, invalid_reason, conversion_error, source_linked, match, confidence, why (array); localized and
    localization_auto for screenshots of the localization policy, which has typed them. items: item_id, requirements.
    A candidate without an item is of no known type and waits for review. Null flags count as false.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    wanted = items.groupBy("item_id").agg(F.min("requirements").alias("requirements"), F.lit(True).alias("has_item"))
    c = candidates.join(wanted, "item_id", "left").withColumn("has_item", F.coalesce("has_item", F.lit(False)))
    known = F.col("has_item") | yes("localized")
    c = c.withColumns({
        "image_type": F.when(known, F.coalesce("image_type", F.lit("unknown"))).otherwise("unknown"),
        "type_confidence": F.when(known, F.coalesce("type_confidence", F.lit(0.0))).otherwise(0.0),
        "requirements": F.coalesce("requirements", F.array(F.lit("unknown"))),
    })
    c = c.withColumn("d", classify.decision(F.col("requirements"), F.col("image_type"), F.col("type_confidence")))
    c = c.withColumn("t", classify.trust_tier(F.col("source_type"), F.col("source_url"), F.col("image_url"), yes("page_official")))
    linked, local, fine = yes("source_linked") & F.col("has_item"), yes("localized"), classify.minimum_quality(F.col("width"), F.col("height"))
    c = c.withColumns({"linked": linked, "fine": fine, "priority": yes("x_photo") & linked, "accepted": ~F.col("has_item") | F.col("d.accepted"), "typed": F.col("has_item") & F.col("d.auto_select")})
    invalid, failed, animated, first = F.col("invalid_reason").isNotNull(), F.col("conversion_error").isNotNull(), yes("animated"), F.col("priority")
    clash = F.col("has_item") & F.coalesce(~F.col("match"), F.lit(False))
    open_ = F.col("has_item") & F.col("match").isNull()
    weak = F.col("has_item") & yes("match") & ((~F.col("t.is_official") & (F.coalesce("confidence", F.lit(0.0)) < SURE)) | (F.col("t.tier").isin(STRICT_TIERS) & ~F.coalesce(F.arrays_overlap("why", F.array(*map(F.lit, STRONG_EVIDENCE))), F.lit(False))))
    auto = (first | (F.col("typed") & F.col("fine"))) & F.col("linked") & ~animated & ~invalid & ~failed & (first | ~(open_ | weak))
    out, refused = clash & ~first, ~F.col("accepted") & ~first
    reasons = marks(
        (~F.col("typed") & ~invalid, F.when(F.col("type_confidence") < SURE, "type_evidence_insufficient").otherwise("automatic_type_selection_disabled")),
        (first, "socialdata_x_photo_priority"), (~F.col("linked"), "source_not_linked_to_news"), (F.col("image_type") == "decorative", "decorative_asset_not_auto_selected"),
        (animated, "animated_source_requires_review"), (~F.col("fine"), "below_minimum_resolution"), (invalid, F.concat(F.lit("invalid:"), "invalid_reason")),
        (failed, "review_image_conversion_failed"), (clash & first, "socialdata_x_photo_source_overrides_entity_classifier"), (out, "entity_conflict"), (open_, "entity_unverified"),
        (refused & ~out, F.concat(F.lit("image_type_rejected:"), "image_type")),
    )
    reviews = marks(
        (~F.col("linked") | ((open_ | weak) & ~first), "uncertain_match"), (~F.col("fine"), "image_quality_review"),
        (animated | ~F.col("has_item") | F.col("d.requires_review") & F.col("accepted"), "image_type_review"),
    )
    failures = marks(
        (~F.col("linked"), "news_source_unlinked"), (~F.col("fine") & ~first, "image_quality_below_auto_select_threshold"), (out, "entity_mismatch"),
        ((open_ | weak) & ~first, "entity_unverified"), (refused & ~out, "image_type_rejected"),
    )
    local_auto, none = yes("localization_auto") & ~invalid, F.array().cast("array<string>")
    branch = lambda there, here: F.when(local, there).otherwise(here)
    score = F.when(~F.col("has_item"), 0.1).when(F.col("d.accepted"), F.col("d.type_match")).otherwise(0.0)
    return c.withColumns({
        "kept": branch(F.lit(True), ~out & ~refused), "auto_select": branch(local_auto, auto & ~out & ~refused),
        "fallback_only": branch(F.lit(False), F.col("has_item") & F.col("accepted") & F.col("d.fallback_only") & ~first),
        "type_match": branch(F.when(local_auto, 1.0).otherwise(0.5), score), "tier": branch(F.lit(None).cast("string"), F.col("t.tier")),
        "officiality": branch(F.lit(0.85), F.col("t.officiality")), "reasons": branch(none, reasons),
        "reviews": branch(marks((~local_auto, "image_type_review")), reviews), "failures": branch(none, failures), "localized": local, "entity_match": F.col("match"),
    }).drop("d", "t", "linked", "fine", "priority", "accepted", "typed", "requirements")


def _same_files(c: DataFrame) -> DataFrame:
    """duplicate_of by equal file hashes alone."""
    lead = lambda *by: F.first("candidate_id").over(Window.partitionBy("item_id", "sha256", *by).orderBy(*selection.representative_order()))
    c = c.withColumn("lead", F.when(F.col("auto_select"), lead("kept", "auto_select")).otherwise(lead("kept")))
    twin = F.col("kept") & F.col("sha256").isNotNull() & (F.col("lead") != F.col("candidate_id"))
    return c.withColumn("duplicate_of", F.when(twin, F.col("lead"))).drop("lead")


def _same_scenes(c: DataFrame, history: DataFrame, confirm: Callable[[Column, Column], Column]) -> DataFrame:
    """duplicate_of by files and confirmed scenes, and the review of what history has: two elections over one table."""
    c, _ = written(c, "curated")
    fields = ["item_id", "candidate_id", "sha256", "phash", "picture", "x_photo", "auto_select", "entity_match", "detail", "width", "height", "total"]
    found = lambda rows, out: near.representatives(rows.select(*fields), history, confirm).select("candidate_id", F.col("duplicate_of").alias(out), F.col("historical").alias(f"{out}_old"))
    every, able = found(c.where("kept"), "of_all"), found(c.where("kept and auto_select"), "of_able")
    c = c.join(every, "candidate_id", "left").join(able, "candidate_id", "left")
    old = F.coalesce("of_all_old", F.lit(False))
    reviews = F.when(old, F.array_append("reviews", F.lit("historical_duplicate"))).otherwise(F.col("reviews"))
    return c.withColumns({"duplicate_of": F.when(F.col("auto_select"), F.col("of_able")).otherwise(F.col("of_all")), "reviews": reviews}).drop("of_all", "of_able", "of_all_old", "of_able_old")


def curate(candidates: DataFrame, items: DataFrame, cap: int | None = None, scenes: tuple[DataFrame, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """decided(), scored, deduplicated within the item and allocated: adds total, duplicate_of, selected, status and the last reasons.

    Reads base_relevance, sha256, detail, published_at and fetched_at besides. Candidates that may be selected are
    deduplicated among themselves, the others against all that are kept: by file, or with scenes (history, confirm) by confirmed
    near copies too, which reads phash and picture (see near.representatives).
    """
    cap = cap or config.DEFAULTS["selection"]["per_item_max"]
    c = selection.score(decided(candidates, items)).withColumn("total", F.when(F.col("has_item"), F.col("total")))
    c = _same_scenes(c, *scenes) if scenes else _same_files(c)
    c = c.withColumn("may", F.col("auto_select")).withColumn("auto_select", F.col("may") & F.col("duplicate_of").isNull())
    c = selection.allocate(c, cap=cap)
    full = F.sum(F.col("selected").cast("int")).over(Window.partitionBy("item_id")) >= cap
    invalid = F.col("invalid_reason").isNotNull()
    last = F.when(invalid, F.lit(None)).when(F.col("duplicate_of").isNotNull(), "duplicate_of_better_candidate").when(F.col("selected"), "selected_by_rank_and_policy").when(F.size("reasons") == 0, F.when(full, "news_selection_limit").otherwise("type_limit_or_minimum_score"))
    status = classify.rules((invalid, "invalid"), (~F.col("kept"), "filtered"), (F.col("selected"), "selected"), otherwise="unselected")
    return c.withColumns({"reasons": F.array_compact(F.concat("reasons", F.array(last))), "status": status, "auto_select": F.col("may")}).drop("may", "slot")


def curate_evidence(candidates: DataFrame, items: DataFrame, scenes: tuple[DataFrame, Callable[[Column, Column], Column]] | None = None, cap: int | None = None) -> DataFrame:
    """curate() of candidates and items as evidence.py has them: image types, entity evidence and what items ask for come from their
    addresses, texts and page evidence. candidates also have candidate_id and what curate() reads of downloads and sizes."""
    typed = image_types.image_types(candidates, items).withColumnRenamed("confidence", "type_confidence")
    tied = evidence.entity_evidence(typed, items)
    said = F.concat_ws(" ", "title", "body", F.array_join(evidence.strings(F.col("keywords")), " "))
    need = image_need.image_need(F.concat_ws("\n", "title", "body"))["need"]
    wanted = items.select("item_id", requirements(text.nfkc_casefold(said), F.col("event_type"), need).alias("requirements"))
    return curate(tied, wanted, cap, scenes)
