"""The type of an image and how sure it is, from its own words, its page's evidence, its name and its shape.

Ordered rules over the candidate and its item (see evidence.py for their columns, and width, height): the first that holds
decides. "Near" text is what belongs to the image alone; "all" text has its page's words too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark import config
from curaspark.functions import text, urls
from curaspark.operators import evidence
from curaspark.operators.classify import rules

# Words and patterns that results depend on.
LOGO = ["logo", "brand-logo", "site-logo", "logo_mark"]
BANNER = ["banner", "bnr", "header", "footer", "mainvisual-banner", "campaign-banner"]
UI = ["button", "btn", "icon", "arrow", "menu", "navigation", "loading", "spinner", "favicon", "steam_share_image"]
GOODS = ["goods", "shop", "store", "product", "item", "tokuten", "tapestry", "acrylic", "badge", "standee", "merchandise", "stand", "figure", "フィギュア", "手办", "手辦", "特典", "商品", "周边", "周邊"]
COVER = ["cover", "package", "jacket", "box", "pkg", "capsule"]
KEY_VISUAL = ["keyvisual", "key_visual", "mainvisual", "main_visual", "kv", "visual"]
CHARACTER = ["character", "chara", "standing", "sprite", "tachie", "立绘", "立繪"]
SCREENSHOT = ["screenshot", "screenshots", "screen", "sample", "play", "ingame", "in_game"]
VAGUE_SCREENSHOT = ["sample", "play"]
PHOTO = ["photo", "photograph", "realphoto", "cosplay", "照片", "写真", "实拍", "實拍"]
ANNOUNCEMENT = ["announcement", "commemorative", "celebration", "anniversary", "贺图", "賀圖", "纪念图", "紀念圖", "应援图", "應援圖", "倒计时图", "倒計時圖"]
STEAM_GOODS = ["store", "item"]
ROLES = {
    "game_cg": "game_cg", "background_art": "background_art", "decorative": "decorative", "goods": "goods", "logo": "logo", "character": "character_art", "character_art": "character_art",
    "cover": "cover", "key_visual": "key_visual", "announcement_art": "announcement_art", "screenshot": "gameplay_screenshot", "gameplay_screenshot": "gameplay_screenshot", "banner": "banner", "ui": "ui",
}
METHODS = ["dom", "script", "browser"]
SHARE_STEM = r"^(?:ogp|og[_-]?image|share[_-]?image|twitter[_-]?card)(?:$|[_-])"
ALT_ROLES = [("logo", r"\blogo\b|ロゴ|标志"), ("banner", r"\bbanner\b|バナー|横幅"), ("character_art", r"standing\s+(?:sprite|art)|立绘|立繪")]
GALLERY, SCENE_NAME = r"gallery|ギャラリー|ギャラリ", r"(?:^|[/_.-])(?:cg|ev|event|scene)(?:[_-]?\d+|cg)?(?:[/_.-]|$)"
STEAM_SHOT = r"screenshots?|(?:^|[/_.-])ss(?:[_-]?\d+)?(?:[/_.-]|$)"
PROMOTION_STEM, CHARACTER_STEM = r"(?:^|[_-])(?:quiz|countdown)(?:$|[_-])", r"^(?:character|chara|standing|sprite|tachie)[_-]?[0-9]+(?:$|[_-])"
GIFT = r"贺图|賀圖|纪念图|紀念圖|应援图|應援圖|倒计时图|倒計時圖|周年|週年|anniversary|commemorative|celebration"
EXPLICIT_CG, OWN_CG, PAGE_CG = r"event.?cg|イベントcg", r"(?:event\s*)?cg|イベントcg", r"(?:event\s*)?cg|イベントcg|game\s*cg"
GROUP_SIGNALS, GROUP_SIZE = ["gallery_image_count", "gallery_group_size", "similar_gallery_images"], 2
DERIVED_SIGNALS = [
    "image_type_supporting_signals", "type_match", "auto_select", "fallback_only", "entity_match", "entity_match_confidence", "entity_match_evidence", "entity_conflict", "official_domain_match",
    "source_tier", "source_is_official", "source_linked", "candidate_status", "duplicate_of", "duplicate_kind", "possible_duplicate_of", "invalid_reason", "quality_eligible", "root_source_url",
    "parent_source_url", "source_chain_alternates", "conversion_error", "sharpness_score", "visible_detail_score", "animated_source", "animation_frame_count", "quality_analysis_failed",
    "gallery_evidence_source", "gallery_evidence_from", "media_variant_of", "gallery_excluded_reason", "gallery_recovery_original", "navigation_kind", "navigation_text",
]
PAGE_SIGNALS = ["page_title", "title", "description", "brand", "game_name", "entity", "source_discovery"]


def _address_words(u: Column) -> Column:
    """Path and query of an address; an official site's /product/brand/title/ route says nothing about the image."""
    parts = F.filter(F.split(urls.path(u), "/"), lambda x: x != "")
    route = (F.col("source_type") == "official_site") & (F.size(parts) >= 3) & F.lower(F.get(parts, F.lit(0))).isin("product", "products")
    rest = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    return F.concat_ws(" ", F.when(F.coalesce(route, F.lit(False)), rest).otherwise(urls.path(u)), urls.query(u))


def _signal_words(near: bool) -> Column:
    """Names of signals and their texts: what is derived or, for near text, of the page is left out."""
    left_out = DERIVED_SIGNALS + (PAGE_SIGNALS if near else [])
    kept = F.filter(F.map_entries("signals"), lambda e: ~e["key"].isin(left_out) & ~F.startswith(e["key"], F.lit("visual_shadow_")))
    return F.array_join(F.transform(kept, lambda e: F.concat_ws(" ", e["key"], e["value"]["s"])), " ")


def _any(x: Column, terms: list[str]) -> Column:
    return text.first_term(x, terms).isNotNull()


def _like(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(pattern))


def image_types(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Adds image_type and confidence to candidates; under the minimum confidence the type is unknown."""
    types = config.DEFAULTS["image_types"]
    fold = text.nfkc_casefold
    c = evidence.joined(candidates, items)
    image, page = F.col("image_url"), F.col("source_url")
    own = F.concat_ws(" ", F.nullif("image_alt", F.lit("")), F.nullif("nearby_text", F.lit("")))
    c = c.withColumns({
        "all_text": fold(F.concat_ws(" ", _address_words(image), _address_words(page), _signal_words(False), own)), "near_text": fold(F.concat_ws(" ", _address_words(image), _signal_words(True), own)),
        "item_text": fold(F.concat_ws(" ", "title", "body", F.array_join("keywords", " "))), "alt_text": fold(F.coalesce("image_alt", F.lit(""))), "own_text": fold(own),
        "stem": F.lower(F.regexp_replace(F.element_at(F.split(urls.path(image), "/"), -1), r"\.[^.]*$", "")), "shop_path": F.lower(urls.path(page)), "linked": evidence.linked_work(True), "page_linked": evidence.linked_work(False),
        "folded_page_title": fold(F.coalesce(evidence.signal_text("page_title"), F.lit(""))), "card": evidence.product_card(), "game_letters": F.split(fold(F.array_join("game_names", evidence.SEPARATOR)), evidence.SEPARATOR),
        "aspect": F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") / F.col("height")),
    })
    role_of, key = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), urls.source_key(page)
    roles = F.transform(F.filter("evidence", lambda e: e["method"].isin(METHODS) & (urls.source_key(e["page_url"]) == key)), lambda e: F.try_element_at(role_of, F.trim(F.lower(e["role"]))))
    c = c.withColumn("roles", F.coalesce(F.array_compact(roles), F.array().cast("array<string>")))
    near, everything, stem, aspect = F.col("near_text"), F.col("all_text"), F.col("stem"), F.col("aspect")
    has = lambda r: F.array_contains("roles", r)
    official, steam = (F.coalesce(F.col("source_type") == t, F.lit(False)) for t in ("official_site", "steam"))
    known = lambda x: F.coalesce(x, F.lit(False))
    extreme = known((aspect >= types["banner_aspect_ratio"]) | (aspect <= 1 / types["banner_aspect_ratio"]))
    other_meaning = _any(everything, GOODS + COVER + CHARACTER + KEY_VISUAL + SCREENSHOT + PHOTO + ANNOUNCEMENT) | _like(everything, f"{GALLERY}|{SCENE_NAME}")
    goods_words = lambda x: F.when(steam, _any(x, [t for t in GOODS if t not in STEAM_GOODS])).otherwise(_any(x, GOODS))
    goods = goods_words(near) | (~official & goods_words(F.col("shop_path")))
    shot = _any(everything, [t for t in SCREENSHOT if t not in VAGUE_SCREENSHOT])
    signal = lambda k: F.coalesce(evidence.number(k) != 0, evidence.signal_text(k) != "", F.lit(False))
    gallery = _like(everything, GALLERY) | signal("gallery") | signal("gallery_path")
    scene_name = _like(everything, SCENE_NAME)
    parser_cg = known(evidence.number("cg_match") >= 0.8)
    own_cg = _like(F.col("own_text"), OWN_CG)
    page_cg = _like(F.col("folded_page_title"), PAGE_CG) & F.exists("game_letters", lambda n: (n != "") & F.contains(F.col("folded_page_title"), n))
    strong = parser_cg | F.col("linked") | page_cg | own_cg
    group = known(F.greatest(*[evidence.number(k) for k in GROUP_SIGNALS]) >= GROUP_SIZE)
    scene = known(aspect >= types["scene_aspect_ratio"])
    support = scene_name | signal("cg_match") | _like(everything, EXPLICIT_CG) | group | scene | F.col("linked")
    excluded = F.coalesce(evidence.signal_text("gallery_excluded_reason"), F.lit("")) != ""
    cg = ~excluded & (own_cg | parser_cg | (gallery & support) | (scene_name & ~_any(everything, LOGO + BANNER + GOODS)))
    likely = gallery | scene_name | group | scene
    character, visual = _any(near, CHARACTER), _any(near, KEY_VISUAL)
    narrow = known(aspect <= 1 / types["character_aspect_ratio"]).cast("int") + evidence.is_true("transparent").cast("int")
    tall = known(aspect < 1 / types["character_aspect_ratio"])
    out = lambda t, x: F.struct(F.lit(t).alias("image_type"), (x if isinstance(x, Column) else F.lit(float(x))).alias("confidence"))
    found = rules(
        (text.has_term(near, "steam_share_image"), out("ui", 1)),
        (_like(stem, SHARE_STEM) | evidence.is_true("social_share_image"), out("ui", 0.98)),
        (has("decorative"), out("decorative", 0.98)),
        *[(_like(F.col("alt_text"), pattern), out(t, 0.95)) for t, pattern in ALT_ROLES],
        *[(has(t), out(t, 0.95)) for t in ("logo", "character_art", "cover", "banner", "ui")],
        (has("goods") & F.col("card"), out("goods", 0.96)),
        (has("background_art") & official & F.col("page_linked"), out("background_art", 0.92)),
        (has("background_art"), out("unknown", 0)),
        *[(has(t), out(t, 0.95)) for t in ("key_visual", "announcement_art", "gameplay_screenshot")],
        (has("game_cg"), out("game_cg", F.when(F.col("linked"), 0.92).otherwise(0.68))),
        (_any(near, UI), out("ui", 0.98)),
        (_any(near, LOGO), out("logo", 0.98)),
        (_any(near, BANNER) | (extreme & ~other_meaning), out("banner", F.when(extreme, 0.98).otherwise(0.94))),
        (steam & _like(everything, STEAM_SHOT), out("gameplay_screenshot", 0.93)),
        (goods, out("goods", F.when(official & ~goods_words(F.col("own_text")), 0.68).otherwise(0.96))),
        (_any(near, COVER), out("cover", F.when(tall, 0.96).otherwise(0.91))),
        (shot, out("gameplay_screenshot", 0.93)),
        (_like(stem, PROMOTION_STEM), out("announcement_art", 0.92)),
        (_like(stem, CHARACTER_STEM), out("character_art", 0.93)),
        (_any(everything, ANNOUNCEMENT) & (_like(F.col("item_text"), GIFT) | F.contains(everything, F.lit("announcement"))), out("announcement_art", 0.94)),
        (cg & ~_any(near, CHARACTER + KEY_VISUAL), out("game_cg", F.when(strong, 0.92).when(likely, 0.68).otherwise(0.0))),
        (character, out("character_art", F.round(0.9 + 0.03 * narrow, 6))),
        (visual, out("key_visual", 0.92)),
        (cg, out("game_cg", F.when(likely, 0.68).otherwise(0.0))),
        (_any(everything, PHOTO), out("photo", 0.9)),
        otherwise=out("unknown", 0),
    )
    low = found["confidence"] < types["minimum_type_confidence"]
    c = c.withColumn("x", F.when(low, out("unknown", 0)).otherwise(found))
    return c.select(*candidates.columns, "x.image_type", "x.confidence")
