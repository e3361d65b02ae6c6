"""What ties a candidate to an item, and what type its image has: one case for each rule."""

import pytest
from pyspark.sql import functions as F

from curaspark.operators import evidence, image_types

ITEM = {"title": "《Sakura Days》更新", "body": "", "game_names": ["Sakura Days"], "organizations": [], "keywords": [], "source_urls": ["https://sakura.example/news/1"], "event_type": "update"}
CANDIDATE = {
    "image_url": "https://img.example/a.jpg", "source_url": "https://other.example/p", "source_type": "unverified", "news_source_url": None, "parent_source_url": None, "image_alt": None, "nearby_text": None,
    "signals": {}, "evidence": [], "width": None, "height": None,
}
WORK = "https://sakura.example/product/sd"
CARD = [("goods", "dom", "https://sakura.example/goods/", "div.product-card", "img[src]", "", "")]

CASES = {
    "other shop number": ({"keywords": ["https://store.steampowered.com/app/123"]}, {"image_url": "https://cdn.example/steam/apps/456/x.jpg"}, (False, 1.0, ["steam_app_id_mismatch"], ["456"])),
    "same shop number": ({"keywords": ["https://store.steampowered.com/app/123"]}, {"signals": {"steam_app_id": 123}}, (True, 0.98, ["steam_app_id_match"], [])),
    "two digits are no shop number": ({"keywords": ["/app/12"]}, {"image_url": "https://cdn.example/app/34"}, (None, 0.0, ["no_entity_context"], [])),
    "image linked from the item": ({}, {"source_type": "direct_image", "source_url": "https://sakura.example/news/1/"}, (True, 0.9, ["image_linked_from_news_source"], [])),
    "title of another work": ({}, {"signals": {"page_title": "Moon Nights"}}, (False, 1.0, [], ["Moon", "Nights"])),
    "generic title": ({}, {"signals": {"page_title": "Gallery CG"}}, (None, 0.0, ["no_entity_context"], [])),
    "named in the title": ({}, {"signals": {"page_title": "Sakura Days"}}, (True, 0.9, ["entity_name_in_context", "page_context"], [])),
    "named in the address": ({}, {"image_url": "https://img.example/sakura%20days.jpg"}, (True, 0.86, ["entity_name_in_context"], [])),
    "named on the domain": ({}, {"source_url": "https://www.sakura.example/sakura-days/", "source_type": "official_site"}, (True, 0.95, ["official_domain_match", "entity_name_in_context"], [])),
    "named on the domain's page": ({}, {"source_url": "https://sakura.example/x", "signals": {"page_title": "Sakura Days"}}, (True, 0.98, ["official_domain_match", "entity_name_in_context", "page_context"], [])),
    "short name": ({"title": "", "game_names": ["Air"]}, {"image_url": "https://img.example/air.jpg"}, (None, 0.0, ["no_entity_context"], [])),
    "short name on a site": ({"title": "", "game_names": ["Air"]}, {"image_url": "https://img.example/air.jpg", "source_type": "official_site"}, (None, 0.0, ["short_name_needs_context"], [])),
    "short name in the text": ({"title": "", "game_names": ["Air"]}, {"nearby_text": "from AIR"}, (True, 0.9, ["entity_name_in_context", "page_context"], [])),
    "site without a name": ({}, {"source_type": "official_site"}, (None, 0.0, ["official_source_without_name"], [])),
    "goods of the item": ({"event_type": "goods", "source_urls": ["https://sakura.example/goods/"]}, {"source_type": "official_site", "source_url": "https://sakura.example/goods/", "news_source_url": "https://sakura.example/goods", "evidence": CARD}, (True, 0.88, ["official_news_linked_goods", "product_card_evidence", "official_source_chain"], [])),
    "goods without a card": ({"event_type": "goods", "source_urls": ["https://sakura.example/goods/"]}, {"source_type": "official_site", "source_url": "https://sakura.example/goods/", "news_source_url": "https://sakura.example/goods"}, (None, 0.0, ["official_domain_match", "no_entity_name"], [])),
    "gallery of the work": ({"source_urls": [WORK + "/"]}, {"source_type": "official_site", "source_url": WORK + "/gallery.html", "signals": {"root_source_url": WORK, "gallery_path": True}}, (True, 0.92, ["official_news_linked_gallery", "official_domain_match"], [])),
    "page of the work": ({"source_urls": [WORK + "/"]}, {"source_type": "official_site", "source_url": WORK + "/story.html", "signals": {"root_source_url": WORK}}, (True, 0.9, ["official_news_linked_work", "official_domain_match"], [])),
    "related works below it": ({"source_urls": [WORK + "/"]}, {"source_type": "official_site", "source_url": WORK + "/related/x.html", "signals": {"root_source_url": WORK, "gallery_path": True}}, (None, 0.0, ["official_domain_match", "no_entity_name"], [])),
    "excluded from the gallery": ({"source_urls": [WORK + "/"]}, {"source_type": "official_site", "source_url": WORK + "/x.html", "signals": {"root_source_url": WORK, "gallery_path": True, "gallery_excluded_reason": "goods"}}, (None, 0.0, ["official_domain_match", "no_entity_name"], [])),
    "database": ({}, {"source_url": "https://vndb.org/v1"}, (True, 0.82, ["trusted_database_context"], [])),
    "a film of that name": ({}, {"signals": {"page_title": "Sakura Days streaming"}}, (False, 1.0, [], ["non_game_media_page"])),
    "asset of another product": ({}, {"source_url": "https://shop.example/products/sakura-days-box", "image_url": "https://shop.example/i/moon-nights.jpg"}, (False, 1.0, [], ["other_product_asset:moon-nights"])),
    "asset without a name": ({}, {"source_url": "https://shop.example/products/sakura-days-box", "image_url": "https://shop.example/i/0123456789abcdef.jpg"}, (True, 0.86, ["entity_name_in_context"], [])),
    "explicit signal": ({}, {"signals": {"game_match": 0.9}}, (True, 0.9, ["game_match", "explicit_entity_signal"], [])),
    "weak signal": ({}, {"signals": {"game_match": 0.7}}, (None, 0.0, ["no_entity_context"], [])),
    "character alone": ({}, {"signals": {"character_match": True}}, (None, 0.0, ["character_match", "no_entity_name"], [])),
    "other brand": ({}, {"signals": {"brand_match": False}}, (False, 1.0, [], ["brand_mismatch"])),
    "named conflicts": ({}, {"signals": {"conflicting_entity": "Moon", "other_title": True, "other_game_name": ""}}, (False, 1.0, [], ["Moon", "other_title"])),
    "publisher in the title": ({"organizations": ["Key Works"]}, {"source_type": "official_site", "signals": {"page_title": "KeyWorks"}}, (None, 0.0, ["official_source_without_name"], [])),
    "chapter's parent": ({"title": "", "game_names": ["Sakura Days Chapter 2"]}, {"image_url": "https://img.example/sakuradays.jpg"}, (True, 0.86, ["entity_name_in_context"], [])),
    "full-width name": ({"title": "", "game_names": ["ＡＢＣＤ　ｅ"]}, {"image_url": "https://img.example/abcd-e.jpg"}, (True, 0.86, ["entity_name_in_context"], [])),
    "numbered host": ({}, {"source_url": "https://9nine-project.example/"}, (False, 1.0, [], ["9-nine"])),
}

TYPES = {
    "share image": ({}, {"image_url": "https://a.example/ogp.png", "evidence": [("game_cg", "dom", "https://other.example/p/", "", "", "", "")]}, ("ui", 0.98)),
    "decoration": ({}, {"evidence": [("game_cg", "dom", "https://other.example/p", "", "", "", ""), ("decorative", "dom", "https://other.example/p", "", "", "", "")]}, ("decorative", 0.98)),
    "evidence of another page": ({}, {"evidence": [("decorative", "dom", "https://other.example/q", "", "", "", "")]}, ("unknown", 0.0)),
    "own words before roles": ({}, {"image_alt": "Site logo", "evidence": [("game_cg", "dom", "https://other.example/p", "", "", "", "")]}, ("logo", 0.95)),
    "standing sprite": ({}, {"image_alt": "standing sprite"}, ("character_art", 0.95)),
    "card with a price": ({}, {"source_type": "official_site", "source_url": "https://sakura.example/goods/", "evidence": CARD}, ("goods", 0.96)),
    "background of the work": ({"source_urls": [WORK]}, {"source_type": "official_site", "source_url": WORK + "/x", "signals": {"root_source_url": WORK}, "evidence": [("background_art", "dom", WORK + "/x", "", "", "", "")]}, ("background_art", 0.92)),
    "background of another": ({}, {"evidence": [("background_art", "dom", "https://other.example/p", "", "", "", "")]}, ("unknown", 0.0)),
    "scene by its place": ({}, {"evidence": [("game_cg", "browser", "https://other.example/p", "", "", "", "")]}, ("game_cg", 0.68)),
    "scene of the work": ({"source_urls": [WORK]}, {"source_type": "official_site", "source_url": WORK + "/x", "signals": {"root_source_url": WORK, "gallery_path": True}, "evidence": [("game_cg", "dom", WORK + "/x", "", "", "", "")]}, ("game_cg", 0.92)),
    "button": ({}, {"image_url": "https://a.example/btn_top.png"}, ("ui", 0.98)),
    "term inside a word": ({}, {"image_url": "https://a.example/lexicon.png"}, ("unknown", 0.0)),
    "wide": ({}, {"width": 1200, "height": 300}, ("banner", 0.98)),
    "tall": ({}, {"width": 300, "height": 1200}, ("banner", 0.98)),
    "wide photo": ({}, {"image_url": "https://a.example/photo1.jpg", "width": 1200, "height": 300}, ("photo", 0.9)),
    "wide scene": ({}, {"image_url": "https://a.example/cg/ev01.jpg", "width": 1200, "height": 300}, ("game_cg", 0.68)),
    "banner by name": ({}, {"image_url": "https://a.example/bnr-01.png"}, ("banner", 0.94)),
    "shop screenshot": ({}, {"source_type": "steam", "image_url": "https://a.example/ss_01.jpg"}, ("gameplay_screenshot", 0.93)),
    "goods by name": ({}, {"image_url": "https://a.example/acrylic1.png"}, ("goods", 0.96)),
    "goods by the page's route": ({}, {"source_url": "https://a.example/shop/1"}, ("goods", 0.96)),
    "goods route of a site": ({}, {"source_type": "official_site", "image_url": "https://a.example/goods/1.png"}, ("goods", 0.68)),
    "product route of a site": ({}, {"source_type": "official_site", "image_url": "https://a.example/product/brand/x.png"}, ("unknown", 0.0)),
    "tall cover": ({}, {"image_url": "https://a.example/package.jpg", "width": 400, "height": 800}, ("cover", 0.96)),
    "square cover": ({}, {"image_url": "https://a.example/package.jpg", "width": 700, "height": 800}, ("cover", 0.91)),
    "screenshot": ({}, {"image_url": "https://a.example/screen-2.jpg"}, ("gameplay_screenshot", 0.93)),
    "sample is vague": ({}, {"image_url": "https://a.example/sample1.jpg"}, ("unknown", 0.0)),
    "countdown": ({}, {"image_url": "https://a.example/x_countdown_3.jpg"}, ("announcement_art", 0.92)),
    "numbered character": ({}, {"image_url": "https://a.example/chara_02.png"}, ("character_art", 0.93)),
    "anniversary": ({"title": "10周年"}, {"image_url": "https://a.example/anniversary.png"}, ("announcement_art", 0.94)),
    "anniversary without such news": ({}, {"image_url": "https://a.example/anniversary.png"}, ("unknown", 0.0)),
    "named scene": ({}, {"image_alt": "Event CG"}, ("game_cg", 0.92)),
    "parser's scene": ({}, {"signals": {"cg_match": 0.9}}, ("game_cg", 0.92)),
    "gallery of a size": ({}, {"signals": {"gallery_path": True, "gallery_image_count": 3}}, ("game_cg", 0.68)),
    "scene on a page that names the work": ({}, {"image_url": "https://a.example/gallery/1.jpg", "width": 1600, "height": 900, "signals": {"page_title": "Sakura Days game CG"}}, ("game_cg", 0.92)),
    "excluded scene": ({}, {"image_url": "https://a.example/cg/1.jpg", "signals": {"gallery_excluded_reason": "news"}}, ("unknown", 0.0)),
    "transparent character": ({}, {"image_url": "https://a.example/img/tachie.png", "width": 300, "height": 800, "signals": {"transparent": True}}, ("character_art", 0.96)),
    "key visual": ({}, {"image_url": "https://a.example/kv.jpg"}, ("key_visual", 0.92)),
    "nothing": ({}, {}, ("unknown", 0.0)),
}


def signals(values):
    return {k: {"s": v if isinstance(v, str) else None, "n": float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None, "b": v if isinstance(v, bool) else None} for k, v in values.items()}


def frames(spark, cases):
    items = [(name, *(ITEM | item).values()) for name, (item, _, _) in cases.items()]
    candidates = [(name, *(CANDIDATE | c | {"signals": signals(c.get("signals", {}))}).values()) for name, (_, c, _) in cases.items()]
    i = spark.createDataFrame(items, "item_id string, title string, body string, game_names array<string>, organizations array<string>, keywords array<string>, source_urls array<string>, event_type string")
    c = spark.createDataFrame(candidates, f"item_id string, image_url string, source_url string, source_type string, news_source_url string, parent_source_url string, image_alt string, nearby_text string, signals map<string,{evidence.SIGNAL}>, evidence array<{evidence.LOCAL}>, width int, height int")
    return c, i


@pytest.fixture(scope="module")
def ties(spark):
    return {r["item_id"]: r for r in evidence.entity_evidence(*frames(spark, CASES)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_evidence(ties, name):
    r = ties[name]
    assert (r["match"], r["confidence"], r["why"], r["conflicts"]) == CASES[name][2]


def test_a_candidate_without_its_item(spark):
    c, i = frames(spark, {"x": ({}, {}, None), "y": ({}, {"signals": {"game_match": 1}}, None)})
    r = evidence.entity_evidence(c, i.where("false")).orderBy("item_id").collect()
    assert [(x["match"], x["why"]) for x in r] == [(None, ["no_entity_context"]), (True, ["game_match", "explicit_entity_signal"])]
    nulls = c.select("item_id", *[F.lit(None).cast(c.schema[x].dataType).alias(x) for x in c.columns[1:]])
    assert [x["match"] for x in evidence.entity_evidence(nulls, i).collect()] == [None, None]


@pytest.fixture(scope="module")
def types(spark):
    return {r["item_id"]: r for r in image_types.image_types(*frames(spark, TYPES)).collect()}


@pytest.mark.parametrize("name", TYPES)
def test_types(types, name):
    assert (types[name]["image_type"], types[name]["confidence"]) == TYPES[name][2]


def test_curation_from_evidence_with_near_copies(spark):
    """Two pictures of one scene and one of another: the better copy represents; history is flagged; types and ties are computed."""
    from curaspark.operators import curate, near

    item = {"source_urls": [WORK + "/"]}
    shot = {"source_type": "official_site", "source_url": WORK + "/gallery.html", "signals": {"root_source_url": WORK, "gallery_path": True, "page_title": "Sakura Days"}, "image_alt": "Event CG", "width": 1280, "height": 720}
    c, i = frames(spark, {n: (item, shot, None) for n in "abcd"})
    gray = {"a": [10] * 64, "b": [11] * 64, "c": [11] * 32 + [200] * 32, "d": [10] * 64}
    more = spark.createDataFrame(
        [(n, 7, (1.0, p), {"a": 0.2, "b": 0.9, "c": 0.5, "d": 0.1}[n], None if n != "d" else "corrupt") for n, p in gray.items()],
        "candidate_id string, phash long, picture struct<aspect double, pixels array<int>>, detail double, invalid_reason string",
    )
    c = c.withColumn("candidate_id", F.col("item_id")).join(more, "candidate_id").withColumn("item_id", F.lit("n"))
    for flag in ("x_photo", "animated", "page_official", "localized", "localization_auto"):
        c = c.withColumn(flag, F.lit(False))
    c = c.withColumns({"conversion_error": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string"), "base_relevance": F.lit(0.6), "published_at": F.lit(None).cast("timestamp"), "fetched_at": F.lit(None).cast("timestamp")})
    news = i.limit(1).withColumn("item_id", F.lit("n"))
    history = spark.createDataFrame([(None, 7)], "sha256 string, phash long")
    out = {r["candidate_id"]: r for r in curate.curate_evidence(c, news, (history, near.pixel_confirmation(8, 4))).collect()}
    assert {n: (r["image_type"], r["match"]) for n, r in out.items()} == {n: ("game_cg", True) for n in "abcd"}
    assert {n: (r["status"], r["duplicate_of"]) for n, r in out.items()} == {"a": ("unselected", "b"), "b": ("selected", None), "c": ("selected", None), "d": ("invalid", "b")}
    assert out["a"]["reasons"] == ["duplicate_of_better_candidate"] and all("historical_duplicate" in r["reviews"] for r in out.values())
