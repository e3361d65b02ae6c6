"""Rule-ordered classifiers as CASE expressions: the first rule that holds decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark import config
from curaspark.functions import text, urls

# Fixed values.
ANNOUNCEMENT = r"更新|公开|公開|公布|新增|追加|发布|發佈|發布|释出|釋出|展示|附上|解禁|登场|登場|掲載|配信|披露|new"
EVENT_PATTERNS = [
    ("localization", r"汉化|漢化|本地化|翻译|翻譯"),
    ("goods", r"周边|周邊|商品|グッズ"),
    ("demo", r"(?i)体验版|體驗版|demo|试玩|試玩"),
    ("release", r"发售|発売|上市|销售|販售"),
    ("event", r"活动|活動|イベント|展会|展覽"),
    ("update", rf"(?i){ANNOUNCEMENT}"),
]
IMPORTANCE = {"new_title": 0.9, "release": 0.8, "demo": 0.75, "update": 0.7, "event": 0.65, "goods": 0.5, "localization": 0.55, "unknown": 0.25}
THIRD_PARTY = ["cbrimages.com", "3dmgame.com", "amazon.com", "media-amazon.com", "images-na.ssl-images-amazon.com", "kunimg.com"]
TRUSTED_DATABASES = ["vndb.org", "vndb.net", "vgmdb.net"]
AGGREGATORS = ["fandom.com", "wikipedia.org", "myanimelist.net", "bangumi.tv", "game8.jp"]
DEFAULT_TRUST = {"official_site": 1.0, "official_x": 0.9, "steam": 0.85, "direct_image": 0.65, "unverified": 0.25}
X_HOSTS = ["x.com", "twitter.com", "www.x.com", "www.twitter.com"]
STEAM_HOSTS = ["store.steampowered.com", "steamcommunity.com"]
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "youtu.be", "bilibili.com", "www.bilibili.com"]
PLACEHOLDERS = ["placeholder", "no_image", "noimage", "no-image", "now_printing", "nowprinting", "dummy", "blank", "spacer", "coming_soon", "comingsoon", "default_image", "loading", "transparent", "pixel"]


def rules(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """CASE over (condition, value) in order; values may be columns or literals."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    first, *rest = cases
    return reduce(lambda acc, c: acc.when(c[0], lit(c[1])), rest, F.when(first[0], lit(first[1]))).otherwise(lit(otherwise))


def any_term(x: Column, terms: list[str]) -> Column:
    return text.first_term(x, terms).isNotNull()


def source_type(u: Column) -> Column:
    """struct(source_type, officiality, requires_review) of a linked URL."""
    h, p = urls.host(u), F.lower(urls.path(u))
    out = lambda t, o, r: F.struct(F.lit(t).alias("source_type"), F.lit(o).alias("officiality"), F.lit(r).alias("requires_review"))
    return rules(
        (F.regexp_like(p, F.lit(r"\.(mp4|webm|m3u8)$")), out("video", 0.5, True)),
        (F.regexp_like(p, F.lit(urls.IMAGE_SUFFIX)), out("direct_image", 0.8, False)),
        (h.isin(X_HOSTS), out("official_x", 0.9, False)),
        (h.isin(STEAM_HOSTS), out("steam", 0.85, False)),
        (h.isin(VIDEO_HOSTS), out("video", 0.5, True)),
        (urls.within(h, ["vndb.org"]), out("unverified", 0.25, True)),
        otherwise=out("official_site", 0.75, False),
    )


def event_type(body: Column, section: Column) -> Column:
    low = F.lower(body)
    has = lambda pattern: reduce(lambda a, w: a | F.contains(low, F.lit(w)), pattern.removeprefix("(?i)").split("|"), F.lit(False))
    cases = [(has(pattern), name) for name, pattern in EVENT_PATTERNS]  # alternations of plain words: byte search, no regex
    return rules(*cases, (section.isin("新作", "新作品") | has("新作"), "new_title"), otherwise="unknown")


def importance(event: Column, has_image_need: Column) -> Column:
    base = rules(*[(event == k, v) for k, v in IMPORTANCE.items()], otherwise=0.25)
    return F.when(has_image_need, F.least(F.lit(1.0), F.round(base + 0.05, 6))).otherwise(base)


def trust_tier(kind: Column, source_url: Column, image_url: Column, page_official: Column) -> Column:
    """struct(tier, officiality, is_official) of a candidate's provenance."""
    h, ih, p = urls.host(source_url), urls.host(image_url), F.lower(urls.path(source_url))
    out = lambda t, o, r: F.struct((t if isinstance(t, Column) else F.lit(t)).alias("tier"), F.lit(o).alias("officiality"), F.lit(r).alias("is_official"))
    site = kind == "official_site"
    third = urls.within(h, THIRD_PARTY) | F.contains(h, F.lit("kun"))
    proxy = F.when(F.regexp_like(h, F.lit("amazon|image")) | (h == "kun"), "image_proxy").otherwise("third_party_news")
    return rules(
        (kind == "official_x", out("official_event_page", 0.88, True)),
        (kind == "steam", out("steam", 0.82, True)),
        (site & F.regexp_like(p, F.lit("/event|/news|/announce|/update")), out("official_event_page", 0.98, True)),
        (site & F.regexp_like(p, F.lit("/brand|/company|/about")), out("official_brand_page", 0.9, True)),
        (site & F.regexp_like(p, F.lit("/store|/shop|/goods")), out("official_store", 0.86, True)),
        (site, out("official_game_page", 0.95, True)),
        ((kind == "direct_image") & F.coalesce(page_official, F.lit(False)), out("official_game_page", 0.9, True)),
        (kind == "direct_image", out("image_proxy", 0.3, False)),
        (third, out(proxy, 0.18, False)),
        (urls.within(h, TRUSTED_DATABASES), out("trusted_database", 0.42, False)),
        (urls.within(h, AGGREGATORS), out("aggregator", 0.12, False)),
        (F.regexp_like(h, F.lit(r"^(cdn|static|images|img|media)\.")) | (ih != h), out("image_proxy", 0.25, False)),
        (h != "", out("unknown", 0.1, False)),
        otherwise=out("unknown", 0.0, False),
    )


def type_match(requirements: Column, kind: Column) -> Column:
    """The best score of a type over an array of requirements."""
    table = F.create_map(*[F.lit(x) for r, m in config.TYPE_MATCH.items() for t, s in m.items() for x in (f"{r}/{t}", s)])
    each = F.transform(requirements, lambda r: F.coalesce(F.try_element_at(table, F.concat(r, F.lit("/"), kind)), F.lit(config.DEFAULT_MATCH)))
    return F.coalesce(F.array_max(each), F.lit(config.DEFAULT_MATCH))


def decision(requirements: Column, kind: Column, confidence: Column) -> Column:
    """struct(accepted, fallback_only, requires_review, auto_select, type_match) of a typed candidate."""
    rejected = config.DEFAULTS["image_types"]["rejected"]
    table = F.create_map(*[x for r, ts in rejected.items() for x in (F.lit(r), F.array(*[F.lit(t) for t in ts]))])
    no = F.transform(requirements, lambda r: F.array_contains(F.coalesce(F.try_element_at(table, r), F.array().cast("array<string>")), kind))
    cg = F.array_contains(requirements, F.lit("cg"))
    refused = (cg & kind.isin(rejected["cg"])) | F.forall(no, lambda x: x)
    low = confidence < config.DEFAULTS["image_types"]["auto_confidence"]
    return F.struct(
        (~refused).alias("accepted"),
        (cg & (kind == "key_visual")).alias("fallback_only"),
        ((kind == "unknown") | low).alias("requires_review"),
        (~((kind == "unknown") | low | (kind == "decorative"))).alias("auto_select"),
        type_match(requirements, kind).alias("type_match"),
    )


def entity_match(apps: Column, own_apps: Column, direct_listed: Column, conflict: Column, linked_goods: Column, linked_gallery: Column, named_in_title: Column, at_root: Column, alias_hit: Column, page_hit: Column, numeric: Column, official_unnamed: Column, unverified: Column) -> Column:
    """struct(matched, confidence): true, false or unknown (null) and how sure; conditions in order."""
    out = lambda m, c: F.struct(F.lit(m).cast("boolean").alias("matched"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    both = (F.size(apps) > 0) & (F.size(own_apps) > 0)
    return rules(
        (both & ~F.arrays_overlap(apps, own_apps), out(False, 1.0)),
        (both, out(True, 0.98)),
        (direct_listed, out(True, 0.9)),
        (conflict, out(False, 1.0)),
        (linked_goods, out(True, 0.88)),
        (linked_gallery & (named_in_title | ~at_root), out(True, 0.92)),
        (alias_hit, out(True, F.least(F.lit(0.98), F.lit(0.95) + F.when(page_hit, 0.04).otherwise(0.0)))),
        (numeric >= 0.8, out(True, 0.9)),
        (official_unnamed, out(None, 0.0)),
        (unverified, out(True, 0.82)),
        otherwise=out(None, 0.0),
    )


def native_size(width: Column, height: Column, minimum: tuple[int, int, int] = (800, 450, 360_000)) -> Column:
    return F.coalesce((width >= minimum[0]) & (height >= minimum[1]) & (width.cast("long") * height >= minimum[2]), F.lit(False))


def localization(section: Column, role: Column, conflict: Column, confirmed: Column, linked: Column, screenshot: Column, full: Column, downloaded: Column, width: Column, height: Column, animated: Column) -> Column:
    """struct(image_type, confidence, priority, auto_select) of work-database and store screenshots."""
    out = lambda t, c, p, a: F.struct((t if isinstance(t, Column) else F.lit(t)).alias("image_type"), F.lit(c).alias("confidence"), (p if isinstance(p, Column) else F.lit(p)).alias("priority"), F.lit(a).alias("auto_select"))
    kind = F.when(role == "event_cg", "game_cg").otherwise("gameplay_screenshot")
    good = confirmed & linked & screenshot & full & downloaded & native_size(width, height) & ~animated
    return rules(
        (section != "h", out("unknown", 0.0, 0, False)),
        (role.isin("logo", "decorative") | conflict, out("unknown", 0.0, 0, False)),
        (good, F.when(role == "event_cg", out("game_cg", 0.92, 100, True)).otherwise(out("gameplay_screenshot", 0.90, 90, True))),
        (confirmed, out(kind, 0.85, 0, False)),
        otherwise=out("unknown", 0.0, 0, False),
    )


def placeholder(url: Column) -> Column:
    """An asset that stands for a missing image: by its URL as it is or without separators."""
    x = F.lower(urls.path(url))
    flat = F.regexp_replace(x, "[^a-z0-9]", "")
    return reduce(lambda a, t: a | F.contains(x, F.lit(t)) | F.contains(flat, F.lit(t.replace("_", "").replace("-", ""))), PLACEHOLDERS, F.lit(False))


def low_resolution(width: Column, height: Column) -> Column:
    return F.coalesce((F.greatest(width, height) < 800) | (F.least(width, height) < 600), F.lit(False))


def minimum_quality(width: Column, height: Column) -> Column:
    f = config.DEFAULTS["filters"]
    return F.coalesce((width >= f["min_width"]) & (height >= f["min_height"]) & (width.cast("long") * height >= f["min_pixels"]), F.lit(False))
