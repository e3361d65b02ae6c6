"""Evidence that ties a candidate to an item: names, addresses, shop numbers, conflicts, compared in columns of both.

Candidates: item_id, image_url, source_url, source_type, news_source_url, parent_source_url, image_alt, nearby_text, signals
(map of SIGNAL) and evidence (array of LOCAL). Items: item_id, title, body, game_names, organizations, keywords, source_urls (arrays of
strings) and event_type. Unicode folding is one Arrow-batched call a column, before everything else; the rest is native.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import text, urls
from curaspark.operators.classify import rules

SIGNAL = "struct<s:string,n:double,b:boolean>"
LOCAL = "struct<role:string,method:string,page_url:string,container:string,relationship:string,text:string,item_id:string>"
SEPARATOR = "\u0001"

# Words, patterns and numbers that results depend on.
CHAPTER = r"(?:chapter|ch\.?)[\s:：-]*[0-9０-９]+\b"
PARENT_EDGE = r"^[ ＊*:：-]+|[ ＊*:：-]+$"
PARENT_LETTERS = 4
TEXT_SIGNALS = ["page_title", "title", "alt", "nearby_text", "caption", "description", "game_slug", "entity", "game_name", "brand", "original_url", "tweet_text"]
NUMERIC_SIGNALS = ["game_match", "organization_match", "page_match", "event_match", "character_match"]
EXPLICIT_SIGNALS = ["game_match", "organization_match", "page_match", "event_match"]
CONFLICT_SIGNALS = ["conflicting_entity", "other_game_name", "other_title"]
SHOP_ID = r"(?i)(?:/app/|/steam/apps/|steam_app_id[=:])([0-9]{3,})"
HOMES = ["", "/", "/index.html", "/index.htm", "/home", "/home.html"]
OTHER_MEDIA = ["tv guide", "where to watch", "/movies/", "/movie/", "/anime/", "streaming", "episode guide", "film review", "/folklore", "folklore"]
GAME_MEDIA = ["visual novel", "galgame", "steam", "pc game", "game official", "ゲーム", "ギャラリー", "公式サイト", "game cg"]
SHOP_FOLDERS = ["shop", "store", "product", "products", "goods"]
GENERIC_FOLDERS = ["shop", "store", "product", "products", "item", "items", "detail", "goods"]
GENERIC_STEMS = [
    "image", "img", "photo", "picture", "visual", "keyvisual", "cover", "banner", "logo", "thumbnail", "thumb", "goods", "product", "item",
    "main", "sub", "detail", "intro", "sample", "screenshot", "screen",
]
GENERIC_TITLES = [
    "cg", "game", "image", "screenshot", "official", "gallery", "graphic", "web", "site", "chapter",
    "公式", "公式サイト", "官方网站", "画像", "画像一覧", "画像公開", "ギャラリー", "ゲーム", "作品", "トップ", "ニュース", "新着",
]
TITLE_TOKEN = r"(?U)[A-Z][A-Za-z0-9]{2,}|\d[\w-]{2,}|[぀-ヿ一-鿿]{2,}"
WORK_FOLDER = r"(?i)/(?:products?|games?|titles?|works?)/"
BRAND_TITLE = r"(?i)official\s*web\s*site|公式サイト"
OTHER_WORKS = ["related", "recommend", "recommendation", "recommendations", "products", "product", "game", "games", "work", "works", "title", "titles"]
GOODS_CONTEXT = r"(?i)周边|周邊|商品|グッズ|通贩|通販|复刻|復刻|goods|merchandise"
CATALOGUE = r"(?i)/(?:item|goods|shop|store|catalog|product)(?:s)?(?:/|[._-])"
CARD_WORDS = r"product|goods|item|catalog|card|商品|周边|周邊|グッズ"
NUMBERED_HOST, NUMBERED_WORK = "9nineproject", "9nine"


def names_of(games: Column, title: Column) -> Column:
    """An item's names: the known ones, and those in brackets in its title, with parents of chapters, each once in order."""
    quoted = F.transform(F.regexp_extract_all(title, F.lit(r"《([^》]+)》|\[([^\]]+)\]"), F.lit(0)), lambda x: F.regexp_replace(x, r"^[《\[]|[》\]]$", ""))
    names = F.filter(F.array_distinct(F.concat(F.filter(strings(games), lambda x: F.trim(x) != ""), F.coalesce(quoted, strings(None)))), lambda x: x != "")
    return with_parents(names)


def strings(x: Column | None) -> Column:
    none = F.array().cast("array<string>")
    return none if x is None else F.coalesce(x, none)


def without_chapter(name: Column) -> tuple[Column, Column]:
    """What stands before a chapter's number in a name, and what is left without a leading one."""
    return F.regexp_replace(name, rf"(?is)\s*{CHAPTER}.*$", ""), F.regexp_replace(name, rf"(?i)^\s*{CHAPTER}\s*", "")


def with_parents(names: Column) -> Column:
    """Names, then what stands before or after a chapter's number in them."""
    fit = lambda p, x: F.when((p != "") & (p != x) & (F.char_length(text.compact(p, False)) >= PARENT_LETTERS), p)
    bare = lambda x: F.regexp_replace(x, PARENT_EDGE, "")
    parents = F.flatten(F.transform(names, lambda x: F.array(*[fit(bare(p), x) for p in without_chapter(x)])))
    return F.array_distinct(F.concat(names, F.array_compact(parents)))


def same_domain(a: Column, b: Column) -> Column:
    """Equal hosts, or one within the other."""
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))


def keys_of(addresses: Column) -> Column:
    return F.transform(F.filter(strings(addresses), lambda u: F.coalesce(u, F.lit("")) != ""), urls.source_key)


def shop_ids(values: Column) -> Column:
    """Numbers of the shop's pages in addresses and key=value texts."""
    return F.array_distinct(F.flatten(F.transform(strings(values), lambda v: F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(SHOP_ID), F.lit(1)))))


def signal_text(key: str) -> Column:
    """A signal as text, whatever its type; null where it is absent."""
    return _as_text(F.try_element_at("signals", F.lit(key)))


def _as_text(x: Column) -> Column:
    return F.coalesce(x["s"], F.when(x["n"] == F.floor(x["n"]), x["n"].cast("long").cast("string")).otherwise(x["n"].cast("string")), F.initcap(x["b"].cast("string")))


def is_true(key: str) -> Column:
    return F.coalesce(F.try_element_at("signals", F.lit(key))["b"], F.lit(False))


def number(key: str) -> Column:
    """A signal as a number; true is one."""
    x = F.try_element_at("signals", F.lit(key))
    return F.coalesce(x["n"], x["b"].cast("int").cast("double"))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def _each_folded(values: Column, keep: str) -> Column:
    """NFKC and casefold of every element of an array in one call, then only what `keep` (a class of characters) says."""
    return F.split(F.regexp_replace(text.nfkc_casefold(F.array_join(values, SEPARATOR)), f"[^{keep}{SEPARATOR}]", ""), SEPARATOR)


LETTERS, ALL = r"\p{L}\p{N}", r"\s\S"


def _path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _has_any(x: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(x, F.lit(w)), words, F.lit(False))


def _no_slash(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def _home(path: Column) -> Column:
    return _no_slash(F.lower(path)).isin(HOMES)


def product_card() -> Column:
    """Whether local evidence of the candidate's own page shows it on a product card."""
    key = urls.source_key(F.col("source_url"))
    own = lambda e: (e["role"] == "goods") & e["method"].isin("dom", "script", "browser") & (urls.source_key(e["page_url"]) == key)
    says = lambda e: (F.coalesce(e["item_id"], F.lit("")) != "") | F.regexp_like(F.lower(F.concat_ws(" ", e["container"], e["relationship"], e["text"])), F.lit(CARD_WORDS))
    return F.coalesce(F.exists("evidence", lambda e: own(e) & says(e)), F.lit(False))


def linked_work(gallery: bool) -> Column:
    """Whether the candidate comes from the work's own pages, reached from an address of the item; with gallery, from a gallery there.

    Reads folded_title and folded_names besides the columns of candidate and item.
    """
    root = F.try_element_at("signals", F.lit("root_source_url"))["s"]
    here, there = urls.host(F.col("source_url")), urls.host(root)
    listed = F.array_contains("item_keys", urls.source_key(root))
    excluded = F.coalesce(signal_text("gallery_excluded_reason"), F.lit("")) != ""
    named = F.exists("work_names", lambda n: (F.char_length(n) >= 4) & F.contains(F.col("folded_title"), n))
    root_path, page_path = _no_slash(urls.path(root)), _no_slash(urls.path(F.col("source_url")))
    work = F.regexp_replace(root_path, r"(?i)/(?:index|home)\.html?$", "")
    below = F.startswith(page_path, F.concat(work, F.lit("/")))
    nested = F.split(F.lower(F.substr(page_path, F.char_length(work) + F.lit(2))), "/")
    elsewhere = below & F.arrays_overlap(nested, F.array(*map(F.lit, OTHER_WORKS)))
    at_home = F.lower(root_path).isin("", "/index.html", "/index.htm", "/home", "/home.html")
    bound = F.when(at_home, named).otherwise(~elsewhere & ((page_path == work) | below | named))
    site = F.coalesce(F.col("source_type") == "official_site", F.lit(False)) & (is_true("gallery_path") if gallery else F.lit(True))
    return F.coalesce(site & root.isNotNull() & listed & same_domain(here, there) & ~excluded & bound, F.lit(False))


def linked_goods() -> Column:
    """Whether the candidate is a product card that the item's own addresses lead to, and the item is about goods."""
    root = F.coalesce(F.try_element_at("signals", F.lit("root_source_url"))["s"], F.nullif(F.col("news_source_url"), F.lit("")))
    about = F.coalesce((F.col("event_type") == "goods") | F.regexp_like(F.concat_ws(" ", "title", "body"), F.lit(GOODS_CONTEXT)), F.lit(False))
    page = lambda u: F.concat_ws("\n", F.regexp_replace(urls.host(u), r"^www\.", ""), _no_slash(urls.path(u)), urls.query(u))
    listed = F.exists(strings(F.col("source_urls")), lambda u: page(u) == page(F.col("source_url"))) & F.regexp_like(urls.path(F.col("source_url")), F.lit(CATALOGUE))
    reached = F.coalesce(signal_text("navigation_kind").isin("goods", "shop", "event"), F.lit(False)) | F.coalesce(listed, F.lit(False))
    site = F.coalesce(F.col("source_type") == "official_site", F.lit(False))
    return F.coalesce(site & F.array_contains("item_keys", urls.source_key(root)), F.lit(False)) & about & reached & product_card()


def _other_product() -> Column:
    """The stem of an image of a shop page that names another product than the page; null where it tells nothing."""
    parts = F.transform(_path_parts(urls.path(F.col("source_url"))), _decoded)
    shop = F.exists(parts, lambda p: F.lower(p).isin(SHOP_FOLDERS))
    letters = lambda x: F.regexp_replace(F.lower(x), rf"[^{LETTERS}]", "")
    slug = F.get(F.reverse(F.filter(parts, lambda p: ~F.lower(p).isin(GENERIC_FOLDERS) & ~F.regexp_like(p, F.lit(r"^\d+$")) & (F.char_length(letters(p)) >= 4))), F.lit(0))
    path = _decoded(urls.path(F.col("image_url")))
    file = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    short = letters(stem)
    silent = (short == "") | ~F.regexp_like(short, F.lit(r"\p{L}")) | short.isin(GENERIC_STEMS) | F.regexp_like(short, F.lit("^[0-9a-f]{16,}$"))
    same = F.contains(letters(path), letters(slug)) | F.contains(letters(slug), short)
    return F.when((F.col("source_type") == "unverified") & shop & slug.isNotNull() & ~silent & ~same, stem)


def joined(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates with the columns of their item, and what several rules read of both."""
    fields = ["title", "body", "game_names", "organizations", "keywords", "source_urls", "event_type"]
    c = candidates.join(items.select("item_id", *fields), "item_id", "left")
    c = c.withColumns({f: strings(F.col(f)) for f in ("game_names", "organizations", "keywords", "source_urls")} | {f: F.coalesce(f, F.lit("")) for f in ("title", "body", "event_type")})
    texts = F.transform(F.filter(F.map_entries("signals"), lambda e: e["key"].isin(TEXT_SIGNALS)), lambda e: _as_text(e["value"]))
    given = F.filter(F.array("news_source_url", "parent_source_url", "image_alt", "nearby_text"), lambda x: F.coalesce(x, F.lit("")) != "")
    page = F.concat(F.filter(strings(texts), lambda x: x.isNotNull()), given)
    title = F.coalesce(F.nullif(signal_text("page_title"), F.lit("")), signal_text("title"), F.lit(""))
    c = c.withColumns({"names": names_of(F.col("game_names"), F.col("title")), "page_values": page, "shown_title": title, "item_keys": keys_of(F.col("source_urls"))})
    works = F.flatten(F.transform("game_names", lambda n: F.array(n, *without_chapter(n))))
    c = c.withColumns({
        "folded_names": _each_folded(F.col("names"), LETTERS), "folded_publishers": _each_folded(F.col("organizations"), LETTERS), "work_names": _each_folded(works, ALL),
        "folded_title": text.nfkc_casefold(F.col("shown_title")), "folded_page": text.nfkc_casefold(F.array_join("page_values", " ")),
        "folded_evidence": text.nfkc_casefold(F.array_join(F.transform(F.concat(F.array("image_url", "source_url"), F.col("page_values")), _decoded), " ")),
    })
    only_letters = lambda x: F.regexp_replace(x, rf"[^{LETTERS}]", "")
    return c.withColumns({"page_letters": only_letters(F.col("folded_page")), "evidence_letters": only_letters(F.col("folded_evidence")), "title_letters": only_letters(F.col("folded_title"))})


def _conflicts(linked: Column) -> Column:
    """What speaks against the candidate, in order, each once."""
    named = lambda key: F.when(~F.coalesce(signal_text(key).isin("", "False", "0"), F.lit(True)), F.when(is_true(key), F.lit(key)).otherwise(signal_text(key)))
    brand = F.when(~F.coalesce(F.try_element_at("signals", F.lit("brand_match"))["b"], F.lit(True)), "brand_mismatch")
    host = F.regexp_replace(urls.host(F.col("source_url")), rf"[^{LETTERS}]", "")
    numbered = F.when(F.contains(host, F.lit(NUMBERED_HOST)) & ~F.contains(F.array_join("folded_names", " "), F.lit(NUMBERED_WORK)), "9-nine")
    around = F.lower(F.concat_ws(" ", F.col("source_url"), F.array_join("page_values", " ")))
    other_media = F.when((F.col("source_type") == "unverified") & _has_any(around, OTHER_MEDIA) & ~_has_any(around, GAME_MEDIA), "non_game_media_page")
    product = F.concat(F.lit("other_product_asset:"), _other_product())
    has_work = F.exists("folded_names", lambda n: (n != "") & F.contains(F.col("title_letters"), n))
    path, official = urls.path(F.col("source_url")), F.coalesce(F.col("source_type") == "official_site", F.lit(False))
    can = ~official | F.regexp_like(path, F.lit(WORK_FOLDER)) | (~_home(path) & ~F.regexp_like(F.col("shown_title"), F.lit(BRAND_TITLE)))
    tokens = F.filter(F.regexp_extract_all("shown_title", F.lit(TITLE_TOKEN), F.lit(0)), lambda t: ~F.lower(t).isin(GENERIC_TITLES))
    tokens = F.when(official, F.filter(tokens, lambda t: ~F.array_contains("folded_publishers", F.regexp_replace(F.lower(t), rf"[^{LETTERS}]", "")))).otherwise(tokens)
    titles = F.when((F.col("shown_title") != "") & ~linked & ~has_work & can, tokens).otherwise(strings(None))
    return F.array_distinct(F.concat(F.array_compact(F.array(*[named(k) for k in CONFLICT_SIGNALS], brand, numbered, other_media, product)), titles))


def entity_evidence(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Adds match (true, false, null: open), confidence, why (array), conflicts (array), matched (names), official_domain, source_linked."""
    c = joined(candidates, items)
    host = urls.host(F.col("source_url"))
    chain = F.concat(F.array("source_url", "news_source_url", "parent_source_url"), F.array(F.try_element_at("signals", F.lit("root_source_url"))["s"]))
    numeric = F.array_compact(F.array(*[F.when(number(k) >= 0.8, F.lit(k)) for k in NUMERIC_SIGNALS]))
    pairs = F.transform(F.map_entries("signals"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(_as_text(e["value"]), F.lit(""))))
    c = c.withColumns({
        "official_domain": F.coalesce(F.exists(F.transform("source_urls", urls.host), lambda h: same_domain(host, h)), F.lit(False)),
        "source_linked": F.coalesce(F.arrays_overlap(keys_of(chain), F.col("item_keys")), F.lit(False)),
        "theirs": shop_ids(F.concat("source_urls", "keywords")), "mine": shop_ids(F.concat(F.array("image_url", "source_url"), strings(pairs))),
        "work_gallery": linked_work(True), "work_page": linked_work(False), "work_goods": linked_goods(),
    })
    c = c.withColumn("supporting", F.concat(numeric, F.when(F.col("official_domain"), F.array(F.lit("official_domain_match"))).otherwise(strings(None))))
    c = c.withColumn("conflicts", _conflicts(F.col("work_gallery") | F.col("work_page") | F.col("work_goods")))
    short = lambda n: F.char_length(n) <= F.when(F.regexp_like(n, F.lit(r"^\p{ASCII}*$")), 3).otherwise(2)
    context = lambda n: F.col("official_domain") | F.contains(F.col("page_letters"), n) | (F.size("supporting") > 0)
    hits = F.filter(F.arrays_zip("names", "folded_names"), lambda x: (x["folded_names"] != "") & F.contains(F.col("evidence_letters"), x["folded_names"]) & (~short(x["folded_names"]) | context(x["folded_names"])))
    c = c.withColumn("hits", hits)
    in_page = F.exists("hits", lambda x: F.contains(F.col("page_letters"), x["folded_names"]))
    has_work = F.exists("folded_names", lambda n: (n != "") & F.contains(F.col("title_letters"), n))
    root = F.coalesce(F.try_element_at("signals", F.lit("root_source_url"))["s"], F.lit(""))
    away = ~_home(urls.path(root))
    official = F.coalesce(F.col("source_type") == "official_site", F.lit(False))
    whys = lambda *x: F.array(*map(F.lit, x))
    also = lambda *x: F.array_distinct(F.concat(F.col("supporting"), whys(*x)))
    out = lambda m, conf, why: F.struct(F.lit(m).cast("boolean").alias("match"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence"), why.alias("why"))
    both = (F.size("theirs") > 0) & (F.size("mine") > 0)
    base = F.when(F.col("official_domain"), 0.95).otherwise(0.86)
    sure = F.round(F.when(in_page, F.least(F.lit(0.98), base + 0.04)).otherwise(base), 6)
    unsure = F.exists("folded_names", lambda n: (n != "") & short(n) & F.contains(F.col("evidence_letters"), n))
    decided = rules(
        (both & ~F.arrays_overlap("theirs", "mine"), out(False, 1.0, whys("steam_app_id_mismatch"))),
        (both, out(True, 0.98, whys("steam_app_id_match"))),
        ((F.col("source_type") == "direct_image") & F.array_contains("item_keys", urls.source_key(F.col("source_url"))), out(True, 0.9, whys("image_linked_from_news_source"))),
        (F.size("conflicts") > 0, out(False, 1.0, F.array_distinct("supporting"))),
        (F.col("work_goods"), out(True, 0.88, whys("official_news_linked_goods", "product_card_evidence", "official_source_chain"))),
        (F.col("work_gallery") & (has_work | away), out(True, 0.92, whys("official_news_linked_gallery", "official_domain_match"))),
        ((F.size("hits") > 0) & in_page, out(True, sure, also("entity_name_in_context", "page_context"))),
        (F.size("hits") > 0, out(True, sure, also("entity_name_in_context"))),
        (F.arrays_overlap("supporting", whys(*EXPLICIT_SIGNALS)), out(True, 0.9, also("explicit_entity_signal"))),
        (F.col("work_page") & away, out(True, 0.9, whys("official_news_linked_work", "official_domain_match"))),
        (official & (host != "") & (F.size("supporting") == 0), out(None, 0.0, F.when(unsure, whys("short_name_needs_context")).otherwise(whys("official_source_without_name")))),
        ((F.col("source_type") == "unverified") & F.regexp_like(host, F.lit(r"vndb\.(org|net)$")), out(True, 0.82, whys("trusted_database_context"))),
        (F.size("supporting") > 0, out(None, 0.0, also("no_entity_name"))),
        otherwise=out(None, 0.0, whys("no_entity_context")),
    )
    mismatch = both & ~F.arrays_overlap("theirs", "mine")
    refused = F.when(mismatch, F.array_sort("mine")).when(F.coalesce(~decided["match"], F.lit(False)), F.col("conflicts")).otherwise(strings(None))
    matched = F.when(F.array_contains(decided["why"], "entity_name_in_context"), F.transform("hits", lambda x: x["names"])).otherwise(strings(None))
    return c.withColumn("x", decided).select(*candidates.columns, "x.match", "x.confidence", "x.why", refused.alias("conflicts"), matched.alias("matched"), "official_domain", "source_linked", "work_gallery", "work_page", "work_goods")
