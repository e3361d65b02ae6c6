"""Evidence and image types of candidates, made of pages: the item of three pages is the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import hashing, urls
from curaspark.operators import curate
from curaspark.operators import evidence as ev
from curaspark.operators import image_types as it
from curaspark.operators.classify import rules
from curaspark.plans.binding import URLS
from curaspark.plans.near_queries import CONFIRM
from curaspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

STEMS = ["a", "logo_mark", "cg/ev01", "chara_02", "bnr-01", "kv_main"]
KINDS = ["official_site", "unverified", "direct_image", "steam"]


def _label(u: Column) -> Column:
    return F.split_part(urls.host(u), F.lit("."), F.lit(1))


def items(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    i, n = F.col("page_id"), _label(F.col("url"))
    p = table(spark, d, "pages").where("page_id % 3 = 0")
    keywords = F.when(i % 2 == 0, F.array(F.concat(F.lit("/app/"), (100 + i % 5).cast("string")))).otherwise(none)
    return p.select(i.alias("item_id"), F.concat(F.lit("《"), n, F.lit("》")).alias("title"), F.lit("").alias("body"), F.array(n).alias("game_names"), none.alias("organizations"), keywords.alias("keywords"), F.array("url").alias("source_urls"), F.lit("update").alias("event_type"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("page_id"), F.col("url")
    signal = lambda s=None, n=None: F.struct((s if isinstance(s, Column) else F.lit(s)).cast("string").alias("s"), (n if isinstance(n, Column) else F.lit(n)).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))
    title = rules((i % 5 == 1, "Gallery CG"), (i % 5 == 2, F.concat(_label(u), F.lit(" page"))), (i % 5 == 3, "Moon Nights"), (i % 5 == 4, ""), otherwise=F.lit(None).cast("string"))
    entry = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value")))
    entries = F.array_compact(F.array(entry(title.isNotNull(), "page_title", signal(title)), entry(i % 7 == 0, "game_match", signal(n=0.9)), entry(i % 9 == 4, "steam_app_id", signal(n=100 + i % 5))))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, d, "pages").select(
        "page_id", (i - i % 3).alias("item_id"), F.concat(F.lit("https://img.example/"), pick(STEMS), F.lit(".jpg")).alias("image_url"), u.alias("source_url"), pick(KINDS).alias("source_type"), none.alias("news_source_url"), none.alias("parent_source_url"),
        F.when(i % 10 == 3, "Event CG").alias("image_alt"), none.alias("nearby_text"), F.map_from_entries(entries).alias("signals"), F.array().cast(f"array<{ev.LOCAL}>").alias("evidence"),
        (400 + (i * 37) % 900).cast("int").alias("width"), (200 + (i * 53) % 900).cast("int").alias("height"),
    )


def entity_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether a candidate shows its item's work, how sure that is and why, or what speaks against it."""
    out = ev.entity_evidence(candidates(spark, d), items(spark, d))
    return out.select("page_id", "match", "confidence", F.array_join("why", " ").alias("why"), F.array_join("conflicts", " ").alias("conflicts"), "official_domain", "source_linked")


def image_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of each candidate's image and how sure it is."""
    return it.image_types(candidates(spark, d), items(spark, d)).select("page_id", "image_type", "confidence")


def curated_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from their addresses, texts and pictures to a status with reasons: types, ties, requirements, scenes and allocation."""
    i, x = F.col("candidate_id"), F.col("x")
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 97).alias("n"), F.col("embedding").cast("array<double>").alias("x")).groupBy("n").agg(F.min("x").alias("x"))
    c = candidates(spark, d).withColumnRenamed("page_id", "candidate_id").withColumn("n", F.floor(i / 2) % 97).join(e, "n")
    gray = F.transform(x, lambda v: F.floor((v + 1) * 128).cast("int") + F.when(i % 2 == 0, 0).otherwise(1))
    flag = lambda every: i % every == 0
    c = c.withColumns({
        "x_photo": flag(13), "animated": flag(29), "invalid_reason": F.when(flag(31), "corrupt"), "conversion_error": F.when(flag(37), "mode"), "page_official": flag(2), "localized": F.lit(False), "localization_auto": F.lit(False),
        "sha256": F.when(flag(3), F.sha2(i.cast("string"), 256)), "phash": F.shiftleft(hashing.mean_bits(x, 0, 32), 32).bitwiseOR(hashing.mean_bits(x, 32, 32)), "picture": F.struct(F.lit(1.0).alias("aspect"), gray.alias("pixels")),
        "detail": (i % 101) / F.lit(100.0), "base_relevance": F.lit(0.6), "published_at": F.lit(None).cast("timestamp"), "fetched_at": F.lit(None).cast("timestamp"),
    }).drop("n", "x")
    history = c.where("candidate_id % 50 = 7").select(F.lit(None).cast("string").alias("sha256"), "phash")
    out = curate.curate_evidence(c, items(spark, d), (history, CONFIRM))
    return out.select("item_id", "candidate_id", "image_type", "match", "status", "total", "duplicate_of", F.array_join("reasons", ",").alias("reasons"), F.array_join("reviews", ",").alias("reviews"))


def _terms(x: str, terms: list[str]) -> str:
    plain = [t for t in terms if t.isascii()]
    other = "".join(f" OR contains({x}, '{t}')" for t in terms if not t.isascii())
    return f"(regexp_matches({x}, '(?:^|[^a-z0-9])(?:{'|'.join(plain)})(?:$|[^a-z])'){other})"


_LETTERS = r"'[^\p{L}\p{N}]', '', 'g'"
_BOUND = rf"""{URLS},
v AS (SELECT page_id, url, s, n AS netloc, p, q, h, concat_ws('|', s, n, regexp_replace(p, '/+$', ''), q) AS k, split_part(h, '.', 1) AS label FROM uu),
b AS (SELECT v.*, w.page_id AS item, w.h AS ih, w.k AS ik, w.label AS name, {STEMS!r}[v.page_id % 6 + 1] AS stem, {KINDS!r}[v.page_id % 4 + 1] AS kind,
  CASE v.page_id % 5 WHEN 1 THEN 'Gallery CG' WHEN 2 THEN v.label || ' page' WHEN 3 THEN 'Moon Nights' WHEN 4 THEN '' END AS title, CASE WHEN v.page_id % 10 = 3 THEN 'Event CG' END AS alt,
  400 + (v.page_id * 37) % 900 AS w, 200 + (v.page_id * 53) % 900 AS ht FROM v JOIN v w ON w.page_id = v.page_id - v.page_id % 3),
t AS (SELECT *, 'https://img.example/' || stem || '.jpg' AS img, regexp_replace(lower(name), {_LETTERS}) AS nl, regexp_replace(lower(coalesce(title, '')), {_LETTERS}) AS tl,
  regexp_replace(lower(concat_ws(' ', title, alt)), {_LETTERS}) AS pl FROM b)"""

ORACLE_SQL["entity_evidence"] = rf"""
WITH {_BOUND},
e AS (SELECT *, regexp_replace(lower(concat_ws(' ', img, url, title, alt)), {_LETTERS}) AS el, h = ih OR ends_with(h, '.' || ih) OR ends_with(ih, '.' || h) AS dom, page_id % 7 = 0 AS gm,
  CASE WHEN item % 2 = 0 THEN 100 + item % 5 END AS theirs, CASE WHEN page_id % 9 = 4 THEN 100 + page_id % 5 END AS mine,
  kind <> 'official_site' OR regexp_matches(p, '(?i)/(?:products?|games?|titles?|works?)/') OR regexp_replace(lower(p), '/+$', '') NOT IN ('', '/index.html', '/index.htm', '/home', '/home.html') AS can FROM t),
f AS (SELECT *, list_filter(['game_match', 'official_domain_match'], lambda x: (x = 'game_match' AND gm) OR (x <> 'game_match' AND dom)) AS sup,
  CASE WHEN coalesce(title, '') <> '' AND NOT contains(tl, nl) AND can THEN list_distinct(list_filter(regexp_extract_all(title, '[A-Z][A-Za-z0-9]{{2,}}|\d[\w-]{{2,}}'), lambda x: lower(x) <> 'gallery')) ELSE [] END AS con FROM e),
g AS (SELECT *, nl <> '' AND contains(el, nl) AND (len(nl) > 3 OR dom OR contains(pl, nl) OR len(sup) > 0) AS hit, contains(pl, nl) AS inpage FROM f),
r AS (SELECT *, CASE WHEN theirs <> mine THEN 1 WHEN theirs = mine THEN 2 WHEN kind = 'direct_image' AND k = ik THEN 3 WHEN len(con) > 0 THEN 4 WHEN hit AND inpage THEN 5 WHEN hit THEN 6 WHEN gm THEN 7
  WHEN kind = 'official_site' AND NOT dom THEN 8 WHEN len(sup) > 0 THEN 9 ELSE 10 END AS rule FROM g)
SELECT page_id, CASE WHEN rule IN (1, 4) THEN false WHEN rule IN (2, 3, 5, 6, 7) THEN true END AS match,
  CASE rule WHEN 1 THEN 1.0 WHEN 2 THEN 0.98 WHEN 3 THEN 0.9 WHEN 4 THEN 1.0 WHEN 5 THEN CASE WHEN dom THEN 0.98 ELSE 0.9 END WHEN 6 THEN CASE WHEN dom THEN 0.95 ELSE 0.86 END WHEN 7 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence,
  CASE rule WHEN 1 THEN 'steam_app_id_mismatch' WHEN 2 THEN 'steam_app_id_match' WHEN 3 THEN 'image_linked_from_news_source' WHEN 4 THEN array_to_string(sup, ' ') WHEN 5 THEN array_to_string(list_concat(sup, ['entity_name_in_context', 'page_context']), ' ')
    WHEN 6 THEN array_to_string(list_append(sup, 'entity_name_in_context'), ' ') WHEN 7 THEN array_to_string(list_append(sup, 'explicit_entity_signal'), ' ')
    WHEN 8 THEN CASE WHEN nl <> '' AND len(nl) <= 3 AND contains(el, nl) THEN 'short_name_needs_context' ELSE 'official_source_without_name' END WHEN 9 THEN array_to_string(list_append(sup, 'no_entity_name'), ' ') ELSE 'no_entity_context' END AS why,
  CASE rule WHEN 1 THEN mine::VARCHAR WHEN 4 THEN CASE title WHEN 'Moon Nights' THEN 'Moon Nights' ELSE array_to_string(con, ' ') END ELSE '' END AS conflicts, dom AS official_domain, k = ik AS source_linked FROM r"""

ORACLE_SQL["image_types"] = rf"""
WITH {_BOUND},
x AS (SELECT *, CASE WHEN w / ht::DOUBLE >= 3 OR w / ht::DOUBLE <= 1 / 3.0::DOUBLE THEN true ELSE false END AS extreme,
  concat_ws(' ', CASE WHEN page_id % 7 = 0 THEN 'game_match' END, CASE WHEN page_id % 9 = 4 THEN 'steam_app_id' END) AS sig FROM t),
y AS (SELECT *, lower(concat_ws(' ', '/' || stem || '.jpg', sig, alt)) AS near, lower(concat_ws(' ', '/' || stem || '.jpg', p, q, CASE WHEN title IS NOT NULL THEN 'page_title ' || title END, sig, alt)) AS every, split_part(stem, '/', -1) AS last FROM x),
z AS (SELECT *, regexp_matches(every, '{it.GALLERY}') AS gal, regexp_matches(every, '{it.SCENE_NAME}') AS sn, coalesce(alt, '') <> '' AS own, kind = 'official_site' AS site, kind = 'steam' AS steam FROM y),
c AS (SELECT *, own OR (gal AND (sn OR regexp_matches(every, 'event.?cg') OR w / ht::DOUBLE >= 1.15)) OR (sn AND NOT {_terms("every", it.LOGO + it.BANNER + it.GOODS)}) AS cg,
  own OR (regexp_matches(lower(coalesce(title, '')), 'cg') AND contains(lower(title), lower(name))) AS strong FROM z),
r AS (SELECT *, CASE
  WHEN {_terms("near", it.UI)} THEN ['ui', '0.98'] WHEN {_terms("near", it.LOGO)} THEN ['logo', '0.98']
  WHEN {_terms("near", it.BANNER)} OR (extreme AND NOT ({_terms("every", it.GOODS + it.COVER + it.CHARACTER + it.KEY_VISUAL + it.SCREENSHOT + it.PHOTO + it.ANNOUNCEMENT)} OR gal OR sn)) THEN ['banner', CASE WHEN extreme THEN '0.98' ELSE '0.94' END]
  WHEN steam AND regexp_matches(every, '{it.STEAM_SHOT}') THEN ['gameplay_screenshot', '0.93']
  WHEN {_terms("near", it.GOODS)} OR (NOT site AND {_terms("lower(p)", [t for t in it.GOODS if t not in it.STEAM_GOODS])}) THEN ['goods', '0.96']
  WHEN {_terms("near", it.COVER)} THEN ['cover', '0.91'] WHEN {_terms("every", [t for t in it.SCREENSHOT if t not in it.VAGUE_SCREENSHOT])} THEN ['gameplay_screenshot', '0.93']
  WHEN regexp_matches(last, '{it.CHARACTER_STEM}') THEN ['character_art', '0.93']
  WHEN cg AND NOT {_terms("near", it.CHARACTER + it.KEY_VISUAL)} THEN ['game_cg', CASE WHEN strong THEN '0.92' ELSE '0.68' END]
  WHEN {_terms("near", it.CHARACTER)} THEN ['character_art', '0.9'] WHEN {_terms("near", it.KEY_VISUAL)} THEN ['key_visual', '0.92'] WHEN cg THEN ['game_cg', '0.68']
  WHEN {_terms("every", it.PHOTO)} THEN ['photo', '0.9'] ELSE ['unknown', '0'] END AS t FROM c)
SELECT page_id, t[1] AS image_type, t[2]::DOUBLE AS confidence FROM r"""

QUERIES |= {"entity_evidence": entity_evidence, "image_types": image_types, "curated_evidence": curated_evidence}
