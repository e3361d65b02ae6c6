"""How the engine's relations are bound to the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.operators import classify, selection
from curaspark.sources.tables import table

KINDS = {"en": "game_cg", "fr": "gameplay_screenshot", "de": "key_visual", "es": "character_art"}
ORIGINS = ["official_site", "official_x", "steam", "direct_image", "unverified"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """documents with labels as candidates: source is the item, lang the type, n_chars the size."""
    n, i = F.col("n_chars"), F.col("doc_id")
    kind = classify.rules(*[(F.col("lang") == k, v) for k, v in KINDS.items()], otherwise="unknown")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        F.col("source").alias("item_id"), i.alias("candidate_id"), kind.alias("image_type"),
        F.element_at(F.array(*map(F.lit, ORIGINS)), (i % 5 + 1).cast("int")).alias("source_type"),
        (200 + n % 1400).cast("int").alias("width"), (150 + (n * 7) % 900).cast("int").alias("height"),
        ((i % 101) / F.lit(100.0)).alias("detail"), (i % 17 == 0).alias("x_photo"), (F.coalesce("quality", F.lit(1)) == 1).alias("auto_select"),
        F.when(i % 4 == 0, True).when(i % 4 == 1, False).alias("entity_match"),
        (i % 11 == 0).alias("fallback_only"), (i % 13 == 0).alias("localized"), F.sha2("text", 256).alias("sha256"), F.col("quality").alias("label_quality"), "toxic",
        F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(None).cast("double").alias("officiality"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    base = selection.relevance(F.array().cast("array<double>"), F.col("candidate_id") % 3 == 0, F.col("source_type"))
    return selection.score(c.withColumns({"base_relevance": base, "type_match": classify.type_match(F.array(F.lit("generic")), F.col("image_type"))}))


CANDIDATES = """
cand AS (SELECT d.source AS item_id, d.doc_id AS candidate_id,
  CASE d.lang WHEN 'en' THEN 'game_cg' WHEN 'fr' THEN 'gameplay_screenshot' WHEN 'de' THEN 'key_visual' WHEN 'es' THEN 'character_art' ELSE 'unknown' END AS image_type,
  ['official_site','official_x','steam','direct_image','unverified'][d.doc_id % 5 + 1] AS source_type,
  CAST(200 + d.n_chars % 1400 AS INTEGER) AS width, CAST(150 + (d.n_chars * 7) % 900 AS INTEGER) AS height, (d.doc_id % 101) / 100.0::DOUBLE AS detail,
  d.doc_id % 17 = 0 AS x_photo, coalesce(l.quality, 1) = 1 AS auto_select, CASE d.doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS entity_match,
  d.doc_id % 11 = 0 AS fallback_only, d.doc_id % 13 = 0 AS localized, sha256(d.text) AS sha256, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SCORED = (
    CANDIDATES
    + """,
sc0 AS (SELECT *, CASE WHEN candidate_id % 3 = 0 AND source_type = 'official_site' THEN 0.65::DOUBLE WHEN source_type IN ('official_site','official_x') THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS base_relevance,
  CASE image_type WHEN 'game_cg' THEN 0.9::DOUBLE WHEN 'gameplay_screenshot' THEN 0.8::DOUBLE WHEN 'key_visual' THEN 0.6::DOUBLE WHEN 'unknown' THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS type_match,
  CASE source_type WHEN 'official_site' THEN 1.0::DOUBLE WHEN 'official_x' THEN 0.9::DOUBLE WHEN 'steam' THEN 0.85::DOUBLE WHEN 'direct_image' THEN 0.65::DOUBLE ELSE 0.25::DOUBLE END AS trust,
  0.7::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, width / 1280.0::DOUBLE, height / 720.0::DOUBLE)) + 0.3::DOUBLE * detail AS quality_score FROM cand),
sc1 AS (SELECT *, CASE WHEN fallback_only THEN greatest(0.0::DOUBLE, type_match - 0.25::DOUBLE) ELSE type_match END AS type_score FROM sc0),
sc2 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE * base_relevance + 0.45::DOUBLE * type_score)) AS relevance FROM sc1),
scored AS (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 * (0.5::DOUBLE * relevance + 0.2::DOUBLE * trust + 0.3::DOUBLE * quality_score))) + 1e-9::DOUBLE, 6) AS total FROM sc2)"""
)

ALLOCATED = (
    SCORED
    + """,
lim AS (SELECT *, CASE WHEN x_photo THEN 20 WHEN localized AND image_type = 'gameplay_screenshot' THEN 20 WHEN image_type = 'game_cg' THEN 20 WHEN image_type = 'gameplay_screenshot' THEN 10 WHEN image_type = 'key_visual' THEN 1 WHEN image_type = 'character_art' THEN 4 ELSE 0 END AS lim FROM scored),
el AS (SELECT *, auto_select AND lim > 0 AS eligible FROM lim),
pl AS (SELECT *, eligible AND (NOT fallback_only OR NOT max(eligible AND NOT fallback_only) OVER (PARTITION BY item_id)) AS in_play FROM el),
tr AS (SELECT *, row_number() OVER (PARTITION BY item_id, image_type, in_play ORDER BY x_photo DESC, localized DESC, image_type = 'background_art', total DESC, trust DESC, width::BIGINT * height DESC, candidate_id) AS type_rank FROM pl),
wi AS (SELECT *, in_play AND (x_photo OR type_rank <= lim) AS within FROM tr),
sl AS (SELECT *, row_number() OVER (PARTITION BY item_id, within ORDER BY x_photo DESC, localized DESC, image_type = 'background_art', total DESC, trust DESC, width::BIGINT * height DESC, candidate_id) AS slot FROM wi),
alloc AS (SELECT *, within AND slot <= 20 AS selected FROM sl)"""
)

URL_PARTS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
URLS = rf"""
u AS (SELECT page_id, url, html, lower(regexp_extract(url, {URL_PARTS}, 1)) AS s, lower(regexp_extract(url, {URL_PARTS}, 2)) AS n,
  regexp_extract(url, {URL_PARTS}, 3) AS p, regexp_extract(url, {URL_PARTS}, 4) AS q, regexp_extract(url, {URL_PARTS}, 5) AS f FROM pages),
uu AS (SELECT *, regexp_replace(n, ':[0-9]*$', '') AS h, s || '://' || n || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS norm FROM u)"""
