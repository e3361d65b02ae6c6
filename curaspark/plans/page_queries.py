"""Images of pages by the elements around them. The tables' pages have no images, so each gets one from a template of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.operators.classify import rules
from curaspark.sources import dom, gallery
from curaspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# What stands before a page's own HTML, by page_id % 9; # is the page's number.
IMAGE = "https://img.example/cg/#-300x200.jpg"
TEMPLATES = [
    f'<div class="gallery"><a href="https://img.example/cg/#.jpg"><img src="{IMAGE}" alt="scene #"></a></div>',
    f'<ul id="list-related"><li class="gallery"><img src="{IMAGE}"></li></ul>',
    f'<div class="product-card"><img src="{IMAGE}"><p class="product-name">Mug #</p><i class="price">9</i></div>',
    f'<header><div class="gallery">Top # <img src="{IMAGE}"></div></header>',
    f'<a id="g_#_bt">背景 #</a><div class="gallery_cg_box_#"><a class="group#"><img data-src="{IMAGE}" alt="CG"></a></div>',
    f'<div class="gallery"><img srcset="https://img.example/x.jpg 200w, {IMAGE} 800w" alt="ロゴ"></div>',
    f'<section id="news"><div class="gallery"><img src="{IMAGE}" alt="n #"></div></section>',
    f"<div style=\"background: url('{IMAGE}')\">Sea #</div>",
    f'<picture><source data-srcset="{IMAGE}"><img alt="free #"></picture>',
]


def illustrated(spark: SparkSession, d: str) -> DataFrame:
    pages, i = table(spark, d, "pages"), F.col("page_id")
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (i % len(TEMPLATES) + 1).cast("int"))
    return pages.select("page_id", "url", F.concat(F.replace(template, F.lit("#"), i.cast("string")), F.coalesce("html", F.lit(""))).alias("html"))


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """Image candidates of pages: address, roles by the rules in order, what excludes it, whether a gallery shows it, its words."""
    found, _ = dom.image_candidates(illustrated(spark, d))
    return found.select("page_id", "rank", "image_url", F.array_join("roles", " ").alias("roles"), "excluded", F.coalesce("gallery", F.lit(False)).alias("gallery"), "image_alt", "nearby_text")


def page_needs_render(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a gallery's shell and no scene in it."""
    i = F.col("page_id")
    shell = rules((i % 3 == 0, '<div class="gallery"></div>'), (i % 3 == 1, '<div class="big gallery"><img src="/a.jpg"></div>'), otherwise='<div class="gallery-note"></div>')
    return dom.needs_render(table(spark, d, "pages").select("page_id", F.concat(shell, F.coalesce("html", F.lit(""))).alias("html")))


# Gallery scripts by page_id % 4: counted, listed, listed for a page without the places, computed.
SHOW = "show(galleryThumbnailTrack, galleryPreview);"
SCRIPTS = [
    "const imageCount = @;\nconst images = Array.from({ length: imageCount }, (_, index) => {\n const number = index + 1;\n return { preview: `https://img.example/#/${number}.jpg`, thumbnail: `https://img.example/t/${index + 1}.png` };\n});" + SHOW,
    "const images = [{preview: 'https://img.example/#.jpg'}, 'https://img.example/#].jpg', {src: 'https://img.example/#.jpg'}, {src: 'https://img.example/s.jpg', thumbnail: 'data:x'}];" + SHOW,
    "const images = ['https://img.example/#.jpg'];" + SHOW,
    "const images = load('https://img.example/#.jpg');" + SHOW,
]
PLACES = '<div class="big-gallery"><p><img id="galleryPreview"></p><ul id="galleryThumbnailTrack"></ul></div>'


def gallery_images(spark: SparkSession, d: str) -> DataFrame:
    """Images that gallery scripts list outright, for pages that have the places for them."""
    i = F.col("page_id")
    script = F.replace(F.replace(F.element_at(F.array(*map(F.lit, SCRIPTS)), (i % 4 + 1).cast("int")), F.lit("#"), i.cast("string")), F.lit("@"), (i % 3 + 1).cast("string"))
    html = F.concat(F.when(i % 4 == 2, '<img id="galleryPreview"><ul id="galleryThumbnailTrack"></ul>').otherwise(PLACES), F.coalesce("html", F.lit("")))
    return gallery.gallery_images(table(spark, d, "pages").select("page_id", "url", html.alias("html"), script.alias("script")))


QUERIES["gallery_images"] = gallery_images
ORACLE_SQL["gallery_images"] = """
WITH c AS (SELECT page_id, unnest(range(1, page_id % 3 + 2)) AS n FROM pages WHERE page_id % 4 = 0)
SELECT page_id, n::INTEGER AS position, 'https://img.example/' || page_id || '/' || n || '.jpg' AS image_url, 'https://img.example/t/' || n || '.png' AS thumbnail_url FROM c
UNION ALL SELECT page_id, k, CASE k WHEN 1 THEN 'https://img.example/' || page_id || '.jpg' WHEN 2 THEN 'https://img.example/' || page_id || '].jpg' ELSE 'https://img.example/s.jpg' END, NULL
FROM pages, (SELECT unnest([1, 2, 4]) AS k) WHERE page_id % 4 = 1"""
QUERIES["page_images"] = page_images
ORACLE_SQL["page_images"] = """
WITH p AS (SELECT page_id, page_id % 9 AS k, page_id::VARCHAR AS n FROM pages),
r AS (SELECT *, ['game_cg', 'decorative', 'goods', 'decorative', 'background_art', 'logo', 'unknown', 'decorative', ''][k + 1] AS roles FROM p),
x AS (SELECT page_id, 1 AS rank, 'https://img.example/cg/' || n || '.jpg' AS image_url, roles, CASE WHEN roles IN ('decorative', 'goods', 'logo') THEN roles END AS excluded, roles IN ('game_cg', 'background_art') AS gallery,
  ['scene ' || n, '', '', '', 'CG', 'ロゴ', 'n ' || n, '', 'free ' || n][k + 1] AS image_alt,
  ['scene ' || n, '推荐商品区域', 'Mug ' || n, 'Top ' || n, '背景 ' || n, 'ロゴ ', 'n ' || n, 'Sea ' || n, ''][k + 1] AS nearby_text FROM r)
SELECT * FROM x"""
QUERIES["page_needs_render"] = page_needs_render
ORACLE_SQL["page_needs_render"] = "SELECT page_id, page_id % 3 = 0 AS needs_render FROM pages"
