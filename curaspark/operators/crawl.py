"""A bounded crawl over links that are known beforehand (frozen pages), breadth first, with budgets that act inside each level.

The sequential rule: pages wait in the order in which they were found; opening one costs a page, finding a child costs a
source; a child is taken while both budgets are left after the page is paid, and each address once per root. Here a level is
one join of all roots' frontiers with their links: places in the order decide which pages are opened and which children are
taken, so no root is walked page by page. A root's frontier is never longer than its source budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.functions import text, urls
from curaspark.session import dropped, written

# Words of gallery routes, labels that stand for frames and data, and media files, which are no pages.
GALLERY_ROUTE = ["gallery", "graphic", "/cg", "cg/", "ギャラリー", "画像一覧"]
GALLERY_LABEL = ["gallery", "graphic", "ギャラリー", "画像一覧", "cg"]
SYNTHETIC = ["gallery data link", "gallery iframe", "gallery modal"]
CHAPTER_LABEL = r"(?i)chapter\s*[:：#-]?\s*\d+|第\s*\d+\s*章"
MEDIA = r"(?i)\.(?:jpe?g|png|webp|gif|avif|bmp|svg|mp4|webm|m3u8)$"
LEADING_CHAPTER, LEADING_PART, TRAILING_CHAPTER = r"(?i)^chapter\s*[:#：-]?\s*\d+\s*[:：-]?\s*", r"^(?:第\s*)?\d+\s*(?:章|話)\s*[:：-]?\s*", r"(?i)\s+chapter\s*[:#：-]?\s*\d+\b.*$"
ALIAS_LETTERS = 4


def _any(x: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(x, F.lit(w)), words, F.lit(False))


def portal_aliases(names: Column) -> Column:
    """Keys under which a site may label a work's portal: the name, and its parent where it names a chapter."""
    plain = F.transform(names, lambda n: text.squash(F.lower(n)))
    variants = F.flatten(F.transform(plain, lambda n: F.array(n, F.regexp_replace(F.regexp_replace(n, LEADING_CHAPTER, ""), LEADING_PART, ""), F.regexp_replace(n, TRAILING_CHAPTER, ""))))
    return F.array_distinct(F.filter(F.transform(variants, lambda n: text.portal_key(n, False)), lambda k: F.char_length(k) >= ALIAS_LETTERS))


def link_policy(page: Column, target: Column, label: Column, names: Column) -> tuple[Column, Column]:
    """Whether a link of an item's page may be followed: from the entry page, and from a page below it.

    Galleries of the same host, the portal that bears the work's name, and numbered chapters inside the portal's own
    product folder. From an entry page of a named work only its portal, or from other than a homepage its galleries.
    """
    same = urls.host(page) == urls.host(target)
    media = F.regexp_like(urls.path(target), F.lit(MEDIA))
    route = F.lower(F.concat_ws(" ", urls.path(target), urls.query(target), urls.fragment(target)))
    low = F.lower(label)
    by_route = _any(route, GALLERY_ROUTE)
    gallery = same & ((urls.query(target) == "") | by_route) & (by_route | (~label.isin(SYNTHETIC) & _any(low, GALLERY_ROUTE)))
    aliases = portal_aliases(names)
    portal = F.arrays_overlap(portal_aliases(F.array(label)), aliases)
    folder = F.concat(F.regexp_replace(F.regexp_replace(urls.path(page), "[^/]*$", ""), "/+$", ""), F.lit("/"))
    chapter = same & F.regexp_like(label, F.lit(CHAPTER_LABEL)) & F.contains(folder, F.lit("/product/")) & F.startswith(urls.path(target), folder) & (urls.query(target) == "")
    inner = ~media & (gallery | (same & portal) | chapter)
    home = urls.path(page).isin("", "/")
    entry = inner & ((F.size(aliases) == 0) | portal | (_any(low, GALLERY_LABEL) & ~home))
    return F.coalesce(entry, F.lit(False)), F.coalesce(inner, F.lit(False))


def crawl(roots: DataFrame, links: DataFrame, depth: int = 3, pages: int = 16, sources: int = 16) -> DataFrame:
    """(root, place, node, level, parent, chain): what is found from each root, in order; chain: the way from the root to the parent.

    roots: root. links: src, dst, ordinal (order on the page), and optionally entry and inner (booleans: may be followed
    from a root, from below one). Repeated links count once, at their first place; nulls are no links.
    """
    spark = roots.sparkSession
    for name in ("entry", "inner"):
        links = links if name in links.columns else links.withColumn(name, F.lit(True))
    links = links.where("src is not null and dst is not null")
    kind = links.schema["dst"].dataType
    level = roots.where("root is not null").select("root").distinct().select("root", F.lit(1).alias("place"), F.col("root").cast(kind).alias("node"), F.array().cast("array<" + kind.simpleString() + ">").alias("chain"), F.lit(0).alias("opened"), F.lit(0).alias("found"))
    seen = level.select("root", "node")
    out, paths = None, []
    for at in range(1, depth + 1):
        follow = links.where("entry") if at == 1 else links.where("inner")
        # the page that empties the budget gives no children
        steps = level.where(F.col("opened") + F.col("place") < pages).join(follow, level["node"] == follow["src"])
        first = steps.groupBy("root", F.col("dst").alias("node")).agg(F.min_by(F.struct("src", "chain", "opened", "found"), F.struct("place", "ordinal")).alias("x"), F.min(F.struct("place", "ordinal")).alias("o"))
        new = first.join(seen, ["root", "node"], "left_anti").select("root", "node", "x.*", "o")
        ranked = new.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("o", "node"))).where(F.col("found") + F.col("place") <= sources)
        taken, path = written(ranked.select("root", "place", "node", F.col("src").alias("parent"), F.array_append("chain", F.col("src")).alias("chain"), "found", "opened"), "crawl")
        rows = taken.select("root", (F.col("found") + F.col("place")).alias("place"), "node", F.lit(at).alias("level"), "parent", "chain")
        out = rows if out is None else out.unionByName(rows)
        paths.append(path)
        if at == depth or not taken.limit(1).count():
            break
        # pages of this level that were opened, or that the source budget kept shut, are paid before the next level's
        paid = level.groupBy("root").agg(F.max("place").alias("width"))
        total = taken.groupBy("root").agg(F.max("place").alias("more"))
        level = taken.join(paid, "root").join(total, "root").select("root", "place", "node", "chain", (F.col("opened") + F.col("width")).alias("opened"), (F.col("found") + F.col("more")).alias("found"))
        level = level.where(F.col("found") < sources)
        seen = seen.unionByName(taken.select("root", "node"))
    result, _ = written(out.select("root", "place", "node", "level", "parent", "chain"), "crawled")
    for path in paths:
        dropped(spark, path)
    return result
