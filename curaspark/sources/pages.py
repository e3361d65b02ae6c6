"""Web pages: links, titles and videos by native patterns; images and what surrounds them are in dom.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import urls

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href="([^"]*)\""""), F.lit(1))


def absolute(page_url: Column, link: Column) -> Column:
    """A link seen on a page as a full URL: absolute, scheme-relative, root-relative or relative to the page's folder."""
    root = F.concat(urls.scheme(page_url), F.lit("://"), urls.netloc(page_url))
    folder = F.regexp_replace(urls.path(page_url), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(link.startswith("//"), F.concat(urls.scheme(page_url), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | (link == ""), F.concat(root, urls.path(page_url), link))
        .otherwise(F.concat(root, folder, link))
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, ordinal, link): every href as a full URL, in order."""
    return pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("ordinal", "href")).select("page_id", "url", "ordinal", absolute(F.col("url"), F.col("href")).alias("link"))


def age_gated(html: Column) -> Column:
    return F.regexp_like(html, F.lit(r"(?i)age[-_ ]?(gate|check|verif)|18歳以上|18岁以上|are you (over )?18"))


def video_urls(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<(?:video|source|iframe|a)\b[^>]*?(?:src|href)="([^"]+)\""""), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, urls.canonical_video)))
