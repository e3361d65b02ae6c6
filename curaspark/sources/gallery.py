"""Image lists that a page's gallery script states outright. Nothing is evaluated: a script that computes its list gives none.

Two shapes count: a list literal of texts or objects, and a counted list whose entries are templates of a number. They count
where the page has the places that the script fills, in one gallery.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark.functions import urls
from curaspark.sources.dom import _Page
from curaspark.sources.pages import absolute

ENTRY = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("image", T.StringType()), T.StructField("thumbnail", T.StringType())]))
# A longer list, or a larger literal, is no gallery; the members that hold an image, in order; the places that are filled.
MOST, MOST_BYTES = 500, 256_000
MEMBERS = ("preview", "image", "src", "url")
TRACK, PREVIEW = "galleryThumbnailTrack", "galleryPreview"


def _closing(script: str, at: int) -> int | None:
    """Where the bracket at a place is closed; texts and templates are skipped as wholes."""
    pairs, open_, quote = {"[": "]", "{": "}", "(": ")"}, [], ""
    while at < len(script):
        c = script[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in pairs:
            open_.append(pairs[c])
        elif c in ")]}":
            if not open_ or open_.pop() != c:
                return None
            if not open_:
                return at
        at += 1
    return None


def _assigned(script: str, name: str, opening: str) -> str | None:
    """The bracketed text that a variable is set to."""
    m = re.search(rf"(?:const|let|var)\s+{name}\s*=\s*(?={re.escape(opening)})", script)
    end = _closing(script, m.end() + len(opening) - 1) if m else None
    return script[m.end() : end + 1] if end is not None and re.match(r"\s*;", script[end + 1 :]) else None


def listed(script: str) -> list[dict]:
    """Entries of `images = [...]`: JSON, or literals with bare member names."""
    literal = _assigned(script, "images", "[")
    if literal is None or len(literal) > MOST_BYTES:
        return []
    try:
        value = json.loads(literal)
    except ValueError:
        try:
            value = ast.literal_eval(re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)\s*:", r"\1'\2':", literal))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
    return [x if isinstance(x, dict) else {"preview": x} for x in value if isinstance(x, (dict, str))] if len(value) <= MOST else []


def counted(script: str) -> list[dict]:
    """Entries of `images = Array.from({ length: imageCount }, (_, index) => {...})` with templates of index + 1."""
    count = re.search(r"(?:const|let|var)\s+imageCount\s*=\s*(\d+)\s*;", script)
    body = _assigned(script, "images", "Array.from(") or _assigned(script, "images", "Array.from (")
    head = re.match(r"Array\.from\s*\(\s*\{\s*length\s*:\s*imageCount\s*\}\s*,\s*\(\s*_\s*,\s*index\s*\)\s*=>\s*\{", body or "")
    if not count or not head or not 1 <= int(count[1]) <= MOST:
        return []
    body = body[head.end() :]
    returned = re.search(r"\breturn\s*\{", body)
    end = _closing(body, returned.end() - 1) if returned else None
    if end is None or not re.search(r"\bindex\s*\+\s*1\b", body) or len(re.findall(r"\bnumber\s*=(?!=)", body)) > 1:
        return []
    members = {k: t for k, t in re.findall(r"\b([A-Za-z_$][\w$]*)\s*:\s*`([^`]{1,500})`", body[returned.end() : end]) if "${" in t}
    if any("${number}" in t.replace(" ", "") for t in members.values()) and not re.search(r"(?:const|let|var)\s+number\s*=\s*index\s*\+\s*1\s*;", body):
        return []
    made = ({k: re.sub(r"\$\{\s*(?:number|index\s*\+\s*1)\s*\}", str(n), t) for k, t in members.items()} for n in range(1, int(count[1]) + 1))
    return [{k: v for k, v in entry.items() if "${" not in v} for entry in made] if members else []


@F.pandas_udf(ENTRY)
def _entries(scripts: pd.Series) -> pd.Series:
    def entries(script):
        script = script or ""
        if TRACK.lower() not in script.lower() or PREVIEW.lower() not in script.lower():
            return []
        found = enumerate(counted(script) or listed(script), 1)
        text = lambda x: x if isinstance(x, str) else None
        return [{"position": i, "image": image, "thumbnail": text(x.get("thumbnail"))} for i, x in found if (image := next((x[m] for m in MEMBERS if isinstance(x.get(m), str)), None))]

    return scripts.map(entries)


@F.pandas_udf(T.BooleanType())
def _linked(pages: pd.Series) -> pd.Series:
    def linked(html):
        page = _Page(html or "")
        at = [next((i for i, (_, a) in enumerate(page.tags) if a.get("id") == name), None) for name in (TRACK, PREVIEW)]
        if None in at:
            return False
        common = set(page.around(at[0])[1:]) & set(page.around(at[1])[1:])
        return any("gallery" in f"{page.tags[i][1].get('id', '')} {page.tags[i][1].get('class', '')}".lower() for i in common)

    return pages.map(linked)


def gallery_images(scripts: DataFrame) -> DataFrame:
    """(page_id, position, image_url, thumbnail_url) of scripts (page_id, url, html, script): http addresses, each once a script, first wins."""
    found = scripts.select("page_id", "url", "html", "script", _entries("script").alias("entries")).where(F.size("entries") > 0).where(_linked("html"))
    web = lambda x: F.when(urls.scheme(x).isin("http", "https"), x)
    each = F.transform("entries", lambda e: F.struct(web(absolute(F.col("url"), e["image"])).alias("image_url"), e["position"].alias("position"), web(absolute(F.col("url"), e["thumbnail"])).alias("thumbnail_url")))
    kept = F.filter(each, lambda e: e["image_url"].isNotNull())
    links = F.transform(kept, lambda e: e["image_url"])
    first: Column = F.filter(kept, lambda e, i: F.array_position(links, e["image_url"]) == i + 1)
    return found.select("page_id", F.inline(first)).select("page_id", "position", "image_url", "thumbnail_url")
