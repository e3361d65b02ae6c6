"""Evidence about the images of a page from the elements around them.

A small streaming parser gives one row for each reference to an image: the address, how it is referred to, and the chain of
elements around it, nearest first, each with its words, its text and what a product card needs. What an image is follows
from ordered rules over that chain, as native expressions. A page that cannot be parsed is a failure row.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curaspark.functions import urls
from curaspark.sources.pages import VOID, absolute

LINK = "struct<tag:string,words:string,classes:array<string>,selector:string,text:string,thumb:boolean,label:string,card:boolean,card_text:string,card_item:string>"
REFERENCE = f"page_id long, ordinal int, kind string, raw string, relationship string, alt string, own string, item string, chain array<{LINK}>, tabs map<string,string>, error string"

# The words, tags and attributes that results depend on.
ROOTS = {"html", "body", "head"}
SILENT = {"script", "style", "template"}
IMAGE_ATTRIBUTES = ("data-original", "data-full", "data-large", "data-hires", "data-zoom-image", "src", "data-src", "data-lazy-src")
BACKGROUND_ATTRIBUTES = ("data-background", "data-bg", "data-image")
META_IMAGES = {"og:image", "og:image:url", "twitter:image", "twitter:image:src"}
CARD_CLASSES = re.compile(r"itemListBox|product[-_ ]?(?:card|item|detail)|goods[-_ ]?(?:card|item|detail)", re.I)
CARD_TITLES = {"loop-title", "product-title", "product-card-product-name", "product-name", "goods-title"}
CARD_PRICES = {"price", "woocommerce-Price-amount", "kakaku_list", "product-price-display-value", "product-card-price"}
RELATED = "related|recommend(?:ed|ation)?|upsells|cross-sells"
OWN_ROLES = [
    ("logo", r"(?:^|[\s_-])logo(?:$|[\s_-])|ロゴ"),
    ("character_art", r"(?:^|[\s_-])(?:character|chara|sprite|tachie)(?:$|[\s_-])|立绘|立繪|キャラクター"),
    ("cover", r"(?:^|[\s_-])(?:cover|package|jacket)(?:$|[\s_-])"),
    ("banner", r"(?:^|[\s_-])(?:banner|bnr)(?:$|[\s_-])|横幅|バナー"),
    ("ui", r"(?:^|[\s_-])(?:icon|btn|button|control)(?:$|[\s_-])"),
]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer"]
FRAME_WORDS = "header|footer|nav|navbar|navigation|heading|title"
CONTROL_WORDS = "logo|separator|divider|arrow|control|navigation|navbar"
EXCLUDED_WORDS = "goods|merchandise|character|chara|special|campaign|package|news"
GALLERY_WORDS = "gallery|graphic"
BACKGROUND_LABEL, SCENE_LABEL = "背景|background", "CG|イベント|event|scene"
LOCAL_PARENTS = ["a", "figure", "li", "picture"]
RELATED_TEXT = "推荐商品区域"


class _Page(HTMLParser):
    """The elements of a page in document order: parent, end of the subtree, and the strings inside."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, dict]] = []
        self.parent: list[int] = []
        self.until: list[int] = []
        self.strings: list[str] = []
        self.span: list[list[int]] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.until[i], self.span[i][1] = len(self.tags), len(self.strings)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in reversed(attrs)}))
        self.parent.append(self.open[-1] if self.open else -1)
        self.until.append(len(self.tags))
        self.span.append([len(self.strings), len(self.strings)])
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[depth]][0] == tag:
                return self._end(depth)

    def handle_data(self, data):
        if data.strip() and not (self.open and self.tags[self.open[-1]][0] in SILENT):
            self.strings.append(data.strip())

    def text(self, i: int) -> str:
        return " ".join(" ".join(self.strings[slice(*self.span[i])]).split())[:400]

    def around(self, i: int) -> list[int]:
        out = []
        while i >= 0:
            out.append(i)
            i = self.parent[i]
        return [i for i in out if self.tags[i][0] not in ROOTS]

    def within(self, i: int, test) -> int | None:
        return next((j for j in range(i + 1, self.until[i]) if test(*self.tags[j])), None)

    def count(self, i: int, tag: str) -> int:
        return sum(self.tags[j][0] == tag for j in range(i + 1, self.until[i]))

    def link(self, i: int, labels: dict[str, str], own: bool = False) -> dict:
        tag, a = self.tags[i]
        classes = a.get("class", "").split()
        words = " ".join([a.get("id", ""), *classes])
        out = {"tag": tag, "words": words, "classes": classes, "selector": tag + (f"#{a['id']}" if a.get("id") else "") + "".join(f".{c}" for c in classes), "text": self.text(i) if own or words.strip() or tag in {*HEADINGS, *LOCAL_PARENTS, "button"} else ""}
        opens = a.get("data-target") or a.get("data-bs-target") or a.get("data-modal") or re.search("gallery|thumb", " ".join(classes), re.I)
        out |= {"thumb": tag == "button" and bool(opens) and self.within(i, lambda t, _: t == "img") is not None, "label": labels.get(a.get("id", ""), ""), "card": False, "card_text": "", "card_item": ""}
        if CARD_CLASSES.search(" ".join(classes)) or a.get("itemtype", "").endswith("schema.org/Product"):
            having = lambda words, prop: self.within(i, lambda _, b: b.get("itemprop") == prop or not words.isdisjoint(b.get("class", "").split()))
            title, price, work = having(CARD_TITLES, "name"), having(CARD_PRICES, "price"), having({"c333"}, "\0")
            if title is not None and price is not None:
                to = i if tag == "a" and a.get("href") else self.within(i, lambda t, b: t == "a" and "href" in b)
                path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", self.tags[to][1]["href"]) if to is not None else ""
                path = re.sub(r"[?#].*$", "", re.sub(r"^//[^/?#]*", "", path))
                out |= {"card": True, "card_item": path.strip("/"), "card_text": " ".join(filter(None, [self.text(work) if work is not None else "", self.text(title)]))}
        return out


def _largest(srcset: str) -> str | None:
    """The candidate of the greatest width or density; the first of equal ones."""
    best, weight = None, -1
    for part in srcset.split(","):
        words = part.split()
        if words:
            m = re.fullmatch(r"(\d+)[wx]", words[1]) if len(words) > 1 else None
            if (int(m[1]) if m else 0) > weight:
                best, weight = words[0], int(m[1]) if m else 0
    return best


def _references(page: _Page):
    """(element, kind, address, relationship) of every image that the page refers to, in the order that decides ties."""
    tags = page.tags
    for i, (tag, a) in enumerate(tags):
        href = a.get("href", "") if tag == "a" else ""
        if href and (re.search(r"\.(?:jpe?g|png|webp|gif|avif|bmp)(?:[?#]|$)", href, re.I) or page.count(i, "img") and re.search("gallery|cg|image|media", href.split("?")[0], re.I)):
            yield i, "link", href, "anchor[href]"
    for i, (tag, a) in enumerate(tags):
        if tag == "meta" and (a.get("property") or a.get("name") or "").casefold() in META_IMAGES and a.get("content"):
            yield i, "meta", a["content"], "meta"
    for i, (tag, a) in enumerate(tags):
        if tag != "img":
            continue
        yield from ((i, "image", a[x], f"img[{x}]") for x in IMAGE_ATTRIBUTES if a.get(x))
        yield from ((i, "image", u, f"img[{x}]") for x in ("srcset", "data-srcset") if a.get(x) and (u := _largest(a[x])))
        picture = next((j for j in page.around(i) if tags[j][0] == "picture"), None)
        if picture is not None and page.count(picture, "img") == 1:
            for j in range(picture + 1, page.until[picture]):
                if tags[j][0] == "source":
                    yield from ((i, "image", u, f"picture/source[{x}]") for x in ("srcset", "data-srcset") if tags[j][1].get(x) and (u := _largest(tags[j][1][x])))
    for i, (_, a) in enumerate(tags):
        background = re.search(r"background(?:-image)?\s*:", a.get("style", ""), re.I)
        yield from ((i, "css" if background else "style", u, "CSS background-image") for u in re.findall(r"url\(\s*['\"]?([^'\")]+)", a.get("style", ""), re.I))
    for i, (_, a) in enumerate(tags):
        yield from ((i, "background", a[x], x) for x in BACKGROUND_ATTRIBUTES if a.get(x))


def _rows(page_id: int, html: str) -> list[dict]:
    page = _Page(html)
    labels: dict[str, str] = {}
    tabs: dict[str, str] = {}
    for i, (_, a) in enumerate(page.tags):
        for of in dict.fromkeys([a.get("aria-controls", ""), a.get("href", "").removeprefix("#") if a.get("href", "").startswith("#") else ""]):
            if of:
                labels[of] = " ".join(filter(None, [labels.get(of, ""), page.text(i)]))
        if re.fullmatch(r"g_\d+_bt", a.get("id", "")):
            tabs.setdefault(a["id"], page.text(i))
    out = []
    for ordinal, (i, kind, raw, relationship) in enumerate(_references(page)):
        a = page.tags[i][1]
        own = " ".join([a.get("alt", ""), a.get("id", ""), *a.get("class", "").split()])
        out.append({"page_id": page_id, "ordinal": ordinal, "kind": kind, "raw": raw, "relationship": relationship, "alt": a.get("alt", ""), "own": own, "item": a.get("data-index") or a.get("src") or "", "chain": [page.link(j, labels, j == i) for j in page.around(i)], "tabs": list(tabs.items()), "error": None})
    return out


def references(pages: DataFrame) -> DataFrame:
    """REFERENCE rows of every page (page_id, html), in document order by kind; error rows for pages that cannot be parsed."""
    schema = to_arrow_schema(T._parse_datatype_string(REFERENCE))

    def run(batches):
        for batch in batches:
            for page_id, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = _rows(page_id, html or "")
                except Exception as e:  # one page must not end the others
                    rows = [{"page_id": page_id, "error": type(e).__name__}]
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 256], schema)

    return pages.select("page_id", "html").mapInArrow(run, REFERENCE)


def _words(x: Column, words: str) -> Column:
    return F.regexp_like(x, F.lit(rf"(?i)(?:^|[\s_-])(?:{words})(?:$|[\s_-])"))


def evidence() -> Column:
    """role, container, text and item of a reference by the first rule that holds; null where none does.

    Related products; the image's own words; headings, navigation and controls; a product card with title and price;
    sections of other things; a numbered group with its tab; a gallery.
    """
    chain, alt, own = F.col("chain"), F.col("alt"), F.col("own")
    first = lambda test: F.get(F.filter(chain, test), F.lit(0))
    says = lambda role, of, text, item="": F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), of.alias("container"), F.left(text, F.lit(400)).alias("text"), (F.lit(item) if isinstance(item, str) else item).alias("item"))
    related = first(lambda c: _words(c["words"], RELATED))
    frame = first(lambda c: c["tag"].isin(HEADINGS) | ((c["tag"] == "button") & ~c["thumb"]) | _words(c["words"], FRAME_WORDS) | _words(c["words"], CONTROL_WORDS))
    card = first(lambda c: c["card"])
    excluded = first(lambda c, i: _words(F.concat(c["words"], F.when(i == 0, F.concat(F.lit(" "), alt)).otherwise("")), EXCLUDED_WORDS))
    group = F.get(F.filter(F.flatten(F.transform(chain, lambda c: c["classes"])), lambda x: F.regexp_like(x, F.lit(r"(?i)^group\d+$"))), F.lit(0))
    number = F.regexp_extract(group, r"(\d+)", 1)
    box = first(lambda c: F.array_contains(c["classes"], F.concat(F.lit("gallery_cg_box_"), number)))
    tab = F.coalesce(F.try_element_at("tabs", F.concat(F.lit("g_"), number, F.lit("_bt"))), F.lit(""))
    is_background = lambda x: F.regexp_like(x, F.lit(f"(?i){BACKGROUND_LABEL}"))
    gallery = first(lambda c: _words(c["words"], GALLERY_WORDS))
    parent = F.get(chain, F.lit(1))
    near = F.when(parent["tag"].isin(LOCAL_PARENTS), parent["text"])
    caption = F.coalesce(F.nullif(gallery["label"], F.lit("")), F.nullif(alt, F.lit("")), near, F.lit(""))
    out = F.when(related.isNotNull(), says("decorative", related["selector"], F.lit(RELATED_TEXT)))
    for role, pattern in OWN_ROLES:
        out = out.when(F.regexp_like(own, F.lit(f"(?i){pattern}")), says(role, chain[0]["selector"], own))
    return (
        out.when(frame.isNotNull(), says("decorative", frame["selector"], frame["text"]))
        .when(card.isNotNull(), says("goods", card["selector"], card["card_text"], card["card_item"]))
        .when(excluded.isNotNull(), says("unknown", excluded["selector"], alt))
        .when(box.isNotNull(), says(F.when(is_background(tab), "background_art").when(F.regexp_like(tab, F.lit(f"(?i){SCENE_LABEL}")), "game_cg").otherwise("unknown"), box["selector"], tab, group))
        .when(gallery.isNotNull(), says(F.when(is_background(gallery["label"]), "background_art").otherwise("game_cg"), gallery["selector"], caption, F.col("item")))
    )


def typed(found: DataFrame) -> DataFrame:
    """References with their evidence; a CSS background is decorative unless it belongs to a product card."""
    e = found.where("error is null").withColumn("e", F.when(F.col("kind").isin("image", "css"), evidence()))
    own = F.struct(F.lit("decorative").alias("role"), F.col("chain")[0]["selector"].alias("container"), F.col("chain")[0]["text"].alias("text"), F.lit("").alias("item"))
    return e.withColumn("e", F.when((F.col("kind") == "css") & ~F.coalesce(F.col("e.role") == "goods", F.lit(False)), own).otherwise(F.col("e")))


def image_candidates(pages: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(candidates, failures) of pages (page_id, url, html).

    A candidate is one image address of a page, in its largest form: the first reference decides its place, all evidence is
    gathered. gallery is true where evidence says scene or background art and nothing says another role; excluded names
    that other role. The first `limit` of a page stay, gallery paths first.
    """
    found = references(pages)
    failures = found.where("error is not null").select("page_id", F.lit("collect").alias("stage"), F.lit("adapter_error").alias("code"), F.col("error").alias("message"))
    refs = typed(found).join(pages.select("page_id", "url"), "page_id").withColumn("image_url", urls.upgraded(absolute(F.col("url"), F.col("raw"))))
    refs = refs.where(urls.scheme(F.col("image_url")).isin("http", "https") & urls.looks_like_image(F.col("image_url")))
    by_place = lambda x: F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("ordinal", x.alias("x"))))), lambda s: s["x"])
    c = refs.groupBy("page_id", "image_url").agg(
        F.min("ordinal").alias("ordinal"), F.array_distinct(by_place(F.col("e.role"))).alias("roles"), F.array_distinct(by_place(F.nullif(F.col("alt"), F.lit("")))).alias("alts"),
        F.array_distinct(by_place(F.nullif(F.col("e.text"), F.lit("")))).alias("texts"), F.array_distinct(by_place(F.concat_ws(" via ", "e.container", "relationship"))).alias("sources"),
    )
    other = F.array_sort(F.array_intersect("roles", F.array(*map(F.lit, ["goods", "logo", "character_art", "cover", "ui", "banner"]))))
    excluded = F.when(F.array_contains("roles", "decorative"), "decorative").otherwise(F.get(other, F.lit(0)))
    scene = F.arrays_overlap("roles", F.array(F.lit("game_cg"), F.lit("background_art")))
    c = c.withColumns({"excluded": excluded, "image_alt": F.array_join("alts", " "), "nearby_text": F.array_join("texts", " ")}).withColumn("gallery", scene & F.col("excluded").isNull())
    top = F.array_sort(F.collect_list(F.struct(urls.image_priority(F.col("image_url")).alias("priority"), "ordinal", "image_url", "roles", "excluded", "gallery", "image_alt", "nearby_text", "sources")))
    kept = c.groupBy("page_id").agg(F.slice(top, 1, limit).alias("c"))
    return kept.select("page_id", F.posexplode("c").alias("rank", "x")).select("page_id", (F.col("rank") + 1).alias("rank"), "x.*"), failures


def needs_render(pages: DataFrame) -> DataFrame:
    """(page_id, needs_render): a gallery shell is there, but no scene image inside: scripts must have filled it."""
    found = typed(references(pages))
    scenes = found.where(F.col("kind").isin("image", "css") & F.col("e.role").isin("game_cg", "background_art")).select("page_id").distinct().withColumn("filled", F.lit(True))
    html = F.col("html")
    has = lambda pattern: F.regexp_like(html, F.lit(f"(?i){pattern}"))
    shell = has(r"\bid=[\"']?(?:galleryPreview|galleryThumbnailTrack)\b") | has(r"\bid=[\"']?gallery_cg_box_") | has(r"\bclass=[\"'][^\"']*gallery_cg_box")
    loose = (has(r"\bdata-gallery\b") | has(r"\bclass=[\"'](?:[^\"']*\s)?gallery(?:\s[^\"']*)?[\"']") | has(r"\bid=[\"']?gallery\b")) & has("<script")
    return pages.join(scenes, "page_id", "left").select("page_id", (F.coalesce(shell | loose, F.lit(False)) & F.col("filled").isNull()).alias("needs_render"))
